"""Resampling plans: each row's fold as a column, never a copy of the rows for each fold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.digests import Ordered, digest_sums, ordered, ordered_digest, row_hash
from foldwise.functions.hashing import RANK_DOMAIN, rank_state, signed, with_finalized, with_rank
from foldwise.operators.state import checkpoint, global_position, skew_join
from foldwise.sources.rows import DataError, Rows, require_unique

#: Most different group sizes whose turns are broadcast; more are joined by a shuffle.
BROADCAST_SIZES = 20_000


@dataclass(frozen=True)
class Plan:
    """Rows with a `fold` column. Complete plans assess each row exactly once; only these may cross-fit."""

    rows: Rows
    folds: int
    complete: bool = True

    def analysis(self, fold: int) -> Rows:
        return self.rows.with_df(self.rows.df.where(F.col("fold") != fold))

    def assessment(self, fold: int) -> Rows:
        return self.rows.with_df(self.rows.df.where(F.col("fold") == fold))

    def sizes(self) -> DataFrame:
        return self.rows.df.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))

    def fingerprints(self) -> dict[int, Ordered]:
        """The digest of each fold's row ids in ascending order: one sort of (fold, id) and one aggregate for all folds."""
        i = self.rows.row_id
        at = global_position(self.rows.df.select("fold", i), [F.col("fold"), F.col(i)])
        return {r["fold"]: ordered(r) for r in at.groupBy("fold").agg(*digest_sums(row_hash(F.col(i)), F.col("pos"))).collect()}


def _checked(rows: Rows, k: int) -> int:
    if k < 2:
        raise DataError("InvalidFoldCount", str(k))
    n = require_unique(rows.df, rows.row_id)
    if n < k:
        raise DataError("TooFewRows", f"{n} for {k} folds")
    return n


def _joined(rows: Rows, assigned: DataFrame, k: int) -> Plan:
    return Plan(rows.with_df(checkpoint(rows.df.join(assigned, rows.row_id))), k)


def k_fold(rows: Rows, k: int, seed: int | None = None) -> Plan:
    """Fold = position modulo k, in the order of the seeded hash of the id, or of the id itself without a seed."""
    _checked(rows, k)
    ids = rows.df.select(F.col(rows.row_id).cast("long").alias(rows.row_id))
    order = [F.col(rows.row_id)]
    if seed is not None:
        ids = with_finalized(ids, F.col(rows.row_id).bitwiseXOR(F.lit(signed(seed)).cast("long")), "_h")
        order = [F.col("_h"), F.col(rows.row_id)]
    at = global_position(ids, order)
    return _joined(rows, at.select(rows.row_id, F.pmod("pos", F.lit(k)).cast("int").alias("fold")), k)


def group_sizes(rows: Rows) -> DataFrame:
    """(group, n, first): rows of each group and its least row id, which stands for its first position."""
    return rows.df.groupBy(F.col(rows.group).alias("group")).agg(F.count(F.lit(1)).alias("n"), F.min(rows.row_id).cast("long").alias("first"))


def packing(classes: list[tuple[int, int]], k: int) -> list[tuple[int, list[int], list[list[int]]]]:
    """Where the greedy packing puts the groups of each size: (size, starts, orders), of classes (size, groups), the largest size first.

    From position starts[i] on, counted over all classes, the groups go round the folds of orders[i]. The greedy order within
    a class is the merge of the progressions (load + j * size, fold): the folds less than one group above the least loaded
    take turns, in the order of load and fold, until the least of the others is as near; so a class has k such phases at most.
    """
    loads, at, out = [0] * k, 0, []
    for size, many in classes:
        starts, orders = [], []
        while many:
            by_load = sorted(range(k), key=lambda f: (loads[f], f))
            least = loads[by_load[0]]
            turn = [f for f in by_load if loads[f] < least + size]
            rounds = many // len(turn)
            if len(turn) < k:
                rounds = min(rounds, (loads[by_load[len(turn)]] - least) // size)
            dealt = rounds * len(turn) or many  # less than a round is left
            starts.append(at)
            orders.append(turn)
            for place, f in enumerate(turn):
                loads[f] += size * (dealt // len(turn) + (place < dealt % len(turn)))
            at, many = at + dealt, many - dealt
        out.append((size, starts, orders))
    return out


def grouped_k_fold(rows: Rows, k: int, seed: int, domain: str = RANK_DOMAIN) -> Plan:
    """Whole groups to folds: the largest group first (ties by the rank of its first row, then that row), always to the smallest fold.

    However many groups there are, the result is that of packing them one by one. The driver gets one count for each
    different size (fewer than the square root of twice the rows) and works out who takes turns (see `packing`); a group's
    fold follows from its position in the order.
    """
    if not rows.group:
        raise DataError("NoGroup")
    _checked(rows, k)
    groups = checkpoint(with_rank(group_sizes(rows), "first", rank_state(rows.fingerprint, seed, domain)))
    classes = sorted(((r["n"], r["many"]) for r in groups.groupBy("n").agg(F.count(F.lit(1)).alias("many")).collect()), reverse=True)
    many = sum(n for _, n in classes)
    if many < k:
        raise DataError("TooFewGroups", f"{many} for {k} folds")
    turns = rows.df.sparkSession.createDataFrame(packing(classes, k), "n long, starts array<long>, orders array<array<int>>")
    at = global_position(groups.select("group", "n", "rank", "first"), [F.desc("n"), F.col("rank"), F.col("first")])
    at = at.join(F.broadcast(turns), "n") if len(classes) <= BROADCAST_SIZES else skew_join(at, turns, ["n"])
    phase = F.size(F.filter("starts", lambda x: x <= F.col("pos")))
    turn = F.element_at("orders", phase)
    fold = F.element_at(turn, (F.pmod(F.col("pos") - F.element_at("starts", phase), F.size(turn)) + 1).cast("int"))
    of_group = at.select(F.col("group").alias("_g"), fold.alias("fold"))
    joined = rows.df.join(of_group, rows.df[rows.group].eqNullSafe(of_group["_g"])).drop("_g")
    return Plan(rows.with_df(checkpoint(joined)), k)


def group_labels(rows: Rows) -> DataFrame:
    """(group, label): dense codes of the groups by the order of their first rows."""
    at = global_position(group_sizes(rows).select("group", "first"), [F.col("first")], "label")
    return at.select("group", "label")


def rolling_origin(rows: Rows, initial: int, assess: int, step: int) -> tuple[DataFrame, DataFrame]:
    """Time-ordered windows: (rows with pos, folds).

    Fold i assesses positions [start, min(start + assess, n)) with start = initial + i * step, and analyses all before start.
    The folds are a range each, so that analysis rows are a predicate on `pos`. Not complete: it can't cross-fit.
    """
    if min(initial, assess, step) < 1:
        raise DataError("InvalidWindow")
    if not rows.time:
        raise DataError("NoTime")
    n = require_unique(rows.df, rows.row_id)
    if n <= initial:
        raise DataError("TooFewRows", f"{n} for an initial window of {initial}")
    at = global_position(rows.df, [F.col(rows.time), F.col(rows.row_id)])
    many = (n - initial + step - 1) // step
    start = F.col("fold") * step + initial
    folds = rows.df.sparkSession.range(many).select(F.col("id").cast("int").alias("fold"))
    folds = folds.select("fold", F.lit(0).cast("long").alias("analysis_from"), start.cast("long").alias("start"), F.least(start + assess, F.lit(n)).cast("long").alias("end"))
    return at, folds


@dataclass(frozen=True)
class RollingPlan:
    """A plan of time-ordered windows over rows with their position `pos`: fold i analyses all rows before its start and assesses those up to its end.

    Rows before the first start are never assessed, others maybe more than once, so that it isn't complete: nothing may cross-fit by it.
    """

    rows: Rows
    n: int
    initial: int
    assess: int
    step: int
    complete: bool = False

    @property
    def folds(self) -> int:
        return (self.n - self.initial + self.step - 1) // self.step

    def ranges(self) -> list[tuple[int, int, int]]:
        """(fold, start, end) of each fold."""
        starts = ((i, self.initial + i * self.step) for i in range(self.folds))
        return [(i, start, min(start + self.assess, self.n)) for i, start in starts]

    def _range(self, fold: int) -> tuple[int, int]:
        if not 0 <= fold < self.folds:
            raise DataError("InvalidFold", str(fold))
        start = self.initial + fold * self.step
        return start, min(start + self.assess, self.n)

    def analysis(self, fold: int) -> Rows:
        return self.rows.with_df(self.rows.df.where(F.col("pos") < self._range(fold)[0]))

    def assessment(self, fold: int) -> Rows:
        start, end = self._range(fold)
        return self.rows.with_df(self.rows.df.where((F.col("pos") >= start) & (F.col("pos") < end)))

    def block_of(self, pos: int) -> int:
        """The block of a position: how many windows begin at or before it, and how many end there."""
        return max(0, (pos - self.initial) // self.step + 1) + max(0, (pos - self.initial - self.assess) // self.step + 1)

    def block(self, pos: Column) -> Column:
        """The same as a column."""
        until = lambda first: F.greatest(F.lit(0).cast("long"), F.floor((pos - first) / self.step) + 1)
        return until(self.initial) + until(self.initial + self.assess)


def rolling_plan(rows: Rows, initial: int, assess: int, step: int) -> RollingPlan:
    """The plan of `rolling_origin` with analysis and assessment rows; rows are ordered by time, ties by id, and written once."""
    at, _ = rolling_origin(rows, initial, assess, step)
    return RollingPlan(rows.with_df(at), at.count(), initial, assess, step)


def rolling_assessment(at: DataFrame, row_id: str, initial: int, assess: int, step: int) -> DataFrame:
    """(row id, fold) of every assessed row: a row's folds follow from its position, without a join."""
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - initial - assess + 1) / step))
    last = F.floor((F.col("pos") - initial) / step)
    return at.where(F.col("pos") >= initial).where(last >= first).select(row_id, F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("fold"))


def bound(rows: Rows, assignment: DataFrame, k: int) -> Plan:
    """A plan from outside: (row id, fold) must cover every row exactly once with folds 0 to k - 1."""
    n = require_unique(rows.df, rows.row_id)
    r = assignment.agg(F.count(F.lit(1)).alias("n"), F.min("fold").alias("low"), F.max("fold").alias("high"), F.count_if(F.col("fold").isNull()).alias("null")).first()
    if r["null"] or r["low"] is None or r["low"] < 0 or r["high"] >= k:
        raise DataError("InvalidFold")
    require_unique(assignment, rows.row_id)
    if r["n"] != n or rows.df.join(assignment, rows.row_id, "left_anti").limit(1).count():
        raise DataError("IncompleteAssignment", f"{r['n']} of {n}")
    return _joined(rows, assignment.select(rows.row_id, F.col("fold").cast("int").alias("fold")), k)


@dataclass(frozen=True)
class External:
    """What a plan from elsewhere says about itself: its rows, folds, seed, and the digest of the row ids that it was made for (see `ordered_fingerprint`); each is checked where it is given."""

    size: int
    folds: int
    seed: int | None = None
    population: str | None = None


def zipped(left: DataFrame, right: DataFrame, position: str = "pos") -> DataFrame:
    """Two frames with gapless positions side by side, row by row. Frames of different lengths are refused; so are columns that both have."""
    if clash := set(left.columns) & set(right.columns) - {position}:
        raise DataError("ReservedName", ", ".join(sorted(clash)))
    found = [df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(position).alias("d"), F.min(position).alias("low"), F.max(position).alias("high")).first() for df in (left, right)]
    for r in found:
        if r["d"] != r["n"] or r["n"] and (r["low"] != 0 or r["high"] != r["n"] - 1):
            raise DataError("InvalidPositions", f"{r['d']} of {r['n']} from {r['low']} to {r['high']}")
    if found[0]["n"] != found[1]["n"]:
        raise DataError("LengthMismatch", f"{found[0]['n']} and {found[1]['n']}")
    return left.join(right, position)


def gathered(at: DataFrame, ordinals: DataFrame, n: int, position: str = "pos") -> DataFrame:
    """The rows of `at` (n rows with gapless positions) that `ordinals` names by position, repeated as often as it names them; a position beyond the rows is refused."""
    bad = ordinals.where(F.col(position).isNull() | (F.col(position) < 0) | (F.col(position) >= n)).limit(1).collect()
    if bad:
        raise DataError("PositionOutOfRange", f"{bad[0][position]} of {n}")
    return skew_join(ordinals, at, [position])


def bound_by_position(rows: Rows, assignment: DataFrame, given: External, seed: int | None = None) -> Plan:
    """A plan from outside by position: (pos, fold), positions counting the rows in ascending order of their ids.

    Refused are other numbers of rows, another seed than the one asked for, rows of another population, positions that are missing, repeated or
    out of range, and folds beyond the plan's own.
    """
    n = require_unique(rows.df, rows.row_id)
    if given.size != n:
        raise DataError("SizeMismatch", f"{given.size} planned, {n} rows")
    if seed is not None and given.seed != seed:
        raise DataError("SeedMismatch", f"{given.seed} planned, {seed} asked for")
    at = global_position(rows.df.select(rows.row_id), [F.col(rows.row_id)])
    if given.population is not None and (digest := ordered_digest(at, [rows.row_id]).text) != given.population:
        raise DataError("PopulationMismatch", digest)
    both = zipped(at, assignment.select("pos", "fold"))
    return bound(rows, both.select(rows.row_id, "fold"), given.folds)
