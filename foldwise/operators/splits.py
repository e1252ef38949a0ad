"""Exactly sized, reproducibly ranked splits into train, validation and test rows."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.digests import derived, digest_sums, ordered, row_hash
from foldwise.functions.hashing import RANK_DOMAIN, Fingerprint, rank_state, with_rank
from foldwise.operators.state import checkpoint, global_position
from foldwise.sources.rows import DataError, Role, Rows, require_unique

Amount = int | Fraction


@dataclass(frozen=True)
class Policy:
    """How many rows go to validation and test: positive counts, or fractions of all rows, rounded down."""

    validation: Amount | None = None
    test: Amount | None = None

    def __post_init__(self) -> None:
        given = [x for x in (self.validation, self.test) if x is not None]
        if not given:
            raise DataError("EmptyPolicy")
        for x in given:
            if isinstance(x, Fraction) and not 0 < x < 1 or isinstance(x, int) and x < 1:
                raise DataError("InvalidAmount", str(x))
        if sum(x for x in given if isinstance(x, Fraction)) >= 1:
            raise DataError("FractionsExhaustRows")

    def counts(self, n: int) -> tuple[int, int, int]:
        """Rows of validation, test and train; each role that the policy names must get some, and so must train."""
        sizes = [0 if x is None else x if isinstance(x, int) else n * x.numerator // x.denominator for x in (self.validation, self.test)]
        if sum(sizes) >= n:
            raise DataError("ExhaustiveSplit", f"{sum(sizes)} of {n}")
        for x, size, role in zip((self.validation, self.test), sizes, ("validation", "test")):
            if x is not None and size == 0:
                raise DataError("EmptySplitRole", role)
        return sizes[0], sizes[1], n - sum(sizes)


@dataclass(frozen=True)
class Split:
    """One assignment of all rows. Roles are filters of it, so that no row can be in two."""

    assigned: Rows
    sizes: tuple[int, int, int]
    policy: Policy
    seed: int
    domain: str = RANK_DOMAIN

    def part(self, role: Role) -> Rows:
        if role not in (Role.TRAIN, Role.VALIDATION, Role.TEST):
            raise DataError("UnknownRole", role.value)
        return self.assigned.with_df(self.assigned.df.where(F.col("_role") == role.value).drop("_role"), role=role, fingerprint=self.identity(role))

    def identity(self, role: Role) -> Fingerprint:
        """What the rows of a role are: the source and the rule that took them from it."""
        return derived("split", self.assigned.fingerprint, algorithm=self.domain, seed=self.seed, validation=self.policy.validation, test=self.policy.test, role=role.value)

    @property
    def train(self) -> Rows:
        return self.part(Role.TRAIN)

    @property
    def validation(self) -> Rows:
        return self.part(Role.VALIDATION)

    @property
    def test(self) -> Rows:
        return self.part(Role.TEST)

    def receipt(self) -> DataFrame:
        """(role, n, low, high, ids_xor): counts and an order-free fingerprint of each role."""
        i = self.assigned.row_id
        return self.assigned.df.groupBy(F.col("_role").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.min(i).alias("low"), F.max(i).alias("high"), F.bit_xor(i).alias("ids_xor"))


    def provenance(self) -> DataFrame:
        """(role, n, ids, source, seed, algorithm, policy, identity) of each role that has rows: `ids` is the digest of its row ids in ascending order."""
        i, source = self.assigned.row_id, self.assigned.fingerprint
        at = global_position(self.assigned.df.select("_role", i), [F.col("_role"), F.col(i)])
        rows = at.groupBy("_role").agg(*digest_sums(row_hash(F.col(i)), F.col("pos"))).collect()  # one row a role
        shared = (f"{source.policy}:{','.join(source.fields)}:{source.digest}", self.seed, self.domain, f"validation={self.policy.validation},test={self.policy.test}")
        out = [(r["_role"], r["n"], ordered(r).text, *shared, self.identity(Role(r["_role"])).digest) for r in rows]
        return at.sparkSession.createDataFrame(out, "role string, n long, ids string, source string, seed long, algorithm string, policy string, identity string")


def ranked(rows: Rows, seed: int, domain: str = RANK_DOMAIN) -> DataFrame:
    """(row id, rank, pos): positions in the order of (rank, id), found without a global sort in one task."""
    state = rank_state(rows.fingerprint, seed, domain)
    i = F.col(rows.row_id).cast("long").alias(rows.row_id)
    return global_position(with_rank(rows.df.select(i), rows.row_id, state), [F.col("rank"), F.col(rows.row_id)])


def split(rows: Rows, policy: Policy, seed: int, domain: str = RANK_DOMAIN) -> Split:
    """Rank all rows and take exactly as many as the policy says: first validation, then test, the rest is train."""
    if rows.role is not Role.UNSPLIT:
        raise DataError("AlreadySplit", rows.role.value)
    n = require_unique(rows.df, rows.row_id)
    v, t, train = policy.counts(n)
    role: Column = F.when(F.col("pos") < v, Role.VALIDATION.value).when(F.col("pos") < v + t, Role.TEST.value).otherwise(Role.TRAIN.value)
    assigned = ranked(rows, seed, domain).select(rows.row_id, role.alias("_role"))
    return Split(rows.with_df(checkpoint(rows.df.join(assigned, rows.row_id))), (v, t, train), policy, seed, domain)


def holdout(rows: Rows, test: Amount, seed: int, domain: str = RANK_DOMAIN) -> Split:
    return split(rows, Policy(test=test), seed, domain)


def validation(rows: Rows, amount: Amount, seed: int, domain: str = RANK_DOMAIN) -> Split:
    return split(rows, Policy(validation=amount), seed, domain)


def train_validation_test(rows: Rows, validation: Amount, test: Amount, seed: int, domain: str = RANK_DOMAIN) -> Split:
    return split(rows, Policy(validation, test), seed, domain)
