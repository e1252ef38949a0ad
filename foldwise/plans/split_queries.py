"""Registered queries on keyed rows, splits and resampling plans."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from foldwise.functions.digests import BASES, PRIMES
from foldwise.functions.hashing import RANK_DOMAIN
from foldwise.operators import resampling, splits
from foldwise.plans.tables import LINES, WORD, finalize_sql, identity, lines, order_features, orders, rank_sql, read, signed_sql
from foldwise.sources.rows import duplicate_ids, ids_fingerprint, numbered, overlap, paired, restore_check, unsplit
from foldwise.sources.rows import ordered_fingerprint as rows_fingerprint

SEED = 42


def _roles(split):
    return split.assigned.df.select("o_orderkey", F.col("_role").alias("role"))


def _role_sql(v: str, t: str, seed: int = SEED) -> str:
    return f"""WITH {rank_sql("orders", "o_orderkey", "o_orderkey", "r", "orders", seed)},
p AS (SELECT o_orderkey, row_number() OVER (ORDER BY rank, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM r)
SELECT o_orderkey, CASE WHEN pos < {v} THEN 'validation' WHEN pos < {v} + {t} THEN 'test' ELSE 'train' END AS role FROM p"""


def split_receipt_counts(spark, sf_dir):
    return splits.train_validation_test(orders(spark, sf_dir), Fraction(1, 5), Fraction(1, 10), SEED).receipt()


def rolling_origin_folds(spark, sf_dir):
    rows = unsplit(read(spark, sf_dir, "events").select("event_id", "ts"), "event_id", identity("events"), time="ts")
    return resampling.rolling_origin(rows, 500, 200, 100)[1]


def rolling_origin_assessment(spark, sf_dir):
    rows = unsplit(read(spark, sf_dir, "events").select("event_id", "ts"), "event_id", identity("events"), time="ts")
    at, _ = resampling.rolling_origin(rows, 500, 200, 100)
    return resampling.rolling_assessment(at, "event_id", 500, 200, 100)


def grouped_kfold(spark, sf_dir):
    return resampling.grouped_k_fold(orders(spark, sf_dir), 5, SEED).rows.df.select("o_orderkey", "o_custkey", "fold")


def grouped_kfold_suppliers(spark, sf_dir):
    return resampling.grouped_k_fold(lines(spark, sf_dir), 10, SEED).rows.df.select("row_id", "l_suppkey", "fold")


def grouped_kfold_unique(spark, sf_dir):
    """Every group is a single row."""
    rows = unsplit(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("alone")), "o_orderkey", identity("orders"), group="alone")
    return resampling.grouped_k_fold(rows, 10, SEED).rows.df.select("o_orderkey", "fold")


def _grouped_sql(source: str, row_id: str, group: str, table: str, k: int, with_sql: str = "") -> str:
    """The greedy packing as a recursion over the groups in their order; the state is the list of fold sizes."""
    best = "list_position(s.sizes, list_min(s.sizes))"
    return f"""WITH RECURSIVE {with_sql} g AS (SELECT {group} AS g, count(*) AS n, min({row_id}) AS first FROM {source} GROUP BY {group}),
{rank_sql("g", "first", "g, n, first", "r", table, SEED)},
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, rank, first) AS i FROM r),
s AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS g, CAST(0 AS BIGINT) AS fold, {[0] * k}::BIGINT[] AS sizes
  UNION ALL SELECT o.i, CAST(o.g AS BIGINT), CAST({best} - 1 AS BIGINT), list_transform(s.sizes, lambda x, j: CASE WHEN j = {best} THEN x + o.n ELSE x END) FROM s JOIN o ON o.i = s.i + 1)
SELECT {row_id}, {group}, CAST(s.fold AS INTEGER) AS fold FROM {source} JOIN s ON s.i > 0 AND s.g = {group}"""


def group_labels(spark, sf_dir):
    return resampling.group_labels(orders(spark, sf_dir))


def duplicate_rowids(spark, sf_dir):
    df = lines(spark, sf_dir).df.select("row_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    return duplicate_ids(df, "line", "row_id")


def restore_examples_check(spark, sf_dir):
    original = read(spark, sf_dir, "orders").select("o_orderkey")
    prepared = original.where("o_orderkey % 7 <> 0").unionByName(original.where("o_orderkey % 11 = 0")).unionByName(original.where("o_orderkey % 13 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey")))
    return restore_check(original, prepared, "o_orderkey")


def evaluation_overlap(spark, sf_dir):
    """Training rows of one split in its own hold-out (none) and in one that was drawn with another seed."""
    split, other = (splits.holdout(orders(spark, sf_dir), Fraction(1, 5), seed) for seed in (SEED, SEED + 1))
    held_out = split.test.df.select("o_orderkey").unionByName(other.test.df.select("o_orderkey"))
    return overlap(split.train.df, held_out, "o_orderkey").distinct()


def partition_fingerprint(spark, sf_dir):
    p = ids_fingerprint(read(spark, sf_dir, "orders"), "o_orderkey")
    return spark.createDataFrame([(p.policy, p.digest)], "policy string, digest string")


def ordered_fingerprint(spark, sf_dir):
    p = rows_fingerprint(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey", ("o_custkey", "o_orderpriority"))
    return spark.createDataFrame([(p.fields[0], p.digest)], "policy string, digest string")


def fold_fingerprints(spark, sf_dir):
    found = resampling.k_fold(orders(spark, sf_dir), 5, SEED).fingerprints()
    return spark.createDataFrame([(k, d.n, d.text) for k, d in found.items()], "fold int, n long, digest string")


def split_provenance(spark, sf_dir):
    return splits.train_validation_test(orders(spark, sf_dir), Fraction(1, 5), Fraction(1, 10), SEED).provenance().drop("identity")


def _positions(spark, sf_dir):
    return numbered(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal")), [F.col("c_custkey")], "pos")


def positional_weights(spark, sf_dir):
    """Customers' balances weighted by the balances' squares a row, which come from another frame by position."""
    rows = _positions(spark, sf_dir)
    weights = _positions(spark, sf_dir).select("pos", (F.col("c_acctbal") * F.col("c_acctbal") + 1).alias("weight"))
    return resampling.zipped(rows, weights).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("c_acctbal") * F.col("weight")) / F.sum("weight"), 4).alias("mean"))


def positional_gather(spark, sf_dir):
    """Every third customer by position, the first ten twice."""
    rows = _positions(spark, sf_dir)
    third = rows.where("pos % 3 = 0").select("pos")
    return resampling.gathered(rows, third.unionByName(rows.where("pos < 10").select("pos")).unionByName(rows.where("pos < 10").select("pos")), rows.count()).select("pos", "c_custkey")


def bound_positions(spark, sf_dir):
    """A plan by position, checked against its size, seed and population."""
    rows = orders(spark, sf_dir)
    n = rows.df.count()
    plan = resampling.External(n, 4, SEED, rows_fingerprint(rows.df, "o_orderkey").digest)
    given = spark.range(n).select(F.col("id").alias("pos"), F.pmod(F.floor(F.col("id") / 7), F.lit(4)).cast("int").alias("fold"))
    return resampling.bound_by_position(rows, given, plan, SEED).rows.df.select("o_orderkey", "fold")


def _digest_sql(source: str, columns: list[str], order: str, by: str = "") -> str:
    """CTE z: n and digest of the rows of `source` in their order, by the column `by` if given."""
    text = ", ".join(f"coalesce('+' || replace(CAST({c} AS VARCHAR), chr(31), chr(31) || chr(31)), '-')" for c in columns)
    powers = [f"list_reduce([{', '.join(f'CASE WHEN (pos >> {k}) & 1 = 1 THEN {pow(b, 1 << k, p)}::BIGINT ELSE 1::BIGINT END' for k in range(24))}], lambda x, y: x * y % {p})" for b, p in zip(BASES, PRIMES)]
    keep = f"{by}, " if by else ""
    sums = ", ".join(f"CAST(sum(h % {p} * {w} % {p}) % {p} AS BIGINT) AS d{i}" for i, (w, p) in enumerate(zip(powers, PRIMES)))
    return f"""h AS (SELECT {keep}CAST('0x' || substr(md5(concat_ws(chr(31) || ',', {text})), 1, 15) AS BIGINT) AS h, row_number() OVER ({f"PARTITION BY {by} " if by else ""}ORDER BY {order}) - 1 AS pos FROM {source}),
z AS (SELECT {keep}n, n || ':' || format('{{:08x}}{{:08x}}', d0, d1) AS digest FROM (SELECT {keep}count(*) AS n, {sums} FROM h {f"GROUP BY {by}" if by else ""}))"""


def bound_assignment(spark, sf_dir):
    rows = order_features(spark, sf_dir)
    given = rows.df.select("o_orderkey", F.pmod("o_custkey", F.lit(4)).cast("int").alias("fold"))
    return resampling.bound(rows, given, 4).sizes()


def source_pairs(spark, sf_dir):
    """Parts as pairs of inputs and a price, without the key."""
    inputs = {"size": F.col("p_size"), "letters": F.length("p_name")}
    return paired(read(spark, sf_dir, "part"), inputs, F.col("p_retailprice"), [F.col("p_size"), F.desc("p_partkey")], identity("part")).df


def source_numbered(spark, sf_dir):
    return numbered(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), [F.col("c_mktsegment"), F.desc("c_custkey")])


def batch_totals(spark, sf_dir):
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = unsplit(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", identity("part"))
    one = lambda b: [pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64()), pa.array([pc.sum(b.column(1)).as_py()], pa.int64())], names=["n", "total"])]
    return rows.batches(100, one, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), (F.max("n") <= 100).alias("bounded"))


QUERIES = {
    "ordered_fingerprint": ordered_fingerprint,
    "fold_fingerprints": fold_fingerprints,
    "split_provenance": split_provenance,
    "positional_weights": positional_weights,
    "positional_gather": positional_gather,
    "bound_positions": bound_positions,
    "split_holdout_rows": lambda s, d: _roles(splits.holdout(orders(s, d), 300, SEED)),
    "split_validation_fraction": lambda s, d: _roles(splits.validation(orders(s, d), Fraction(1, 5), SEED)),
    "split_tvt": lambda s, d: _roles(splits.train_validation_test(orders(s, d), Fraction(1, 5), Fraction(1, 10), SEED)),
    "split_receipt_counts": split_receipt_counts,
    "kfold_shuffled": lambda s, d: resampling.k_fold(orders(s, d), 5, SEED).rows.df.select("o_orderkey", "fold"),
    "kfold_ordered": lambda s, d: resampling.k_fold(orders(s, d), 5).rows.df.select("o_orderkey", "fold"),
    "kfold_analysis_sizes": lambda s, d: resampling.k_fold(orders(s, d), 5, SEED).analysis(2).df.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("ids")),
    "grouped_kfold": grouped_kfold,
    "grouped_kfold_suppliers": grouped_kfold_suppliers,
    "grouped_kfold_unique": grouped_kfold_unique,
    "rolling_origin_folds": rolling_origin_folds,
    "rolling_origin_assessment": rolling_origin_assessment,
    "group_labels": group_labels,
    "duplicate_rowids": duplicate_rowids,
    "restore_examples_check": restore_examples_check,
    "evaluation_overlap": evaluation_overlap,
    "partition_fingerprint": partition_fingerprint,
    "bound_assignment": bound_assignment,
    "source_pairs": source_pairs,
    "source_numbered": source_numbered,
    "batch_totals": batch_totals,
}

#: Fixed values of XXH64.
XXH64 = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _xxhash64_sql(x: str, source: str) -> str:
    """CTEs that end in `hashed`: h, the signed XXH64 (seed 42) of the eight bytes of the long `x` of every row of `source`."""
    p1, p2, p3, p4, p5 = XXH64
    times = lambda v, p: f"CAST(({v})::UHUGEINT * {p}::UHUGEINT % {WORD} AS UBIGINT)"
    turned = lambda v, n: f"CAST(({v}::UHUGEINT * {1 << n}::UHUGEINT) % {WORD} + ({v} >> {64 - n}) AS UBIGINT)"
    start = f"{42 + p5 + 8}::UBIGINT"
    return f"""x1 AS (SELECT {times(f"CAST({x} AS UBIGINT)", p2)} AS h FROM {source}), x2 AS (SELECT {turned("h", 31)} AS h FROM x1), x3 AS (SELECT xor({start}, {times("h", p1)}) AS h FROM x2),
x4 AS (SELECT {turned("h", 27)} AS h FROM x3), x5 AS (SELECT CAST(({times("h", p1)}::UHUGEINT + {p4}::UHUGEINT) % {WORD} AS UBIGINT) AS h FROM x4),
x6 AS (SELECT {times("xor(h, h >> 33)", p2)} AS h FROM x5), x7 AS (SELECT {times("xor(h, h >> 29)", p3)} AS h FROM x6), x8 AS (SELECT xor(h, h >> 32) AS h FROM x7),
hashed AS (SELECT {signed_sql("h")} AS h FROM x8)"""


_FOLD = finalize_sql("orders", f"xor(CAST(o_orderkey AS UBIGINT), {SEED}::UBIGINT)", "o_orderkey", "r")
ORACLE = {
    "ordered_fingerprint": f"""WITH {_digest_sql("orders", ["o_orderkey", "o_custkey", "o_orderpriority"], "o_orderkey")} SELECT 'ordered-rows-v1' AS policy, digest FROM z""",
    "fold_fingerprints": f"""WITH {finalize_sql("orders", f"xor(CAST(o_orderkey AS UBIGINT), {SEED}::UBIGINT)", "o_orderkey", "r")}, g AS (SELECT o_orderkey, (row_number() OVER (ORDER BY rank, o_orderkey) - 1) % 5 AS fold FROM r),
{_digest_sql("g", ["o_orderkey"], "o_orderkey", "fold")} SELECT CAST(fold AS INTEGER) AS fold, n, digest FROM z""",
    "split_provenance": f"""WITH t AS ({_role_sql("(n // 5)", "(n // 10)")}), {_digest_sql("t", ["o_orderkey"], "o_orderkey", "role")}
SELECT role, n, digest AS ids, 'source-identity:orders,1:parquet' AS source, CAST({SEED} AS BIGINT) AS seed, '{RANK_DOMAIN}' AS algorithm, 'validation=1/5,test=1/10' AS policy FROM z""",
    "positional_weights": "SELECT count(*) AS n, round(sum(b * (b * b + 1)) / sum(b * b + 1), 4) AS mean FROM (SELECT CAST(c_acctbal AS DOUBLE) AS b FROM customer)",
    "positional_gather": "WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) SELECT pos, c_custkey FROM a WHERE pos % 3 = 0 UNION ALL SELECT pos, c_custkey FROM a, range(0, 2) WHERE pos < 10",
    "bound_positions": "SELECT o_orderkey, CAST(((row_number() OVER (ORDER BY o_orderkey) - 1) // 7) % 4 AS INTEGER) AS fold FROM orders",
    "split_holdout_rows": _role_sql("0", "300"),
    "split_validation_fraction": _role_sql("(n // 5)", "0"),
    "split_tvt": _role_sql("(n // 5)", "(n // 10)"),
    "split_receipt_counts": f"SELECT role, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high, bit_xor(o_orderkey) AS ids_xor FROM ({_role_sql('(n // 5)', '(n // 10)')}) GROUP BY role",
    "kfold_shuffled": f"WITH {_FOLD} SELECT o_orderkey, CAST((row_number() OVER (ORDER BY rank, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM r",
    "kfold_ordered": "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders",
    "kfold_analysis_sizes": f"WITH {_FOLD} SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY rank, o_orderkey) - 1) % 5 AS fold FROM r) WHERE fold <> 2",
    "grouped_kfold": _grouped_sql("orders", "o_orderkey", "o_custkey", "orders", 5),
    "grouped_kfold_suppliers": _grouped_sql("l", "row_id", "l_suppkey", "lineitem", 10, LINES + ","),
    "grouped_kfold_unique": f"WITH {rank_sql('orders', 'o_orderkey', 'o_orderkey', 'r', 'orders', SEED)} SELECT o_orderkey, CAST((row_number() OVER (ORDER BY rank, o_orderkey) - 1) % 10 AS INTEGER) AS fold FROM r",
    "partition_fingerprint": f"WITH {_xxhash64_sql('o_orderkey', 'orders')} SELECT 'summary' AS policy, concat(count(*), ':', bit_xor(h), ':', sum(CAST(h AS HUGEINT))::HUGEINT) AS digest FROM hashed",
    "rolling_origin_folds": "SELECT CAST(i AS INTEGER) AS fold, CAST(0 AS BIGINT) AS analysis_from, CAST(500 + i * 100 AS BIGINT) AS start, CAST(least(700 + i * 100, n) AS BIGINT) AS \"end\" FROM (SELECT count(*) AS n FROM events), range(0, 1000000) t(i) WHERE 500 + i * 100 < n",
    "rolling_origin_assessment": "WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events) SELECT event_id, CAST(i AS INTEGER) AS fold FROM p, range(0, 100000) t(i) WHERE pos >= 500 + i * 100 AND pos < 700 + i * 100",
    "group_labels": 'SELECT g AS "group", row_number() OVER (ORDER BY first) - 1 AS label FROM (SELECT o_custkey AS g, min(o_orderkey) AS first FROM orders GROUP BY o_custkey)',
    "duplicate_rowids": f"WITH {LINES}, k AS (SELECT l_orderkey * 10 + l_linenumber AS line, row_id, row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber ORDER BY row_id) AS i FROM l) SELECT line, count(*) AS n, max(CASE WHEN i = 2 THEN row_id END) AS at FROM k GROUP BY line HAVING count(*) > 1",
    "restore_examples_check": """WITH p AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT -o_orderkey - 1 FROM orders WHERE o_orderkey % 13 = 0),
c AS (SELECT o_orderkey, count(*) AS b FROM p GROUP BY o_orderkey)
SELECT code, count(*) AS n FROM (SELECT CASE WHEN b > 1 THEN 'DuplicatePreparedRow' WHEN a.o_orderkey IS NULL THEN 'UnknownPreparedRow' WHEN b IS NULL THEN 'MissingPreparedRow' END AS code FROM orders a FULL JOIN c ON a.o_orderkey = c.o_orderkey) WHERE code IS NOT NULL GROUP BY code""",
    "evaluation_overlap": f"SELECT o_orderkey FROM ({_role_sql('0', '(n // 5)')}) a JOIN ({_role_sql('0', '(n // 5)', SEED + 1)}) b USING (o_orderkey) WHERE a.role = 'train' AND b.role = 'test'",
    "bound_assignment": "SELECT CAST(o_custkey % 4 AS INTEGER) AS fold, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY o_custkey % 4",
    "source_pairs": "SELECT row_number() OVER (ORDER BY p_size, p_partkey DESC) - 1 AS row_id, CAST(p_size AS DOUBLE) AS size, CAST(length(p_name) AS DOUBLE) AS letters, CAST(p_retailprice AS DOUBLE) AS target FROM part",
    "source_numbered": "SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment, c_custkey DESC) - 1 AS row_id FROM customer",
    "batch_totals": "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total, true AS bounded FROM part",
}
