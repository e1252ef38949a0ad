"""The registered queries' inputs as keyed rows, and the SQL that their oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.hashing import FNV_PRIME, MIX_1, MIX_2, Fingerprint, rank_state
from foldwise.sources.rows import Rows, numbered, unsplit


def identity(name: str) -> Fingerprint:
    return Fingerprint("source-identity", (name, "1"), "parquet")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> Rows:
    return unsplit(read(spark, sf_dir, "orders"), "o_orderkey", identity("orders"), target="o_totalprice", group="o_custkey", time="o_orderdate")


def order_features(spark: SparkSession, sf_dir: str) -> Rows:
    """Orders that have line items, with their quantity and number of lines; the target is the order's price, the weight its number of lines."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("double").alias("quantity"), F.count(F.lit(1)).cast("double").alias("lines"))
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_custkey", "o_orderpriority").join(lines, "o_orderkey")
    return unsplit(df, "o_orderkey", identity("order_features"), features=("quantity", "lines"), target="o_totalprice", weight="lines", group="o_custkey")


#: The same rows in SQL.
ORDER_FEATURES = """
f AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS y, o_custkey, o_orderpriority, x1, x2 FROM orders JOIN
      (SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS x1, CAST(count(*) AS DOUBLE) AS x2 FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)
"""

LINE_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def lines(spark: SparkSession, sf_dir: str) -> Rows:
    """Line items, which have no key of their own, numbered by all their columns."""
    df = numbered(read(spark, sf_dir, "lineitem").select(*LINE_KEY), [F.col(c) for c in LINE_KEY])
    df = df.withColumns({c: F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")})
    return unsplit(df, "row_id", identity("lineitem"), features=("l_quantity", "l_discount"), target="l_extendedprice", weight="l_quantity", group="l_suppkey", time="l_shipdate")


def priced(spark: SparkSession, sf_dir: str) -> Rows:
    """Line items as they are read, without a key that tells all of them apart: for fits and metrics, which need none."""
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount")])
    return unsplit(df, "l_orderkey", identity("lineitem"), features=("l_quantity", "l_discount"), target="l_extendedprice", weight="l_quantity")


LINES = f"l AS (SELECT *, row_number() OVER (ORDER BY {', '.join(LINE_KEY)}) - 1 AS row_id FROM lineitem)"

WORD = "18446744073709551616::UHUGEINT"


def signed_sql(h: str) -> str:
    return f"CASE WHEN {h} >= 9223372036854775808::UBIGINT THEN CAST(CAST({h} AS HUGEINT) - 18446744073709551616 AS BIGINT) ELSE CAST({h} AS BIGINT) END"


def finalize_sql(source: str, h: str, keep: str, name: str) -> str:
    """CTEs `name`_1, `name`_2 and `name`: `keep` of `source` and rank, the signed finalizer of the unsigned expression h."""
    step = lambda shift, factor, f: f"SELECT {keep}, CAST((xor(h, h >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {WORD} AS UBIGINT) AS h FROM {f}"
    last = "xor(h, h >> 31)"
    return f"""{name}_0 AS (SELECT {keep}, {h} AS h FROM {source}),
{name}_1 AS ({step(30, MIX_1, name + "_0")}),
{name}_2 AS ({step(27, MIX_2, name + "_1")}),
{name} AS (SELECT {keep}, {signed_sql(last)} AS rank FROM {name}_2)"""


def rank_sql(source: str, row_id: str, keep: str, name: str, table: str, seed: int) -> str:
    """CTEs that end in `name`: `keep` of `source` and the rank of `row_id` (not negative) for a table's identity."""
    h = f"{rank_state(identity(table), seed)}::UBIGINT"
    for k in range(7, -1, -1):
        h = f"CAST((xor({h}, (CAST({row_id} AS UBIGINT) >> {8 * k}) & 255::UBIGINT)::UHUGEINT * {FNV_PRIME}::UHUGEINT) % {WORD} AS UBIGINT)"
    return finalize_sql(source, h, keep, name)
