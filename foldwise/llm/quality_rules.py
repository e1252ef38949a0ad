"""Host-level quality rules in DataFrame functions only.

Every document is measured and tested by two rules. Failures are counted by host (the `source`), each host's failure rate
is shrunk by a beta prior fitted to all hosts, and hosts whose shrunk rate is too high lose all their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import table, words
from foldwise.operators.state import checkpoint

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: A host is rejected over this shrunk failure rate; hosts are broadcast up to so many, else joined by a shuffle.
MOST_FAILING, BROADCAST_HOSTS = 0.5, 100_000


def with_measures(df: DataFrame, text: str, also: dict[str, Column] | None = None) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of the column `text`.

    A null text has no words. Windows are compared by the 64-bit hash of their words, within their own text only.
    `also`: further columns, of the text and of the words `_words`; the text and helper columns are dropped.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = df.withColumns({"_words": words(F.col(text)), "_lines": lines})
    n = F.size("_words")
    spans = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))))
    out = out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_spans": spans,
        }
        | (also or {})
    ).drop(text, "_words", "_lines")
    # hash and position of each window, sorted, but only where some window occurs twice
    twice = F.size(F.array_distinct("_spans")) < F.size("_spans")
    out = out.withColumn("_sorted", F.when(twice, F.sort_array(F.transform("_spans", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("_spans")
    same = lambda x, j: F.coalesce(F.get("_sorted", j)["h"] == x["h"], F.lit(False))
    starts = F.filter(F.transform("_sorted", lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])), lambda i: i.isNotNull())
    out = out.withColumn("_starts", F.sort_array(starts)).drop("_sorted")
    covered = F.transform("_starts", lambda i, j: F.least(F.coalesce(F.get("_starts", j + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
    return out.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_starts")


def host_verdicts(failed: DataFrame) -> DataFrame:
    """One row per `source` of (source, base_failed): host_rate, its failure rate shrunk by the empirical beta prior, and host_kept.

    The prior's mean is the hosts' mean rate; its strength comes from the rates' variance beyond what their counts explain
    (method of moments). Without such variance all hosts get the mean rate, nearly.
    """
    hosts = checkpoint(failed.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f")))
    rate = F.col("f") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(F.lit(1.0) / F.col("n")).alias("inv")).first()
    m, v = prior["m"] or 0.0, (prior["v"] or 0.0) - (prior["m"] or 0.0) * (1 - (prior["m"] or 0.0)) * (prior["inv"] or 0.0)
    strength = min(max(m * (1 - m) / v - 1, 1.0), 1e6) if v > 0 else 1e6
    shrunk = (F.col("f") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    out = hosts.select("source", shrunk.alias("host_rate"), (shrunk <= MOST_FAILING).alias("host_kept"))
    return F.broadcast(out) if hosts.count() <= BROADCAST_HOSTS else out


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Measures and verdicts of every row of `df`.

    Returns `key`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate. Null hosts are
    a host of their own; equal rows are judged alike and each counts; other columns are not read; an empty table gives no
    rows. Counts by host are summed before they move, so a host with most of the rows is no burden to one task.
    """
    rows = with_measures(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("source")), "text")
    bad = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = checkpoint(rows.withColumn("base_failed", bad))
    hosts = host_verdicts(rows.select("source", "base_failed")).withColumnRenamed("source", "_host")
    joined = rows.join(hosts, rows["source"].eqNullSafe(hosts["_host"]), "left")
    return joined.select(
        F.col("doc_id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"), F.round("host_rate", 6).alias("host_rate"),
    )


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op2_host_rules": op2_host_rules}

ORACLE = {
    "op2_host_rules": r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM p) WHERE c > 1
), v AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM r CROSS JOIN range(0, 8) t(j) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, len(ws) AS n_words, CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT) AS word_chars,
         length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words
  FROM w LEFT JOIN v ON w.doc_id = v.doc_id
), b AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS n, CAST(sum(CAST(base_failed AS BIGINT)) AS BIGINT) AS f FROM b GROUP BY source
), q AS (
  SELECT avg(f / n) AS m, var_pop(f / n) - avg(f / n) * (1 - avg(f / n)) * avg(1.0 / n) AS v FROM h
), s AS (
  SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) ELSE 1e6 END AS strength FROM q
), k AS (
  SELECT source, (f + m * strength) / (n + strength) AS host_rate FROM h CROSS JOIN s
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, (NOT base_failed AND host_rate <= 0.5) AS kept, round(host_rate, 6) AS host_rate
FROM b JOIN k ON b.source IS NOT DISTINCT FROM k.source
"""
}
