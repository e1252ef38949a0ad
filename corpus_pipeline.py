"""A training corpus from `documents` in five stages, each written as Parquet and read again by the next.

Stages decide on keys: 128 bits of hash of all columns name a row, so that rows that agree in everything are interchangeable.
Whole rows are neither sorted nor shuffled, unless more of them go or repeat than may be broadcast.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import bpe, mixing, quality_classifier, secrets, simhash
from foldwise.llm.common import table
from foldwise.operators.state import shared_folder, written

#: Keys with an unusual number of copies are broadcast up to so many, else joined by a shuffle.
BROADCAST = 1_000_000


def _name(docs: DataFrame) -> Column:
    """A struct (i1, i2) of two hashes of all columns of a row, nulls told apart from what stands beside them."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    nulls = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in columns])
    return F.struct(F.xxhash64(F.lit(1), nulls, *columns).alias("i1"), F.xxhash64(F.lit(2), nulls, *columns).alias("i2"))


def _repeat(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of `docs`, each as often as `verdicts` (id: `_name`, copies), which has a row for each of them, says.

    Where rows that agree in everything get different numbers, one of them is repeated as often as all of them are wanted.
    """
    v = written(verdicts.groupBy("id").agg(F.sum("copies").cast("int").alias("total"), F.min("copies").cast("int").alias("least"), F.max("copies").cast("int").alias("most")))
    usual = v.where("least = most").groupBy("most").count().orderBy(F.desc("count"), "most").first()
    usual = usual["most"] if usual else 0
    other = v.where(f"least <> most or most <> {usual}").select("id", F.when(F.col("least") == F.col("most"), F.col("most")).otherwise(0).alias("copies"))
    mixed = v.where("least <> most").select("id", F.col("total").alias("copies"))
    near = lambda side: F.broadcast(side) if side.count() <= BROADCAST else side.hint("shuffle_hash")
    # whole rows stand in a struct, so that no column of theirs can clash with the names used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _name(docs).alias("id"))
    copies = lambda df: df.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
    out = copies(rows.join(near(other), "id", "left").select("row", F.coalesce("copies", F.lit(usual)).alias("copies")))
    if mixed.isEmpty():
        return out
    return out.unionByName(copies(rows.join(near(mixed), "id").dropDuplicates(["id"])))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; rows that agree in everything share their verdict."""
    rows = quality_classifier.measured(docs.withColumn("_row", _name(docs)), table(spark, sf_dir, "labels"), also=["_row"])
    found = quality_classifier.scored(rows, quality_classifier.fit(rows), also=["_row"])
    return _repeat(docs, found.select(F.col("_row").alias("id"), F.col("kept").cast("int").alias("copies")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: the least doc_id, a null one only if all are null, then the least hash of the row. Of rows that agree in everything one stays."""
    key = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", _name(docs).alias("id"))
    found = simhash.near_duplicates(docs.select(key.alias("doc"), "text"), "doc", "text").groupBy("doc", "component_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.col("doc") == F.col("component_id")
    alone = found.select("doc.id", first.cast("int").alias("copies"))
    again = found.where(first & (F.col("n") > 1)).select("doc.id", F.lit(0).alias("copies"))  # its other rows
    return _repeat(docs, alone.unionByName(again))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars follows. Null texts and all other columns stay as they are; no row goes."""
    clean = secrets.redact(docs, "text", secrets.learn(docs, "text"))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are dropped, kept or repeated. Rows without words go; rows that agree in everything are interchangeable."""
    return _repeat(docs, mixing.mix(docs.select(_name(docs).alias("id"), "source", "text"), "id").select(F.col("doc_id").alias("id"), "copies"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of the decoded text; a null text has none, equal rows have equal ids."""
    return bpe.encode(docs, "doc_id", "text", bpe.default_tokenizer())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mix", mix), ("encode", encode)]

#: SQL can express none of the classifier, the index, the models and the dynamic programme.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Stages are written below the session's checkpoint folder."""
    at = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
