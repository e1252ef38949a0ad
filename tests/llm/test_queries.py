import hashlib
import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foldwise.llm import bpe, registry, simhash
from foldwise.llm.common import min_labels


def test_names():
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    want, got = con.sql(registry.oracle_sql()[name]).df(), registry.queries()[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    # whole numbers beside nulls are floats in one frame and integers in the other
    value = lambda x: None if pd.isna(x) else int(x) if isinstance(x, float) and x.is_integer() else x
    rows = lambda df: Counter(repr([value(x) for x in r]) for r in df[columns].astype(object).values.tolist())
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name, source, key", [("op13_pitman_yor", "documents", "doc_id"), ("op1_rotation_codes", "embeddings", "vec_id"), ("op8_co_training", "documents", "doc_id"), ("op9_subset_sum_mix", "documents", "doc_id")])
def test_one_row_each(spark, sf, name, source, key):
    """One row for each row of the table, none missing or repeated, and no null verdict."""
    got = registry.queries()[name](spark, sf).toPandas()
    assert Counter(got[key]) == Counter(r[0] for r in spark.read.parquet(f"{sf}/{source}.parquet").select(key).collect())
    assert not got.drop(columns="source", errors="ignore").isna().any().any()


def test_shared_passages_query(spark, sf):
    """Each passage has windows of two documents or more; the first one's copy is kept; spans lie within the texts."""
    got = registry.queries()["op3_shared_passages"](spark, sf).toPandas()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert len(got)
    for _, rows in got.groupby("passage"):
        assert rows["doc_id"].nunique() > 1 and (rows["component_id"] == rows["doc_id"].min()).all()
        first = rows[rows["doc_id"] == rows["doc_id"].min()].sort_values(["start", "end"])
        assert rows[rows["doc_id"] != rows["doc_id"].min()]["removed"].all() and (first["removed"] == (first["start"] >= first["end"].iloc[0])).all()
    for r in got.itertuples():
        assert len(texts[r.doc_id][r.start : r.end].split()) == r.n_words


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(3).withColumns({"doc_id": F.lit(None).cast("long")}).unionByName(docs.limit(2)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    out, before = {}, docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf).write.parquet(str(tmp_path / name))
        out[name] = spark.read.parquet(str(tmp_path / name))
        if name != "encode":
            assert out[name].columns == docs.columns
        before = out[name]
    rows = {k: v.toPandas() for k, v in out.items()}
    kept = rows["quality"]
    fps = [simhash.fingerprint(t) for t in kept["text"]]
    a, b = np.nonzero(np.bitwise_count(np.array(fps, dtype=np.uint64)[:, None] ^ np.array(fps, dtype=np.uint64)) <= 3)
    assert len(rows["near_duplicates"]) == len(set(min_labels(len(fps), a, b).tolist()))
    assert len(rows["secret_scan"]) == len(rows["near_duplicates"]) and not rows["secret_scan"]["text"].str.contains("AKIA[A-Z0-9]{16}", na=False).any()
    assert rows["mix"].groupby(["doc_id", "text"]).size().max() <= 2
    library = __import__("tokenizers").Tokenizer.from_file(bpe.default_tokenizer())
    want = Counter(hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes()).hexdigest() for t in rows["mix"]["text"])
    assert Counter(rows["encode"]["ids_sha256"]) == want


def test_pipeline_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


@pytest.mark.parametrize("stage", ["quality", "near_duplicates", "secret_scan", "mix", "encode"])
def test_stages_with_clashing_columns(spark, sf, tmp_path, stage):
    """Columns named as the stages' own helpers come through as they were; rows are those of the table without them."""
    names = ("_id", "_n", "_copies", "id", "row", "copies", "doc", "n")
    plain, run = spark.read.parquet(f"{sf}/documents.parquet"), dict(corpus_pipeline.STAGES)[stage]
    docs = plain.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in names})
    run(spark, docs, sf).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    if stage == "encode":
        assert got.count() == docs.count()
        return
    assert got.columns == docs.columns and got.where(" or ".join(f"`{c}` <> '{c}-' || doc_id" for c in names)).count() == 0
    if stage == "secret_scan":
        assert got.count() == docs.count()
    elif stage == "mix":
        words = F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
        assert 0.9 < got.agg(F.sum(words)).first()[0] / (1.5 * docs.agg(F.sum(words)).first()[0]) < 1.1
    else:
        assert 0 < got.count() < docs.count() and got.groupBy("doc_id").count().where("count > 1").isEmpty()
