import heapq
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from foldwise.functions.hashing import RANK_DOMAIN, Fingerprint, rank_state, with_rank
from foldwise.operators import resampling, splits
from foldwise.operators.state import global_position, skew_join
from foldwise.sources.rows import DataError, Role, duplicate_ids, ids_fingerprint, numbered, overlap, restore_check, unsplit

PRINT = Fingerprint("content-digest", ("sha256",), "abc")


def rows_of(spark, n, **parts):
    df = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 7).alias("g"), F.expr("cast((id * 13) % 5 as int)").alias("t"), F.lit(1.5).alias("y"))
    return unsplit(df.repartition(3), "row_id", PRINT, target="y", group="g", time="t", **parts)


@pytest.mark.parametrize("n", [2, 5, 33, 80])
def test_splits_are_exact_and_disjoint(spark, n):
    s = splits.holdout(rows_of(spark, n), 1, 3)
    train, test = ({r[0] for r in p.df.select("row_id").collect()} for p in (s.train, s.test))
    assert len(test) == 1 and train | test == set(range(n)) and not train & test
    assert s.train.role is Role.TRAIN and "_role" not in s.train.df.columns


def test_splits_don_t_depend_on_partitions(spark):
    a = splits.train_validation_test(rows_of(spark, 50), Fraction(1, 5), 7, 9)
    b = splits.train_validation_test(rows_of(spark, 50).with_df(rows_of(spark, 50).df.coalesce(1)), Fraction(1, 5), 7, 9)
    assert a.sizes == (10, 7, 33)
    assert sorted(a.assigned.df.collect()) == sorted(b.assigned.df.collect())
    assert {r["role"]: r["n"] for r in a.receipt().collect()} == {"validation": 10, "test": 7, "train": 33}


def test_bad_ids(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "row_id long")
    with pytest.raises(DataError, match="DuplicateRowId: 2"):
        splits.holdout(unsplit(df, "row_id", PRINT), 1, 0)
    with pytest.raises(DataError, match="NullRowId"):
        splits.holdout(unsplit(spark.createDataFrame([(None,), (1,)], "row_id long"), "row_id", PRINT), 1, 0)
    got = duplicate_ids(numbered(df, [F.col("row_id")], "pos"), "row_id", "pos").collect()
    assert [tuple(r) for r in got] == [(2, 2, 2)]
    with pytest.raises(DataError, match="AlreadySplit"):
        splits.holdout(splits.holdout(rows_of(spark, 9), 1, 0).train, 1, 0)


def test_k_fold(spark):
    for seed in (None, 4):
        p = resampling.k_fold(rows_of(spark, 23), 4, seed)
        assert sorted(r["n"] for r in p.sizes().collect()) == [5, 6, 6, 6]
        assert p.analysis(1).df.count() + p.assessment(1).df.count() == 23
    for k in (1, 24):
        with pytest.raises(DataError):
            resampling.k_fold(rows_of(spark, 23), k)


def test_grouped_k_fold(spark):
    p = resampling.grouped_k_fold(rows_of(spark, 70), 3, 11)
    got = p.rows.df.groupBy("g").agg(F.count_distinct("fold").alias("f"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["f"] == 1 and r["n"] == 10 for r in got)
    assert sorted(r["n"] for r in p.sizes().collect()) == [20, 20, 30]
    with pytest.raises(DataError, match="TooFewGroups"):
        resampling.grouped_k_fold(rows_of(spark, 70), 8, 11)


def greedy(sizes, k):
    heap, folds = [(0, f) for f in range(k)], []
    for n in sizes:
        held, fold = heapq.heappop(heap)
        folds.append(fold)
        heapq.heappush(heap, (held + n, fold))
    return folds


def test_packing_is_greedy():
    rnd = random.Random(5)
    for _ in range(400):
        k = rnd.randint(2, 7)
        sizes = sorted((rnd.choice((1, 1, 2, 3, 7, rnd.randint(1, 60))) for _ in range(rnd.randint(1, 80))), reverse=True)
        got = []
        for size, starts, orders in resampling.packing(sorted(Counter(sizes).items(), reverse=True), k):
            ends = [*starts[1:], len(got) + Counter(sizes)[size]]
            for start, end, turn in zip(starts, ends, orders):
                got += [turn[i % len(turn)] for i in range(end - start)]
        assert got == greedy(sizes, k)


@pytest.mark.parametrize("broadcast", [0, 20_000])
def test_one_hot_group_leaves_the_other_folds_full(spark, monkeypatch, broadcast):
    monkeypatch.setattr(resampling, "BROADCAST_SIZES", broadcast)
    df = spark.range(900).select(F.col("id").alias("row_id"), F.when(F.col("id") < 300, F.lit(None)).when(F.col("id") < 700, F.col("id")).otherwise(F.floor(F.col("id") / 2)).alias("g"))
    rows = unsplit(df.repartition(5), "row_id", PRINT, group="g")
    p = resampling.grouped_k_fold(rows, 5, 3)
    assert sorted(r["n"] for r in p.sizes().collect()) == [150, 150, 150, 150, 300]
    order = with_rank(resampling.group_sizes(rows), "first", rank_state(PRINT, 3, RANK_DOMAIN)).orderBy(F.desc("n"), "rank", "first").collect()
    want = dict(zip((r["group"] for r in order), greedy([r["n"] for r in order], 5)))
    assert {r["g"]: r["fold"] for r in p.rows.df.select("g", "fold").distinct().collect()} == want


def test_rolling_origin(spark):
    rows = rows_of(spark, 12)
    at, folds = resampling.rolling_origin(rows, 4, 3, 2)
    order = [r["row_id"] for r in at.orderBy("pos").collect()]
    assert order == sorted(range(12), key=lambda i: (i * 13 % 5, i))
    spans = {r["fold"]: (r["start"], r["end"]) for r in folds.collect()}
    assert spans == {0: (4, 7), 1: (6, 9), 2: (8, 11), 3: (10, 12)}
    got = {(r["row_id"], r["fold"]) for r in resampling.rolling_assessment(at, "row_id", 4, 3, 2).collect()}
    assert got == {(order[p], f) for f, (a, b) in spans.items() for p in range(a, b)}


def test_bound(spark):
    rows = rows_of(spark, 6)
    good = spark.createDataFrame([(i, i % 2) for i in range(6)], "row_id long, fold int")
    assert resampling.bound(rows, good, 2).folds == 2
    for bad, code in ((good.where("row_id > 0"), "IncompleteAssignment"), (good.withColumn("fold", F.lit(2)), "InvalidFold"), (good.unionByName(good), "DuplicateRowId")):
        with pytest.raises(DataError, match=code):
            resampling.bound(rows, bad, 2)


def test_labels_and_checks(spark):
    got = {r["group"]: r["label"] for r in resampling.group_labels(rows_of(spark, 30)).collect()}
    assert got == {i: i for i in range(7)}
    a = spark.createDataFrame([(1,), (1,), (2,), (3,)], "row_id long")
    b = spark.createDataFrame([(1,), (3,), (3,), (9,)], "row_id long")
    assert {r["code"]: r["n"] for r in restore_check(a, b, "row_id").collect()} == {"DuplicateInputRow": 1, "DuplicatePreparedRow": 1, "UnknownPreparedRow": 1, "MissingPreparedRow": 1}
    assert [r[0] for r in overlap(a, b, "row_id").distinct().orderBy("row_id").collect()] == [1, 3]
    assert ids_fingerprint(b, "row_id") == ids_fingerprint(b.repartition(4), "row_id") != ids_fingerprint(a, "row_id")


def test_empty_positions_and_hot_join(spark):
    assert global_position(spark.range(0), [F.col("id")]).count() == 0
    left = spark.range(1000).select(F.lit(1).alias("k"), "id")
    assert skew_join(left, spark.createDataFrame([(1, "a")], "k int, v string"), ["k"]).count() == 1000


def test_batches(spark):
    import pyarrow as pa

    size = lambda b: [pa.RecordBatch.from_arrays([pa.array([len(b)])], names=["n"])]
    got = [r["n"] for r in rows_of(spark, 50).batches(8, size, "n long").collect()]
    assert sum(got) == 50 and max(got) <= 8
    with pytest.raises(DataError):
        rows_of(spark, 5).batches(0, size, "n long")
