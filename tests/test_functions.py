from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foldwise.functions import hashing as h
from foldwise.operators.splits import Policy
from foldwise.plans import search
from foldwise.sources.rows import DataError

LONGS = st.integers(-(1 << 63), (1 << 63) - 1)
PRINT = h.Fingerprint("source-identity", ("table", "v1"), "digest")


def test_known_hashes():
    assert h.fnv1a(b"") == 0xCBF29CE484222325
    assert h.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    # the first word of the published SplitMix64 stream from seed 0
    assert search.Stream(0).word() == 0xE220A8397B1DCDAF


def test_columns_equal_driver(spark):
    ids = [0, 1, -1, 7, 1 << 40, -(1 << 63), (1 << 63) - 1, 123456789, *range(1000, 1200)]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    state = h.rank_state(PRINT, -5)
    got = {r["id"]: r["rank"] for r in h.with_rank(df, "id", state).collect()}
    assert got == {i: h.rank(PRINT, -5, i) for i in ids}
    got = {r["id"]: r["f"] for r in h.with_finalized(df, df["id"], "f").collect()}
    assert got == {i: h.signed(h.finalize(i)) for i in ids}


def test_fingerprints_differ_by_field():
    a = h.rank(PRINT, 0, 1)
    assert a != h.rank(h.Fingerprint("source-identity", ("tabl", "ev1"), "digest"), 0, 1)
    with pytest.raises(ValueError):
        h.Fingerprint("summary", ("a", "b"), "c")
    with pytest.raises(ValueError):
        h.framed("\ud800")


@given(st.integers(3, 10_000), st.fractions(Fraction(1, 50), Fraction(1, 3)), st.fractions(Fraction(1, 50), Fraction(1, 3)))
@settings(max_examples=100, deadline=None)
def test_policy_counts(n, v, t):
    try:
        a, b, c = Policy(v, t).counts(n)
    except DataError as e:
        assert e.code == "EmptySplitRole" and (n * v < 1 or n * t < 1)
    else:
        assert a == int(n * v) and b == int(n * t) and a + b + c == n and min(a, b, c) > 0


def test_policy_errors():
    for bad, code in (((0, None), "InvalidAmount"), ((Fraction(1), None), "InvalidAmount"), ((Fraction(1, 2), Fraction(1, 2)), "FractionsExhaustRows"), ((None, None), "EmptyPolicy")):
        with pytest.raises(DataError, match=code):
            Policy(*bad)
    with pytest.raises(DataError, match="ExhaustiveSplit"):
        Policy(3, 2).counts(5)


def test_spaces():
    s = search.int_range(1, 2) * search.choice("a", "b")
    assert search.grid(s, 3) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]
    assert search.grid(search.log_uniform(1e-4, 1.0), 1) == [1e-4]
    assert search.grid(search.log_uniform(1e-4, 1.0).map(lambda x: x * 2), 3)[1] == pytest.approx(2e-2)
    assert search.random(s, 9, 91) == search.random(s, 9, 91) != search.random(s, 9, 92)
    for bad in (lambda: search.choice(), lambda: search.int_range(0, 3), lambda: search.log_uniform(2, 1), lambda: search.grid(s, 0), lambda: search.random(s, 0, 1)):
        with pytest.raises(DataError):
            bad()


def test_study():
    best, trials = search.study([5, 3, 1, 3], lambda c: abs(c - 3))
    assert (best.index, best.objective, len(trials)) == (1, 0, 4)
    assert search.study([5, 3, 1], lambda c: abs(c - 3), minimize=False)[0].index == 0
    with pytest.raises(DataError, match="NoSuccessfulTrial"):
        search.study([1, 2], lambda c: float("nan"))


@given(LONGS)
@settings(max_examples=200, deadline=None)
def test_signed_round_trip(x):
    assert h.signed(x & h.MASK) == x
