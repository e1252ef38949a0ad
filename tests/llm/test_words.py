"""Spelling variants, fill-in-middle and the Pitman-Yor model against brute force, on awkward tables too."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import infilling, pitman_yor, registry, spelling
from foldwise.llm.common import flat

from test_operators import CLASH, SCHEMA, awkward, prose

LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in (*CLASH, "form", "n", "output", "word", "b", "g", "k")}).cache()


def counted(rows, every=0):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return found


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def grouped(words, ratio=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-words[v], v))
            if words[best] >= ratio * words[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def rows_of(df):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()}


def test_variants(spark, docs):
    """Random words of few letters and their edits, some by letters beyond the alphabet; chains of forms."""
    rnd = random.Random(1)
    texts = [(r[0], r[1]) for r in awkward()]
    base = ["".join(rnd.choice("abcde\u00e9\u00d7") for _ in range(7)) for _ in range(40)]
    for i in range(60):
        words = []
        for _ in range(80):
            w = rnd.choice(base)
            k = rnd.randrange(len(w))
            words += [w] * 6 + [rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("abcdeY\u00e8") + w[k:], w[:k] + rnd.choice("abcdZ") + w[k + 1 :]])]
        texts.append((1000 + i, " ".join(words) + "-" + words[0].upper()))
    texts.append((5000, "abacus " * 2000 + "abacuss " * 300 + "abacusss " * 40 + "abacussss " * 5))
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "form", "k", "size")}).repartition(3)
    words = {w: n for w, n in counted(texts, 7).items() if len(w) >= 6 and n >= 5}
    want = grouped(words)
    assert sum(f is not None for _, f, *_ in want) > 20 and ("abacussss", "abacusss", "abacus", 5, 1, 40) in grouped({w: n for w, n in counted(texts).items() if w.startswith("abacus")})
    assert rows_of(spelling.variants(df, "doc_id", "text", typo_every=7)) == want
    assert spelling.variants(df.limit(0), "doc_id", "text").count() == 0
    assert rows_of(spelling.variants(docs, "doc_id", "text", least_size=4, least_n=2)) == grouped({w: n for w, n in counted((r[0], r[1]) for r in awkward()).items() if len(w) >= 4 and n >= 2})


def test_variants_of_other_letters(spark):
    """Letters of any script: those that share a bit of the mask, and those beyond 16 bits."""
    words = {"\u4e00\u4e01\u4e02\u4e03\u4e04\u4e05": 9, "\u4e00\u4e01\u4e02\u4e03\u4e04\u4e45": 8, "\u4e00\u4e01\u4e02\u4e03\u4e04": 7, "\U0001f600\U0001f601abcd": 6, "\U0001f600\U0001f605abcd": 5, "\U0001f600abcd": 4}
    got = Counter(tuple(sorted((r["a"], r["b"]))) for r in spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect())
    assert got == Counter((a, b) for a in words for b in words if a < b and one_edit(a, b))


def test_variants_query(spark, sf):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    words = {w: n for w, n in counted(texts, 199).items() if len(w) >= 6 and n >= 5}
    assert rows_of(registry.queries()["op11_parity_variants"](spark, sf)) == grouped(words)


def units(text, unit):
    if unit == "characters":
        return list(range(len(text)))
    return [m.start() for m in re.finditer("[^ \t\n\x0b\x0c\r]+", text)]


@pytest.mark.parametrize("unit", ["characters", "words"])
@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_places(unit, chunk):
    """Every rank of every text against a plain scan, over chunks that cut characters and words."""
    import pyarrow as pa

    texts = ["", "a", "\u00e9\u4e00\U0001f642 ab", "  x yz \n\tw", "word", "", "\u00e9" * 9]
    raw, ends = flat(pa.array(["skipped", *texts]).slice(1))
    found = infilling.decomposed(raw, ends, unit, chunk)
    at = [units(t, unit) for t in texts]
    assert found.units.tolist() == list(map(len, at))
    for r in range(14):
        got = infilling.places(raw, ends, found, np.full(len(texts), r), unit) - ends[:-1]
        assert got.tolist() == [len(t[: 0 if r == 0 else a[r] if r < len(a) else None].encode()) for t, a in zip(texts, at)]


def test_fill_in_middle(spark, docs):
    rows = [(r[0], r[1]) for r in awkward()] + [(i, f"x{i} \u00e9\u4e00 " * (i % 9) + "<P" * (i % 3) + ("<S>" if i % 10 == 0 else "")) for i in range(300, 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "n", "form", "output", "h0")}).repartition(3)
    got = infilling.fill_in_middle(df, "doc_id", "text").withColumn("back", infilling.restored()).collect()
    want = Counter()
    for i, t in rows:
        t, h = t or "", hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            want[i, len(t), "plain", None, None, t, t] += 1
        elif h[3] % 100 < 20:
            want[i, len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}", t] += 1
        else:
            want[i, len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", t] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n", "form", "prefix", "middle", "output", "back")) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert infilling.fill_in_middle(df.limit(0), "doc_id", "text").count() == 0
    assert infilling.fill_in_middle(docs, "doc_id", "text", unit="words").where(infilling.restored() == F.col("output")).where("form <> 'plain'").count() == 0
    named = infilling.fill_in_middle(docs.select(F.col("doc_id").alias("middle"), F.col("text").alias("prefix"), "form"), "middle", "prefix")
    assert named.columns[:4] == ["middle", "n", "form", "prefix"] and named.count() == docs.count()


def brute_tokens(text):
    return (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split() + [b"\0 end"]


def test_tokens():
    import pyarrow as pa

    texts = ["", "a B a", " \t", "\u00e9t\u00e9 A\x0bb", prose(3, 500), "A" * 70_000 + " " + "a" * 69_999, "", "b"]
    words, contexts, sizes = pitman_yor.tokens(*flat(pa.array(texts)))
    want = [brute_tokens(t) for t in texts]
    assert sizes.tolist() == list(map(len, want))
    named = {}
    for h, w in zip(words.tolist(), [w for t in want for w in t]):
        assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)
    bits = pitman_yor.BITS
    before = [c for t in want for c in [0, *[(w[-1] << bits) | (named[w] & ((1 << bits) - 1)) for w in t[:-1]]]]
    assert contexts.tolist() == before
    a = np.array([0, 1, 255, 70_000, 2**32 - 1])
    assert pitman_yor.unpack(pitman_yor.pack(a)).tolist() == a.tolist() and pitman_yor.unpack(pitman_yor.pack(a << 20, 8), 8).tolist() == (a << 20).tolist()


def test_seating():
    """Tables of a dish against their exact distribution, from all ways to seat its customers."""
    d, strength, others, p, n = 0.6, 1.0, 4, 0.3, 5
    exact = Counter()
    seatings = {(1,): 1.0}
    for _ in range(n - 1):
        new = Counter()
        for tables, w in seatings.items():
            for k, size in enumerate(tables):
                new[tuple(sorted((*tables[:k], size + 1, *tables[k + 1 :])))] += w * (size - d)
            new[tuple(sorted((*tables, 1)))] += w * (strength + d * (others + len(tables))) * p
        seatings = new
    for tables, w in seatings.items():
        exact[len(tables)] += w
    total = sum(exact.values())
    got = Counter(pitman_yor.reseated(np.full(100_000, n), np.full(100_000, others), np.full(100_000, p), d, strength, np.random.default_rng(1), 12).tolist())
    assert set(got) <= set(exact)
    for k, w in exact.items():
        assert abs(got[k] / 100_000 - w / total) < 0.006
    assert np.abs(pitman_yor.log_gamma(np.array([0.1, 1.5, 30.0, 1e6])) - [math.lgamma(x) for x in (0.1, 1.5, 30.0, 1e6)]).max() < 1e-6
    assert pitman_yor.reseated(np.array([1, 10**12]), np.array([0, 0]), np.array([1e-9, 1e-6]), 0.5, 1.0, np.random.default_rng(2))[0] == 1


@pytest.mark.parametrize("part_bytes", [4 << 20, 3000])
def test_model_of_a_corpus(spark, docs, monkeypatch, part_bytes):
    """Scores and base scores against a plain recomputation from the samples' tables; probabilities add up to 1 in every context."""
    monkeypatch.setattr(pitman_yor, "PART_BYTES", part_bytes)  # the smaller one splits all buckets into parts
    rows = [(r[0], r[1]) for r in awkward()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "n", "held", "chunk", "bucket")}).repartition(3)
    held = F.pmod(F.col("doc_id"), F.lit(3)) == 1
    out = pitman_yor.scored(df, "doc_id", "text", held, bits=3, bucket_bytes=40_000)
    got = {(r["doc_id"], r["n_tokens"]): r for r in out.collect()}
    train = [brute_tokens(t) for i, t in rows if i is None or i % 3 != 1]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        r, t = got[i, len(brute_tokens(t))], brute_tokens(t)
        assert r["held_out"] == (i is not None and i % 3 == 1) and r["train_tokens"] == n and r["n_known"] == sum(w in c for w in t)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel=1e-9)
    assert sum(x["n"] for x in out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()) == len(rows)
    again = {(r["doc_id"], r["n_tokens"]): r["score"] for r in pitman_yor.scored(df, "doc_id", "text", held, bits=3, bucket_bytes=40_000).collect()}
    assert all(again[k] == r["score"] for k, r in got.items())

    bits, buckets = 3, 4
    requests = pitman_yor.requested(df, "doc_id", "text", held, buckets, bits).cache()
    asked, heavy = pitman_yor.parted(requests)
    cells = pitman_yor.counted(asked, heavy, buckets).cache()
    assert (heavy.count() > 1) == (part_bytes == 3000) and cells.groupBy("bucket").count().where("count > 1").count() == 0
    start = pitman_yor.sums_of_ones(cells, bits)
    totals = pitman_yor.totals_of(start, bits, v, None)[0]
    seats = pitman_yor.seated(cells, spark.sparkContext.broadcast(totals), 1, 2, bits, 5).cache()
    samples = pitman_yor.totals_of(pitman_yor.sums_of_samples(seats, bits), bits, v, totals.discounts)
    assert len(samples) == 2 and samples[0].customers[0].sum() == n
    tables = [[{} for _ in range(3)] for _ in samples]
    customers = {}
    for row in seats.collect():
        own = pitman_yor.Cells(row, bits)
        for s in range(2):
            t2, t1, t0 = (pitman_yor.unpack(b) for b in row["seats"][3 * s : 3 * s + 3])
            for k, (w, u) in enumerate(zip(own.words[own.word].tolist(), own.contexts.tolist())):
                customers[w, u] = int(own.n[k])
                tables[s][0][w, u] = int(t2[k])
                assert 1 <= t2[k] <= own.n[k]
            tables[s][1].update(zip(zip(own.words[own.up[1]].tolist(), own.rooms[1].tolist()), t1.tolist()))
            tables[s][2].update(zip(own.words.tolist(), t0.tolist()))

    def p(s, w, u):
        t, d = samples[s], samples[s].discounts
        c1 = sum(k for (x, y), k in by_word[s].get(w, {}).items() if y >> bits == u >> bits)
        c0 = sum(k for (x, g), k in by_parent[s].get(w, {}).items())
        p0 = (c0 - d[2] * tables[s][2].get(w, 0) + (1 + d[2] * t.tables[2][0]) / (v + 1)) / (t.customers[2][0] + 1)
        p1 = (c1 - d[1] * tables[s][1].get((w, u >> bits), 0) + (1 + d[1] * t.tables[1][u >> bits]) * p0) / (t.customers[1][u >> bits] + 1)
        return (customers.get((w, u), 0) - d[0] * tables[s][0].get((w, u), 0) + (1 + d[0] * t.tables[0][u]) * p1) / (t.customers[0][u] + 1)

    by_word, by_parent = [{} for _ in samples], [{} for _ in samples]
    for s in range(2):
        for held_by, t in ((by_word, tables[s][0]), (by_parent, tables[s][1])):
            for (w, u), k in t.items():
                held_by[s].setdefault(w, {})[w, u] = k
    known = list(by_word[0])
    contexts = sorted({u for _, u in customers})
    for u in [*contexts[:: max(1, len(contexts) // 8)], (255 << bits) | 1]:
        for s in range(2):
            assert sum(p(s, w, u) for w in known) + p(s, -1, u) == pytest.approx(1, abs=1e-9)
    answers = pitman_yor.answered(asked, heavy, seats, spark.sparkContext.broadcast(samples), buckets, bits)
    final = {(r["doc_id"], r["n_tokens"]): r["score"] for r in pitman_yor.added_up(requests, answers, "doc_id", n, v, buckets).collect()}
    import pyarrow as pa

    for i, t in rows[5:45:4] + rows[-3:]:
        words, at, _ = pitman_yor.tokens(*flat(pa.array([t or ""])), bits)
        want = sum(math.log10((p(0, w, u) + p(1, w, u)) / 2) for w, u in zip(words.tolist(), at.tolist()))
        assert final[i, len(words)] == pytest.approx(want, rel=1e-5)


def test_model_edges(spark, docs):
    none = pitman_yor.scored(docs.where("doc_id < 5"), "doc_id", "text", F.lit(True)).collect()
    assert len(none) == 5 and all(r["score"] == 0 and r["base_score"] == 0 and r["train_tokens"] == 0 and r["n_known"] == 0 for r in none)
    assert pitman_yor.scored(docs.limit(0), "doc_id", "text", F.lit(False)).count() == 0


def test_model_query(spark, sf):
    """Held-out texts are likelier under the model than under single words; reruns agree."""
    got = registry.queries()["op13_pitman_yor"](spark, sf)
    r = {x["held_out"]: x for x in pitman_yor.perplexity(got).collect()}
    assert r[True]["perplexity"] < 0.6 * r[True]["base_perplexity"] and r[False]["perplexity"] < r[True]["perplexity"]


def test_long_pieces():
    """One piece of a million letters, and long ones of few letters, spaces and the same letter, equal the library's ids within seconds."""
    import time

    from tokenizers import Tokenizer

    from foldwise.llm import bpe

    library = Tokenizer.from_file(bpe.default_tokenizer())
    own = bpe.ByteBPE(open(bpe.default_tokenizer(), encoding="utf-8").read())
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(letters) for _ in range(n)) for letters in ("ab", "aaab", "theion", "abcdefghijklmnopqrstuvwxyz", "\u00e9a\u4e00", " ", "!-=") for n in (999, 1000, 1001, 30_000)]
    texts += ["a" * 50_001, "x" + " " * 20_000 + "y", "word " * 500 + "z" * 1500 + " word" * 500]
    for t, ids, want in zip(texts, own.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == want.ids and own.decode(ids) == library.decode(want.ids, skip_special_tokens=False)
    text = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    start = time.perf_counter()
    ids = own.encode_batch([text])[0]
    assert time.perf_counter() - start < 60  # some seconds on a free machine
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
