"""Toxicity by class-conditional Kneser-Ney models over characters.

Two models of five-character sequences, one of toxic and one of ordinary texts. Each discounts its counts absolutely and
backs off to one character less; its lower orders hold the class's own counts of texts, summed by suffix, and only the
distribution of single characters under all of them is one of continuations, shared by both classes and taken from all
documents, labelled or not. A text's evidence is its length-normalised log-likelihood ratio: over the whole text, over its
best short and long windows, and what single ratios have beyond a floor, on average; a ratio is first brought nearer to
zero by SURE standard errors, so that a sequence of one or two texts says nothing. A logistic calibration on labelled rows
that the models haven't seen turns these into a score. The README gives the figures of other smoothings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.llm.common import chunks, table
from foldwise.operators.state import checkpoint, skew_join

ORDER, DISCOUNT, SURE = 5, 0.75, 2.5
#: Sequences in a short and a long window, floor of a ratio that counts as excess; most sequences whose ratios are broadcast (others are joined), joined rows in a batch.
SHORT, LONG, FLOOR, KEYS, ROWS = 3, 8, 0.5, 1 << 22, 50_000
EVIDENCE = ("whole", "weight", "peak", "stretch", "excess")
#: Labels are broadcast up to so many rows, else joined by a shuffle; rows that calibrate, at most in expectation; characters at a time.
BROADCAST_LABELS, CALIBRATING, CHUNK = 1_000_000, 20_000, 2 << 20
THRESHOLD = 0.3


def alphabet() -> np.ndarray:
    """The 64 classes of the first 256 code points: space, letters, digit, other ASCII, accented letters, the rest."""
    of = np.full(256, 62, dtype=np.uint32)
    of[:128] = 28
    of[[32, *range(9, 14)]] = 0
    of[97:123] = np.arange(1, 27)
    of[48:58] = 27
    of[0xDF:0x100] = np.arange(29, 62)
    return of


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all five-character sequences (6 bits a character) of the lower-cased texts, and each text's number of them.

    Four spaces stand before each text and one behind it, so that each has a sequence for each character and one for the end.
    """
    padded = [f"    {t.lower()} " for t in texts]
    n = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
    points = np.frombuffer("".join(padded).encode("utf-32-le", errors="surrogatepass"), dtype=np.uint32)
    codes = np.where(points < 256, alphabet()[np.minimum(points, 255)], 29 + points % 35).astype(np.uint32)
    keys = codes[4:].copy()
    for k in range(1, ORDER):
        keys += codes[4 - k : len(codes) - k] << np.uint32(6 * k)
    inner = np.ones(len(codes), dtype=bool)
    first = np.cumsum(n) - n
    for k in range(ORDER - 1):
        inner[first + k] = False
    return keys[inner[4:]], n - (ORDER - 1)


def cell(keys: np.ndarray, cells: int) -> np.ndarray:
    """Fibonacci hashing of 32-bit keys to a power of two of cells."""
    return (keys * np.uint32(2654435769)) >> np.uint32(32 - (cells - 1).bit_length())


class Lookup:
    """Values of different keys in an open-addressed table with two cells a key at least; it holds every key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.cells = 1 << max(10, (2 * len(keys)).bit_length())
        home = cell(keys, self.cells).astype(np.int64)
        order = np.argsort(home, kind="stable")
        rank = np.arange(len(keys))
        at = np.maximum.accumulate(home[order] - rank) + rank  # its own cell, or the next after those before it
        size = max(self.cells, int(at[-1]) + 1 if len(at) else 0) + 1
        self.held, self.of = np.full(size, 0xFFFFFFFF, dtype=np.uint32), np.zeros(size, dtype=np.float32)
        self.held[at], self.of[at] = keys[order], values[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is held, and its value, else 0."""
        at = cell(keys, self.cells).astype(np.int64)
        held = self.held[at]
        known = held == keys
        value = np.where(known, self.of[at], np.float32(0))
        left = np.flatnonzero(~known & (held != 0xFFFFFFFF))
        at = at[left]
        while len(left):
            at += 1
            held = self.held[at]
            hit = held == keys[left]
            known[left[hit]], value[left[hit]] = True, self.of[at[hit]]
            go = ~hit & (held != 0xFFFFFFFF)
            left, at = left[go], at[go]
        return known, value


def counted(docs: DataFrame) -> DataFrame:
    """How many texts have each sequence (key, n_other, n_ordinary, n_toxic), of docs (text, role); role 1 ordinary, 2 toxic, else none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            roles = np.array([r or 0 for r in batch.column(1).to_pylist()], dtype=np.uint64)
            for lo, hi in chunks(np.array([len(t) for t in texts], dtype=np.int64), CHUNK):
                keys, n = grams(texts[lo:hi])
                own = np.sort(np.repeat(np.arange(lo, hi, dtype=np.uint64), n) << np.uint64(6 * ORDER) | keys)
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]  # a text counts once for each of its sequences
                tagged = np.sort((own & np.uint64((1 << 6 * ORDER) - 1)) << np.uint64(2) | roles[own >> np.uint64(6 * ORDER)])
                at = np.flatnonzero(np.concatenate([[True], tagged[1:] != tagged[:-1]]))
                both, number = np.concatenate([held, tagged[at]]), np.concatenate([numbers, np.diff(np.append(at, len(tagged)))])
                order = np.argsort(both, kind="stable")
                both, number = both[order], number[order]
                at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
                held, numbers = both[at], np.add.reduceat(number, at)
        key, role = (held >> np.uint64(2)).astype(np.int64), (held & np.uint64(3)).astype(np.int32)
        for lo in range(0, len(key), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 50_000]) for x in (key, role, numbers)], names=["key", "role", "n"])

    of = lambda k: F.sum(F.when(F.col("role") == k, F.col("n")).otherwise(0))
    return docs.select("text", "role").mapInArrow(count, "key long, role int, n long").groupBy("key").agg(of(0).alias("n_other"), of(1).alias("n_ordinary"), of(2).alias("n_toxic"))


def ratios(counts: DataFrame) -> DataFrame:
    """(key, seen, ratio): how many texts have each whole sequence that a class has, and its log P(toxic)/P(ordinary), as far as it is sure.

    A sequence's probability is the product of its characters' after those before them. A class discounts its counts of two
    to five characters (texts that have a whole sequence, summed by suffix) and spreads what that frees by its own model of
    one character less, at last by the shared distribution of characters, which counts the different sequences that end in
    them in all documents. SURE standard errors of the counts' log ratio are taken off each ratio's size. A sequence that neither class
    has says nothing and is left out.
    """
    types = counts.groupBy(F.col("key").bitwiseAND(F.lit(63)).alias("below")).agg(F.count(F.lit(1)).alias("c"))  # 64 rows
    total = types.agg(F.sum("c")).first()[0] or 0
    lower = types.select("below", ((F.col("c") + 1) / F.lit(total + 64)).alias("p_toxic")).withColumn("p_ordinary", F.col("p_toxic"))
    seen = checkpoint(counts.where(F.col("n_toxic") + F.col("n_ordinary") > 0))
    out = seen.withColumn("raw", F.lit(0.0))
    for order in range(2, ORDER + 1):
        g = seen.groupBy(F.col("key").bitwiseAND(F.lit((1 << 6 * order) - 1)).alias("key")).agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_ordinary").alias("n_ordinary"))
        g = g.withColumns({"context": F.shiftright("key", 6), "below": F.col("key").bitwiseAND(F.lit((1 << 6 * (order - 1)) - 1))}).join(lower, "below")
        by, p = Window.partitionBy("context"), {}
        for k in ("toxic", "ordinary"):
            n, all_n = F.col(f"n_{k}"), F.sum(f"n_{k}").over(by)
            kinds = F.sum((n > 0).cast("long")).over(by)
            p[f"q_{k}"] = F.when(all_n > 0, (F.greatest(n - DISCOUNT, F.lit(0)) + DISCOUNT * kinds * F.col(f"p_{k}")) / all_n).otherwise(F.col(f"p_{k}"))
        g = checkpoint(g.withColumns(p).select("key", "q_toxic", "q_ordinary"))
        lower = g.select(F.col("key").alias("below"), F.col("q_toxic").alias("p_toxic"), F.col("q_ordinary").alias("p_ordinary"))
        step = g.select(F.col("key").alias("start"), F.log(F.col("q_toxic") / F.col("q_ordinary")).alias("step"))
        out = out.withColumn("start", F.shiftright("key", 6 * (ORDER - order))).join(step, "start", "left").withColumn("raw", F.col("raw") + F.coalesce("step", F.lit(0.0))).drop("start", "step")
    error = F.sqrt(1 / (F.col("n_toxic") + 0.5) + 1 / (F.col("n_ordinary") + 0.5))
    ratio = (F.signum("raw") * F.greatest(F.abs("raw") - SURE * error, F.lit(0))).cast("float")
    return out.select("key", (F.col("n_other") + F.col("n_toxic") + F.col("n_ordinary")).alias("seen"), ratio.alias("ratio")).where("ratio <> 0")


def split(model: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The sequences whose ratios are broadcast, at most `most`, and the others, if any.

    The first are those that many texts have, from a power of two on. Of the others no one is in more than about twice as
    many texts as a sequence of the model is on average for each that could be broadcast, so that no key of their join is hot.
    """
    level = F.floor(F.log2(F.greatest("seen", F.lit(1)).cast("double"))).cast("int")
    levels = sorted(map(tuple, model.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    if sum(n for _, n in levels) <= most:
        return model, None
    total, least = 0, levels[0][0] + 1
    for at, n in levels:
        if total + n > most:
            break
        total, least = total + n, at
    return model.where(level >= least), model.where(level < least)


def joined(docs: DataFrame, text: str, known: Broadcast, rest: DataFrame) -> DataFrame:
    """(digest, keys, ratios): what each different text has of the sequences in `rest`, which aren't broadcast.

    The different sequences of each text are dealt by the sequence, joined with the ratios and brought together by the text's
    digest; equal texts become one before the join.
    """

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(np.array([len(t) for t in texts], dtype=np.int64), CHUNK):
                keys, n = grams(texts[lo:hi])
                own = np.unique(np.repeat(np.arange(lo, hi, dtype=np.uint64), n) << np.uint64(6 * ORDER) | keys)
                key = (own & np.uint64((1 << 6 * ORDER) - 1)).astype(np.uint32)
                left = np.flatnonzero(~found(known.value).find(key)[0])
                for at in range(0, len(left), ROWS):
                    some = left[at : at + ROWS]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array((own[some] >> np.uint64(6 * ORDER)).astype(np.int64))), pa.array(key[some].astype(np.int64))], names=["digest", "key"])

    pairs = docs.select(digest(text).alias("digest"), F.col(text).alias("text")).mapInArrow(wanted, "digest string, key long").distinct()
    got = skew_join(pairs, rest.select("key", "ratio"), ["key"]).groupBy("digest").agg(F.collect_list(F.struct("key", "ratio")).alias("got"))
    return got.select("digest", F.col("got.key").alias("keys"), F.col("got.ratio").alias("ratios"))


def digest(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def found(arrays: tuple[np.ndarray, np.ndarray]) -> Lookup:
    """The table of a broadcast, made once in a task."""
    if _made.get("of") is not arrays:
        _made.update(of=arrays, table=Lookup(*arrays))
    return _made["table"]


_made: dict = {}


def evidence(docs: DataFrame, key: str, text: str, model: DataFrame, most: int | None = None) -> DataFrame:
    """`key` and EVIDENCE: the mean ratio over each text's sequences, the same in standard errors (but for a factor), the mean over its best window of SHORT and of LONG sequences, and the logarithm of the sequences' mean excess over FLOOR.

    Every sequence of `model` counts. Up to `most` ratios are broadcast (KEYS by default); if there are more, the others come
    by a join, with equal results.
    """
    common, rest = split(model, KEYS if most is None else most)
    partly = rest is not None
    got = common.select("key", "ratio").toArrow()
    known = docs.sparkSession.sparkContext.broadcast((got["key"].to_numpy().astype(np.uint32), got["ratio"].to_numpy().astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(np.array([len(t) for t in texts], dtype=np.int64), CHUNK):
                keys, n = grams(texts[lo:hi])
                first = np.cumsum(n) - n
                value = found(known.value).find(keys)[1]
                if partly:
                    own, ratio = batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo)
                    for k in np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False)).tolist():
                        at = slice(first[k], first[k] + n[k])
                        has, more = Lookup(own[k].values.to_numpy().astype(np.uint32), ratio[k].values.to_numpy()).find(keys[at])
                        value[at] = np.where(has, more, value[at])
                sums = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
                last = np.repeat(first + n, n)
                window = lambda span: (sums[np.minimum(np.arange(len(value)) + span, last)] - sums[:-1]) / span  # noqa: B023, E731
                total = sums[first + n] - sums[first]
                columns = [
                    total / n,
                    total / np.sqrt(n),
                    np.maximum.reduceat(window(SHORT), first),
                    np.maximum.reduceat(window(LONG), first),
                    np.log(1e-4 + np.add.reduceat(np.maximum(value - FLOOR, 0), first) / n),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, columns)], names=[key, *EVIDENCE])

    rows = docs.select(F.col(key), F.col(text))
    if partly:
        rows = skew_join(rows.withColumn("digest", digest(text)), joined(docs, text, known, rest), ["digest"], "left").select(key, text, "keys", "ratios")
    return rows.mapInArrow(score, f"`{key}` {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{x} double" for x in EVIDENCE))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Coefficients, intercept first, of a ridge-penalised logistic regression by Newton steps; the intercept isn't penalised."""
    x = np.column_stack([np.ones(len(x)), x])
    b, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", calibrating: int = CALIBRATING) -> DataFrame:
    """Toxicity of every whole text: `key`, held_out, score, predicted and EVIDENCE.

    Only rows of `labels` whose crc32(key as text) mod 4 isn't 2 are learnt from: remainders 0 and 1 train the class models,
    remainder 3 (about `calibrating` rows at most) the calibration. A null text counts as empty; a null key has no label and
    isn't held out; a key with several labels is toxic if one says so; null labels are ignored; equal texts score alike;
    other columns are not read. Without labelled rows every score is 0.5; an empty table gives no rows.
    """
    part = lambda c: F.pmod(F.crc32(c.cast("string")), F.lit(4))
    known = checkpoint(labels.select(F.col(key).alias("_key"), F.col(toxic).cast("int").alias("_toxic")).where("_key is not null and _toxic is not null").groupBy("_key").agg(F.max("_toxic").alias("_toxic")).where(part(F.col("_key")) != 2))
    n = known.count()
    side = F.broadcast(known) if n <= BROADCAST_LABELS else known.hint("shuffle_hash")
    trains = F.when(part(F.col(key)) < 2, F.col("_toxic") + 1)
    docs = docs.select(F.col(key), F.col(text).alias("text"))
    roles = docs.join(side, docs[key] == F.col("_key"), "left").select("text", trains.alias("role"))
    model = checkpoint(ratios(checkpoint(counted(roles))))
    found = checkpoint(evidence(docs, key, "text", model))
    sample = found.where(part(F.col(key)) == 3).join(known, found[key] == F.col("_key"))
    share = min(1.0, calibrating / max(1, n / 3))
    got = sample.where(F.pmod(F.xxhash64(F.lit(3), "_key"), F.lit(1_000_000)) < int(share * 1_000_000)).select(*EVIDENCE, "_toxic").toPandas()
    b = logistic(got[list(EVIDENCE)].to_numpy(dtype=float), got["_toxic"].to_numpy(dtype=float)) if len(got) else np.zeros(1 + len(EVIDENCE))
    z = F.lit(float(b[0]))
    for name, weight in zip(EVIDENCE, b[1:].tolist()):
        z = z + F.lit(weight) * F.col(name)
    out = found.withColumn("score", 1 / (1 + F.exp(-z)))
    return out.select(key, F.coalesce(part(F.col(key)) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *EVIDENCE)


def op7_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_kneser_ney_toxicity": op7_kneser_ney_toxicity}
