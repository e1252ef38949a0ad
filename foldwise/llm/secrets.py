"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

The models are trained from labelled samples: strings that the fixed patterns caught and seeded random strings are labelled
random, long words elsewhere ordinary. A token whose mean log-likelihood ratio per character exceeds a margin is a secret.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import table

#: The base patterns, as the scan's contract has them: kind, pattern, the group and least length that count.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: A maximal run that is too short holds no long one, so that the length can stand in the pattern.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")
#: Shortest token that the models judge, and the length from which on letters or digits alone will do and MARGIN holds.
LEAST_TOKEN, LONG_TOKEN = 12, 20
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_TOKEN},}}")
#: Words and numbers that are ordinary; texts at a time.
PLAIN, DOCS = re.compile(r"[A-Za-z]{8,}(?:[_-][A-Za-z]+)*|[0-9]{8,}"), 200
LETTER, DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")
#: Classes of characters: one for each of these, one for any other, one for both ends.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
OTHER, END = len(ALPHABET), len(ALPHABET) + 1
STATES = END + 1
CODES = np.full(256, OTHER, dtype=np.int64)
CODES[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(len(ALPHABET))
#: Generated random strings per alphabet, smoothing, margin in nats per character of a long token.
GENERATED, SMOOTHING, MARGIN, SEED = 1500, 0.5, 1.0, 5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches in `text`, sorted."""
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if any(len(w) >= 24 for w in text.split()):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of tokens that don't overlap the spans in `taken`; those below LONG_TOKEN characters must have letters and digits."""
    if not any(len(w) >= LEAST_TOKEN for w in text.split()):
        return []
    found = [m.span() for m in TOKEN.finditer(text) if m.end() - m.start() >= LONG_TOKEN or DIGIT.search(m.group()) and LETTER.search(m.group())]
    return [(s, e) for s, e in found if not any(s < b and a < e for a, _, b in taken)]


def transitions(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Transition codes of all strings, ends included, and the number of transitions of each string."""
    raw = [s.encode("ascii", errors="replace") for s in strings]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 2
    codes = np.full(int(sizes.sum()), END, dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    inner = np.ones(len(codes), dtype=bool)
    inner[first] = False
    inner[first + sizes - 1] = False
    codes[inner] = CODES[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    pairs = codes[:-1] * STATES + codes[1:]
    within = np.ones(len(codes), dtype=bool)
    within[first + sizes - 1] = False
    return pairs[within[:-1]], sizes - 1


def generated_samples(seed: int = SEED) -> pd.DataFrame:
    """Seeded random strings over hexadecimal, alphanumeric and base64 alphabets, labelled random, and plain numbers, labelled ordinary."""
    rng, rows = np.random.default_rng(seed), []
    for letters in ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64], "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
        picks = rng.integers(0, len(letters), size=(GENERATED, 32))
        rows += ["".join(letters[i] for i in p) for p in picks.tolist()]
    numbers = ["".join(map(str, rng.integers(0, 10, n).tolist())) for n in rng.integers(8, 24, GENERATED)]
    return pd.DataFrame({"string": rows + numbers, "label": [1] * len(rows) + [0] * len(numbers)})


def sample_strings(texts: list[str | None]) -> tuple[list[str], list[int]]:
    """Strings of the texts and their labels.

    Label 1: what the base patterns caught. Label 0: long words and numbers elsewhere, as they
    are, in upper and lower case, and as identifiers made of two neighbours. Null texts give none.
    """
    strings, labels = [], []
    for t in texts:
        if not t:
            continue
        spans = base_spans(t)
        strings += [t[s:e] if k else ASSIGN.match(t, s).group(2) for s, k, e in spans]
        labels += [1] * len(spans)
        caught = [t[s:e] for s, _, e in spans]
        plain = [w for w in PLAIN.findall(t) if not any(w in x for x in caught)]
        named = [x for a, b in pairwise(plain) for x in (f"{a}_{b}".lower(), a.lower() + b.capitalize(), f"{a}/{b}".lower(), f"{a}-{b}".lower())]
        strings += [x for w in plain for x in (w, w.lower(), w.upper())] + named
        labels += [0] * (len(strings) - len(labels))
    return strings, labels


def labelled_samples(df: DataFrame, text: str, seed: int = SEED) -> DataFrame:
    """`sample_strings` (string, label) of all texts, besides generated ones."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), DOCS):
                strings, labels = sample_strings(batch.column(0).slice(lo, DOCS).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(strings, pa.string()), pa.array(labels, pa.int32())], names=["string", "label"])

    made = df.sparkSession.createDataFrame(generated_samples(seed), "string string, label int")
    return df.select(F.col(text).alias("text")).mapInArrow(gather, "string string, label int").unionByName(made)


def transition_counts(strings: list[str], labels: list[int]) -> np.ndarray:
    """How often each label's strings have each transition."""
    total = np.zeros((2, STATES * STATES), dtype=np.int64)
    for k in (0, 1):
        if some := [s for s, label in zip(strings, labels) if label == k]:
            total[k] += np.bincount(transitions(some)[0], minlength=STATES * STATES)
    return total


def _ratios(counted: DataFrame, more: np.ndarray) -> np.ndarray:
    """Log-likelihood ratios from the tasks' counts (label, pair, n); the driver gets at most 2 * STATES**2 sums."""
    counts = SMOOTHING + more.astype(float)
    for r in counted.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        counts[r["label"], r["pair"]] += r["n"]
    counts = counts.reshape(2, STATES, STATES)
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return (logs[1] - logs[0]).reshape(-1)


def _as_batch(total: np.ndarray) -> pa.RecordBatch:
    k, pair = np.nonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(pair, pa.int64()), pa.array(total[k, pair])], names=["label", "pair", "n"])


def train(samples: DataFrame) -> np.ndarray:
    """Log-likelihood ratio, random against ordinary, of each transition, from (string, label). Without samples of a label its model is uniform."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, STATES * STATES), dtype=np.int64)
        for batch in batches:
            for lo in range(0, len(batch), 50_000):
                total += transition_counts(*(c.slice(lo, 50_000).to_pylist() for c in batch.columns[:2]))
        yield _as_batch(total)

    some = samples.where("string is not null and label is not null").select("string", "label")
    return _ratios(some.mapInArrow(count, "label int, pair long, n long"), np.zeros((2, STATES * STATES)))


def learn(df: DataFrame, text: str, seed: int = SEED) -> np.ndarray:
    """As `train(labelled_samples(df, text))`, but tasks count as they gather, so that they hold the strings of a few texts only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, STATES * STATES), dtype=np.int64)
        for batch in batches:
            for lo in range(0, len(batch), DOCS):
                total += transition_counts(*sample_strings(batch.column(0).slice(lo, DOCS).to_pylist()))
        yield _as_batch(total)

    made = generated_samples(seed)
    return _ratios(df.select(F.col(text).alias("text")).mapInArrow(count, "label int, pair long, n long"), transition_counts(made["string"].tolist(), made["label"].tolist()))


def markov_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], ratios: np.ndarray, margin: float = MARGIN) -> list[list[tuple[int, int, int]]]:
    """For each text, the spans that the models add."""
    where = [(i, s, e) for i, t in enumerate(texts) for s, e in candidates(t, bases[i])]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if where:
        pairs, n = transitions([texts[i][s:e] for i, s, e in where])
        mean = np.add.reduceat(ratios[pairs], np.cumsum(n) - n) / n
        for (i, s, e), x in zip(where, mean.tolist()):
            if x > margin * max(1.0, LONG_TOKEN / (e - s)) ** 0.5:  # a mean of few characters varies more
                out[i].append((s, 3, e))
    return out


def all_spans(texts: list[str], ratios: np.ndarray, margin: float = MARGIN) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """The base spans of each text, and these with the models' spans."""
    bases = [base_spans(t) for t in texts]
    return bases, [sorted(b + m) for b, m in zip(bases, markov_spans(texts, bases, ratios, margin))]


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """`text` with every run of overlapping spans replaced by `mask`."""
    out, end = [], 0
    for s, _, e in spans:
        if s >= end:
            out += [text[end:s], mask]
        end = max(end, e)
    return "".join(out) + text[end:]


def scan(df: DataFrame, key: str, text: str, ratios: np.ndarray, margin: float = MARGIN) -> DataFrame:
    """Secrets of every whole text: `key`, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start, then kind as in KINDS. A null text counts as empty and
    has no spans; equal rows give equal results; texts are never cut; other columns are not read; an empty
    table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                bases, spans = all_spans(["" if t is None else t for t in batch.column(1).to_pylist()], ratios, margin)
                columns = [batch.column(0), *(pa.array([sum(k == x[1] for x in b) for b in bases], pa.int64()) for k in range(3))]
                columns += [pa.array([hashlib.sha256(said(b).encode()).hexdigest() for b in bases], pa.string()), pa.array(map(said, spans), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def redact(df: DataFrame, text: str, ratios: np.ndarray, mask: str = "[SECRET]", margin: float = MARGIN) -> DataFrame:
    """`df` with every secret in the column `text` replaced by `mask`; nulls stay null, all other columns as they are."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 1000):
                batch = whole.slice(lo, 1000)
                given = batch.column(at).to_pylist()
                spans = all_spans(["" if t is None else t for t in given], ratios, margin)[1]
                clean = pa.array([t if not s else masked(t, s, mask) for t, s in zip(given, spans)], pa.string())
                yield pa.RecordBatch.from_arrays([clean if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return df.mapInArrow(run, df.schema)


def op10_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, "doc_id", "text", learn(docs, "text"))


QUERIES = {"op10_markov_secrets": op10_markov_secrets}
