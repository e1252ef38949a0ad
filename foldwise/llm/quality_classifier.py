"""Quality classification by co-training two views of a document.

One classifier sees the text's content, the other the page's metadata (source, language, size, number of lines). Both start
from labelled rows. In each round each view labels the rows of the pool that it is surest of, at either end, for the other,
with its calibrated probability. The pool is all rows without a label: tasks sum what the fits need of it. Labelled rows that
neither view learns from calibrate the views and their combination, which scores all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import table
from foldwise.llm.quality_rules import with_measures
from foldwise.llm.toxicity import logistic
from foldwise.operators.state import skew_join, written

#: Labelled rows that the fit sees at most (in expectation), chosen by a seeded hash of the row; labels are broadcast up to so many rows.
LABELLED, BROADCAST_LABELS, SEED = 40_000, 1_000_000, 23
#: Rounds; the share of rows at either end that a view is sure of; weight of all pseudo-labels to all labels; least score of a kept document.
ROUNDS, SURE, WEIGHT, THRESHOLD = 4, 0.1, 0.5, 0.5
#: Hash buckets of sources and of languages, classes of sizes and of numbers of lines (powers of four).
SOURCES, LANGUAGES, SIZES, LINES = 32, 8, 12, 6
CELLS = SOURCES * LANGUAGES * SIZES * LINES
TEXT_VIEW = ("words", "word_length", "symbols", "dup_lines", "repeats", "upper", "marks", "digits", "stops", "distinct", "line_words")
D = len(TEXT_VIEW) + 1
#: Penalties of the text view's coefficients; the intercept has next to none.
RIDGE = np.array([1e-6] + [1.0] * (D - 1))


def measured(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", quality: str = "quality", also: list[str] | None = None) -> DataFrame:
    """A table of `key`, the columns `also`, y (1, 0, or null), held, the features of TEXT_VIEW and cell (the metadata) of each row of `df`.

    Null keys and null labels count as unlabelled; a key with several labels takes the least; a null text has no words;
    null metadata have buckets of their own; other columns are not read.
    """
    among = lambda pattern: F.length(F.regexp_replace(F.coalesce(F.col("_text"), F.lit("")), pattern, ""))
    measures = {"_upper": among(r"[^\p{Lu}]+"), "_marks": among(r"[^!?|]+"), "_digits": among(r"[^0-9]+"), "_stops": among(r"[^.,]+"), "_kinds": F.size(F.array_distinct("_words")), "_many": F.size("_lines")}
    step = lambda n, most: F.least(F.floor(F.log2(F.greatest(n, F.lit(0)) + 1) / 2), F.lit(most - 1))
    page = (F.pmod(F.xxhash64(F.col(source).cast("string")), F.lit(SOURCES)) * LANGUAGES + F.pmod(F.xxhash64(F.col(lang).cast("string")), F.lit(LANGUAGES))) * SIZES + step(F.coalesce(F.col(n_chars), F.lit(0)), SIZES)
    rows = df.select(F.col(key).alias("_doc"), *(F.col(c) for c in also or []), page.alias("_page"), F.col(text).alias("_text"))
    m = with_measures(rows, "_text", measures)
    words, chars, lines = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1)), F.greatest("_many", F.lit(1))
    features = (
        F.log1p("n_words"), F.col("word_chars") / words, F.col("n_symbols") / chars, F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words, F.col("_upper") / chars,
        F.col("_marks") / words, F.col("_digits") / chars, F.col("_stops") / words, F.col("_kinds") / words, F.log1p(words / lines),
    )
    m = m.select("_doc", *(also or []), *(f.alias(k) for k, f in zip(TEXT_VIEW, features)), (F.col("_page") * LINES + step(F.col("_many"), LINES)).cast("int").alias("cell"))
    known = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(key).alias("_doc")).agg(F.min(F.col(quality).cast("int")).alias("y"))
    known = written(known)
    m = m.join(F.broadcast(known), "_doc", "left") if known.count() <= BROADCAST_LABELS else skew_join(m, known, ["_doc"], "left")
    held = F.coalesce(F.pmod(F.xxhash64(F.lit(SEED + 1), "_doc"), F.lit(4)) == 0, F.lit(False))
    return written(m.select(F.col("_doc").alias(key), *(also or []), "y", held.alias("held"), *TEXT_VIEW, "cell"))


@dataclass
class CoTrained:
    """Coefficients of both views, their calibration lines, the scales of the text view, the combination's weights, and how many pseudo-labels (text view, metadata view) got in the last round."""

    mean: np.ndarray
    scale: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    lines: tuple[np.ndarray, np.ndarray]
    sure: tuple[tuple[float, float], tuple[float, float]]
    combined: np.ndarray
    pseudo: tuple[int, int] = (0, 0)

    def columns(self) -> tuple[Column, Column, Column]:
        """Log odds of quality by text, by metadata and combined, as expressions over `measured` columns."""
        t = F.lit(float(self.text[0]))
        for k, name in enumerate(TEXT_VIEW):
            t = t + F.lit(float(self.text[k + 1])) * F.least(F.greatest((F.col(name) - float(self.mean[k])) / float(self.scale[k]), F.lit(-8.0)), F.lit(8.0))
        m, at = F.lit(float(self.meta[0])), 1
        for many, below in ((SOURCES, LANGUAGES * SIZES * LINES), (LANGUAGES, SIZES * LINES), (SIZES, LINES), (LINES, 1)):
            m = m + F.element_at(F.array(*[F.lit(float(x)) for x in self.meta[at : at + many]]), (F.floor(F.col("cell") / below) % many + 1).cast("int"))
            at += many
        return t, m, F.lit(float(self.combined[0])) + F.lit(float(self.combined[1])) * t + F.lit(float(self.combined[2])) * m


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def curvature(z: np.ndarray) -> np.ndarray:
    """Weights of a quadratic that touches the logistic loss at z and lies above it elsewhere, so that no step can overshoot."""
    z = np.maximum(np.abs(z), 1e-6)
    return np.tanh(z / 2) / (2 * z)


def text_matrix(features: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(features)), np.clip((features - mean) / scale, -8, 8)])


def meta_matrix(cell: np.ndarray) -> np.ndarray:
    """One column for each source, language, size and number of lines, after the intercept's."""
    hot = lambda at, many: np.eye(many)[at % many]
    return np.hstack([np.ones((len(cell), 1)), hot(cell // (LANGUAGES * SIZES * LINES), SOURCES), hot(cell // (SIZES * LINES), LANGUAGES), hot(cell // LINES, SIZES), hot(cell, LINES)])


def pool_sums(x: np.ndarray, cell: np.ndarray, m: CoTrained, meta_odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a round needs of the pool's rows (x: `text_matrix`): for each cell the number of rows that the text view is sure of
    and the sum of their probabilities; for the rows whose metadata are sure, their number and the text view's gradient and
    bounding Hessian, flat, with the metadata's probabilities as targets."""
    odds = m.lines[0][0] + m.lines[0][1] * (x @ m.text)
    own = (odds <= m.sure[0][0]) | (odds >= m.sure[0][1])
    cells = np.stack([np.bincount(cell[own], minlength=CELLS), np.bincount(cell[own], sigmoid(odds[own]), minlength=CELLS)])
    odds = meta_odds[cell]
    other = (odds <= m.sure[1][0]) | (odds >= m.sure[1][1])
    x, target = x[other], sigmoid(odds[other])
    z = x @ m.text
    return cells, np.concatenate([[other.sum()], x.T @ (target - sigmoid(z)), ((x * curvature(z)[:, None]).T @ x).ravel()])


def summed(pool: DataFrame, m: CoTrained) -> tuple[np.ndarray, np.ndarray]:
    """`pool_sums` over all rows of `pool` (TEXT_VIEW, cell): tasks add up, the driver gets at most 2 * CELLS + D * (D + 1) + 1 sums."""
    meta_odds = m.lines[1][0] + m.lines[1][1] * (meta_matrix(np.arange(CELLS)) @ m.meta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, sums = np.zeros((2, CELLS)), np.zeros(1 + D + D * D)
        for batch in batches:
            for lo in range(0, len(batch), 20_000):
                some = batch.slice(lo, 20_000)
                x = np.column_stack([c.to_numpy() for c in some.columns[:-1]]).reshape(len(some), D - 1)
                a, b = pool_sums(text_matrix(x, m.mean, m.scale), some.columns[-1].to_numpy().astype(np.int64), m, meta_odds)
                cells, sums = cells + a, sums + b
        some = np.flatnonzero(cells[0])
        at = np.concatenate([some, CELLS + some, 2 * CELLS + np.arange(len(sums))])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([cells[0, some], cells[1, some], sums]))], names=["at", "value"])

    out = np.zeros(2 * CELLS + 1 + D + D * D)
    for r in pool.select(*TEXT_VIEW, "cell").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out[: 2 * CELLS].reshape(2, CELLS), out[2 * CELLS :]


def co_train(x: np.ndarray, cell: np.ndarray, y: np.ndarray, held: np.ndarray, mean: np.ndarray, scale: np.ndarray, pool, rounds: int = ROUNDS) -> CoTrained:
    """Both views and their combination. x (`text_matrix`), cell, y and held are labelled rows; `pool(model)` gives the sums of `pool_sums` over all others."""
    learns, meta = ~held, meta_matrix(cell)
    both = len(set(y[held].tolist())) == 2
    line = lambda odds: logistic(odds[:, None], y[held].astype(float)) if both else np.array([0.0, 1.0])
    m = CoTrained(mean, scale, weighted_logistic(x[learns], y[learns], np.ones(learns.sum())), weighted_logistic(meta[learns], y[learns], np.ones(learns.sum())), (np.array([0.0, 1.0]),) * 2, ((0.0, 0.0),) * 2, np.array([0.0, 1.0, 0.0]))
    every = np.arange(CELLS)
    for k in range(rounds + 1):
        odds = (x @ m.text, meta @ m.meta)
        m.lines = tuple(line(o[held]) for o in odds)
        rate = np.log((y[learns].sum() + 0.5) / (len(y[learns]) - y[learns].sum() + 0.5))
        ends = [np.quantile(a + b * o[learns], (SURE, 1 - SURE)) if learns.any() else (-np.inf, np.inf) for o, (a, b) in zip(odds, m.lines)]
        m.sure = tuple((float(min(lo, rate)) + 1e-9, float(max(hi, rate)) - 1e-9) for lo, hi in ends)  # surer than the classes' rate
        if k == rounds or not learns.any():
            break
        cells, sums = pool(m)
        m.pseudo = (int(sums[0]), int(cells[0].sum()))
        z = x[learns] @ m.text
        share = WEIGHT * learns.sum() / max(1.0, sums[0])
        gradient = x[learns].T @ (y[learns] - sigmoid(z)) - RIDGE * m.text + share * sums[1 : 1 + D]
        hessian = (x[learns] * curvature(z)[:, None]).T @ x[learns] + np.diag(RIDGE) + share * sums[1 + D :].reshape(D, D)
        some = np.flatnonzero(cells[0])
        given = np.concatenate([meta[learns], meta_matrix(every[some])])
        target = np.concatenate([y[learns], cells[1, some] / np.maximum(cells[0, some], 1)])
        weight = np.concatenate([np.ones(learns.sum()), WEIGHT * learns.sum() / max(1.0, cells[0].sum()) * cells[0, some]])
        m.text = m.text + np.linalg.solve(hessian, gradient)  # a step a round
        m.meta = weighted_logistic(given, target, weight)
    if both:
        m.combined = logistic(np.column_stack([x[held] @ m.text, meta[held] @ m.meta]), y[held].astype(float))
    return m


def weighted_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic coefficients for targets between 0 and 1 by damped Newton steps; the first column of x is the intercept's."""
    b, keep = np.zeros(x.shape[1]), np.array([1e-6] + [1.0] * (x.shape[1] - 1))
    loss = lambda b: (w * (np.logaddexp(0, z := x @ b) - y * z)).sum() + (keep * b * b).sum() / 2
    now = loss(b)
    for _ in range(100):
        p = sigmoid(x @ b)
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (w * (y - p)) - keep * b)
        while (new := loss(b + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if np.abs(step).max() < 1e-9:
            break
        b, now = b + step, new
    return b


def fit(rows: DataFrame, labelled: int = LABELLED) -> CoTrained:
    """Co-train on the table `rows` (see `measured`).

    Means, scales and pseudo-labels come from all rows. Of the labelled rows, equal ones once, about `labelled` are used at
    most, chosen by a seeded hash of the whole row, so that null or repeated keys are no hot spot. Without labels everything
    scores 0.5.
    """
    stats = rows.agg(F.count("y").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in TEXT_VIEW for f in (F.avg, F.stddev_pop))).first()
    rounded = lambda x, other: float(f"{other if x is None else x:.9g}")
    mean, scale = (np.array([rounded(stats[f"{f}_{c}"], 0.0) for c in TEXT_VIEW]) for f in ("avg", "stddev_pop"))
    scale = np.where(scale > 0, scale, 1.0)
    share = min(1.0, labelled / max(1, stats["n"]))
    columns = ["y", "held", *TEXT_VIEW, "cell"]
    place = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), rows.columns[0], *columns), 11) / float(1 << 53)
    got = rows.where(F.col("y").isNotNull()).where(place < share).select(rows.columns[0], *columns).distinct().toPandas().sort_values([*columns], kind="stable")
    x = text_matrix(got[list(TEXT_VIEW)].to_numpy(dtype=float).reshape(-1, D - 1), mean, scale)
    pool = rows.where(F.col("y").isNull())
    return co_train(x, got["cell"].to_numpy(dtype=np.int64), got["y"].to_numpy(dtype=float), got["held"].to_numpy(dtype=bool), mean, scale, lambda m: summed(pool, m))


def scored(rows: DataFrame, model: CoTrained, also: list[str] | None = None) -> DataFrame:
    """(key, the columns `also`, score, kept, text_odds, meta_odds) of every row of a `measured` table; equal rows score alike; an empty table gives no rows."""
    t, m, z = model.columns()
    score = 1 / (1 + F.exp(-z))
    return rows.select(rows.columns[0], *(also or []), score.alias("score"), (score >= THRESHOLD).alias("kept"), t.alias("text_odds"), m.alias("meta_odds"))


def op8_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored(rows, fit(rows))


QUERIES = {"op8_co_training": op8_co_training}
