"""Ridge regression from aggregates: the data is scanned a few times whatever the solver, and only d x d numbers reach the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions import tiles
from foldwise.functions.exact import near
from foldwise.operators.coordinates import View
from foldwise.operators.scalers import vector_spread
from foldwise.operators.stages import Learner, Stage, checked
from foldwise.operators.tree import added, tree_fold
from foldwise.sources.rows import DataError, Rows

#: The solvers that come along: on d x d sums (cholesky, lsqr, cg), on triangles (qr), on the rows themselves (row-lsqr, row-cg).
SOLVERS = ("cholesky", "qr", "lsqr", "cg")
ROW_SOLVERS = ("row-lsqr", "row-cg")


@dataclass(frozen=True)
class Config:
    penalty: float
    intercept: bool = True
    tolerance: float = 1e-10
    solver: str = "cholesky"
    iterations: int = 1000

    def __post_init__(self) -> None:
        if not (math.isfinite(self.penalty) and self.penalty >= 0):
            raise DataError("InvalidPenalty", str(self.penalty))
        if not (math.isfinite(self.tolerance) and self.tolerance > 0):
            raise DataError("InvalidTolerance", str(self.tolerance))
        if self.solver not in BACKENDS:
            raise DataError("UnknownSolver", self.solver)
        BACKENDS[self.solver].check(self)
        if self.iterations < 1:
            raise DataError("InvalidIterations", str(self.iterations))


@dataclass(frozen=True)
class Receipt:
    """How the solution came about. Reaching the last iteration is no failure, but told."""

    solver: str
    iterations: int
    termination: str
    residual: float
    passes: int = 0
    assumptions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Gram:
    """Weighted sums of centred data: sw, sx (d), sy, sxx (d x d), sxy (d), syy, and the centre that was taken off before; rows and the coordinates' ranges."""

    sw: float
    sx: np.ndarray
    sy: float
    sxx: np.ndarray
    sxy: np.ndarray
    syy: float
    centre: np.ndarray
    y_centre: float
    n: int
    low: np.ndarray
    high: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        ranges = np.minimum(self.low, other.low), np.maximum(self.high, other.high)
        return Gram(self.sw + other.sw, self.sx + other.sx, self.sy + other.sy, self.sxx + other.sxx, self.sxy + other.sxy, self.syy + other.syy, self.centre, self.y_centre, self.n + other.n, *ranges)

    def scaled(self, mean: np.ndarray | None, inverse: np.ndarray) -> Gram:
        """The sums of the same rows after (x - mean) * inverse, or x * inverse; no row is read."""
        about = lambda x: (x if mean is None else x - mean) * inverse
        return replace(self, sx=self.sx * inverse, sxx=self.sxx * np.outer(inverse, inverse), sxy=self.sxy * inverse, centre=about(self.centre), low=about(self.low), high=about(self.high))

    def centred(self, intercept: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Gram matrix and right side about these rows' own means (or about zero), and the means."""
        if not intercept:
            mean, ym = -self.centre, -self.y_centre  # back to the origin
        else:
            mean, ym = self.sx / self.sw, self.sy / self.sw
        a = self.sxx - np.outer(self.sx, mean) - np.outer(mean, self.sx) + self.sw * np.outer(mean, mean)
        b = self.sxy - self.sx * ym - mean * self.sy + self.sw * mean * ym
        return a, b, mean + self.centre, ym + self.y_centre

    def squares(self, coefficients: np.ndarray, intercept: float) -> float:
        """The sum of squared residuals of a model over these rows."""
        c = intercept + coefficients @ self.centre - self.y_centre  # the model's intercept for the centred data
        return float(self.syy - 2 * coefficients @ self.sxy - 2 * c * self.sy + coefficients @ self.sxx @ coefficients + 2 * c * coefficients @ self.sx + c * c * self.sw)


def weight_of(rows: Rows, weighted: bool) -> Column:
    if weighted and not rows.weight:
        raise DataError("NoWeight")
    return F.col(rows.weight).cast("double") if weighted else F.lit(1.0)


@dataclass(frozen=True)
class Centre:
    """Round numbers near the means of features and target, that are taken off before anything is multiplied; the row count and the sizes of what remains."""

    x: np.ndarray
    y: float
    n: int
    off: np.ndarray
    y_off: float
    weight: float


def view_of(rows: Rows, view: View | None) -> View:
    return view or View(rows.features)


def centre(rows: Rows, weighted: bool, view: View | None = None) -> Centre:
    """Where to take the sums, with the first bad row found on the way: weight, then target, then coordinates."""
    view = view_of(rows, view)
    view.check(rows.df)
    w, y = weight_of(rows, weighted), F.col(rows.target).cast("double")
    unfit = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    code = F.when(unfit(w), "NonFiniteWeight").when(w < 0, "NegativeWeight").when(unfit(y), "NonFiniteTarget").otherwise(view.problem(rows)["code"])
    bad = F.min(F.when(code.isNotNull(), F.struct(F.col(rows.row_id).alias("row"), code.alias("code"))))
    columns = [*([] if view.column else view.columns(rows.df)), y]
    aggs = [a(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, a in (("m", F.avg), ("l", F.min), ("h", F.max))]
    r = rows.df.agg(F.count(F.lit(1)).alias("n"), bad.alias("bad"), F.max(w).alias("w"), *aggs).first()
    if not r["n"]:
        raise DataError("EmptyData")
    if r["bad"]:
        raise DataError(r["bad"]["code"], f"row {r['bad']['row']}")
    if r["w"] <= 0:
        raise DataError("ZeroTotalWeight")
    seen = [(r[f"m{i}"], r[f"l{i}"], r[f"h{i}"]) for i in range(len(columns))]
    if view.column:
        got = vector_spread(rows.df, view)
        seen = [*zip((got["sum"] / got["n"][0]).tolist(), got["low"].tolist(), got["high"].tolist()), *seen]
    at = [near(*x) for x in seen]
    off = [max(abs(low - c), abs(high - c)) for (_, low, high), c in zip(seen, at)]
    return Centre(np.array(at[:-1], dtype=float), at[-1], r["n"], np.array(off[:-1], dtype=float), off[-1], float(r["w"]))


#: Doubles of a matrix that a task multiplies at once.
AT_ONCE = 1 << 22


def _parts(batches, view: View, first: int, sparse: bool = False):
    """The batches as (batch, matrix of coordinates), in parts of bounded size; `sparse`: those of a sparse view as they are."""
    if sparse and view.sparse:
        yield from ((batch, view.rows(batch, first)) for batch in batches if len(batch))
        return
    rows = max(1, AT_ONCE // max(1, len(view)))
    for whole in batches:
        for lo in range(0, len(whole), rows):
            batch = whole.slice(lo, rows)
            yield batch, view.matrix(batch, first)


@dataclass(frozen=True)
class Sums:
    """How products about a point become whole numbers, and whole numbers Gram sums: what states of the same pass share."""

    point: np.ndarray
    left: np.ndarray
    e: np.ndarray

    @classmethod
    def about(cls, at: Centre, weighted: bool) -> Sums:
        size = np.concatenate([at.off, [at.y_off, 1.0]])
        if not np.isfinite(size).all():
            raise DataError("NonFiniteSolution")
        e = tiles.exponents(size)
        return cls(np.append(at.x, at.y), e + (tiles.exponents(np.array([at.weight]))[0] if weighted else 0), e)

    def matrix(self, state: dict) -> np.ndarray:
        out = tiles.total(state, self.left[:, None] + self.e[None, :], 2 * tiles.BITS)
        if not np.isfinite(out).all():
            raise DataError("NonFiniteSolution")
        return out

    def gram(self, g: np.ndarray, mean: np.ndarray, state: dict) -> Gram:
        """A matrix of sums, taken about the mean."""
        d = len(self.point) - 1
        sw, single, two = g[-1, -1], g[:-1, -1], (g[:-1, :-1] + g[:-1, :-1].T) / 2
        two = two - np.outer(mean, single) - np.outer(single, mean) + sw * np.outer(mean, mean)
        one = single - mean * sw
        return Gram(float(sw), one[:d], float(one[d]), two[:d, :d], two[:d, d], float(two[d, d]), self.point[:d] + mean[:d], float(self.point[d] + mean[d]), int(state["n"][0]), state["least"], state["most"])


def merged(a: dict, b: dict) -> dict:
    """The state of both states' rows."""
    sums = added({k: a[k] for k in ("high", "low", "n")}, b)
    return sums | {"least": np.minimum(a["least"], b["least"]), "most": np.maximum(a["most"], b["most"])}


def states(rows: Rows, weighted: bool, sums: Sums, by: str | None, view: View | None, most: int | None = None):
    """What to fold, and the fold's step: batches to states by None or the values of the column `by`; with `most`, an iterator of such dicts of some `most` keys."""
    view = view_of(rows, view)
    point, left, e = sums.point, sums.left, sums.e
    keys = int(by is not None)
    frame = rows.df.select(*([F.col(by).alias("_by")] if keys else []), weight_of(rows, weighted).alias("_w"), F.col(rows.target).cast("double").alias("_y"), *view.columns(rows.df))

    def parts(batches):
        held: dict = {}
        for batch, x in _parts(batches, view, 2 + keys):
            y, w = (batch.column(i + keys).to_numpy(zero_copy_only=False) for i in (1, 0))
            z = np.column_stack([np.column_stack([x, y]) - point, np.ones(len(x))])
            groups, of = [None], np.zeros(len(x), dtype=np.int64)
            if keys:
                groups = batch.column(0).unique().to_pylist()
                of = np.array([groups.index(k) for k in groups])[batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)] if len(groups) > 1 else of
            for i, k in enumerate(groups):
                own = z if len(groups) == 1 else z[of == i]
                if not len(own):
                    continue
                state = tiles.products(own * (w if len(groups) == 1 else w[of == i])[:, None] if weighted else own, own, left, e) | {"n": np.array([len(own)])}
                coordinates = x if len(groups) == 1 else x[of == i]
                state |= {"least": coordinates.min(axis=0), "most": coordinates.max(axis=0)}
                held[k] = merged(held[k], state) if k in held else state
            if most and len(held) >= most:
                yield held
                held = {}
        yield held

    return frame, parts if most else lambda batches: next(parts(batches))


def grams(rows: Rows, weighted: bool, at: Centre, by: str | None = None, view: View | None = None) -> dict:
    """The Gram sums about the weighted means, of all rows under None, or of each value of the column `by`, in one pass.

    Tasks multiply blocks of rows in whole numbers (see `tiles`), so the sums don't depend on the order of the rows. With
    `by`, all groups are taken about the same point, so that they add up. d x d numbers a group reach the driver.
    """
    d, sums = len(at.x), Sums.about(at, weighted)
    frame, step = states(rows, weighted, sums, by, view)
    found = {k: (sums.matrix(s), s) for k, s in tree_fold(frame, step, merged).items()}
    # groups in a fixed order, so that their sum has the same bits whichever task came first
    found = dict(sorted(found.items(), key=lambda x: (x[0] is None, str(type(x[0])), x[0] if x[0] is not None else 0)))
    total = sum(g[-1, -1] for g, _ in found.values())
    mean = sum(g[:-1, -1] for g, _ in found.values()) / total if total else np.zeros(d + 1)
    return {k: sums.gram(g, mean, s) for k, (g, s) in found.items()}


def solve(gram: Gram, config: Config) -> tuple[np.ndarray, float, Receipt]:
    """Coefficients, intercept and receipt from the Gram sums; no more data is read."""
    a, b, mean, ym = gram.centred(config.intercept)
    m = a + config.penalty * np.eye(len(b))
    done, how = 1, "direct"
    if config.solver in ("cholesky", "qr"):
        try:
            l = np.linalg.cholesky(m)
            beta = np.linalg.solve(l.T, np.linalg.solve(l, b))
        except np.linalg.LinAlgError:
            if config.penalty > 0:
                raise DataError("NotPositiveDefinite") from None
            beta, how = np.linalg.lstsq(m, b, rcond=None)[0], "least-norm"
    elif config.solver == "cg":
        beta, done, how = conjugate_gradients(lambda p: m @ p, b, config.tolerance, config.iterations)
    else:  # the same steps as on the data: a root of the Gram matrix stands for the rows
        values, vectors = np.linalg.eigh(a)
        s = np.sqrt(np.clip(values, 0, None))
        keep = s > (s.max() if len(s) else 0) * 1e-14
        rows = np.vstack([s[keep, None] * vectors.T[keep], math.sqrt(config.penalty) * np.eye(len(b))])
        right = np.concatenate([(vectors.T @ b)[keep] / s[keep], np.zeros(len(b))])
        beta, done, how = lsqr(Bidiagonal(rows, right), len(b), config.tolerance, config.iterations)
    return finished(beta, mean, ym, config, Receipt(config.solver, done, how, float(np.linalg.norm(m @ beta - b))))


def finished(beta: np.ndarray, mean: np.ndarray, ym: float, config: Config, receipt: Receipt) -> tuple[np.ndarray, float, Receipt]:
    intercept = float(ym - mean @ beta) if config.intercept else 0.0
    if not (np.isfinite(beta).all() and math.isfinite(intercept)):
        raise DataError("NonFiniteSolution")
    return beta, intercept, receipt


def conjugate_gradients(times, b: np.ndarray, tolerance: float, most: int) -> tuple[np.ndarray, int, str]:
    """`times`: the product of the matrix and a vector."""
    x, r = np.zeros(len(b)), b.copy()
    p, rr, least = r.copy(), r @ r, (tolerance * np.linalg.norm(b)) ** 2
    for i in range(most):
        if rr <= least:
            return x, i, "converged"
        q = times(p)
        step = rr / (p @ q)
        x, r = x + step * p, r - step * q
        new = r @ r
        p, rr = r + new / rr * p, new
    return x, most, "converged" if rr <= least else "iteration-limit"


class Bidiagonal:
    """The steps of a Golub-Kahan bidiagonalisation of a matrix that is held whole."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.u = a, b

    def start(self) -> tuple[float, np.ndarray]:
        """The norm of the right side, and the product of the transpose with its direction."""
        beta = float(np.linalg.norm(self.u))
        self.u = self.u / beta if beta else self.u
        return beta, self.a.T @ self.u

    def step(self, v: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
        """The next left direction's length, and the product of the transpose with it."""
        u = self.a @ v - alpha * self.u
        beta = float(np.linalg.norm(u))
        self.u = u / beta if beta else u
        return beta, self.a.T @ self.u


class RowBidiagonal:
    """The same over distributed rows, without a matrix: one pass over the rows a step.

    A left direction has a number for each row. It isn't kept: it always is a combination of the coordinates and the target,
    u = X c + t y, so that c and t stand for it and each pass works it out anew. The penalty's d rows are kept here.
    """

    def __init__(self, passed, d: int, penalty: float):
        self.passed, self.c, self.t, self.rest, self.root = passed, np.zeros(d), 1.0, np.zeros(d), math.sqrt(penalty)

    def _along(self, c: np.ndarray, t: float, rest: np.ndarray) -> tuple[float, np.ndarray]:
        squares, g = self.passed(c, t)
        beta = math.sqrt(max(0.0, squares + float(rest @ rest)))
        k = 1 / beta if beta else 1.0
        self.c, self.t, self.rest = c * k, t * k, rest * k
        return beta, (g + self.root * rest) * k

    def start(self) -> tuple[float, np.ndarray]:
        return self._along(self.c, self.t, self.rest)

    def step(self, v: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
        return self._along(v - alpha * self.c, -alpha * self.t, self.root * v - alpha * self.rest)


def lsqr(steps, d: int, tolerance: float, most: int) -> tuple[np.ndarray, int, str]:
    """Golub-Kahan bidiagonalisation least squares (Paige and Saunders, 1982); stops when the normal residual is small."""
    x = np.zeros(d)
    beta, v = steps.start()
    alpha = float(np.linalg.norm(v))
    if beta == 0 or alpha == 0:
        return x, 0, "converged"
    v = v / alpha
    w, phi, rho, scale = v.copy(), beta, alpha, alpha * beta
    for i in range(1, most + 1):
        beta, along = steps.step(v, alpha)
        v_next = along - beta * v
        alpha = float(np.linalg.norm(v_next))
        v = v_next / alpha if alpha else v_next
        turned = math.hypot(rho, beta)
        c, s = rho / turned, beta / turned
        theta, rho = s * alpha, -c * alpha
        step, phi = c * phi, s * phi
        x = x + step / turned * w
        w = v - theta / turned * w
        if abs(phi * alpha * c) <= tolerance * scale:
            return x, i, "converged"
    return x, most, "iteration-limit"


class Problem:
    """What a backend may ask of the rows: the Gram sums (one pass, kept), passes along a direction, a triangle. Bad rows are refused first."""

    def __init__(self, rows: Rows, weighted: bool, intercept: bool, view: View | None = None):
        self.rows, self.weighted, self.intercept, self.view = rows, weighted, intercept, view_of(rows, view)
        self.at = centre(rows, weighted, self.view)
        self.passes, self._gram = 0, None

    @property
    def d(self) -> int:
        return len(self.at.x)

    def gram(self) -> Gram:
        if self._gram is None:
            self.passes += 1
            self._gram = grams(self.rows, self.weighted, self.at, None, self.view)[None]
        return self._gram

    def frame(self) -> DataFrame:
        df = self.rows.df
        return df.select(weight_of(self.rows, self.weighted).alias("_w"), F.col(self.rows.target).cast("double").alias("_y"), *self.view.columns(df))

    def _fold(self, step, merge=added, sparse: bool = True) -> dict:
        view = self.view

        def over(batches):
            held = None
            for batch, x in _parts(batches, view, 2, sparse):
                y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 0))
                state = step(x, y, w)
                held = state if held is None else merge(held, state)
            return {} if held is None else {None: held}

        self.passes += 1
        return tree_fold(self.frame(), over, merge)[None]

    def means(self) -> tuple[np.ndarray, float]:
        """The weighted means, or zeros without an intercept."""
        if not self.intercept:
            return np.zeros(self.d), 0.0
        x0, y0 = self.at.x, self.at.y
        got = self._fold(lambda x, y, w: {"w": np.array([w.sum()]), "s": np.append(w @ (x - x0), w @ (y - y0))})
        mean = got["s"] / got["w"][0]
        return x0 + mean[:-1], float(y0 + mean[-1])

    def along(self, mean: np.ndarray, ym: float):
        """The pass (c, t) -> (sum of w r r, sums of w x r) with r = x c + t y about the means: one tree of partial sums, whatever d is."""

        def passed(c: np.ndarray, t: float) -> tuple[float, np.ndarray]:
            def step(x, y, w):
                x = x - mean
                r = x @ c + t * (y - ym)
                return {"s": np.array([w @ (r * r)]), "g": (w * r) @ x}

            got = self._fold(step)
            return float(got["s"][0]), got["g"]

        return passed

    def triangle(self, mean: np.ndarray, ym: float) -> np.ndarray:
        """The triangle of the weighted, centred rows and target: each task reduces its rows, rounds of tasks the triangles."""
        qr = lambda m: {"r": np.linalg.qr(m, mode="r")}
        return self._fold(lambda x, y, w: qr(np.column_stack([x - mean, y - ym]) * np.sqrt(w)[:, None]), lambda a, b: qr(np.vstack([a["r"], b["r"]])), sparse=False)["r"]


class Backend:
    """A way to solve a problem. `assumptions` go to the receipt."""

    name, assumptions = "backend", ()

    def check(self, config: Config) -> None:
        """Refuse settings that the backend can't work with."""

    def solve(self, problem: Problem, config: Config) -> tuple[np.ndarray, float, Receipt]:
        raise NotImplementedError


class GramBackend(Backend):
    """Solvers of the d x d normal equations; all of them share one pass."""

    assumptions = ("d x d sums fit the driver",)

    def __init__(self, name: str):
        self.name = name

    def check(self, config: Config) -> None:
        if self.name == "cg" and config.penalty == 0:
            raise DataError("PenaltyRequired", self.name)

    def solve(self, problem: Problem, config: Config) -> tuple[np.ndarray, float, Receipt]:
        return solve(problem.gram(), config)


class QRBackend(Backend):
    """Augmented QR without squaring the data."""

    name, assumptions = "qr", ("triangles of d + 1 columns fit a task",)

    def solve(self, problem: Problem, config: Config) -> tuple[np.ndarray, float, Receipt]:
        d, (mean, ym) = problem.d, problem.means()
        r = np.vstack([problem.triangle(mean, ym), np.hstack([math.sqrt(config.penalty) * np.eye(d), np.zeros((d, 1))])])
        q, t = np.linalg.qr(r[:, :d])
        beta = np.linalg.lstsq(t, q.T @ r[:, d], rcond=None)[0]
        return finished(beta, mean, ym, config, Receipt("qr", 1, "direct", float(np.linalg.norm(r[:, :d].T @ (r[:, :d] @ beta - r[:, d])))))


class RowBackend(Backend):
    """Matrix-free solvers: a pass over the rows an iteration, vectors of d numbers on the driver, centring implied."""

    assumptions = ("vectors of d numbers fit the driver", "rows are read again each iteration")

    def __init__(self, name: str):
        self.name = name

    def check(self, config: Config) -> None:
        if self.name == "row-cg" and config.penalty == 0:
            raise DataError("PenaltyRequired", self.name)

    def solve(self, problem: Problem, config: Config) -> tuple[np.ndarray, float, Receipt]:
        mean, ym = problem.means()
        passed = problem.along(mean, ym)
        if self.name == "row-lsqr":
            beta, done, how = lsqr(RowBidiagonal(passed, problem.d, config.penalty), problem.d, config.tolerance, config.iterations)
        else:
            right = passed(np.zeros(problem.d), 1.0)[1]
            beta, done, how = conjugate_gradients(lambda p: passed(p, 0.0)[1] + config.penalty * p, right, config.tolerance, config.iterations)
        gradient = passed(beta, -1.0)[1] + config.penalty * beta
        return finished(beta, mean, ym, config, Receipt(self.name, done, how, float(np.linalg.norm(gradient))))


#: Solvers by the name that a configuration gives; others can be added.
BACKENDS: dict[str, Backend] = {b.name: b for b in (*map(GramBackend, ("cholesky", "lsqr", "cg")), QRBackend(), *map(RowBackend, ("row-lsqr", "row-cg")))}


def register_backend(backend: Backend) -> None:
    if backend.name in BACKENDS:
        raise DataError("BackendExists", backend.name)
    BACKENDS[backend.name] = backend


def evidence(problem: Problem, coefficients: np.ndarray, intercept: float, penalty: float) -> tuple[float, float]:
    """The objective (weighted squares plus penalty) and the norm of its gradient, halved.

    They follow from the Gram sums where these are there and the squares haven't cancelled out, else from one more pass.
    """
    b, at = np.asarray(coefficients, dtype=float), problem._gram
    extra = penalty * float(b @ b)
    if at is not None and (squares := at.squares(b, intercept)) > 1e-6 * at.syy:
        c = intercept + b @ at.centre - at.y_centre
        off = b @ at.sx + c * at.sw - at.sy
        return squares + extra, float(np.linalg.norm(at.sxx @ b + c * at.sx - at.sxy + at.centre * off + penalty * b))
    mean, ym = problem.at.x, problem.at.y

    def step(x, y, w):
        x = x - mean
        r = x @ b + (intercept + mean @ b - ym) - (y - ym)
        return {"s": np.array([w @ (r * r), w @ r]), "g": (w * r) @ x}

    got = problem._fold(step)
    if not (np.isfinite(got["s"]).all() and np.isfinite(got["g"]).all()):
        raise DataError("NonFiniteSolution")
    return float(got["s"][0]) + extra, float(np.linalg.norm(got["g"] + mean * got["s"][1] + penalty * b))


@dataclass(frozen=True)
class Model(Stage):
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    receipt: Receipt | None = None
    objective: float | None = None
    kkt: float | None = None
    name: str = "ridge"
    column: str | None = None
    sparse: bool = False

    def _contributions(self) -> Column:
        """Each coordinate of the vector column times its coefficient; of a sparse one those that the row holds."""
        c, b = F.col(self.column), F.lit(list(self.coefficients))
        if self.sparse:
            return F.zip_with(c["indices"], c["values"], lambda i, x: x * F.get(b, i))
        return F.zip_with(c.cast("array<double>"), b, lambda x, b: x * b)

    def prediction(self) -> Column:
        if self.column:
            return F.aggregate(self._contributions(), F.lit(self.intercept), lambda a, x: a + x)
        out = F.lit(self.intercept)
        for f, b in zip(self.features, self.coefficients):
            out = out + F.col(f).cast("double") * F.lit(b)
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.prediction())

    def guarded(self, df: DataFrame) -> DataFrame:
        return checked(df, () if self.column else self.features, {"prediction": self.prediction()})

    def explained(self, df: DataFrame) -> DataFrame:
        """Intercept, each feature's contribution (an array for a vector column), and the prediction that they add up to."""
        if self.column:
            parts = [self._contributions().alias("contributions")]
        else:
            parts = [(F.col(f).cast("double") * F.lit(b)).alias(f"from_{f}") for f, b in zip(self.features, self.coefficients)]
        return df.select("*", F.lit(self.intercept).alias("intercept"), *parts, self.prediction().alias("prediction"))

    def table(self, df: DataFrame) -> DataFrame:
        """(position, name, value): the intercept at -1, then the coefficients."""
        rows = [(-1, "intercept", self.intercept), *((i, f, b) for i, (f, b) in enumerate(zip(self.features, self.coefficients)))]
        return df.sparkSession.createDataFrame(rows, "position int, name string, value double")

    def record(self) -> dict:
        return {"coefficients": self.coefficients, "intercept": self.intercept, "receipt": self.receipt, "objective": self.objective, "kkt": self.kkt}


class Ridge(Learner):
    """Ridge regression with uniform weights, or those of the rows' weight column, on the feature columns or on the vector column of `view`."""

    def __init__(self, config: Config, weighted: bool = False, view: View | None = None):
        self.config, self.weighted, self.view = config, weighted, view
        self.name = f"ridge:{config.solver}:{config.penalty!r}:{config.intercept}:{'weighted' if weighted else 'uniform'}" + (f":{view.column}" if view and view.column else "")

    def fit(self, rows: Rows, seed: int = 0) -> Model:
        return fits(rows, [self.config], self.weighted, self.view)[0]


def fits(rows: Rows, configs: list[Config], weighted: bool = False, view: View | None = None) -> list[Model]:
    """A model for each configuration; those whose solvers work on the Gram sums share one pass over the rows."""
    rows.fitting()
    shared = {i: Problem(rows, weighted, i, view) for i in {c.intercept for c in configs}}
    out = []
    for config in configs:
        problem, backend = shared[config.intercept], BACKENDS[config.solver]
        before = problem.passes
        beta, intercept, receipt = backend.solve(problem, config)
        receipt = replace(receipt, passes=problem.passes - before, assumptions=tuple(backend.assumptions))
        objective, kkt = evidence(problem, beta, intercept, config.penalty)
        out.append(Model(problem.view.names, tuple(map(float, beta)), intercept, receipt, objective, kkt, column=problem.view.column, sparse=problem.view.sparse))
    return out
