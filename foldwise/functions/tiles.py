"""Sums of products of columns as blocked matrix products in whole numbers: the same for every order and partitioning of the rows.

Values are cut into three limbs of 18 bits below their column's greatest one. Products of limbs over 2**16 rows add up to
less than 2**53, so that a matrix product in doubles is exact, whatever the order of its additions.
"""

from __future__ import annotations

import math

import numpy as np

BITS, LIMBS, BLOCK = 18, 3, 1 << 16
#: Pairs of limbs that count, by their weight: what is left out lies 2**-54 below the greatest product.
PAIRS = (((0, 0),), ((0, 1), (1, 0)), ((0, 2), (1, 1), (2, 0)))


def exponents(size: np.ndarray) -> np.ndarray:
    """The power of two above each column's greatest size."""
    return np.array([max(-900, math.frexp(x)[1]) for x in np.asarray(size, dtype=float)], dtype=np.int64)


def limbs(m: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
    """The matrix as whole numbers: m = sum of limb * 2**(e - BITS * (its place + 1)), up to the last limb's rounding."""
    out, rest = [], np.ldexp(m, -e)
    for _ in range(LIMBS):
        rest = rest * float(1 << BITS)
        out.append(np.rint(rest))
        rest = rest - out[-1]
    return out


def products(left: np.ndarray, right: np.ndarray, el: np.ndarray, er: np.ndarray) -> dict[str, np.ndarray]:
    """The sums over rows of left[i] * right[j] as a state that adds up exactly (see `total`)."""
    sums = np.zeros((LIMBS, left.shape[1], right.shape[1]), dtype=np.int64)
    for lo in range(0, len(left), BLOCK):
        a = limbs(left[lo : lo + BLOCK], el)
        b = a if left is right else limbs(right[lo : lo + BLOCK], er)
        for k, pairs in enumerate(PAIRS):
            for i, j in pairs:
                sums[k] += (a[i].T @ b[j]).astype(np.int64)
    return {"high": sums >> 32, "low": sums & 0xFFFFFFFF}


def squares(m: np.ndarray, e: np.ndarray) -> dict[str, np.ndarray]:
    """The sums over rows of each column and of its square, as a state (two rows of columns)."""
    sums = np.zeros((LIMBS, 2, m.shape[1]), dtype=np.int64)
    for lo in range(0, len(m), BLOCK):
        a = limbs(m[lo : lo + BLOCK], e)
        for k, pairs in enumerate(PAIRS):
            sums[k, 0] += a[k].sum(axis=0).astype(np.int64)
            for i, j in pairs:
                sums[k, 1] += (a[i] * a[j]).sum(axis=0).astype(np.int64)
    return {"high": sums >> 32, "low": sums & 0xFFFFFFFF}


def total(state: dict[str, np.ndarray], shift: np.ndarray, least: np.ndarray | int) -> np.ndarray:
    """The sums as doubles, correctly rounded. `shift`: the exponent of each entry; `least`: how far its first limb's unit lies below that, in bits."""
    whole = (state["high"].astype(object) * (1 << 32)) + state["low"].astype(object)
    mixed = sum(whole[k] * (1 << BITS * (LIMBS - 1 - k)) for k in range(LIMBS))
    power = np.broadcast_to(shift - least - BITS * (LIMBS - 1), mixed.shape)
    return np.array([_scaled(int(x), int(p)) for x, p in zip(mixed.ravel(), power.ravel())], dtype=float).reshape(mixed.shape)


def _scaled(x: int, power: int) -> float:
    """x * 2**power, rounded once; infinite beyond a double's range."""
    try:
        return math.ldexp(float(x), power) if abs(x) < 1 << 900 and power > -1000 else float(x) * 2.0**power
    except OverflowError:
        return math.copysign(math.inf, x)
