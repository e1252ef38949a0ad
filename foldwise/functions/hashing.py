"""Reproducible 64-bit hashing, on the driver and as column expressions that never overflow under ANSI arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: FNV-1a's 64-bit offset and prime, SplitMix64's finalizer multipliers and gamma.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX_1, MIX_2, GAMMA = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
#: Default domain of split ranks; another one gives other, equally valid splits.
RANK_DOMAIN = "foldwise.split.rank-v1"


def signed(x: int) -> int:
    """The signed 64-bit integer with the bits of x."""
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def fnv1a(data: bytes, state: int = FNV_OFFSET) -> int:
    for b in data:
        state = (state ^ b) * FNV_PRIME & MASK
    return state


def finalize(x: int) -> int:
    """SplitMix64's finalizer, without the additive step."""
    x &= MASK
    x = (x ^ x >> 30) * MIX_1 & MASK
    x = (x ^ x >> 27) * MIX_2 & MASK
    return x ^ x >> 31


def framed(text: str) -> bytes:
    """UTF-8 behind its length as four big-endian bytes; unpaired surrogates are refused."""
    try:
        raw = text.encode("utf-8")
    except UnicodeEncodeError as e:
        raise ValueError(f"text holds an unpaired surrogate at {e.start}") from e
    return len(raw).to_bytes(4, "big") + raw


@dataclass(frozen=True)
class Fingerprint:
    """Identity of a data set: how its digest came about (content-digest, source-identity or summary, with that policy's fields), and the digest."""

    policy: str
    fields: tuple[str, ...]
    digest: str

    def __post_init__(self) -> None:
        fields = {"content-digest": 1, "source-identity": 2, "summary": 1}
        if fields.get(self.policy) != len(self.fields):
            raise ValueError(f"{self.policy} doesn't take {len(self.fields)} fields")

    def prefix(self, domain: str = RANK_DOMAIN) -> bytes:
        return b"".join(map(framed, (domain, self.policy, *self.fields, self.digest)))


def rank_state(fingerprint: Fingerprint, seed: int, domain: str = RANK_DOMAIN) -> int:
    """The hash state after everything but the row id."""
    return fnv1a(fingerprint.prefix(domain) + (seed & MASK).to_bytes(8, "big"))


def rank(fingerprint: Fingerprint, seed: int, row_id: int, domain: str = RANK_DOMAIN) -> int:
    """The signed rank of one row."""
    return signed(finalize(fnv1a((row_id & MASK).to_bytes(8, "big"), rank_state(fingerprint, seed, domain))))


def _low(c: Column, bits: int) -> Column:
    return c.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _times(df: DataFrame, c: str, factor: int) -> DataFrame:
    """Replace the long column c by its product with `factor`, modulo 2**64, by way of 16-bit limbs: no step exceeds 2**51."""
    low, high = factor & 0xFFFFFFFF, factor >> 32
    limb = [_low(F.shiftrightunsigned(c, 16 * k), 16) for k in range(4)]
    df = df.withColumns({f"_{k}": limb[k] for k in range(4)})
    df = df.withColumn("_l", F.col("_0") * low + F.shiftleft(_low(F.col("_1") * low, 16), 16))
    top = F.shiftright("_l", 32) + F.shiftright(F.col("_1") * low, 16) + _low(F.col("_2") * low, 32) + F.shiftleft(_low(F.col("_3") * low, 16), 16)
    top = top + _low(F.col("_0") * high, 32) + F.shiftleft(_low(F.col("_1") * high, 16), 16)
    return df.withColumn(c, F.shiftleft(_low(top, 32), 32).bitwiseOR(_low(F.col("_l"), 32))).drop("_0", "_1", "_2", "_3", "_l")


def with_finalized(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add the long column `name`: the finalizer of the long `value`. Each step is a projection of its own, so that none is computed twice."""
    df = df.withColumn(name, value)
    for shift, factor in ((30, MIX_1), (27, MIX_2)):
        df = _times(df.withColumn(name, F.col(name).bitwiseXOR(F.shiftrightunsigned(name, shift))), name, factor)
    return df.withColumn(name, F.col(name).bitwiseXOR(F.shiftrightunsigned(name, 31)))


def with_rank(df: DataFrame, row_id: str, state: int, name: str = "rank") -> DataFrame:
    """Add the long column `name`: the rank of each `row_id` under a state of `rank_state`."""
    df = df.withColumns({"_hi": F.lit(state >> 32).cast("long"), "_lo": F.lit(state & 0xFFFFFFFF).cast("long")})
    for k in range(7, -1, -1):  # the prime is 2**40 + 435
        df = df.withColumn("_lo", F.col("_lo").bitwiseXOR(_low(F.shiftrightunsigned(row_id, 8 * k), 8)))
        df = df.withColumn("_p", F.col("_lo") * 435)
        df = df.withColumns({"_hi": _low(F.col("_hi") * 435 + F.shiftleft("_lo", 8) + F.shiftright("_p", 32), 32), "_lo": _low(F.col("_p"), 32)})
    return with_finalized(df, F.shiftleft("_hi", 32).bitwiseOR(F.col("_lo")), name).drop("_hi", "_lo", "_p")


def hex16(x: int) -> str:
    return f"{x & MASK:016x}"
