"""Digests of rows in an order, worked out without bringing them into that order in one task, and fingerprints derived from others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.hashing import Fingerprint, fnv1a, framed, hex16

#: Two primes below 2**31, so that products fit a long, and a base for each.
PRIMES, BASES = (2147483647, 2147483629), (1000003, 1299709)
#: Bits of a position.
POSITION = 40


@dataclass(frozen=True)
class Ordered:
    """Length and digest of a sequence: the sum of h(row) * base**position, modulo each prime. Digests of two sequences give that of one behind the other."""

    n: int
    parts: tuple[int, ...] = (0,) * len(PRIMES)

    def __add__(self, other: Ordered) -> Ordered:
        return Ordered(self.n + other.n, tuple((a + pow(base, self.n, p) * b) % p for a, b, base, p in zip(self.parts, other.parts, BASES, PRIMES)))

    @property
    def text(self) -> str:
        return f"{self.n}:" + "".join(f"{x:08x}" for x in self.parts)

    def fingerprint(self) -> Fingerprint:
        return Fingerprint("content-digest", ("ordered-rows-v1",), self.text)


def row_hash(*columns: Column) -> Column:
    """60 bits of a row's content; nulls are told from empty strings, and values from what stands beside them."""
    parts = [F.coalesce(F.concat(F.lit("+"), F.replace(c.cast("string"), F.lit("\x1f"), F.lit("\x1f\x1f"))), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f,", *parts)), 1, 15), 16, 10).cast("long")


def power(position: Column, base: int, prime: int) -> Column:
    """base**position modulo prime, a factor for each bit of the position."""
    out = F.lit(1).cast("long")
    for k in range(POSITION):
        bit = F.shiftright(position, k).bitwiseAND(F.lit(1))
        out = out * F.when(bit == 1, F.lit(pow(base, 1 << k, prime)).cast("long")).otherwise(F.lit(1).cast("long")) % prime
    return out


def digest_sums(h: Column, position: Column) -> list[Column]:
    """The aggregates that `ordered` is made of: rows, first position, and a sum for each prime."""
    terms = [F.sum((h % p * power(position, b, p) % p).cast("decimal(38,0)")).alias(f"d{i}") for i, (b, p) in enumerate(zip(BASES, PRIMES))]
    return [F.count(F.lit(1)).alias("n"), F.min(position).alias("first"), *terms]


def ordered(row) -> Ordered:
    """The digest from a row of `digest_sums`, counted from its own first position on."""
    first = row["first"] or 0
    return Ordered(row["n"], tuple(int(row[f"d{i}"] or 0) * pow(b, -first, p) % p for i, (b, p) in enumerate(zip(BASES, PRIMES))))


def ordered_digest(at: DataFrame, columns: list[str], position: str = "pos") -> Ordered:
    """The digest of rows with their gapless position in the order: one aggregate, whatever the partitions."""
    return ordered(at.agg(*digest_sums(row_hash(*map(F.col, columns)), F.col(position))).first())


def derived(kind: str, *sources: Fingerprint, **fields: object) -> Fingerprint:
    """The identity of what follows from other data by a rule: the rule's name and fields, and the sources in order."""
    parts = [kind, *(f"{k}={v}" for k, v in sorted(fields.items())), *(x for s in sources for x in (s.policy, *s.fields, s.digest))]
    return Fingerprint("summary", (f"derived:{kind}",), hex16(fnv1a(b"".join(map(framed, parts)))))
