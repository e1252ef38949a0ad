"""Spelling variants: words at one edit's distance, found through bitmasks of letter parities.

A word's mask has a bit for each letter, set if the letter occurs an odd number of times. One edit flips two bits at most,
so of three bands of the mask one stays equal. An inserted or deleted letter flips one bit and leaves two bands equal; so
does a replaced letter of the same band. Otherwise one bit flips in each of two bands; the bit of the replaced letter is
one of the word's own letters, so that the second band is known as well. Pairs therefore always meet on two bands and
the length, an exact key; masks and the edit distance decide in the join.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import table
from foldwise.operators.state import skew_join, written

RUN = re.compile("[A-Za-z\u00C0-\u00FF]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: English letters from the commonest to the rarest, dealt to the bands in turn so that each tells words apart.
COMMON = "etaoinshrdlcumwfgypbvkjxqz"
BANDS, EXTRA = 3, 64
#: Different words that a task counts before it hands them on.
HELD = 200_000


def occurrences(df: DataFrame, key: str, text: str, typo_every: int = 0) -> DataFrame:
    """(word, n) of the maximal runs of letters in all whole texts, A-Z lower-cased.

    With `typo_every`, a run of which the CRC-32 of `<key>:<run>` is divisible by it loses its letter at that number modulo
    the run's length: typing errors that are the same whenever the table is read. Null texts have no runs; a null key counts as an empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for name, t in zip(*(c.to_pylist() for c in batch.columns)):
                start = zlib.crc32(f"{name}:".encode())
                for word, n in Counter(RUN.findall(t.encode(errors="surrogatepass").translate(LOWER).decode(errors="surrogatepass"))).items():
                    if typo_every:
                        h = zlib.crc32(word.encode(), start)
                        if h % typo_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    texts = df.where(F.col(text).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _places(word: Column) -> Column:
    """The number of each letter of a word; letters beyond the alphabet share EXTRA numbers, which never hides an edit."""
    order = F.array(*[F.lit(COMMON.index(chr(c))) for c in range(97, 123)])
    code = lambda c: F.ascii(c)
    return F.transform(F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0)), lambda c: F.when(code(c).between(97, 122), F.get(order, code(c) - 97)).otherwise(len(COMMON) + F.pmod(code(c), F.lit(EXTRA))))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.floor(place / BANDS).cast("int"))


def masked(words: DataFrame) -> DataFrame:
    """`words` (word, n) with size (code points), b (the mask's bands) and own (in each band, the bits of all the word's letters)."""
    placed = words.select("word", "n", F.length("word").alias("size"), _places(F.col("word")).alias("places"))
    in_band = lambda g: F.transform(F.filter("places", lambda p: p % BANDS == g), _bit)
    parity = lambda g: F.aggregate(in_band(g), F.lit(0), lambda a, x: a.bitwiseXOR(x))
    return placed.select("word", "n", "size", F.array(*map(parity, range(BANDS))).alias("b"), F.array(*[F.aggregate(in_band(g), F.lit(0), lambda a, x: a.bitwiseOR(x)) for g in range(BANDS)]).alias("own"))


def near_words(words: DataFrame) -> DataFrame:
    """Each pair of words of `words` (word, n; words distinct) that differ by one inserted, deleted or replaced code point, once: a, a_n, b, b_n.

    A pair is found on the first band that is equal for it: keys of two equal bands join words of the same length or one
    more; keys with one of the word's own letters flipped in the second band join words of the same length.
    """
    rows = written(masked(words))
    b = lambda g: F.element_at("b", F.pmod(g, F.lit(BANDS)) + 1)
    pack = lambda g, one, two: F.call_function("shiftleft", one.cast("long"), F.lit(32)).bitwiseOR(two.cast("long")) * 4 + g
    letters = lambda g: F.element_at("own", F.pmod(g, F.lit(BANDS)) + 1)
    g = F.explode(F.array(*map(F.lit, range(BANDS)))).alias("g")
    dealt = rows.select("*", g)
    gc = F.col("g")
    right = dealt.select(pack(gc, b(gc), b(gc + 1)).alias("k"), F.col("size"), F.col("word").alias("b"), F.col("n").alias("b_n"), b(gc + 2).alias("b_rest"), letters(gc + 1).alias("b_own"))
    equal = dealt.select(F.lit(0).alias("bit"), gc, b(gc + 1).alias("two"), F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("size"), F.col("size").alias("a_size"), "b", "word", "n")
    flips = dealt.select("*", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: letters(gc + 1).bitwiseAND(F.call_function("shiftleft", F.lit(1), i))), lambda x: x > 0)).alias("bit"))
    flips = flips.select("bit", gc, b(gc + 1).bitwiseXOR(F.col("bit")).alias("two"), F.col("size"), F.col("size").alias("a_size"), "b", "word", "n")
    left = equal.unionByName(flips).select(pack(gc, b(gc), F.col("two")).alias("k"), "size", "bit", "g", "a_size", F.col("word").alias("a"), F.col("n").alias("a_n"), b(gc + 2).alias("a_rest"))
    apart = F.bit_count(F.col("a_rest").bitwiseXOR(F.col("b_rest")))
    ordered = F.col("a") < F.col("b")
    # a flipped letter that both words have is met from both; all keys of words with equal masks agree, the first one counts
    once = F.when(F.col("bit") > 0, (apart == 1) & ((F.col("b_own").bitwiseAND(F.col("bit")) == 0) | ordered)).when(F.col("a_size") < F.col("size"), apart <= 1).otherwise((apart <= 2) & ordered)
    first = (F.col("bit") > 0) | (apart > 0) | (F.col("g") == 0)
    met = skew_join(left, right, ["k", "size"]).where(once & first & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of `forms` (word, form; without cycles): where its forms lead to. Each round, written, doubles the steps."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if skew_join(now, onward, ["root"]).isEmpty():
            return now
        now = written(skew_join(now, onward, ["root"], "left").select("word", F.coalesce("further", "root").alias("root")))


def variants(df: DataFrame, key: str, text: str, least_size: int = 6, least_n: int = 5, ratio: int = 5, typo_every: int = 0) -> DataFrame:
    """Spelling groups of the words of `df`: word, form, root, n, n_near, form_n.

    Words are the runs of letters (see `occurrences`) of at least `least_size` code points that occur `least_n` times or
    more. A word's form is its commonest near word (ties: the smallest in code-point order), if that is `ratio` times as
    common or more; root is where forms lead to, the word itself without a form. Null and empty texts have no words;
    equal rows count each; an empty table gives no rows; other columns are not read, so names that clash are harmless.
    """
    words = written(occurrences(df, key, text, typo_every).where((F.col("n") >= least_n) & (F.length("word") >= least_size)))
    pairs = written(near_words(words))
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))).alias("s")
    best = pairs.select(sides).groupBy("s.word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("s.m")).alias("m"), F.col("s.other").alias("other"))).alias("best"))
    formed = words.join(best, "word", "left").withColumn("formed", -F.col("best.m") >= F.col("n") * ratio)
    formed = written(formed.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("formed"), F.col("best.other")).alias("form"), F.when(F.col("formed"), -F.col("best.m")).alias("form_n")))
    out = formed.join(roots(formed.where("form is not null").select("word", "form")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_parity_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"), "doc_id", "text", typo_every=199)


QUERIES = {"op11_parity_variants": op11_parity_variants}
