"""Byte-level BPE in batched numpy merge rounds.

Texts are cut into pieces by the tokenizer's pattern. Pieces that the batch has not met before are laid out in one flat
array of symbols; each round looks the adjacent pairs up by binary search over the sorted pair keys and merges the pair of
lowest rank of every piece at once, until no piece holds a known pair. A long piece would take a round of its whole length
for each of its many ranks: its symbols are linked instead, and a round touches the pairs of one rank and their new
neighbours only. The vocabulary file is a parameter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import chunks, table

#: The byte-level pre-tokenizer's published pattern; \s without the four separators U+001C to U+001F, which it doesn't count as space. Fixed value.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Characters of text in one round, texts at a time, pieces and their bytes that a task remembers at most, bytes from which a piece is long.
ROUND_CHARS, DOCS, MOST_PIECES, MOST_BYTES, LONG = 1 << 20, 500, 200_000, 16 << 20, 1000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by rule: printable bytes stand for themselves, the rest follow U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        alphabet, vocab = byte_alphabet(), j["model"]["vocab"]
        added = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.added = added
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.pieces = regex.compile(PATTERN)
        self.base = np.array([vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in j["model"]["merges"]]
        self.width = len(self.bytes_of)
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.known: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.known = {t: k for k, t in enumerate(self.added)}
        self.flat = [np.array([i], dtype=np.int64) for i in self.added.values()]
        self.lengths = [np.ones(len(self.added), dtype=np.int64)]
        self.held = 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of symbols, by binary search; the number of all pairs for one that is unknown."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.keys))

    def merge_long(self, raw: bytes) -> np.ndarray:
        """Token ids of one long piece: rounds by ascending rank over linked symbols.

        `waiting` has for each rank the positions that had such a pair when it came about; those that have changed since are left out when their turn comes.
        """
        symbols = self.base[np.frombuffer(raw, dtype=np.uint8)]
        n, none = len(symbols), len(self.keys)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, alive = np.full(n, none, dtype=np.int64), np.ones(n, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        turns: list[int] = []

        def look(at: np.ndarray) -> None:
            """Note the pairs that begin at the positions `at`, each once."""
            inner = at[after[at] < n]
            rank[at] = none
            rank[inner] = self.ranks(symbols[inner], symbols[after[inner]])
            inner = inner[rank[inner] < none]
            inner = inner[np.argsort(rank[inner], kind="stable")]
            cuts = np.flatnonzero(np.diff(rank[inner], prepend=-1))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(inner)]):
                r = int(rank[inner[lo]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(turns, r)
                waiting[r].append(inner[lo:hi])

        look(np.arange(n))
        while turns:
            r = heapq.heappop(turns)
            hit = np.unique(np.concatenate(waiting.pop(r)))
            hit = hit[alive[hit] & (rank[hit] == r)]
            if not len(hit):
                continue
            run = np.concatenate([[True], after[hit[:-1]] != hit[1:]])
            start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            gone = after[hit]
            symbols[hit] = self.made[np.searchsorted(self.keys, symbols[hit] * self.width + symbols[gone])]
            alive[gone] = False
            after[hit] = after[gone]
            inner = after[hit] < n
            before[after[hit[inner]]] = hit[inner]
            look(np.unique(np.concatenate([hit, before[hit[before[hit] >= 0]]])))
        return symbols[alive]

    def merge(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces, one after another, and the number of ids of each piece (none of them empty)."""
        if not any(len(r) >= LONG for r in raw):
            return self._merge_short(raw)
        short = [r for r in raw if len(r) < LONG]
        ids, n = self._merge_short(short) if short else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        parts = iter(np.split(ids, np.cumsum(n)[:-1]) if short else ())
        out = [self.merge_long(r) if len(r) >= LONG else next(parts) for r in raw]
        return np.concatenate(out), np.fromiter(map(len, out), dtype=np.int64, count=len(out))

    def _merge_short(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        symbols = self.base[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        piece = np.repeat(np.arange(len(raw)), size)
        done_ids, done_piece = [], []
        none = len(self.keys)
        while len(symbols):
            left = np.flatnonzero(piece[1:] == piece[:-1])
            rank = np.full(len(symbols), none, dtype=np.int64)
            rank[left] = self.ranks(symbols[left], symbols[left + 1])
            begins = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            counts = np.diff(np.append(begins, len(symbols)))
            best = np.repeat(np.minimum.reduceat(rank, begins), counts)
            over = best == none
            if over.any():  # pieces without a known pair are final
                done_ids.append(symbols[over])
                done_piece.append(piece[over])
                keep = ~over
                symbols, piece, rank, best = symbols[keep], piece[keep], rank[keep], best[keep]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == best)
            # in a run of overlapping pairs (the same symbol again and again) every other one counts, from the left
            run = np.concatenate([[True], np.diff(hit) > 1])
            start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            made_at = np.searchsorted(self.keys, symbols[hit] * self.width + symbols[hit + 1])
            symbols[hit] = self.made[made_at]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            symbols, piece = symbols[keep], piece[keep]
        ids, piece = np.concatenate(done_ids), np.concatenate(done_piece)
        order = np.argsort(piece, kind="stable")
        return ids[order], np.bincount(piece, minlength=len(raw))

    def cut(self, text: str) -> list[str]:
        if self.split is None or not any(t in text for t in self.added):
            return self.pieces.findall(text)
        out, end = [], 0
        for m in self.split.finditer(text):
            out += self.pieces.findall(text[end : m.start()])
            out.append(m.group())
            end = m.end()
        return out + self.pieces.findall(text[end:])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers."""
        cuts = [self.cut(t) for t in texts]
        if len(self.known) > MOST_PIECES or self.held > MOST_BYTES:
            self._reset()
        known, fresh = self.known, []
        before = len(known)
        for words in cuts:
            for w in set(words):
                if w not in known:
                    known[w] = before + len(fresh)
                    fresh.append(w.encode())
        if fresh:
            self.held += sum(map(len, fresh))
            ids, n = self.merge(fresh)
            self.flat.append(ids)
            self.lengths.append(n)
        flat, lengths = np.concatenate(self.flat), np.concatenate(self.lengths)
        self.flat, self.lengths = [flat], [lengths]
        begins = np.cumsum(lengths) - lengths
        count = np.fromiter(map(len, cuts), dtype=np.int64, count=len(cuts))
        codes = np.fromiter((known[w] for words in cuts for w in words), dtype=np.int64, count=int(count.sum()))
        n = lengths[codes]
        total = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(begins[codes] - total[:-1], n) + np.arange(total[-1])
        ids = flat[take].astype("<u4")
        ends = total[np.concatenate([[0], np.cumsum(count)])]
        return [ids[lo:hi] for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


def encode(df: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """Encode and decode every text with the tokenizer file at `tokenizer`.

    Returns `key`, ids (array of long), n_tokens, ids_sha256, decoded_sha256 (see `_coded`). A null text counts as the
    empty one, which has no ids; equal rows give equal results; a text of any length is encoded whole, a round holds about
    ROUND_CHARS characters. Other columns are not read; an empty table gives no rows.
    """
    return _coded(df, key, text, tokenizer, True)


def _coded(df: DataFrame, key: str, text: str, tokenizer: str, with_ids: bool) -> DataFrame:
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    kept = df.select(F.col(key), F.col(text))
    kind = f"`{key}` {df.schema[key].dataType.simpleString()}, " + "ids array<bigint>, " * with_ids + "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(spec)
        for batch in (whole.slice(at, DOCS) for whole in batches for at in range(0, len(whole), DOCS)):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(np.array([len(t) for t in texts], dtype=np.int64), ROUND_CHARS):
                ids = bpe.encode_batch(texts[lo:hi])
                decoded = [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]
                columns = [batch.column(0).slice(lo, hi - lo)]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                columns += [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, *["ids"] * with_ids, "n_tokens", "ids_sha256", "decoded_sha256"])

    return kept.mapInArrow(run, kind)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(table(spark, sf_dir, "documents"), "doc_id", "text", default_tokenizer(), False)


QUERIES = {"op4_bpe_round_trip": op4_bpe_round_trip}
