"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary (levels of collision-free
slots, ranked) resolves a whole pre-token that is itself a token; one comparison
of bytes tells a member from a stranger. Second tier: other pre-tokens start as
a linked list of bytes, and a heap hands out the adjacent pair of lowest rank
until no pair is in the vocabulary.

Pre-tokens are remembered up to a bound. With the public tokenizers' own pattern,
where no two white-space characters meet and none stands at an end of a line, a
text can be cut at single spaces and line feeds first, since no pre-token goes on
past such a place; other texts, and all under another pattern, go through the
pattern as a whole. Both give the same ids.

Null counts as empty: no ids, digests of nothing. Very long texts are encoded whole,
pre-token by pre-token. Every row gives one row, repeated ids and texts too; an empty
table gives none. No other column of the input is read, so extra columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path
from .word_bpe import Remembered

_ROUGH = re.compile(r"\s\s|\A\s|\s\Z|[^\S \n]")


def _own_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class MinimalPerfectHash:
    """Maps the n given keys one to one onto 0..n-1; other keys anywhere or to -1."""

    def __init__(self, keys: list[bytes], spread: float = 2.0):
        self.levels: list[tuple[int, int, bytes, np.ndarray]] = []
        left, base, level = list(keys), 0, 0
        while left:
            size = max(8, int(len(left) * spread))
            slots = np.fromiter((xxhash.xxh3_64_intdigest(k, level) % size for k in left), np.int64, len(left))
            taken = np.bincount(slots, minlength=size) == 1
            ranks = np.cumsum(taken) - 1 + base
            self.levels.append((level, size, taken.tobytes(), ranks.astype(np.int64)))
            alone = taken[slots]
            base += int(taken.sum())
            left = [k for k, a in zip(left, alone, strict=True) if not a]
            level += 1

    def slot(self, key: bytes) -> int:
        for level, size, taken, ranks in self.levels:
            at = xxhash.xxh3_64_intdigest(key, level) % size
            if taken[at]:
                return int(ranks[at])
        return -1


class ByteBpe:
    def __init__(self, path: str, pattern: str, most: int = 400_000):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.cuts_at_spaces = pattern == _own_pattern()
        keys = list(self.ranks)
        self.hash = MinimalPerfectHash(keys)
        self.slots: list[tuple[bytes, int]] = [(b"", 0)] * len(keys)
        for k in keys:
            self.slots[self.hash.slot(k)] = (k, self.ranks[k])
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for k, r in self.ranks.items():
            self.tokens[r] = k
        self.pre_tokens = Remembered(self._pre_token, most)
        self.pieces = Remembered(self._piece, most)

    def _pre_token(self, pre_token: str) -> bytes:
        raw = pre_token.encode("utf-8", "surrogatepass")
        at = self.hash.slot(raw)
        if at >= 0 and self.slots[at][0] == raw:
            return array("I", [self.slots[at][1]]).tobytes()
        return array("I", self.merge(raw)).tobytes()

    def merge(self, raw: bytes) -> list[int]:
        """The heap over linked bytes."""
        rank, n = self.ranks.get, len(raw)
        bits = n.bit_length()
        mask, wide = (1 << bits) - 1, 2 * bits
        ends = list(range(1, n + 1))  # of the part that starts at each position; 0: merged away
        before = list(range(-1, n - 1))
        # rank, begin and end of a pair as one number, which orders as the three do
        heap = [r << wide | i << bits | i + 2 for i in range(n - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            best = heappop(heap)
            i, end = best >> bits & mask, best & mask
            middle = ends[i]
            if not middle or middle >= n or ends[middle] != end:
                continue  # a neighbour has changed since
            ends[i], ends[middle] = end, 0
            if end < n:
                before[end] = i
                if (r := rank(raw[i : ends[end]])) is not None:
                    heappush(heap, r << wide | i << bits | ends[end])
            if (j := before[i]) >= 0 and (r := rank(raw[j:end])) is not None:
                heappush(heap, r << wide | j << bits | end)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : ends[i]]])
            i = ends[i]
        return out

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self.pre_tokens.__getitem__, self.pattern.findall(piece)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.cuts_at_spaces or _ROUGH.search(text):
            return self._piece_of_any_length(text)
        known, out = self.pieces, []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.pre_tokens["\n"])
            first, *rest = line.split(" ")
            out.append(known[first])
            out += map(known.__getitem__, map(" ".__add__, rest))
        return b"".join(out)

    def _piece_of_any_length(self, text: str) -> bytes:
        known = self.pre_tokens
        return b"".join(known[m[0]] for m in self.pattern.finditer(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def byte_bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids (binary).

    vocabulary: a rank file of the public tokenizers, or a path. pattern: what
    splits the text, by default that of the public tokenizers.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary if "/" in vocabulary else tokenizer_path(vocabulary), pattern or _own_pattern())
        for batch in batches:
            n, ids_sha, decoded_sha, all_ids = [], [], [], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns, names = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(all_ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return rows.mapInArrow(encode, f"doc_id {kind.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
