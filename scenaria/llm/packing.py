"""Packing: documents into fixed sequences, as a cutting-stock problem.

Documents become token ids plus an end id, and only those longer than a sequence
are cut (into whole sequences and a rest). The lengths of all pieces go into a
histogram of `classes` length classes, the only thing the driver gets; its size
is fixed. A linear program chooses patterns (how many pieces of each class share
a sequence) with the fewest sequences; its columns are generated: the dual prices
of the length classes go to an unbounded knapsack, solved by dynamic programming,
which returns the pattern most worth adding, until none is (or the bound of
Farley says that less than `gap` is left to gain). Pattern counts are rounded
down and the rest is filled greedily from the largest class down.

Pieces are ranked within their class (hash buckets with counted offsets, so no
class goes to a single task), and the rank alone says which copy of which
pattern a piece belongs to. Offsets are running sums within a sequence.

Null and empty texts are the end id alone, very long ones are encoded whole and cut.
Repeated rows are packed as often as they occur. An empty table gives no piece. No
column but id and text is read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, thrifty, tokenizer_path
from .word_bpe import LibraryEncoder

SEQUENCE = 4096
END_ID = 2
CLASSES = 512


@lru_cache(1)
def _encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def forget() -> None:
    _encoder.cache_clear()


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document in pieces of at most `length` ids."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary if "/" in vocabulary else tokenizer_path(vocabulary))
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            of, start, size, crc, total = [], [], [], [], []
            for k, t in enumerate(batch.column(1)):
                ids = memoryview(encoder.encode(t.as_py() or "") + end)
                n = len(ids) // 4
                for at in range(0, n, length):
                    of.append(k)
                    start.append(at)
                    size.append(min(length, n - at))
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + length)]))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(thrifty(cut, forget), f"doc_id {kind.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def knapsack(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items that fits, by dynamic programming; sizes ascend."""
    worth, choice = np.zeros(room + 1), np.full(room + 1, -1)
    reach = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for s in range(1, room + 1):
        worth[s] = worth[s - 1]
        if reach[s]:
            got = worth[s - sizes[: reach[s]]] + prices[: reach[s]]
            best = int(got.argmax())
            if got[best] > worth[s] + 1e-12:
                worth[s], choice[s] = got[best], best
    taken, s = np.zeros(len(sizes), np.int64), room
    while s > 0:
        if choice[s] < 0:
            s -= 1
        else:
            taken[choice[s]] += 1
            s -= int(sizes[choice[s]])
    return float(worth[room]), taken


def generate_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 0.0005, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """(pattern, how often) of the linear program, by revised simplex with generated columns."""
    m = len(sizes)
    columns = np.diag((room // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    amount = inverse @ demand
    for _ in range(rounds):
        prices = np.maximum(inverse.sum(axis=0), 0)
        worth, pattern = knapsack(prices, sizes, room)
        if worth <= 1 + 1e-9 or amount.sum() * (1 - gap) <= prices @ demand / worth:
            break
        enter = inverse @ pattern
        rows = np.nonzero(enter > 1e-9)[0]
        if not len(rows):
            break
        leave = int(rows[np.argmin(amount[rows] / enter[rows])])
        step = amount[leave] / enter[leave]
        amount -= step * enter
        amount[leave] = step
        np.maximum(amount, 0, out=amount)
        pivot = inverse[leave] / enter[leave]
        inverse -= np.outer(enter, pivot)
        inverse[leave] = pivot
        columns[:, leave] = pattern
    return [(columns[:, k].astype(np.int64), float(amount[k])) for k in range(m) if amount[k] > 1e-9]


def plan(histogram: dict[int, int], room: int = CLASSES) -> list[tuple[dict[int, int], int]]:
    """(pattern as {class: pieces}, copies), enough for every piece: rounded down, the rest from the largest class down."""
    sizes = np.array(sorted(histogram), np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[int(s)] for s in sizes], np.int64)
    out = []
    for pattern, amount in sorted(generate_patterns(sizes, left.astype(float), room), key=lambda x: -x[1]):
        used = pattern > 0
        copies = min(int(amount + 1e-6), int((left[used] // pattern[used]).min()))
        if copies:
            left -= copies * pattern
            out.append(({int(s): int(a) for s, a in zip(sizes, pattern, strict=True) if a}, copies))
    while left.any():
        free, taken = room, {}
        for k in range(len(sizes) - 1, -1, -1):
            if n := min(int(left[k]), free // int(sizes[k])):
                taken[k] = n
                free -= n * int(sizes[k])
        copies = min(int(left[k]) // n for k, n in taken.items())
        for k, n in taken.items():
            left[k] -= copies * n
        out.append(({int(sizes[k]): n for k, n in taken.items()}, copies))
    return out


def pack(pieces: DataFrame, length: int = SEQUENCE, classes: int = CLASSES) -> DataFrame:
    """pieces with sequence_id and offset. pieces is read several times: give a table, not a computation."""
    width = length // classes
    if length % classes:
        raise ValueError("length must be a multiple of classes")
    pieces = pieces.withColumn("size", F.ceil(F.col("length") / width).cast("int"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("size").agg(F.count("*")).collect()}
    patterns = plan(histogram, classes)
    buckets = min(4096, max(16, sum(histogram.values()) // 20_000))

    # slots of each class in order: where they begin, how many a copy holds, the first copy's sequence
    begins: dict[int, list[tuple[int, int, int]]] = {}
    count, base = dict.fromkeys(histogram, 0), 0
    for pattern, copies in patterns:
        for size, a in pattern.items():
            begins.setdefault(size, []).append((count[size], a, base))
            count[size] += a * copies
        base += copies
    table = {s: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for s, v in begins.items()}

    # by the number of the row, so rows that repeat are dealt like all others
    pieces = pieces.withColumn("row", F.monotonically_increasing_id())
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("size", "bucket").agg(F.count("*").alias("n")).select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = Window.partitionBy("size", "bucket").orderBy("row")
    ranked = pieces.withColumn("place", F.row_number().over(place)).join(offsets, ["size", "bucket"]).withColumn("rank", F.col("place") - 1 + F.col("first"))

    @F.pandas_udf("sequence_id bigint, slot bigint")
    def seat(size, rank):
        import pandas as pd

        size, rank = size.to_numpy(), rank.to_numpy()
        sequence, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s in np.unique(size):
            at = size == s
            begin, held, first = table[int(s)]
            k = np.searchsorted(begin, rank[at], side="right") - 1
            local = rank[at] - begin[k]
            sequence[at], slot[at] = first[k] + local // held[k], local % held[k]
        return pd.DataFrame({"sequence_id": sequence, "slot": slot})

    seated = ranked.withColumn("seat", seat("size", "rank"))
    inside = Window.partitionBy("seat.sequence_id").orderBy(F.desc("size"), "seat.slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0))
    names = [c for c in pieces.columns if c not in ("size", "bucket", "row")]
    return seated.select(*names, F.col("seat.sequence_id").alias("sequence_id"), offset.alias("offset"))


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(materialise(token_pieces(docs, **options)))
