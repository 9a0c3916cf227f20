"""Quality classifier: a factorisation machine.

Features of a text: hashed words (weights are square roots of their shares, so a
text has length 1 whatever its size), structure statistics, and its sizes as
metadata. Pairs of features interact through low-rank factors; by the
sum-of-squares identity a score costs time linear in the features present:

    sum over pairs <v_i, v_j> x_i x_j = 1/2 sum over factors ((sum v x)^2 - sum v^2 x^2)

The model is trained on the driver from at most `sample` labelled rows (a
documented bound: those with the lowest hashes of their ids, outside the held-out
fold), whose features the executors compute; every text is then scored whole.

Rows whose crc32 of the id as text is divisible by 5 are held out and never
learned from. Labels, lang, source and ids are never inputs of a score. Null
texts count as empty, empty ones are scored, very long ones are read whole. Null
labels and ids are not learned from; of repeated labels the larger counts, of
different texts of one id the first in their order. Without labelled rows all scores
are 0.5. Every row gives one row, repeated ones too; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import thrifty
from .word_bpe import Remembered

BITS = 15
STATISTICS = 16
FACTORS = 8
CUT = 0.3
_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


_place = Remembered(lambda w: xxhash.xxh3_64_intdigest(w) >> (64 - BITS), 100_000)


def forget() -> None:
    _place.clear()


def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words present, their weights, and the statistics."""
    words = text.split()
    n = max(1, len(words))
    seen, counts = np.unique(np.fromiter(map(_place.__getitem__, map(str.lower, words)), np.int64, len(words)), return_counts=True)
    size = max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    count = text.count
    letters = len(_WORD.findall(text))
    upper = sum(map(str.isupper, words))
    symbols = sum(map(count, "#*$%&|<>"))
    distinct = len(set(words))
    top = int(counts.max()) if len(counts) else 0
    statistics = np.array([
        1.0,
        np.log1p(size) / 10,
        np.log1p(len(words)) / 10,
        min(4.0, size / n / 8),
        distinct / n,
        top / n,
        min(2.0, symbols / n),
        min(2.0, (count("!") + count("?")) / n),
        min(2.0, (count(".") + count(",")) / n),
        upper / n,
        min(2.0, sum(map(count, "0123456789")) / n),
        1 - len(set(lines)) / max(1, len(lines)),
        min(4.0, np.log1p(len(words) / max(1, len(lines))) / 3),
        min(2.0, letters / n),
        min(2.0, (count("{") + count("}") + count("=") + count(";") + count("<")) / n),
        min(4.0, max(map(len, words), default=0) / 40),
    ])
    return seen, np.sqrt(counts / n), statistics


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip((statistics - self.mean) / self.scale, -4, 4) / 4

    def scores(self, texts: list[str]) -> np.ndarray:
        """Of a batch, all at once."""
        if not texts:
            return np.zeros(0)
        found = [features(t) for t in texts]
        own = (1 << BITS) + np.arange(STATISTICS)
        at = np.concatenate([x for seen, _, _ in found for x in (seen, own)])
        x = np.concatenate([x for _, weights, statistics in found for x in (weights, self.standard(statistics))])
        begin = np.cumsum([0, *(len(seen) + STATISTICS for seen, _, _ in found[:-1])])
        v = self.factors[at] * x[:, None]
        raw = self.bias + np.add.reduceat(self.linear[at] * x, begin) + 0.5 * (np.add.reduceat(v, begin) ** 2 - np.add.reduceat(v**2, begin)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], epochs: int = 12, batch: int = 256, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss by AdaGrad over shuffled batches."""
    width = (1 << BITS) + STATISTICS
    draw = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(width), np.zeros((width, FACTORS)), np.zeros(STATISTICS), np.ones(STATISTICS))
    if not rows:
        return machine
    machine.factors = draw.normal(0, 0.05, (width, FACTORS))
    table = np.stack([r[2] for r in rows])
    machine.mean, machine.scale = table.mean(axis=0), table.std(axis=0) + 1e-3
    good = sum(r[3] for r in rows)
    machine.bias = float(np.log((good + 1) / (len(rows) - good + 1)))
    own = (1 << BITS) + np.arange(STATISTICS)
    ready = [(np.concatenate([s, own]), np.concatenate([w, machine.standard(t)]), y) for s, w, t, y in rows]
    g_linear, g_factors, g_bias = np.full(width, 1e-8), np.full((width, FACTORS), 1e-8), 1e-8
    for _ in range(epochs):
        order = draw.permutation(len(ready))
        for k in range(0, len(order), batch):
            part = [ready[i] for i in order[k : k + batch]]
            at, x, y = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part]), np.array([p[2] for p in part])
            begin = np.cumsum([0, *(len(p[0]) for p in part[:-1])])
            of = np.repeat(np.arange(len(part)), [len(p[0]) for p in part])
            v = machine.factors[at]
            vx = v * x[:, None]
            total = np.add.reduceat(vx, begin)
            raw = machine.bias + np.add.reduceat(machine.linear[at] * x, begin) + 0.5 * (total**2 - np.add.reduceat(vx**2, begin)).sum(axis=1)
            off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y) / len(part)
            each = off[of] * x
            used, back = np.unique(at, return_inverse=True)
            d_linear = np.bincount(back, each, len(used)) + decay * machine.linear[used]
            d_factors = np.stack([np.bincount(back, each * (total[of, f] - vx[:, f]), len(used)) for f in range(FACTORS)], axis=1) + decay * machine.factors[used]
            g_linear[used] += d_linear**2
            g_factors[used] += d_factors**2
            machine.linear[used] -= rate * d_linear / np.sqrt(g_linear[used])
            machine.factors[used] -= rate * 0.3 * d_factors / np.sqrt(g_factors[used])
            g_bias += float(off.sum()) ** 2
            machine.bias -= rate * float(off.sum()) / np.sqrt(g_bias)
    return machine


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 8000) -> Machine:
    """A machine from at most `sample` labelled rows outside the held-out fold."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label is not null").filter(~held_out(F.col("id")))
    chosen = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most `sample` pairs of numbers; of rows that share an id one is enough
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t.as_py() or "") for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0].astype(np.int32).tobytes() for g in got], pa.binary()), pa.array([g[1].astype(np.float32).tobytes() for g in got], pa.binary()), pa.array([g[2].tobytes() for g in got], pa.binary()), b.column(1)], ["seen", "weights", "statistics", "label"])

    found = rows.mapInArrow(thrifty(measure, forget), "seen binary, weights binary, statistics binary, label int").collect()
    read = sorted((bytes(r[0]), bytes(r[1]), bytes(r[2]), r[3]) for r in found)  # in an order of their own: the same model each time
    return train([(np.frombuffer(s, np.int32).astype(np.int64), np.frombuffer(w, np.float32).astype(float), np.frombuffer(t), int(y)) for s, w, t, y in read])


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """docs with held_out, score and predicted added (columns of these names are replaced)."""
    spark = docs.sparkSession
    judge = _judge(spark.sparkContext.broadcast(machine))  # about 4 MB, whatever the corpus
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn("held_out", held_out(F.col(id_col))).withColumn("score", judge(text)).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def _judge(shared: Broadcast) -> Callable[[Column], Column]:
    """Scores of a column, some texts at a time, so that a batch of long ones stays small."""

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [texts.iloc[k : k + 64].tolist() for k in range(0, len(texts), 64)]
            yield pd.Series(np.concatenate([shared.value.scores(p) for p in parts]) if parts else [], dtype=float)

    return F.pandas_udf(thrifty(judge, forget), "double")


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT, **options) -> DataFrame:
    """The rows of docs that are not rejected, with the columns of docs."""
    judge = _judge(docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options)))
    return docs.filter(judge(F.coalesce(F.col("text").cast("string"), F.lit(""))) >= cut)
