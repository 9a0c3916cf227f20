"""Basin shares by sampling, with score intervals, where spaces defeat exact counts.

One Spark row is one numbered block of samples with a stream of its own, so the
hits depend on seed and sample count alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import wilson as wilson_columns
from ..functions.random import BLOCK, SEED, block_digits, wilson, z_for
from ..model import Model, signature_order
from ..plans.rules import GLOBAL, Rule, margin_of
from ..session import ship
from .kernel import consistent_frame, find_consistent


@dataclass(frozen=True)
class BasinEstimate:
    """shares and intervals by fixed point (ascending signature), and for cycles."""

    model: Model
    fixed_points: tuple[tuple[int, ...], ...]
    hits: tuple[int, ...]
    shares: tuple[float, ...]
    ci_low: tuple[float, ...]
    ci_high: tuple[float, ...]
    size_estimates: tuple[float, ...]
    cycle_hits: int
    cycle_share: float
    cycle_ci_low: float
    cycle_ci_high: float
    samples: int
    seed: int
    confidence: float
    scenario_count: int

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per attractor and one (digits null) for cycles; intervals are worked out by Spark."""
        rows = [(list(u), h) for u, h in zip(self.fixed_points, self.hits, strict=True)]
        base = spark.createDataFrame([*rows, (None, self.cycle_hits)], "digits array<int>, hits bigint")
        return _framed(base, self.samples, self.confidence, self.scenario_count)


def walk_ends(digits: np.ndarray, model: Model, rule: Rule, names: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last state, whether it is a fixed point, steps) of every walk, all at once.

    Brent's method: a tortoise waits at powers of two; a walk that meets it is in
    a cycle, one that stands still has arrived. Walks that are done drop out. Steps
    are those of that method, in which also a fixed point is met as a cycle of one;
    with `names`, cycles are gone round once more, and end in their member of least
    signature.
    """
    state = digits.copy()
    ends, still, steps, ring = digits.copy(), np.zeros(len(digits), bool), np.zeros(len(digits), np.int64), np.zeros(len(digits), np.int64)
    alive = np.arange(len(digits))
    tortoise, power, lap, count = state.copy(), 1, 0, 0
    while len(alive):
        to = rule.step(state, model)
        lap, count = lap + 1, count + 1
        fixed = (to == state).all(axis=1)
        cycle = (to == tortoise).all(axis=1) & ~fixed
        done = fixed | cycle
        ends[alive[done]] = to[done]
        still[alive[fixed]] = True
        steps[alive[fixed]] = 1 << (count - 1).bit_length()
        steps[alive[cycle]] = count
        ring[alive[cycle]] = lap
        alive, state, tortoise = alive[~done], to[~done], tortoise[~done]
        if lap == power:
            tortoise, power, lap = state.copy(), power * 2, 0
    if names:
        steps += np.maximum(ring - 1, 0)
        round_, state = np.nonzero(ring > 1)[0], ends.copy()
        for k in range(1, int(ring.max(initial=0))):
            round_ = round_[ring[round_] > k]
            state[round_] = rule.step(state[round_], model)
            less = _less(state[round_], ends[round_])
            ends[round_[less]] = state[round_[less]]
    return ends, still, steps


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, by signature: the last digit that differs decides."""
    apart = (a != b)[:, ::-1]
    at = a.shape[1] - 1 - apart.argmax(axis=1)
    each = np.arange(len(a))
    return apart.any(axis=1) & (a[each, at] < b[each, at])


def sampled_hits(spark: SparkSession, model: Model, rule: Rule, samples: int, seed: int) -> DataFrame:
    """digits (null: cycles), hits of the attractors that samples reach; a row for each task's attractors is all that is shuffled."""
    if samples < 1:
        raise ValueError("samples must be at least 1")
    blocks = -(-samples // BLOCK)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                start = block_digits(seed, k, min(BLOCK, samples - k * BLOCK), model.sizes)
                unique, weight = np.unique(start, axis=0, return_counts=True)
                ends, still, _ = walk_ends(unique, model, rule)
                hit, back = np.unique(ends[still], axis=0, return_inverse=True)
                hits = np.bincount(back.ravel(), weight[still], len(hit)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([*hit.tolist(), None], pa.list_(pa.int32())), pa.array([*hits.tolist(), int(weight[~still].sum())], pa.int64())], ["digits", "hits"])

    return ship(spark).range(0, blocks, 1, min(blocks, 16 * spark.sparkContext.defaultParallelism)).mapInArrow(draw, "digits array<int>, hits bigint").groupBy("digits").agg(F.sum("hits").alias("hits"))


def _framed(hits: DataFrame, samples: int, confidence: float, scenarios: int) -> DataFrame:
    low, high = wilson_columns(F.col("hits"), F.lit(samples), z_for(confidence))
    share = F.col("hits") / F.lit(samples)
    return hits.select("digits", "hits", share.alias("share"), low.alias("ci_low"), high.alias("ci_high"), (share * F.lit(float(scenarios))).alias("size_estimate"))


def estimate_frame(spark: SparkSession, model: Model, rule: Rule = GLOBAL, samples: int = 1_000_000, seed: int = SEED, confidence: float = 0.95) -> DataFrame:
    """One row per attractor, those of the kernel without a hit too, and one (digits null) for cycles, however many there are."""
    hits = sampled_hits(spark, model, rule, samples, seed).union(spark.createDataFrame([(None, 0)], "digits array<int>, hits bigint"))
    if margin_of(rule) is not None:
        hits = hits.union(consistent_frame(spark, model, rule).select("digits", F.lit(0).cast("bigint").alias("hits")))
    return _framed(hits.groupBy("digits").agg(F.sum("hits").alias("hits")), samples, confidence, model.scenario_count())


def estimate_basins(spark: SparkSession, model: Model, rule: Rule = GLOBAL, samples: int = 1_000_000, seed: int = SEED, confidence: float = 0.95, kernel: Sequence[Sequence[int]] | None = None) -> BasinEstimate:
    """The kernel is registered first, so attractors without a hit appear with their upper bound."""
    z, count = z_for(confidence), model.scenario_count()
    known = resolve_kernel(spark, model, rule, kernel)
    tally = sampled_hits(spark, model, rule, samples, seed)
    found = {None if r["digits"] is None else tuple(r["digits"]): r["hits"] for r in tally.collect()}
    cycles = found.pop(None, 0)
    for u in known or ():
        found.setdefault(tuple(u), 0)
    fps = signature_order(found)
    hits = tuple(found[u] for u in fps)
    bounds = [wilson(h, samples, z) for h in hits]
    low, high = wilson(cycles, samples, z)
    shares = tuple(h / samples for h in hits)
    return BasinEstimate(model, tuple(fps), hits, shares, tuple(b[0] for b in bounds), tuple(b[1] for b in bounds), tuple(s * count for s in shares), cycles, cycles / samples, low, high, samples, seed, confidence, count)


def resolve_kernel(spark: SparkSession, model: Model, rule: Rule, kernel) -> list[tuple[int, ...]] | None:
    """The kernel given (checked), the model's own for a rule of margin 0, a search, or None where the rule promises no margin."""
    if kernel is not None:
        out = [model.check(u) for u in kernel]
        for u in out:
            if not (rule.step(np.array([u]), model)[0] == u).all():
                raise ValueError(f"{list(u)} is not a fixed point of the rule")
        return out
    margin = margin_of(rule)
    if margin == 0 and model.kernel is not None:
        return [tuple(u) for u in model.kernel]
    return None if margin is None else find_consistent(spark, model, rule)
