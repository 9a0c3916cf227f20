"""Kernel search: all consistent scenarios.

Three strategies. A generic scan steps every scenario, for rules that promise no
margin. A sweep tests every scenario against its rivals. Branch and bound builds
scenarios descriptor by descriptor and drops a prefix as soon as some decided
descriptor cannot be saved by any completion: for each pair of its variants the
lead of the rival over the chosen one, plus the least that every undecided
descriptor must add to it, already exceeds the margin. The bound takes the least
over one shared variant choice per descriptor, which is what makes it sharp.

consistent_frame gives the kernel as a DataFrame, whatever its size; find_consistent
collects it, for kernels that a list can hold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import INT64, Model, signature_order
from ..plans.dynamics import Space, digits_of
from ..plans.rules import GLOBAL, Rule, margin_of
from ..session import ship
from ..storage import Scratch

#: Below this many scenarios a sweep is simply done.
SMALL = 100_000
#: Branch and bound may visit one node for so many scenarios before the sweep takes over.
BUDGET = 16
BLOCK = 8_192
TASKS_A_CORE = 4


def find_consistent(spark: SparkSession, model: Model, rule: Rule = GLOBAL, algorithm: str = "auto", node_budget: int | None = None) -> list[tuple[int, ...]]:
    """Digits of all consistent scenarios, by ascending signature, as a list."""
    return signature_order(r["digits"] for r in consistent_frame(spark, model, rule, algorithm, node_budget).select("digits").collect())


def consistent_frame(spark: SparkSession, model: Model, rule: Rule = GLOBAL, algorithm: str = "auto", node_budget: int | None = None) -> DataFrame:
    """sig (bigint; decimal(38,0) where the space is wider), digits of all consistent scenarios, in no order."""
    if algorithm not in ("auto", "sweep", "bnb"):
        raise ValueError(f"algorithm {algorithm!r}: choose auto, sweep or bnb")
    margin, count = margin_of(rule), model.scenario_count()
    if margin is None:
        if algorithm != "auto":
            raise ValueError("this rule promises no fixed-point margin, so only the generic scan applies; leave algorithm out")
        if count - 1 > INT64:
            raise OverflowError(f"{count} scenarios cannot be scanned one by one; a rule with a margin opens branch and bound")
        return _with_digits(scan(spark, model, rule), model)
    if algorithm == "sweep" or (algorithm == "auto" and count < SMALL):
        return _with_digits(sweep(spark, model, margin), model)
    budget = node_budget if node_budget is not None else count // BUDGET if algorithm == "auto" else None
    found = branch_and_bound_frame(spark, model, margin, budget)
    if found is not None:
        return found
    if count - 1 > INT64:
        raise OverflowError(f"branch and bound gave up after {budget} nodes, and {count} scenarios cannot be swept. What still works: a larger node_budget, algorithm='bnb', or product_basins where the model splits into islands.")
    return _with_digits(sweep(spark, model, margin), model)


def _with_digits(frame: DataFrame, model: Model) -> DataFrame:
    return frame.select("sig", C.digits("sig", model).alias("digits"))


def kernel_frame(spark: SparkSession, model: Model, kernel: Sequence[Sequence[int]]) -> DataFrame:
    """sig decimal(38,0), digits, by ascending signature."""
    rows = [(model.signature(u), list(u)) for u in signature_order(kernel)]
    table = spark.createDataFrame([(str(s), d) for s, d in rows], "sig string, digits array<int>")
    return table.select(F.col("sig").cast("decimal(38,0)").alias("sig"), "digits")


def high_parts(spark: SparkSession, count: int, low: int) -> DataFrame:
    """One row per high part of the space, spread for balance over many small tasks."""
    parts = -(-count // low)
    cores = spark.sparkContext.defaultParallelism
    return spark.range(0, parts, 1, int(max(1, min(parts, 16 * cores))))


def sweep(spark: SparkSession, model: Model, margin: int = 0) -> DataFrame:
    """sig of every consistent scenario, by testing all."""
    model.max_signature()
    space = Space(model)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for index in b.column(0).to_pylist():
                if len(found := space.consistent(index, margin)):
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["sig"])

    return high_parts(ship(spark), model.scenario_count(), space.low).mapInArrow(test, "sig bigint")


def scan(spark: SparkSession, model: Model, rule: Rule) -> DataFrame:
    """sig of every scenario that the rule leaves alone."""
    n = model.max_signature() + 1

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy()
            d = digits_of(at, model)
            still = (rule.step(d, model) == d).all(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(at[still], pa.int64())], ["sig"])

    return ship(spark).range(n).withColumnRenamed("id", "sig").mapInArrow(test, "sig bigint")


def coupled_first(model: Model) -> list[int]:
    """Order of descriptors: the one most coupled to those before it, first the most coupled of all."""
    d = len(model.sizes)
    if d <= 2:
        return list(range(d))
    heads = np.array(model.offsets)
    pull = np.add.reduceat(np.add.reduceat(np.abs(model.matrix), heads, axis=0), heads, axis=1)
    pull = pull + pull.T
    np.fill_diagonal(pull, 0)
    order = [int(pull.sum(axis=1).argmax())]
    while len(order) < d:
        left = [k for k in range(d) if k not in order]
        order.append(max(left, key=lambda k: (pull[k, order].sum(), -k)))
    return order


class Bounds:
    """Of a model in search order. tail[i][k]: for descriptor i, chosen and rival variant, the least the descriptors from k on add to the rival's lead."""

    def __init__(self, model: Model, margin: int):
        self.model, self.margin = model, margin
        d = len(model.sizes)
        self.tail = []
        for o, n in zip(model.offsets, model.sizes, strict=True):
            block = model.matrix[:, o : o + n]
            lead = block[:, None, :] - block[:, :, None]  # row, chosen, rival
            after = np.zeros((d + 1, n, n), np.int64)
            for k in range(d - 1, -1, -1):
                rows = slice(model.offsets[k], model.offsets[k] + model.sizes[k])
                after[k] = after[k + 1] + lead[rows].min(axis=0)
            self.tail.append(after)

    def expand(self, digits: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The surviving children of prefixes, in order."""
        k = digits.shape[1]
        n, o = self.model.sizes[k], self.model.offsets[k]
        digits = np.concatenate([np.repeat(digits, n, axis=0), np.tile(np.arange(n), len(digits))[:, None]], axis=1)
        scores = np.repeat(scores, n, axis=0) + self.model.matrix[o + digits[:, -1]]
        good = np.ones(len(digits), bool)
        at = np.arange(len(digits))
        for i in range(k + 1):
            oi, ni = self.model.offsets[i], self.model.sizes[i]
            block = scores[:, oi : oi + ni]
            chosen = digits[:, i]
            lead = block - block[at, chosen][:, None] + self.tail[i][k + 1][chosen]
            good &= lead.max(axis=1) <= self.margin
        return digits[good], scores[good]

    def search(self, digits: np.ndarray, scores: np.ndarray, most: int | None = None) -> tuple[list[np.ndarray], int, list[np.ndarray]]:
        """Depth first over blocks of prefixes: (consistent scenarios, nodes, prefixes left open when `most` nodes are spent)."""
        full, found, nodes, stack = len(self.model.sizes), [], 0, [(digits, scores)]
        while stack:
            if most is not None and nodes > most:
                return found, nodes, [d for d, _ in stack]
            digits, scores = stack.pop()
            if digits.shape[1] == full:
                found.append(digits)
                continue
            if len(digits) > BLOCK:
                stack += [(digits[a : a + BLOCK], scores[a : a + BLOCK]) for a in range(0, len(digits), BLOCK)]
                continue
            nodes += len(digits) * self.model.sizes[digits.shape[1]]
            digits, scores = self.expand(digits, scores)
            if len(digits):
                stack.append((digits, scores))
        return found, nodes, []

    def scores(self, digits: np.ndarray) -> np.ndarray:
        """Of prefixes."""
        out = np.zeros((len(digits), self.model.dimensions), np.int64)
        for k in range(digits.shape[1]):
            out += self.model.matrix[self.model.offsets[k] + digits[:, k]]
        return out


#: Up to so many nodes the driver searches alone; more are spread over the cluster.
ALONE = 300_000
#: Nodes that a task searches in a round, for each of its prefixes' batches, before what is left is dealt anew.
SHARE = 4_000_000


def _begin(model: Model, margin: int) -> tuple[Bounds, np.ndarray, np.ndarray, np.ndarray]:
    """Bounds in search order, the empty prefix with its scores, and the way back to the model's order."""
    order = coupled_first(model)
    return Bounds(model.permuted(order), margin), np.zeros((1, 0), np.int64), np.zeros((1, model.dimensions), np.int64), np.argsort(order)


def branch_and_bound(model: Model, margin: int = 0, budget: int | None = None) -> list[tuple[int, ...]] | None:
    """On this machine: all consistent scenarios by ascending signature, or None when the budget of nodes is spent."""
    bounds, digits, scores, back = _begin(model, margin)
    found, nodes, left = bounds.search(digits, scores, budget)
    return None if left else signature_order(tuple(row[back]) for block in found for row in block)


def branch_and_bound_frame(spark: SparkSession, model: Model, margin: int = 0, budget: int | None = None) -> DataFrame | None:
    """sig, digits; or None when the budget of nodes, which all tasks share, is spent.

    Small searches are done here. Others run in rounds: every task searches its
    prefixes depth first up to a number of nodes and gives back what it found, the
    nodes it spent, and the prefixes it has left, which the next round deals anew. So
    a deep subtree is split again, and the budget is charged for nodes really spent.
    """
    bounds, digits, scores, back = _begin(model, margin)
    full = len(model.sizes)
    found, nodes, left = bounds.search(digits, scores, ALONE if budget is None else min(budget, ALONE))
    rows = [row.tolist() for block in found for row in block]
    here = spark.createDataFrame([(r,) for r in rows], "digits array<int>")
    if left and budget is not None and nodes > budget:
        return None
    parts = [here]
    if left:
        ship(spark)
        tasks = 4 * TASKS_A_CORE * spark.sparkContext.defaultParallelism
        open_now = spark.createDataFrame([(row.tolist(),) for block in left for row in block], "digits array<int>")
        with Scratch(spark) as scratch:
            while True:
                share = SHARE if budget is None else max(1, min(SHARE, (budget - nodes) // tasks + 1))
                out = scratch.write(open_now.repartition(tasks, F.xxhash64("digits")).mapInArrow(_digger(bounds, share), "digits array<int>, nodes bigint"))
                nodes += out.agg(F.sum("nodes")).first()[0] or 0
                if budget is not None and nodes > budget:
                    return None
                open_now = out.filter(F.size("digits") < full)
                parts.append(out.filter(F.size("digits") == full).select("digits"))
                scratch.keep(out)
                if open_now.isEmpty():
                    break
    table = parts[0]
    for part in parts[1:]:
        table = table.union(part.select("digits"))
    ordered = table.select(F.array(*(F.get("digits", F.lit(int(k))) for k in back)).alias("digits"))
    return ordered.select(C.signature(F.col("digits"), model).alias("sig"), "digits")


def _digger(bounds: Bounds, share: int):
    """Rows of prefixes -> scenarios and open prefixes (digits), and one row with the nodes spent for each batch."""

    def dig(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length: dict[int, list[list[int]]] = {}
            for row in batch.column(0).to_pylist():
                by_length.setdefault(len(row), []).append(row)
            spent = 0
            for rows in by_length.values():
                d = np.array(rows, np.int64)
                found, nodes, left = bounds.search(d, bounds.scores(d), max(0, share - spent))
                spent += nodes
                for block in (*found, *left):
                    yield pa.RecordBatch.from_arrays([pa.array(block.tolist(), pa.list_(pa.int32())), pa.nulls(len(block), pa.int64())], ["digits", "nodes"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.list_(pa.int32())), pa.array([spent], pa.int64())], ["digits", "nodes"])

    return dig
