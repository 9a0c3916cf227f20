"""Exact basins: how many starts end in each consistent scenario, and how many in cycles.

Mass push: every start carries weight 1. One step of the whole space, summed
where it lands, leaves far fewer states; weight on fixed points is taken out,
and the rest moves on as a DataFrame of (state, weight). When the states are few
enough, tasks follow theirs to the end: each closes its states under the rule and
doubles their pointers, within a bound. What a task gives back, or a frontier that
stays too large, goes on in rounds, and at last by pointers doubled in self-joins.
Weight that does not reach a fixed point is in cycles, transient tails included.

basins_frame gives the result as a DataFrame, whatever its size; find_basins collects
it, for kernels that a list can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import INT64, Model
from ..plans.dynamics import Space, TooMany, digits_of, fast, resolve, step_signatures, stretch
from ..plans.rules import GLOBAL, Rule
from ..session import ship
from ..storage import Scratch

#: Frontier states that a task follows to their ends, and states it may reach on the way.
FEW, REACHED = 250_000, 8_000_000
#: A frontier of more than FEW for each core moves on in rounds, at most so many of them.
ROUNDS = 64
#: States that a task holds before it sums them and lets them go.
CHUNK = 1_048_576

BASINS = "fp bigint, basin_size bigint"


@dataclass(frozen=True)
class Basins:
    """fixed points by ascending signature, their sizes, starts that end in cycles."""

    model: Model
    fixed_points: tuple[tuple[int, ...], ...]
    sizes: tuple[int, ...]
    cycle_count: int

    @property
    def starts(self) -> int:
        return sum(self.sizes) + self.cycle_count

    def frame(self, spark: SparkSession) -> DataFrame:
        """fp (null: cycles), basin_size."""
        rows = [(self.model.signature(u), n) for u, n in zip(self.fixed_points, self.sizes, strict=True)]
        return spark.createDataFrame([*rows, (None, self.cycle_count)], BASINS)

    def records(self) -> list[dict]:
        """Largest first, ties by signature: rank, signature, size, fraction and names."""
        order = sorted(range(len(self.sizes)), key=lambda k: (-self.sizes[k], k))
        return [{"rank": r + 1, "signature": self.model.signature(self.fixed_points[k]), "basin_size": self.sizes[k], "basin_fraction": self.sizes[k] / self.starts, **self.model.names(self.fixed_points[k])} for r, k in enumerate(order)]


def _count(model: Model) -> int:
    n = model.scenario_count()
    if n > INT64:
        raise OverflowError(f"{n} scenarios: exact basins count up to 2^63 - 1 starts. What still works: estimate_basins, transition_graph, and product_basins where the model splits into islands.")
    return n


def find_basins(spark: SparkSession, model: Model, rule: Rule = GLOBAL, first: int | None = None, last: int | None = None) -> Basins:
    """Over the whole space, or the starts first..last."""
    n = _count(model)
    first, last = 0 if first is None else first, n - 1 if last is None else last
    if not 0 <= first <= last < n:
        raise ValueError(f"starts {first}..{last} are not within 0..{n - 1}")
    found = {r["fp"]: r["basin_size"] for r in basins_frame(spark, model, rule, first, last).collect()}
    cycles = found.pop(None, 0)
    fps = np.array(sorted(found), np.int64)
    digits = tuple(tuple(map(int, d)) for d in digits_of(fps, model))
    return Basins(model, digits, tuple(found[int(k)] for k in fps), cycles)


def _summed(state: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(state, kind="stable")
    state = state[order]
    heads = np.nonzero(np.concatenate([[True], state[1:] != state[:-1]]))[0] if len(state) else np.zeros(0, np.int64)
    return state[heads], np.add.reduceat(weight[order], heads) if len(heads) else weight[:0]


def _batch(state: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(state, pa.int64()), pa.array(weight, pa.int64())], ["state", "weight"])


def first_step(spark: SparkSession, model: Model, rule: Rule, first: int, last: int) -> DataFrame:
    """state, weight after one step of the starts first..last; each task sums its own before the shuffle."""
    space = Space(model)
    width = space.low if fast(rule) else 65_536
    tasks = int(max(1, min(-(-(last - first + 1) // width), 16 * spark.sparkContext.defaultParallelism)))
    if (last - first + 1) // tasks > 256 * CHUNK:
        tasks = (last - first + 1) // (256 * CHUNK)
    edges = [first + (last + 1 - first) * k // tasks for k in range(tasks + 1)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                held, size = [], 0
                for found in stretch(space, edges[k], edges[k + 1] - 1, rule):
                    # starts that share their high part meet in few states: a small sort here spares a large one later
                    held.append(np.unique(found, return_counts=True))
                    size += len(held[-1][0])
                    if size >= CHUNK:
                        yield _batch(*_summed(*map(np.concatenate, zip(*held, strict=True))))
                        held, size = [], 0
                if held:
                    yield _batch(*_summed(*map(np.concatenate, zip(*held, strict=True))))

    return spark.range(0, tasks, 1, tasks).mapInArrow(walk, "state bigint, weight bigint").groupBy("state").agg(F.sum("weight").alias("weight"))


def next_step(frontier: DataFrame, model: Model, rule: Rule) -> DataFrame:
    """state, weight, still (the state is a fixed point) after one more step."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            state, weight = b.column(0).to_numpy(), b.column(1).to_numpy()
            to = step_signatures(state, model, rule)
            yield _batch(*_summed(np.where(to == state, -1 - state, to), weight))

    # fixed points go below zero: -1 - signature
    return frontier.mapInArrow(walk, "state bigint, weight bigint").groupBy("state").agg(F.sum("weight").alias("weight"))


def ends_of(frontier: DataFrame, model: Model, rule: Rule) -> DataFrame:
    """fp (-1: a cycle; null: not followed to its end), state (null unless fp is), weight: each task follows its own states."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        state, weight = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
        for a in range(0, len(state), FEW):
            part, n = state[a : a + FEW], weight[a : a + FEW]
            try:
                fp, n = _summed(resolve(part, model, rule, REACHED), n)
                yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.nulls(len(fp), pa.int64()), pa.array(n, pa.int64())], ["fp", "state", "weight"])
            except TooMany:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), pa.array(part, pa.int64()), pa.array(n, pa.int64())], ["fp", "state", "weight"])

    return frontier.select("state", "weight").mapInArrow(walk, "fp bigint, state bigint, weight bigint")


def basins_frame(spark: SparkSession, model: Model, rule: Rule = GLOBAL, first: int | None = None, last: int | None = None) -> DataFrame:
    """fp (null: cycles), basin_size over the whole space, or the starts first..last. Fixed points that no start reaches have no row."""
    n = _count(model)
    first, last = 0 if first is None else first, n - 1 if last is None else last
    if not 0 <= first <= last < n:
        raise ValueError(f"starts {first}..{last} are not within 0..{n - 1}")
    cores = ship(spark).sparkContext.defaultParallelism
    with Scratch(spark) as scratch:
        frontier = scratch.write(first_step(spark, model, rule, first, last))
        settled: list[DataFrame] = []  # fp (-1: cycles), weight
        for _ in range(ROUNDS):
            size = frontier.count()
            if size <= FEW * cores:
                ends = scratch.write(ends_of(frontier.repartition(int(max(1, min(cores, size // 4096)))), model, rule))
                settled.append(ends.filter("fp is not null").select("fp", "weight"))
                frontier = ends.filter("fp is null").select("state", "weight")
                if frontier.isEmpty():
                    break
            moved = scratch.write(next_step(frontier, model, rule))
            settled.append(moved.filter("state < 0").select((-1 - F.col("state")).alias("fp"), "weight"))
            frontier = moved.filter("state >= 0")
        else:
            settled.append(double_pointers(scratch, model, rule, frontier))
        total = settled[0]
        for part in settled[1:]:
            total = total.union(part)
        sums = total.groupBy("fp").agg(F.sum("weight").alias("basin_size"))
        done = scratch.write(sums.union(spark.createDataFrame([(-1, 0)], "fp bigint, basin_size bigint")).groupBy(F.when(F.col("fp") >= 0, F.col("fp")).alias("fp")).agg(F.sum("basin_size").alias("basin_size")))
        scratch.keep(done)
        return done


def double_pointers(scratch: Scratch, model: Model, rule: Rule, frontier: DataFrame) -> DataFrame:
    """fp (-1: a cycle), weight. For frontiers that stay large: pointers of all states, doubled by self-joins until no new start settles."""
    n = _count(model)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            state = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(state, pa.int64()), pa.array(step_signatures(state, model, rule), pa.int64())], ["state", "to"])

    links = scratch.write(scratch.spark.range(n).withColumnRenamed("id", "state").mapInArrow(walk, "state bigint, to bigint"))
    fixed = scratch.write(links.filter("state = to").select("state"))
    far, open_before = links, None
    while True:
        a, b = far.alias("a"), far.alias("b")
        before, far = far, scratch.write(a.join(b, F.col("a.to") == F.col("b.state")).select(F.col("a.state"), F.col("b.to")))
        scratch.drop(before)
        open_now = far.join(fixed.withColumnRenamed("state", "to"), "to", "left_anti").count()
        if open_now == open_before:
            break
        open_before = open_now
    ends = frontier.join(far, "state").join(fixed.select(F.col("state").alias("to"), F.lit(True).alias("still")), "to", "left")
    return ends.select(F.when(F.col("still"), F.col("to")).otherwise(-1).alias("fp"), "weight")


# -- partial results -----------------------------------------------------------

PARTIALS = "model string, first bigint, last bigint, kind string, fp bigint, count bigint"


def partial_basins(spark: SparkSession, model: Model, name: str, first: int, last: int, rule: Rule = GLOBAL) -> DataFrame:
    """One share of the starts as rows: kind F (fixed point, count) or C (cycles)."""
    found = basins_frame(spark, model, rule, first, last)
    kind = F.when(F.col("fp").isNull(), "C").otherwise("F")
    return found.select(F.lit(name).alias("model"), F.lit(first).cast("bigint").alias("first"), F.lit(last).cast("bigint").alias("last"), kind.alias("kind"), "fp", F.col("basin_size").alias("count"))


def tiling_faults(partials: DataFrame, scenarios: int | None = None) -> DataFrame:
    """Rows first, last, fault for every gap, overlap, second model or missing end; none when the ranges tile the space."""
    ranges = partials.select("model", "first", "last").distinct()
    order = Window.partitionBy().orderBy("first", "last", "model")  # a row for each machine's share
    seen = ranges.withColumn("before", F.lag("last").over(order)).withColumn("other", F.lag("model").over(order)).withColumn("next", F.lead("first").over(order))
    fault = F.when(F.col("other") != F.col("model"), "model").when(F.col("before").isNull() & (F.col("first") != 0), "gap").when(F.col("first") > F.col("before") + 1, "gap").when(F.col("first") <= F.col("before"), "overlap")
    if scenarios is not None:
        fault = F.coalesce(fault, F.when(F.col("next").isNull() & (F.col("last") != scenarios - 1), "end"))
    return seen.select("first", "last", fault.alias("fault")).filter("fault is not null")


def merge_partials(partials: DataFrame, scenarios: int | None = None) -> DataFrame:
    """fp (null: cycles), basin_size over all shares; refuses shares that do not tile."""
    faults = tiling_faults(partials, scenarios).collect()
    if faults:
        raise ValueError("the shares do not tile the space: " + ", ".join(f"{r['fault']} at {r['first']}..{r['last']}" for r in faults))
    covered = partials.select("first", "last").distinct().agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0]
    total = partials.agg(F.sum("count")).first()[0]
    if covered != total:
        raise ValueError(f"the shares cover {covered} starts but count {total}")
    return partials.groupBy("kind", "fp").agg(F.sum("count").alias("basin_size")).select("fp", "basin_size")


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    """Shares written as M/R/F/C lines, one file each."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("lines"))
    field = lambda kind, k: F.split(F.filter("lines", lambda x: x.startswith(kind + "\t"))[0], "\t")[k]
    head = lines.select(field("M", 1).alias("model"), field("R", 1).cast("bigint").alias("first"), field("R", 2).cast("bigint").alias("last"), F.explode(F.filter("lines", lambda x: x.rlike("^[FC]\t"))).alias("line"))
    part = F.split("line", "\t")
    return head.select("model", "first", "last", part[0].alias("kind"), F.when(part[0] == "F", part[1].cast("bigint")).alias("fp"), F.when(part[0] == "F", F.get(part, F.lit(2))).otherwise(part[1]).cast("bigint").alias("count"))
