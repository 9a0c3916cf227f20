"""Lever graph: which single or paired commitments lead from one future to another.

Every node (consistent scenario, and the current world if given) is perturbed
in one descriptor, or two, and walked to its attractor. lever_frames does this for
kernels of any size and gives DataFrames: the changes are exploded, walked in
batches, and counted by node. transition_graph gives the graph of one model as a
value, for reports.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Model
from ..plans.rules import GLOBAL, Rule
from ..session import ship
from .estimate import resolve_kernel, walk_ends


@dataclass(frozen=True)
class Transition:
    """source and target are node numbers from 0; changes: (descriptor, variant), none for the world's own course."""

    source: int
    target: int
    changes: tuple[tuple[int, int], ...]
    steps: int


@dataclass(frozen=True)
class TransitionGraph:
    model: Model
    nodes: tuple[tuple[int, ...], ...]
    kinds: tuple[str, ...]
    signatures: tuple[int, ...]
    edges: tuple[Transition, ...]
    returned: tuple[int, ...]
    moved: tuple[int, ...]
    destabilized: tuple[int, ...]
    robustness: tuple[float, ...]
    radius: int
    world: int | None

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, TransitionGraph):
            return NotImplemented
        plain = lambda g: (g.nodes, g.kinds, g.signatures, g.edges, g.returned, g.moved, g.destabilized, tuple(None if math.isnan(r) else r for r in g.robustness), g.radius, g.world)
        return plain(self) == plain(other)

    def __hash__(self) -> int:
        return hash((self.nodes, self.edges))

    def node_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, self.kinds[k], str(self.signatures[k]), list(self.nodes[k]), self.returned[k], self.moved[k], self.destabilized[k], None if math.isnan(self.robustness[k]) else self.robustness[k]) for k in range(len(self.nodes))]
        return spark.createDataFrame(rows, "idx int, kind string, sig string, digits array<int>, returned int, moved int, destabilized int, robustness double")

    def edge_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(e.source, e.target, [{"descriptor": d, "variant": v} for d, v in e.changes], e.steps) for e in self.edges]
        return spark.createDataFrame(rows, "src int, dst int, changes array<struct<descriptor:int,variant:int>>, steps int")


#: Walks that are done here; more go to the cluster.
HERE = 20_000


def _walked(digits: DataFrame, model: Model, rule: Rule) -> DataFrame:
    """digits with still, target, steps: where each of them ends (a cycle: in its member of least signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start = np.array(b.column(b.num_columns - 1).to_pylist(), np.int64).reshape(b.num_rows, len(model.sizes))
            ends, still, steps = walk_ends(start, model, rule, names=True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(still), pa.array(ends.tolist(), pa.list_(pa.int32())), pa.array(steps, pa.int64())], [*b.schema.names, "still", "target", "steps"])

    kept = [c for c in digits.columns if c != "digits"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in digits.select(*kept, "digits").schema)
    ship(digits.sparkSession)
    return digits.select(*kept, "digits").mapInArrow(run, f"{schema}, still boolean, target array<int>, steps bigint")


def lever_frames(spark: SparkSession, model: Model, rule: Rule, nodes: DataFrame, radius: int = 1) -> tuple[DataFrame, DataFrame]:
    """(counts, edges) of the nodes, a DataFrame of their digits, each of which is a consistent scenario.

    counts: digits, returned, moved, destabilized of every node. edges: source,
    target, still (the target is a consistent scenario), changes, steps; those of
    single changes that do not come back, and with radius 2 of pairs that reach what
    no single change of the node reaches.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    # ranges follow from the model, so a node gives at most as many rows as there are variants, or pairs of them
    every = F.array(*(F.struct(F.lit(d).alias("descriptor"), F.lit(v).alias("variant")) for d, n in enumerate(model.sizes) for v in range(n)))
    source = nodes.select(F.col("digits").alias("source"))
    of = lambda change: F.get("source", change["descriptor"])
    set_to = lambda digits, change: F.transform(digits, lambda x, k: F.when(k == change["descriptor"], change["variant"]).otherwise(x))
    single = source.select("source", F.explode(F.filter(every, lambda c: of(c) != c["variant"])).alias("change"))
    walks = _walked(single.select("source", F.array("change").alias("changes"), set_to(F.col("source"), F.col("change")).alias("digits")), model, rule).drop("digits")
    home = F.col("target") == F.col("source")
    count = lambda when, name: F.sum(F.when(when, 1).otherwise(0)).cast("int").alias(name)
    found = walks.groupBy("source").agg(count(home, "returned"), count(~home & F.col("still"), "moved"), count(~F.col("still"), "destabilized"))
    counts = source.join(found, "source", "left").select(F.col("source").alias("digits"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("returned", "moved", "destabilized")))
    columns = ("source", "target", "still", "changes", "steps")
    edges = walks.filter(~home).select(*columns)
    if radius == 2:
        other = F.filter(every, lambda c: (c["descriptor"] > F.col("change.descriptor")) & (of(c) != c["variant"]))
        pair = single.select("source", "change", F.explode(other).alias("other"))
        twice = pair.select("source", F.array("change", "other").alias("changes"), set_to(set_to(F.col("source"), F.col("change")), F.col("other")).alias("digits"))
        far = _walked(twice, model, rule).filter(~home)
        edges = edges.unionByName(far.join(walks.select("source", "target").distinct(), ["source", "target"], "left_anti").select(*columns))
    return counts, edges


def walks(spark: SparkSession, model: Model, rule: Rule, starts: Sequence[tuple[int, ...]]) -> list[tuple[bool, tuple[int, ...], int]]:
    """(is a fixed point, attractor, steps) of every start, spread over the cluster when there are many."""
    unique = list(dict.fromkeys(starts))
    if len(unique) <= HERE:
        ends, still, steps = walk_ends(np.array(unique, np.int64).reshape(len(unique), len(model.sizes)), model, rule, names=True)
        found = {u: (bool(f), tuple(map(int, e)), int(n)) for u, e, f, n in zip(unique, ends, still, steps, strict=True)}
        return [found[s] for s in starts]
    frame = spark.createDataFrame([(list(s),) for s in unique], "digits array<int>").repartition(4 * spark.sparkContext.defaultParallelism)
    found = {tuple(r["digits"]): (r["still"], tuple(r["target"]), r["steps"]) for r in _walked(frame, model, rule).collect()}
    return [found[s] for s in starts]


def _changed(u: tuple[int, ...], changes) -> tuple[int, ...]:
    out = list(u)
    for d, v in changes:
        out[d] = v
    return tuple(out)


def transition_graph(spark: SparkSession, model: Model, rule: Rule = GLOBAL, kernel=None, world=None, radius: int = 1) -> TransitionGraph:
    """radius 2 adds the pairs that reach what neither single change of the node reaches."""
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    known = resolve_kernel(spark, model, rule, kernel)
    here = None if world is None else model.resolve(world)
    if not known and here is None:
        raise ValueError("there is no consistent scenario and no current world to start from")
    kinds: dict[tuple[int, ...], str] = {u: "attractor" for u in dict.fromkeys(map(tuple, known or ()))}
    if here is not None and here not in kinds:
        kinds[here] = "attractor" if (rule.step(np.array([here]), model)[0] == here).all() else "world"
    perturbed = list(kinds)
    singles = [[((d, v),) for d, n in enumerate(model.sizes) for v in range(n) if v != u[d]] for u in perturbed]
    every = [_changed(u, c) for u, cs in zip(perturbed, singles, strict=True) for c in cs]
    own = walks(spark, model, rule, perturbed)
    ends = iter(walks(spark, model, rule, every))
    returned, moved, off = {}, {}, {}
    edges: list[tuple] = []
    reached: dict[tuple[int, ...], set] = {}

    def note(at: tuple[int, ...], still: bool) -> None:
        kinds.setdefault(at, "attractor" if still else "cycle")

    for u, cs, (base_still, base, base_steps) in zip(perturbed, singles, own, strict=True):
        if kinds[u] == "world":
            note(base, base_still)
            if base != u:
                edges.append((u, base, (), base_steps))
        home = base if kinds[u] == "world" else u
        counts = [0, 0, 0]
        seen = reached[u] = {home}
        for c in cs:
            still, to, steps = next(ends)
            if to == home:
                counts[0] += 1
                continue
            counts[1 if still else 2] += 1
            note(to, still)
            edges.append((u, to, c, steps))
            seen.add(to)
        returned[u], moved[u], off[u] = counts
    if radius == 2:
        pairs = [[(a[0], b[0]) for a, b in combinations(cs, 2) if a[0][0] < b[0][0]] for cs in singles]
        ends = iter(walks(spark, model, rule, [_changed(u, c) for u, cs in zip(perturbed, pairs, strict=True) for c in cs]))
        for u, cs in zip(perturbed, pairs, strict=True):
            for c in cs:
                still, to, steps = next(ends)
                if to not in reached[u]:
                    note(to, still)
                    edges.append((u, to, c, steps))
    order = sorted(kinds, key=lambda u: (kinds[u] == "world", u[::-1]))
    place = {u: k for k, u in enumerate(order)}
    tried = sum(model.sizes) - len(model.sizes)
    robust = tuple((returned[u] / tried if tried else 1.0) if u in returned else math.nan for u in order)
    levers = sorted((Transition(place[a], place[b], c, s) for a, b, c, s in edges), key=lambda e: (e.source, len(e.changes) == 2))
    of = lambda table: tuple(table.get(u, 0) for u in order)
    return TransitionGraph(model, tuple(order), tuple(kinds[u] for u in order), tuple(model.signature(u) for u in order), tuple(levers), of(returned), of(moved), of(off), robust, radius, None if here is None else place[here])
