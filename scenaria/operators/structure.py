"""Influence structure: who acts on whom, islands, dials, and what is forced; products over islands."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Model
from ..plans.rules import GLOBAL, Rule, fast_product
from ..sources.frames import impacts_frame
from .basins import find_basins

#: Combinations of attractors that product_basins lists.
MOST_COMBINATIONS = 100_000


@dataclass(frozen=True)
class InfluenceStructure:
    """edges: (source, target) descriptors, self-edges too. components: islands, each ascending. dials: descriptors
    that nothing acts on and whose scores tie, so that they stay where they are put. forced: (descriptor, best
    variants) of the others that nothing acts on."""

    descriptors: tuple[str, ...]
    edges: tuple[tuple[int, int], ...]
    components: tuple[tuple[int, ...], ...]
    dials: tuple[int, ...]
    forced: tuple[tuple[int, tuple[int, ...]], ...]


def edges_frame(impacts: DataFrame) -> DataFrame:
    """src_desc, tgt_desc where the variant of the source makes a difference to the target's ranking scores."""
    per_column = impacts.groupBy("src_desc", "tgt_desc", "tgt_var").agg((F.max("impact") != F.min("impact")).alias("acts"))
    return per_column.groupBy("src_desc", "tgt_desc").agg(F.max("acts").alias("acts")).filter("acts").select("src_desc", "tgt_desc")


def constant_scores(model: Model, descriptor: int) -> np.ndarray:
    """What a descriptor's variants score when nothing acts on it."""
    block = slice(model.offsets[descriptor], model.offsets[descriptor] + model.sizes[descriptor])
    return model.matrix[list(model.offsets), block].sum(axis=0)


def influence_structure(spark: SparkSession, model: Model) -> InfluenceStructure:
    edges = sorted((r[0], r[1]) for r in edges_frame(impacts_frame(spark, model)).collect())  # at most descriptors squared
    parent = list(range(len(model.sizes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    islands: dict[int, list[int]] = {}
    for k in range(len(parent)):
        islands.setdefault(find(k), []).append(k)
    acted = {b for _, b in edges}
    dials, forced = [], []
    for k in range(len(model.sizes)):
        if k not in acted:
            scores = constant_scores(model, k)
            top = tuple(int(v) for v in np.nonzero(scores == scores.max())[0])
            if len(top) == model.sizes[k]:
                dials.append(k)
            else:
                forced.append((k, top))
    return InfluenceStructure(model.descriptors, tuple(edges), tuple(map(tuple, islands.values())), tuple(dials), tuple(forced))


def split(model: Model, components) -> list[Model]:
    """One model per island, with the descriptors outside pinned to their first variant."""
    if sorted(k for c in components for k in c) != list(range(len(model.sizes))):
        raise ValueError("the components are not those of this model")
    out = []
    for c in components:
        part = model
        for k in range(len(model.sizes)):
            if k not in c:
                part = part.fix(k, 0)
        out.append(part)
    return out


@dataclass(frozen=True)
class ComposedBasins:
    """Sizes are exact integers of any size, in the order of the fixed points."""

    fixed_points: tuple[tuple[int, ...], ...]
    sizes: tuple[int, ...]
    cycle_count: int
    scenario_count: int
    components: tuple[tuple[int, ...], ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        """digits (null: cycles), basin_size decimal(38,0)."""
        rows = [(list(u), str(n)) for u, n in zip(self.fixed_points, self.sizes, strict=True)]
        return spark.createDataFrame([*rows, (None, str(self.cycle_count))], "digits array<int>, basin_size string").select("digits", F.col("basin_size").cast("decimal(38,0)").alias("basin_size"))


def product_basins(spark: SparkSession, model: Model, rule: Rule = GLOBAL) -> ComposedBasins:
    """Basins island by island; sizes multiply over all combinations, and what does not converge is cycles."""
    if not fast_product(rule):
        raise ValueError("product_basins needs a built-in rule: a custom one may tie islands together")
    structure = influence_structure(spark, model)
    parts = [find_basins(spark, m, rule) for m in split(model, structure.components)]
    combinations = int(np.prod([float(len(p.sizes)) for p in parts]))
    if combinations > MOST_COMBINATIONS:
        raise ValueError(f"{combinations} combinations of attractors are too many to list; the islands themselves can still be analysed with split and find_basins")
    combined: list[tuple[dict[int, int], int]] = [({}, 1)]
    for island, p in zip(structure.components, parts, strict=True):
        combined = [(at | {k: u[k] for k in island}, n * m) for at, n in combined for u, m in zip(p.fixed_points, p.sizes, strict=True)]
    rows = sorted(((tuple(at[k] for k in range(len(model.sizes))), n) for at, n in combined), key=lambda x: x[0][::-1])
    converging = 1
    for p in parts:
        converging *= sum(p.sizes)
    total = model.scenario_count()
    return ComposedBasins(tuple(u for u, _ in rows), tuple(n for _, n in rows), total - converging, total, structure.components)
