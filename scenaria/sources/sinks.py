"""Sinks and renderers: CSV, TSV, JSON, Graphviz and text reports of results."""

from __future__ import annotations

import csv
import io
import json
import math
import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Model, signature_order
from ..operators.basins import Basins
from ..operators.estimate import BasinEstimate
from ..operators.structure import ComposedBasins, InfluenceStructure
from ..operators.transitions import Transition, TransitionGraph
from ..plans.rules import GLOBAL, Rule, succession_trace
from ..storage import materialise

#: Scenarios that a report lists, and that a file takes.
MOST_SHOWN, MOST_EXPORTED = 2_000, 1_000_000


def csv_row(values: Sequence) -> str:
    """Quoted where a field has a comma, quote or line end; quotes are doubled."""
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(values)
    return out.getvalue()


def significant(x: float, digits: int) -> float:
    return 0.0 if x == 0 else round(x, digits - 1 - math.floor(math.log10(abs(x))))


def grouped(n: int) -> str:
    return f"{n:,}"


def percent(x: float) -> str:
    return f"{100 * x:.1f}%"


def write_text(path: str, text: str) -> None:
    """Atomically: beside the target, then renamed onto it."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, at = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(at, path)


# -- basins --------------------------------------------------------------------


def numbered(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with its place in the order, from 1: rows are range-partitioned and numbered where they lie, and every partition is told how many rows come before it."""
    place = F.monotonically_increasing_id()
    sorted_rows = materialise(df.orderBy(*order).select("*", F.shiftright(place, 33).alias("__part"), (place % (1 << 33)).alias("__at")))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sorted_rows.groupBy("__part").agg(F.count("*").alias("n")).select("__part", before.alias("__before"))  # a row for each partition
    return sorted_rows.join(F.broadcast(begins), "__part").withColumn(name, (F.col("__before") + F.col("__at") + 1).cast("int")).drop("__part", "__at", "__before")


def ranked_basins(basins: DataFrame) -> DataFrame:
    """rank, fp, basin_size, fraction: largest first, ties by signature; the row of cycles has no rank."""
    total = basins.agg(F.sum("basin_size")).first()[0] or 0
    fraction = F.col("basin_size") / F.lit(total)
    ranked = numbered(basins.filter("fp is not null"), F.desc("basin_size"), F.asc("fp"))
    return ranked.unionByName(basins.filter("fp is null"), allowMissingColumns=True).select("rank", "fp", "basin_size", fraction.alias("fraction"))


def basin_csv(b: Basins) -> str:
    if len(b.sizes) > MOST_EXPORTED:
        raise ValueError(f"{len(b.sizes)} consistent scenarios are too many for one file; write frame() as Parquet")
    head = f"# basins\n# total scenarios,{b.starts}\n# consistent scenarios,{len(b.sizes)}\n# into-cycle starts,{b.cycle_count}\n"
    rows = [csv_row(["rank", "signature", *b.model.descriptors, "basin_size", "basin_fraction_pct"])]
    for r in b.records():
        rows.append(csv_row([r["rank"], r["signature"], *(r[d] for d in b.model.descriptors), r["basin_size"], round(100 * r["basin_fraction"], 4)]))
    return head + "".join(rows)


def basin_tsv(b: Basins) -> str:
    rows = ["rank\tsignature\tbasin_size\tbasin_pct\tscenario"]
    for r in b.records():
        rows.append(f"{r['rank']}\t{r['signature']}\t{r['basin_size']}\t{100 * r['basin_fraction']:.4f}\t{'/'.join(r[d] for d in b.model.descriptors)}")
    return "\n".join(rows) + "\n"


def partial_tsv(name: str, first: int, last: int, b: Basins) -> str:
    """One share of the starts: model, range, fixed points, cycles."""
    rows = [f"M\t{name}", f"R\t{first}\t{last}", *(f"F\t{b.model.signature(u)}\t{n}" for u, n in zip(b.fixed_points, b.sizes, strict=True)), f"C\t{b.cycle_count}"]
    return "\n".join(rows) + "\n"


def basin_text(b: Basins) -> str:
    lines = [f"{len(b.sizes)} consistent scenario(s) over {grouped(b.starts)} starts"]
    for r in b.records()[:MOST_SHOWN]:
        lines.append(f"  {r['rank']}. {'/'.join(r[d] for d in b.model.descriptors)} — {grouped(r['basin_size'])} ({100 * r['basin_fraction']:.2f}%)")
    lines.append(f"  into cycles: {grouped(b.cycle_count)} ({100 * b.cycle_count / b.starts:.2f}%)")
    lines.append(f"  covered: {grouped(sum(b.sizes))} + {grouped(b.cycle_count)} = {grouped(b.starts)}")
    return "\n".join(lines)


# -- estimates -----------------------------------------------------------------


def estimate_csv(e: BasinEstimate) -> str:
    p = lambda x: significant(100 * x, 4)
    rows = [
        f"# estimated basin shares\n# total scenarios,{e.scenario_count}\n# samples,{e.samples}\n# seed,{e.seed:#x}\n# confidence,{e.confidence}\n",
        f"# cycle share pct,{p(e.cycle_share)},ci_low,{p(e.cycle_ci_low)},ci_high,{p(e.cycle_ci_high)}\n",
        csv_row(["rank", *e.model.descriptors, "hits", "share_pct", "ci_low_pct", "ci_high_pct", "estimated_size"]),
    ]
    for rank, k in enumerate(sorted(range(len(e.hits)), key=lambda k: (-e.hits[k], k))):
        rows.append(csv_row([rank + 1, *e.model.names(e.fixed_points[k]).values(), e.hits[k], p(e.shares[k]), p(e.ci_low[k]), p(e.ci_high[k]), significant(e.size_estimates[k], 3)]))
    return "".join(rows)


def estimate_text(e: BasinEstimate) -> str:
    lines = [f"Estimated shares of an exact kernel from {grouped(e.samples)} samples of {grouped(e.scenario_count)} scenarios (seed {e.seed:#x}, {100 * e.confidence:g}% intervals)"]
    for k in sorted(range(len(e.hits)), key=lambda k: (-e.hits[k], k)):
        at = "/".join(e.model.names(e.fixed_points[k]).values())
        lines.append(f"  {at}: {percent(e.shares[k])} [{percent(e.ci_low[k])}, {percent(e.ci_high[k])}]" if e.hits[k] else f"  {at}: no hits — share ≤ {100 * e.ci_high[k]:.2g}%")
    lines.append(f"  cycles: {percent(e.cycle_share)} [{percent(e.cycle_ci_low)}, {percent(e.cycle_ci_high)}]")
    return "\n".join(lines)


# -- structure -----------------------------------------------------------------


def structure_text(s: InfluenceStructure) -> str:
    name = s.descriptors.__getitem__
    lines = [f"{len(s.edges)} active influence(s), {len(s.components)} island(s)"]
    lines += [f"  island {k + 1}: {', '.join(map(name, c))}" for k, c in enumerate(s.components)]
    lines += [f"  dial: {name(d)} stays where it is put" for d in s.dials]
    lines += [f"  forced: {name(d)} goes to variant {' or '.join(map(str, best))} whatever the others do" for d, best in s.forced]
    return "\n".join(lines)


def composed_text(c: ComposedBasins, model: Model) -> str:
    order = sorted(range(len(c.sizes)), key=lambda k: (-c.sizes[k], k))
    lines = [f"{len(c.sizes)} consistent scenario(s) over {grouped(c.scenario_count)} scenarios in {len(c.components)} island(s)"]
    lines += [f"  {'/'.join(model.names(c.fixed_points[k]).values())}: {grouped(c.sizes[k])}" for k in order[:10]]
    if len(order) > 10:
        lines.append(f"  … and {len(order) - 10} more")
    lines.append(f"  into cycles: {grouped(c.cycle_count)}")
    return "\n".join(lines)


# -- transitions ---------------------------------------------------------------


def scenario_text(g: TransitionGraph, node: int) -> str:
    return "/".join(g.model.names(g.nodes[node]).values())


def changes_text(g: TransitionGraph, e: Transition, separator: str = " + ") -> str:
    if not e.changes:
        return "(its own course)"
    names, at = g.model.variants, g.nodes[e.source]
    return separator.join(f"{g.model.descriptors[d]}: {names[d][at[d]]}→{names[d][v]}" for d, v in e.changes)


def transition_csv(g: TransitionGraph) -> str:
    head = f"# levers between scenarios\n# total scenarios,{g.model.scenario_count()}\n# radius,{g.radius}\n"
    rows = [csv_row(["from_index", "to_index", "to_kind", "steps", *g.model.descriptors, "commitment"])]
    for e in g.edges:
        said = " + ".join(f"{g.model.descriptors[d]}={g.model.variants[d][v]}" for d, v in e.changes) or "(its own course)"
        rows.append(csv_row([e.source + 1, e.target + 1, g.kinds[e.target], e.steps, *g.model.names(g.nodes[e.target]).values(), said]))
    return head + "".join(rows)


def to_dot(g: TransitionGraph) -> str:
    """Graphviz: boxes with robustness, dashed ellipses for cycles, the world in bold, pairs dotted; nodes count from 1."""
    safe = lambda s: s.replace("\\", "\\\\").replace('"', '\\"')
    shapes = {"world": 'shape=box, style="bold,rounded"', "cycle": "shape=ellipse, style=dashed", "attractor": "shape=box"}
    before = {"world": "current world\\n", "cycle": "cycle\\n", "attractor": ""}
    lines = ["digraph levers {", "  rankdir=LR;"]
    for k, kind in enumerate(g.kinds):
        robust = f"\\n{percent(g.robustness[k])} robust" if kind == "attractor" and not math.isnan(g.robustness[k]) else ""
        lines.append(f'  n{k + 1} [label="{before[kind]}{safe(scenario_text(g, k))}{robust}", {shapes[kind]}];')
    for e in g.edges:
        look = '[label="(default)", style=bold]' if not e.changes else '[label="{}"{}]'.format(safe(changes_text(g, e, "\n")).replace("\n", "\\n"), ", style=dotted" * (len(e.changes) > 1))
        lines.append(f"  n{e.source + 1} -> n{e.target + 1} {look};")
    return "\n".join([*lines, "}"]) + "\n"


def transition_text(g: TransitionGraph) -> str:
    """Most robust first, then places that were only reached, then the current world."""

    def place(k: int) -> str:
        return f"[{k + 1}] {scenario_text(g, k)}{' (cycle)' if g.kinds[k] == 'cycle' else ''}"

    def levers(k: int) -> list[str]:
        out: dict[int, list[str]] = {}
        for e in g.edges:
            if e.source == k and e.changes:
                out.setdefault(e.target, []).append(changes_text(g, e) + " (pair)" * (len(e.changes) > 1))
        return [line for to, said in out.items() for line in (f"    to {place(to)} by", *(f"      {x}" for x in said))] or ["    nothing leads away from it"]

    tried = sum(g.model.sizes) - len(g.model.sizes)
    count = {kind: g.kinds.count(kind) for kind in ("attractor", "cycle")}
    lines = [f"{count['attractor']} consistent, {count['cycle']} cyclic, {len(g.edges)} levers of radius {g.radius}"]
    ranked = sorted((k for k in range(len(g.nodes)) if not math.isnan(g.robustness[k]) and k != g.world), key=lambda k: -g.robustness[k])
    for k in ranked:
        lines.append(f"  {place(k)}: robustness {percent(g.robustness[k])}; of its {tried} single changes {g.returned[k]} come back, {g.moved[k]} settle elsewhere, {g.destabilized[k]} end in cycles")
        lines += levers(k)
    if reached := [place(k) for k in range(len(g.nodes)) if math.isnan(g.robustness[k])]:
        lines.append("  only reached: " + ", ".join(reached))
    if (w := g.world) is not None:
        own = next((e for e in g.edges if e.source == w and not e.changes), None)
        course = "is consistent" if g.kinds[w] != "world" else "stays" if own is None else f"drifts to {place(own.target)} in {own.steps} steps"
        lines.append(f"  current world {place(w)} {course}; {g.returned[w]} of {tried} single changes do not alter that")
        lines += levers(w)
    return "\n".join(lines)


# -- single scenarios ------------------------------------------------------------


def trace_text(model: Model, digits: Sequence[int], rule: Rule = GLOBAL) -> str:
    states, length = succession_trace(model, digits, rule)
    end = "not settled" if not length else "fixed point" if length == 1 else f"cycle of {length}"
    return "\n".join([*(f"  {k}. {'/'.join(model.names(s).values())}" for k, s in enumerate(states)), f"  {end}"])


def balance_text(model: Model, digits: Sequence[int]) -> str:
    lines = []
    for d, block in model.named_balance(digits).items():
        top = max(block["scores"].values())
        lines.append(d)
        for v, s in block["scores"].items():
            mark = "  [selected]" if v == block["selected"] else "  ← would win" if s == top and not block["consistent"] else ""
            lines.append(f"  {v}: {s}{mark}")
    return "\n".join(lines)


# -- JSON ------------------------------------------------------------------------


def json_ready(x):
    """Integers beyond 2^53 as strings, NaN as null, tuples as lists."""
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, int):
        return str(x) if abs(x) > 2**53 else x
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, dict):
        return {str(k): json_ready(v) for k, v in x.items()}
    return [json_ready(v) for v in x]


def to_json(x) -> str:
    return json.dumps(json_ready(x), ensure_ascii=False)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row, made by Spark."""
    wide = {f.name for f in df.schema if f.dataType.simpleString().startswith("decimal")}
    return df.select(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) if c in wide else F.col(c) for c in df.columns))).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"').mode("overwrite").csv(path)


# -- services --------------------------------------------------------------------


def analyse(spark: SparkSession, model: Model, mode: str, samples: int = 1_000_000, radius: int = 1, world=None) -> dict:
    """One of the modes consistent, basins, estimate, structure and transitions as a JSON-ready report."""
    from ..operators.basins import find_basins
    from ..operators.estimate import estimate_basins
    from ..operators.structure import influence_structure, product_basins, split
    from ..operators.transitions import transition_graph

    head = {"mode": mode, "descriptors": list(model.descriptors), "total": model.scenario_count()}
    if mode == "structure":
        s = influence_structure(spark, model)
        out = {"edges": s.edges, "components": s.components, "dials": s.dials, "forced": s.forced}
        if len(s.components) > 1 and max(m.scenario_count() for m in split(model, s.components)) <= 50_000_000:
            c = product_basins(spark, model)
            out["composed"] = {"count": len(c.sizes), "cycles": c.cycle_count, "sizes": c.sizes}
        return json_ready(head | out)
    if mode == "basins":
        b = find_basins(spark, model)
        if len(b.sizes) > MOST_SHOWN:
            return json_ready(head | {"kernel_too_big": True, "count": len(b.sizes)})
        return json_ready(head | {"count": len(b.sizes), "cycles": b.cycle_count, "covered": sum(b.sizes), "scenarios": b.records()})
    kernel, size = list_kernel(spark, model)
    if kernel is None and mode in ("consistent", "estimate", "transitions"):
        return json_ready(head | {"kernel_too_big": True, "count": size, "message": f"{grouped(size)} consistent scenarios are too many to list; the islands can be analysed one by one (structure)"})
    if mode == "consistent":
        return json_ready(head | {"count": size, "scenarios": [{"signature": model.signature(u), "variants": model.names(u)} for u in kernel]})
    if mode == "estimate":
        e = estimate_basins(spark, model, samples=min(max(samples, 1_000), 100_000_000), kernel=kernel)
        rows = [{"variants": model.names(u), "hits": h, "share": s, "ci_low": a, "ci_high": b} for u, h, s, a, b in zip(e.fixed_points, e.hits, e.shares, e.ci_low, e.ci_high, strict=True)]
        return json_ready(head | {"samples": e.samples, "cycle_share": e.cycle_share, "scenarios": sorted(rows, key=lambda r: -r["hits"])})
    if mode == "transitions":
        g = transition_graph(spark, model, kernel=kernel, world=world, radius=min(max(radius, 1), 2))
        return json_ready(head | {"nodes": [{"kind": k, "variants": model.names(u), "robustness": r} for k, u, r in zip(g.kinds, g.nodes, g.robustness, strict=True)], "edges": [{"from": e.source, "to": e.target, "changes": e.changes, "steps": e.steps} for e in g.edges], "dot": to_dot(g)})
    raise ValueError(f"mode {mode!r}: choose consistent, basins, estimate, structure or transitions")


def export_csv(spark: SparkSession, model: Model, mode: str, samples: int = 1_000_000, radius: int = 1, world=None) -> str:
    """The table of the modes basins, estimate and transitions."""
    from ..operators.basins import find_basins
    from ..operators.estimate import estimate_basins
    from ..operators.transitions import transition_graph

    if mode == "basins":
        return basin_csv(find_basins(spark, model))
    if mode == "estimate":
        return estimate_csv(estimate_basins(spark, model, samples=min(max(samples, 1_000), 100_000_000)))
    if mode == "transitions":
        return transition_csv(transition_graph(spark, model, world=world, radius=min(max(radius, 1), 2)))
    raise ValueError(f"mode {mode!r} has no table; choose basins, estimate or transitions")


def list_kernel(spark: SparkSession, model: Model, most: int = MOST_SHOWN) -> tuple[list | None, int]:
    """The kernel and its size; where the islands' kernels multiply to more than `most`, the exact size alone."""
    from ..operators.kernel import consistent_frame
    from ..operators.structure import influence_structure, split

    if model.kernel is not None:
        return (list(model.kernel) if len(model.kernel) <= most else None), len(model.kernel)
    parts = split(model, influence_structure(spark, model).components)
    if len(parts) > 1:
        size = 1
        for part in parts:
            size *= consistent_frame(spark, part).count()
        if size > most:
            return None, size
    found = consistent_frame(spark, model)
    size = found.count()
    return (signature_order(r["digits"] for r in found.select("digits").collect()) if size <= most else None), size
