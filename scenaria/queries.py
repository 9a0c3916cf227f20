"""Queries of the scenario engine, by name, and equivalent SQL.

Two families. The first works on a small model given by its matrix. The second
derives a model from the tables: descriptors are categorical columns of the
joined orders, and the impact of one category on another follows from how much
more often the two meet than chance has it; every line item is then a scenario
that the model scores, steps and ranks.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as C
from .model import Model
from .operators import basins, batch, estimate, kernel, structure, transitions
from .plans.rules import GLOBAL, SEQUENTIAL, Sequential, Threshold, succession_trace
from .session import ship
from .sources import frames
from .sources.files import parse_scw, parse_solutions, to_scw
from .sources.sinks import json_rows, ranked_basins, to_dot

#: A model of three descriptors in trade, security and economy, with expert judgements. Fixed values.
SMALL = Model(
    ("WTRD", "WSEC", "WECO"),
    (("FT", "Ntl", "Mix"), ("Rlx", "Mod", "Alrt"), ("Decl", "Stag", "ModGr", "RpdGr")),
    [
        [0, 0, 0, 1, 2, -3, -4, -2, 3, 3],
        [0, 0, 0, -2, 1, 1, 3, 5, -3, -5],
        [0, 0, 0, 2, 1, -3, -2, 0, 4, -2],
        [1, -3, 2, 0, 0, 0, -1, -1, 1, 1],
        [1, -2, 1, 0, 0, 0, 0, 1, 0, -1],
        [-2, 3, -1, 0, 0, 0, 1, 2, -1, -2],
        [-3, 5, -2, -3, 1, 2, 0, 0, 0, 0],
        [-2, 3, -1, -2, 1, 1, 0, 0, 0, 0],
        [2, -4, 2, 1, 0, -1, 0, 0, 0, 0],
        [3, -6, 3, -1, 1, 0, 0, 0, 0, 0],
    ],
)
#: Two islands, one descriptor that nothing moves (a dial) and one that its own scores force.
ISLANDS = Model.build(
    (2, 3, 2, 2, 2),
    [
        [0, 0, 2, -1, 0, 0, 0, 0, 0, 0, 1],
        [0, 0, -1, 1, 2, 0, 0, 0, 0, 0, 1],
        [1, -1, 0, 0, 0, 0, 0, 0, 0, 0, 0],
        [0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0],
        [-2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0],
        [0, 0, 0, 0, 0, 0, 0, 2, -1, 0, 0],
        [0, 0, 0, 0, 0, 0, 0, -1, 2, 0, 0],
        [0, 0, 0, 0, 0, 2, -1, 0, 0, 0, 0],
        [0, 0, 0, 0, 0, -1, 1, 0, 0, 0, 0],
        [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
        [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    ],
)


# == SQL building blocks (DuckDB) ==============================================


def values_sql(model: Model) -> str:
    """CTEs m (impacts), d (descriptors) and s (sig, desc, var of the space)."""
    cells = ", ".join(str(r) for r in frames.impact_rows(model))
    descriptors = ", ".join(f"({k}, {n}, {p})" for k, (n, p) in enumerate(zip(model.sizes, model.places, strict=True)))
    return f"""m(src_desc, src_var, tgt_desc, tgt_var, impact) AS (VALUES {cells}),
d(k, n, place) AS (VALUES {descriptors}),
s AS (SELECT r.range AS sig, d.k AS descr, (r.range // d.place) % d.n AS var FROM range({model.scenario_count()}) r, d)"""


BALANCE_SQL = """b AS (SELECT s.sig, m.tgt_desc, m.tgt_var, CAST(sum(m.impact) AS BIGINT) AS score FROM s JOIN m ON m.src_desc = s.descr AND m.src_var = s.var GROUP BY ALL)"""
OWN_SQL = """o AS (SELECT b.sig, b.tgt_desc, b.score AS own, s.var AS own_var FROM b JOIN s ON s.sig = b.sig AND s.descr = b.tgt_desc AND s.var = b.tgt_var)"""


def step_sql(margin: int = 0) -> str:
    """CTE t (sig, succ) of the global or a threshold rule."""
    return f"""top AS (SELECT b.sig, b.tgt_desc, b.tgt_var, b.score, o.own, o.own_var, row_number() OVER (PARTITION BY b.sig, b.tgt_desc ORDER BY b.score DESC, b.tgt_var) AS r FROM b JOIN o USING (sig, tgt_desc)),
t AS (SELECT sig, CAST(sum(CASE WHEN score - own > {margin} THEN tgt_var ELSE own_var END * d.place) AS BIGINT) AS succ FROM top JOIN d ON d.k = top.tgt_desc WHERE r = 1 GROUP BY sig)"""


def sequential_sql(model: Model) -> str:
    """CTE t of the sequential rule: one round per descriptor on the scenario moved so far."""
    out, state = [], "SELECT sig AS start, sig AS sig FROM t_all"
    out.append(f"t_all AS (SELECT range AS sig FROM range({model.scenario_count()}))")
    previous = f"({state})"
    for k, p in enumerate(model.places):
        out.append(
            f"""q{k} AS (SELECT u.start, u.sig, row_number() OVER (PARTITION BY u.start ORDER BY b.score DESC, (b.tgt_var = (u.sig // {p}) % {model.sizes[k]}) DESC, b.tgt_var) AS r, b.tgt_var FROM {previous} u JOIN b ON b.sig = u.sig AND b.tgt_desc = {k}),
p{k} AS (SELECT start, CAST(sig + (tgt_var - (sig // {p}) % {model.sizes[k]}) * {p} AS BIGINT) AS sig FROM q{k} WHERE r = 1)"""
        )
        previous = f"p{k}"
    out.append(f"t AS (SELECT start AS sig, sig AS succ FROM {previous})")
    return ",\n".join(out)


def walk_sql(rounds: int) -> str:
    """CTE w (sig, fp): where every start ends, fp null for cycles; rounds of pointer doubling."""
    out = [f"j0 AS (SELECT sig, succ AS far FROM t)"]
    for k in range(rounds):
        out.append(f"j{k + 1} AS (SELECT a.sig, b.far FROM j{k} a JOIN j{k} b ON b.sig = a.far)")
    out.append(f"w AS (SELECT j.sig, CASE WHEN t.succ = t.sig THEN t.sig END AS fp FROM j{rounds} j JOIN t ON t.sig = j.far)")
    return ",\n".join(out)


def chain(model: Model, *parts: str) -> str:
    return "WITH " + ",\n".join((values_sql(model), *parts)) + "\n"


# == the small model =============================================================


def _digits(model: Model) -> list:
    return [F.col(f"d{k}") for k in range(len(model.sizes))]


def encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scenario decoded, named and encoded again."""
    of = F.array(*_digits(SMALL))
    s = C.space(spark, SMALL)
    name = C.names(of, SMALL)
    return s.select("sig", *_digits(SMALL), C.signature(of, SMALL).alias("again"), F.concat_ws("/", *(F.element_at(name, F.lit(d)) for d in SMALL.descriptors)).alias("named"))


def wide_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures past 64 bits, exact in decimal(38,0): digits all 1 and all 2 of 60 ternary descriptors, by prefix."""
    big = Model.build((3,) * 60, [[0] * 180] * 180)
    base = spark.range(1, 61).select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("v"))
    of = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.when(k <= F.col("id"), F.col("v")).otherwise(0))
    return base.select(F.col("id").alias("k"), "v", C.signature(of, big).cast("string").alias("sig"))


def impact_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as a join of digits with the matrix and a grouped sum."""
    s = C.space(spark, SMALL).select("sig", F.posexplode(F.array(*_digits(SMALL))).alias("src_desc", "src_var"))
    impacts = frames.impacts_frame(spark, SMALL)  # the square of the variants
    return s.join(F.broadcast(impacts), ["src_desc", "src_var"]).groupBy("sig", "tgt_desc", "tgt_var").agg(F.sum("impact").alias("score"))


def inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every pair of consistent scenarios (u, v): the balance of u at v's variants, summed; u and v meet in those variants."""
    of = _digits(SMALL)
    good = C.space(spark, SMALL).filter(C.consistent(SMALL, of))
    u = good.select(F.col("sig").alias("u"), F.posexplode(F.array(*C.balance(SMALL, of))).alias("dim", "score"))
    v = good.select(F.col("sig").alias("v"), F.explode(F.array(*(d + o for d, o in zip(of, SMALL.offsets, strict=True)))).alias("dim"))
    return u.join(v, "dim").groupBy("u", "v").agg(F.sum("score").cast("bigint").alias("product"))


def step_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.space(spark, SMALL).select("sig", C.encode(SMALL, C.step(SMALL, _digits(SMALL))).alias("succ"))


def step_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves only for a gain of more than 2."""
    return C.space(spark, SMALL).select("sig", C.encode(SMALL, C.step(SMALL, _digits(SMALL), 2)).alias("succ"))


def step_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors one after the other, rescored in between: a projection for each."""
    s = C.space(spark, SMALL)
    for k, (o, n) in enumerate(zip(SMALL.offsets, SMALL.sizes, strict=True)):
        of = _digits(SMALL)
        s = s.withColumn(f"d{k}", C.best([C.score(SMALL, c, of) for c in range(o, o + n)], of[k]))
    return s.select("sig", C.encode(SMALL, _digits(SMALL)).alias("succ"))


def kernel_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.space(spark, SMALL).filter(C.consistent(SMALL, _digits(SMALL))).select("sig")


def kernel_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.sweep(spark, SMALL, 2)


def kernel_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.consistent_frame(spark, SMALL, algorithm="bnb").select("sig")


class Stubborn(Sequential):
    """A custom rule, with no margin promised: the sequential rule under another name."""

    margin = None

    def __init__(self):
        pass


def kernel_generic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.scan(spark, SMALL, Stubborn())


def find_basins_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basins.basins_frame(spark, SMALL)


def find_basins_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basins.basins_frame(spark, SMALL, SEQUENTIAL)


def find_basins_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basins.basins_frame(spark, SMALL, GLOBAL, 7, 29)


def basins_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the space counted one by one, then merged."""
    parts = [basins.partial_basins(spark, SMALL, "small", a, b - 1) for a, b in pairwise((0, 10, 25, 36))]
    return basins.merge_partials(parts[0].union(parts[1]).union(parts[2]), 36)


def basins_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranked_basins(basins.basins_frame(spark, SMALL))
    return ranked.select("rank", "fp", "basin_size", F.round("fraction", 6).alias("fraction"))


def walk_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every start with the fixed point it ends in (null: a cycle), walked in batches."""
    import pyarrow as pa

    from .plans.dynamics import resolve

    def run(batches):
        for b in batches:
            ends = resolve(b.column(0).to_numpy(), SMALL)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if e < 0 else int(e) for e in ends], pa.int64())], ["sig", "fp"])

    return ship(spark).range(SMALL.scenario_count()).withColumnRenamed("id", "sig").mapInArrow(run, "sig bigint, fp bigint")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states from 0,0,0 to the first repeat."""
    states, length = succession_trace(SMALL, (0, 0, 0))
    return spark.createDataFrame([(k, SMALL.signature(u), length) for k, u in enumerate(states)], "step int, sig bigint, cycle_length int")


def influence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.edges_frame(frames.impacts_frame(spark, ISLANDS))


def influence_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """descriptor, component (its least descriptor), and whether it is a dial or forced."""
    s = structure.influence_structure(spark, ISLANDS)
    rows = [(k, min(c), k in s.dials, k in dict(s.forced)) for c in s.components for k in c]
    return spark.createDataFrame(rows, "descriptor int, component int, dial boolean, forced boolean")


def fixed_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel with WSEC held at Mod, as signatures of the free model."""
    pinned = SMALL.fix("WSEC", "Mod")
    of = F.array(F.get("digits", F.lit(0)), F.lit(1), F.get("digits", F.lit(2)))
    return kernel.consistent_frame(spark, pinned).select(C.signature(of, SMALL).alias("sig"))


def product_of_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basins of a model from those of its islands."""
    c = structure.product_basins(spark, ISLANDS)
    rows = [(ISLANDS.signature(u), n) for u, n in zip(c.fixed_points, c.sizes, strict=True)]
    return spark.createDataFrame([*rows, (None, c.cycle_count)], basins.BASINS)


def lever_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By consistent scenario: single changes absorbed, leading elsewhere, into cycles."""
    g = transitions.transition_graph(spark, SMALL)
    rows = [(int(s), a, b, c) for s, k, a, b, c in zip(g.signatures, g.kinds, g.returned, g.moved, g.destabilized, strict=True) if k == "attractor"]
    return spark.createDataFrame(rows, "sig bigint, returned int, moved int, destabilized int")


def lever_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single changes that lead to another consistent scenario."""
    g = transitions.transition_graph(spark, SMALL)
    rows = [(int(g.signatures[e.source]), e.changes[0][0], e.changes[0][1], int(g.signatures[e.target])) for e in g.edges if g.kinds[e.target] == "attractor"]
    return spark.createDataFrame(rows, "sig bigint, descriptor int, variant int, target bigint")


def lever_graph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lever graph of pairs from a current world, for Graphviz, line by line (beyond SQL)."""
    g = transitions.transition_graph(spark, SMALL, world={"WTRD": "FT", "WSEC": "Rlx", "WECO": "Decl"}, radius=2)
    return spark.createDataFrame(list(enumerate(to_dot(g).splitlines())), "line int, text string")


def sweep_of_a_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent scenarios for each value of the cell FT on RpdGr."""
    return batch.sweep_impact(spark, SMALL, ("WTRD", "FT"), ("WECO", "RpdGr"), range(-3, 6))


def edited_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix in long form after one edit."""
    return frames.impacts_frame(spark, SMALL.with_impact(("WTRD", "FT"), ("WECO", "RpdGr"), -2)).withColumn("impact", F.col("impact").cast("bigint"))


def estimate_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled basin shares with intervals; what the pinned generator hits is pinned too."""
    e = estimate.estimate_frame(spark, SMALL, samples=50_000)
    rounded = [F.round(c, 6).alias(c) for c in ("share", "ci_low", "ci_high", "size_estimate")]
    return e.select(F.when(F.col("digits").isNotNull(), C.signature(F.col("digits"), SMALL)).alias("fp"), "hits", *rounded)


def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model written as text, parsed, and put in frames."""
    again = parse_scw(to_scw(SMALL))
    v = frames.variants_frame(spark, again)
    return v.join(F.broadcast(frames.descriptors_frame(spark, again)), "descriptor_idx").select("descriptor", "variant", "descriptor_idx", "variant_idx", "dim")


def solutions_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '$ ScenarioWizard 3.0\nSolution set\n 2 \n\n" 2 3 2",4,0,0,15,""\n" 3 1 3",12,1,0,12,""\n'
    return spark.createDataFrame([(k, SMALL.signature(u)) for k, u in enumerate(parse_solutions(text))], "scenario_id int, sig bigint")


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basins as JSON, one text per row."""
    return json_rows(basins.basins_frame(spark, SMALL).filter("fp is not null"))


# == models derived from the tables ===============================================

COLUMNS = ("l_returnflag", "l_linestatus", "o_orderpriority", "c_mktsegment", "r_name")
#: Excess of how often two categories meet over chance, in per mille, from which an impact of 1, 2, 3 is given.
STEPS = (4, 10, 20)


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five categories of every line item. The dimension tables are small against line items; Spark picks the joins."""
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    nations = read("nation", "n_nationkey", "n_regionkey").join(read("region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = read("customer", "c_custkey", "c_mktsegment", "c_nationkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = read("orders", "o_orderkey", "o_custkey", "o_orderpriority").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return read("lineitem", "l_orderkey", "l_returnflag", "l_linestatus").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(*COLUMNS)


def tallied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories with their counts: one pass over the line items, as many rows as there are combinations."""
    return observed(spark, sf_dir).groupBy(*COLUMNS).agg(F.count("*").alias("n"))


def derived_model(rows: list) -> Model:
    """From the tally; all arithmetic is in integers."""
    names = [sorted({r[c] for r in rows}) for c in COLUMNS]
    at = [{v: j for j, v in enumerate(vs)} for vs in names]
    sizes = [len(v) for v in names]
    heads = [sum(sizes[:k]) for k in range(len(sizes))]
    n = sum(r["n"] for r in rows)
    single = [0] * sum(sizes)
    pair = [[0] * sum(sizes) for _ in range(sum(sizes))]
    for r in rows:
        where = [heads[k] + at[k][r[c]] for k, c in enumerate(COLUMNS)]
        for i in where:
            single[i] += r["n"]
            for j in where:
                if i != j:
                    pair[i][j] += r["n"]
    owner = [k for k, s in enumerate(sizes) for _ in range(s)]
    cells = [[0 if owner[i] == owner[j] else level(pair[i][j] * n * 1000 // (single[i] * single[j]) - 1000) for j in range(len(owner))] for i in range(len(owner))]
    return Model(COLUMNS, tuple(map(tuple, names)), cells)


def level(excess: int) -> int:
    up = sum(excess >= s for s in STEPS)
    return up if up else -sum(excess <= -s for s in STEPS)


def _tally_and_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Model]:
    from .storage import materialise

    tally = materialise(tallied(ship(spark), sf_dir))
    return tally, derived_model(tally.collect())  # one row per combination of categories


def _placed(tally: DataFrame, model: Model) -> DataFrame:
    """The tally with digits d0.. of each scenario."""
    number = lambda k: F.array_position(F.array(*map(F.lit, model.variants[k])), F.col(COLUMNS[k])).cast("int") - 1
    return tally.select("n", *(number(k).alias(f"d{k}") for k in range(len(COLUMNS))))


def derived_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix derived from the tables, by names."""
    _, model = _tally_and_model(spark, sf_dir)
    rows = [(model.descriptors[a], model.variants[a][b], model.descriptors[c], model.variants[c][d], x) for a, b, c, d, x in frames.impact_rows(model) if a != c]
    return spark.createDataFrame(rows, "source string, source_variant string, target string, target_variant string, impact bigint")


def derived_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, model = _tally_and_model(spark, sf_dir)
    return kernel.consistent_frame(spark, model).select("sig")


def derived_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, model = _tally_and_model(spark, sf_dir)
    return basins.basins_frame(spark, model)


def observed_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by scenario: how many, whether it is consistent, and where it moves."""
    tally, model = _tally_and_model(spark, sf_dir)
    of = [F.col(f"d{k}") for k in range(len(COLUMNS))]
    return _placed(tally, model).select(C.encode(model, of).alias("sig"), F.col("n").alias("n_items"), C.consistent(model, of).alias("consistent"), C.encode(model, C.step(model, of)).alias("succ"))


def observed_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by the consistent scenario that their own would drift to (null: a cycle)."""
    import numpy as np

    from .plans.dynamics import resolve

    tally, model = _tally_and_model(spark, sf_dir)
    of = [F.col(f"d{k}") for k in range(len(COLUMNS))]

    @F.pandas_udf("bigint")
    def ends(sig):
        import pandas as pd

        e = resolve(sig.to_numpy(np.int64), model)
        return pd.Series(pd.array(e, "Int64")).mask(e < 0)

    return _placed(tally, model).select("n", ends(C.encode(model, of)).alias("fp")).groupBy("fp").agg(F.sum("n").alias("n_items"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basins of the model derived from the tables, largest first."""
    ranked = ranked_basins(derived_basins(spark, sf_dir))
    return ranked.select("rank", "fp", "basin_size", "fraction").orderBy(F.asc_nulls_last("rank"))


# == a chain of blocks: a space of middling size ===================================


#: What a descriptor of the chain adds to the next one, and to the third after it. Fixed values.
NEXT, THIRD = [[2, -1, 0], [-1, 1, 1], [0, 1, -1]], [[0, 1, -1], [1, -1, 0], [-1, 0, 2]]


def chain_model(links: int = 8) -> Model:
    """Ternary descriptors in a ring, each pulled by the one before it and the third before it; 3^links scenarios."""
    cells = [[0] * (3 * links) for _ in range(3 * links)]
    for k in range(links):
        for away, part in ((1, NEXT), (3, THIRD)):
            to = (k + away) % links
            for i in range(3):
                for j in range(3):
                    cells[3 * k + i][3 * to + j] += part[i][j]
    return Model.build((3,) * links, cells)


def ring_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.sweep(spark, chain_model())


def ring_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basins.basins_frame(spark, chain_model())


def large_ring_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """14,348,907 scenarios."""
    return basins.basins_frame(spark, chain_model(15))


def large_ring_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.consistent_frame(spark, chain_model(15)).select("sig")


def mixed_model() -> Model:
    """Ten ternary and ten binary descriptors, 60,466,176 scenarios; impacts of -3 to 3, one in three of them other than 0."""
    import numpy as np

    draw = np.random.default_rng(2024)
    sizes = (3,) * 10 + (2,) * 10
    cells = draw.integers(-3, 4, (50, 50)) * (draw.random((50, 50)) < 0.39)
    heads = np.cumsum((0, *sizes))
    for a, b in pairwise(heads):
        cells[a:b, a:b] = 0
    return Model.build(sizes, cells)


def wide_space_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.consistent_frame(spark, mixed_model()).select("sig")


def wide_space_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60,466,176 scenarios, the size of the largest published timing; beyond what the SQL check should spend."""
    return basins.basins_frame(spark, mixed_model())


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    encoding, wide_signature, impact_balance, inner_product, step_global, step_threshold, step_sequential, kernel_sweep, kernel_threshold, kernel_branch_and_bound,
    kernel_generic_scan, find_basins_global, find_basins_sequential, find_basins_range, basins_merged, basins_ranked, walk_destinations, trace, influence_edges,
    influence_components, fixed_descriptor, product_of_islands, lever_counts, lever_edges, lever_graph_text, sweep_of_a_cell, edited_cell, estimate_shares,
    model_round_trip, solutions_parsed, report_json, derived_impacts, derived_kernel, derived_basins, observed_scenarios, observed_basins, ring_kernel, ring_basins,
    large_ring_basins, large_ring_kernel, wide_space_kernel, wide_space_basins,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .more_queries import QUERIES as more

    return {f.__name__: f for f in (*QUERIES, *more)}


def oracle_sql() -> dict[str, str]:
    from .more_queries import oracle_sql as more
    from .oracles import oracle_sql as sql

    return sql() | more()
