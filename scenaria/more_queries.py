"""Queries over files, streams, walks, reports and the smaller operators, each beside its SQL for DuckDB."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as q
from .functions import columns as C
from .functions.random import Stream, z_for
from .functions.table import register_trace
from .model import Model
from .operators import basins, batch, kernel, structure, transitions
from .oracles import CONSISTENT, _basins
from .plans.rules import GLOBAL
from .queries import ISLANDS, SMALL, chain_model
from .session import ship
from .sources import frames, sinks
from .sources.files import parse_scw, signature_from, to_scw
from .storage import materialise, shared_dir

WORLD = {"WTRD": "FT", "WSEC": "Rlx", "WECO": "Decl"}


def _sig(digits: str | Column, model: Model = SMALL) -> Column:
    return C.signature(F.col(digits) if isinstance(digits, str) else digits, model)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def _files(spark: SparkSession, texts: list[str]) -> str:
    """A folder with one file for each text, written by Spark."""
    at = _folder(spark)
    for text in texts:
        spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("append").text(at)
    return at


def _digits() -> list[Column]:
    return [F.col(f"d{k}") for k in range(len(SMALL.sizes))]


# -- encoding and scores -----------------------------------------------------------


def scenario_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of spaces and their last signatures, past 64 bits too."""
    rows = []
    for n in (1, 20, 39, 41, 70):
        model = Model.build((3,) * n, [[0] * (3 * n)] * (3 * n))
        try:
            last = str(model.max_signature())
        except OverflowError:
            last = None
        rows.append((n, str(model.scenario_count()), last))
    return spark.createDataFrame(rows, "descriptors int, scenarios string, last string")


def named_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scenario's scores by name, with the variant selected and whether none beats it."""
    of = _digits()
    scores = F.array(*C.balance(SMALL, of))
    blocks = []
    for k, (d, vs, o) in enumerate(zip(SMALL.descriptors, SMALL.variants, SMALL.offsets, strict=True)):
        block = F.slice(F.col("scores"), o + 1, len(vs))
        own = F.get(block, F.col(f"d{k}"))
        for j, v in enumerate(vs):
            blocks.append(F.struct(F.lit(d).alias("descriptor"), F.lit(v).alias("variant"), F.get(block, F.lit(j)).cast("bigint").alias("score"), (F.col(f"d{k}") == j).alias("selected"), (own >= F.array_max(block)).alias("consistent")))
    return C.space(spark, SMALL).withColumn("scores", scores).select("sig", F.explode(F.array(*blocks)).alias("x")).select("sig", "x.*")


def named_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix by names, joined from the frames of a model."""
    names = frames.variants_frame(spark, SMALL).join(frames.descriptors_frame(spark, SMALL), "descriptor_idx")
    side = lambda p: names.select(F.col("descriptor_idx").alias(f"{p}_desc"), F.col("variant_idx").alias(f"{p}_var"), F.col("descriptor").alias(f"{p}"), F.col("variant").alias(f"{p}_variant"))
    table = frames.impacts_frame(spark, SMALL).join(side("src"), ["src_desc", "src_var"]).join(side("tgt"), ["tgt_desc", "tgt_var"])
    return table.select(F.col("src").alias("source"), F.col("src_variant").alias("source_variant"), F.col("tgt").alias("target"), F.col("tgt_variant").alias("target_variant"), "impact")


def resolved_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, indices and both mixed, as lists and as mappings."""
    said = (["FT", "Alrt", "Stag"], [0, 2, 1], ["FT", 2, "Stag"], {"WECO": "Stag", "WSEC": 2, "WTRD": "FT"}, {0: 0, 1: "Alrt", 2: 1})
    return spark.createDataFrame([(k, SMALL.signature(SMALL.resolve(x))) for k, x in enumerate(said)], "k int, sig bigint")


def signature_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios numbered in the order of their digits read from the last, which is that of signatures."""
    table = C.space(spark, SMALL).select("sig", F.array(*_digits()).alias("digits"))
    return sinks.numbered(table, F.reverse("digits"), name="place").select("sig", "place")


def json_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as JSON writes them, numbers up to 2^53 and strings beyond, and read back."""
    numbers = [0, 36, 2**53 - 1, 2**53, 2**53 + 1, 2**62]
    table = spark.createDataFrame([(n, str(signature_from(json.loads(sinks.to_json(n))))) for n in numbers], "n bigint, again string")
    return table.select("n", C.json_count(F.col("n")).alias("said"), "again")


def generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first numbers of the pinned generator."""
    rows = []
    for seed in (0, 42):
        stream = Stream(seed)
        rows += [(seed, k, f"{stream.next():016x}") for k in range(4)]
    return spark.createDataFrame(rows, "seed int, k int, word string")


# -- search and structure -----------------------------------------------------------


def descriptor_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which branch and bound takes descriptors."""
    return spark.createDataFrame(list(enumerate(kernel.coupled_first(SMALL))), "place int, descriptor int")


def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.space(spark, SMALL).select("sig", C.consistent(SMALL, _digits()).alias("consistent"))


def wide_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seventy binary descriptors, each forced by the one before it."""
    n = 70
    cells = [[int(t == ((s // 2 + 1) % n) * 2 + s % 2) for t in range(2 * n)] for s in range(2 * n)]
    return kernel.consistent_frame(spark, Model.build((2,) * n, cells)).select(F.col("sig").cast("string").alias("sig"))


def kernel_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of kernels by islands, without listing them."""
    rows = [(name, sinks.list_kernel(spark, model, most=0)[1]) for name, model in (("small", SMALL), ("islands", ISLANDS))]
    return spark.createDataFrame(rows, "model string, size bigint")


def constant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What variants score where all sources stand at their first variant."""
    impacts = frames.impacts_frame(spark, ISLANDS)
    return impacts.filter("src_var = 0").groupBy("tgt_desc", "tgt_var").agg(F.sum("impact").alias("score"))


def islands_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each island: its first descriptor, and the scenarios of its own model."""
    s = structure.influence_structure(spark, ISLANDS)
    rows = [(min(c), m.scenario_count()) for c, m in zip(s.components, structure.split(ISLANDS, s.components), strict=True)]
    return spark.createDataFrame(rows, "first int, scenarios bigint")


# -- files and streams ----------------------------------------------------------------


def solutions_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solution lists in several files, read by Spark."""
    texts = [f'$ ScenarioWizard 3.0\nSolution set\n 2 \n\n" {a + 1} {b + 1} 1",4,0\n" {b + 1} 3 {a + 1}",12,1\n' for a, b in ((0, 1), (1, 2), (2, 0))]
    return frames.read_solutions(spark, _files(spark, texts)).select("scenario_id", _sig("digits").alias("sig"))


def model_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model file read by Spark, as rows of its matrix."""
    table = frames.read_models(spark, _files(spark, [to_scw(SMALL)]))

    def rows(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                yield pd.DataFrame(frames.impact_rows(parse_scw(content)), columns=["src_desc", "src_var", "tgt_desc", "tgt_var", "impact"])

    ship(spark)
    return table.mapInPandas(rows, frames.IMPACTS)


def models_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models and a file that is none, side by side."""
    table = frames.read_models(spark, _files(spark, [to_scw(SMALL), to_scw(ISLANDS), "nothing"]))
    return batch.run_models(spark, table, "basins").select("error", "scenario", F.col("signature").cast("bigint").alias("sig"), "basin_size")


def shares_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares written as lines, one file each, then read and merged."""
    texts = [sinks.partial_tsv("small", a, b, basins.find_basins(spark, SMALL, GLOBAL, a, b)) for a, b in ((0, 11), (12, 30), (31, 35))]
    return basins.merge_partials(materialise(basins.read_partials(spark, _files(spark, texts))), 36)


def shares_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that do not tile a space of 100."""
    rows = [("m", a, b, "C", None, 0) for a, b in ((5, 9), (10, 19), (25, 39), (35, 50), (51, 90))]
    return basins.tiling_faults(spark.createDataFrame(rows, basins.PARTIALS), 100)


def shares_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares that arrive in a folder, one of them twice, merged by a stream."""
    from .streaming import merged_stream

    at, name = _folder(spark), f"merged_{uuid.uuid4().hex}"
    for a, b in ((0, 11), (12, 35), (0, 11)):
        basins.partial_basins(spark, SMALL, "small", a, b).write.mode("append").parquet(at)
    stream = merged_stream(spark, at).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", _folder(spark)).trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.table(name).select("fp", "basin_size")


# -- walks and levers -------------------------------------------------------------------


def trace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of every start, by the table function."""
    register_trace(spark, SMALL)
    return spark.sql("SELECT s.id AS start, t.step, t.sig, t.cycle_length FROM range(36) s, LATERAL succession_trace(s.id) t")


def _levers(spark: SparkSession, radius: int) -> tuple[DataFrame, DataFrame]:
    return transitions.lever_frames(spark, SMALL, GLOBAL, kernel.consistent_frame(spark, SMALL), radius)


def lever_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single changes that lead elsewhere, into cycles too, and the steps it takes."""
    _, edges = _levers(spark, 1)
    return edges.select(_sig("source").alias("sig"), F.col("changes")[0]["descriptor"].alias("descriptor"), F.col("changes")[0]["variant"].alias("variant"), _sig("target").alias("target"), "still", "steps")


def lever_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of changes that reach what no single change reaches."""
    _, edges = _levers(spark, 2)
    x = lambda k, f: F.col("changes")[k][f].alias(f"{f}_{k + 1}")
    return edges.filter(F.size("changes") == 2).select(_sig("source").alias("sig"), x(0, "descriptor"), x(0, "variant"), x(1, "descriptor"), x(1, "variant"), _sig("target").alias("target"), "still", "steps")


def lever_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent scenarios by the share of single changes that come back, most robust first."""
    counts, _ = _levers(spark, 1)
    tried = sum(SMALL.sizes) - len(SMALL.sizes)
    table = counts.select(_sig("digits").alias("sig"), F.round(F.col("returned") / F.lit(tried), 6).alias("robustness"))
    return sinks.numbered(table, F.desc("robustness"), F.asc("sig"))


def lever_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a current world: its own course (no change), and the single changes that lead elsewhere."""
    g = transitions.transition_graph(spark, SMALL, world=WORLD)
    rows = [(*(e.changes[0] if e.changes else (None, None)), int(g.signatures[e.target]), g.kinds[e.target] == "attractor", e.steps) for e in g.edges if e.source == g.world]
    return spark.createDataFrame(rows, "descriptor int, variant int, target bigint, still boolean, steps bigint")


# -- reports ------------------------------------------------------------------------------


def basin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basins as a tab-separated table."""
    text = sinks.basin_tsv(basins.find_basins(spark, SMALL))
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line int, text string")


def basin_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the CSV, below its notes and heading."""
    text = [x for x in sinks.basin_csv(basins.find_basins(spark, SMALL)).splitlines() if not x.startswith(("#", "rank"))]
    return spark.createDataFrame(list(enumerate(text)), "line int, text string")


def composed_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest of the composed basins."""
    c = structure.product_basins(spark, ISLANDS).frame(spark).filter("digits is not null")
    of = c.select(_sig("digits", ISLANDS).alias("fp"), F.col("basin_size").cast("bigint").alias("basin_size"))
    return of.orderBy(F.desc("basin_size"), "fp").limit(10)


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    scenario_counts, named_balance, named_impacts, resolved_scenarios, signature_sort, json_counts, generator, descriptor_order, consistency, wide_kernel, kernel_sizes,
    constant_scores, islands_split, solutions_read, model_source, models_batch, shares_read, shares_faults, shares_streamed, trace_table, lever_steps, lever_pairs,
    lever_robustness, lever_world, basin_lines, basin_csv_lines, composed_largest,
)


def walks_sql() -> str:
    """CTEs up to e (start, target, still, steps): where every start ends and the steps of the walk, from its whole path."""
    stepped = q.chain(SMALL, q.BALANCE_SQL, q.OWN_SQL, q.step_sql()).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    return f"""{stepped},
path(start, k, sig) AS (SELECT sig, 0, sig FROM t UNION ALL SELECT path.start, path.k + 1, t.succ FROM path JOIN t ON t.sig = path.sig WHERE path.k < 40),
again AS (SELECT a.start, min(b.k) AS second FROM path a JOIN path b ON b.start = a.start AND b.sig = a.sig AND a.k < b.k GROUP BY a.start),
loop AS (SELECT again.start, again.second, a.k AS tail, again.second - a.k AS size FROM again JOIN path b ON b.start = again.start AND b.k = again.second JOIN path a ON a.start = b.start AND a.sig = b.sig AND a.k < b.k),
e AS (SELECT l.start, min(p.sig) AS target, l.size = 1 AS still, CAST(pow(2, ceil(log2(greatest(l.tail + 1, l.size)))) AS BIGINT) - 1 + l.size + greatest(l.size - 1, 0) AS steps
 FROM loop l JOIN path p ON p.start = l.start AND p.k >= l.tail AND p.k < l.second GROUP BY l.start, l.size, l.tail, l.second),
f AS (SELECT sig FROM t WHERE succ = sig),
one(sig, descriptor, variant, changed) AS (SELECT t.sig, d.k, v.range, t.sig + (v.range - (t.sig // d.place) % d.n) * d.place FROM t, d, range(10) v WHERE v.range < d.n AND v.range <> (t.sig // d.place) % d.n)"""


def ring_scores(before: str, third: str, variant: str) -> str:
    """SQL: what a variant of a ring's descriptor scores."""
    look = lambda table, row: f"list_extract({[x for r in table for x in r]}, CAST({row} * 3 + {variant} + 1 AS INTEGER))"
    return f"({look(q.NEXT, before)} + {look(q.THIRD, third)})"


def ring_kernel_sql(links: int) -> str:
    """Scenarios built link by link: a descriptor is pulled by two others only, and the first three are checked at the end."""
    fits = lambda c, a, v: f"({c}, {a}, {v}) IN (SELECT (c, a, v) FROM fit)"
    return f"""WITH RECURSIVE n(x) AS (VALUES (0), (1), (2)),
score AS (SELECT c.x AS c, a.x AS a, v.x AS v, {ring_scores('c.x', 'a.x', 'v.x')} AS s FROM n c, n a, n v),
fit AS (SELECT c, a, v FROM (SELECT *, max(s) OVER (PARTITION BY c, a) AS most FROM score) WHERE s = most),
r(t, sig, a, b, c, x0, x1, x2) AS (SELECT 3, CAST(x.x + 3 * y.x + 9 * z.x AS BIGINT), x.x, y.x, z.x, x.x, y.x, z.x FROM n x, n y, n z
 UNION ALL SELECT t + 1, sig + fit.v * CAST(pow(3, t) AS BIGINT), b, r.c, fit.v, x0, x1, x2 FROM r JOIN fit ON fit.c = r.c AND fit.a = r.a WHERE t < {links})
SELECT sig FROM r WHERE t = {links} AND {fits('c', 'a', 'x0')} AND {fits('x0', 'b', 'x1')} AND {fits('x1', 'c', 'x2')}"""


def ring_basins_sql(links: int, rounds: int) -> str:
    """Weights pushed on by the step, which is arithmetic on the signature, until all stand on attractors."""
    moves = []
    for third in range(3):
        for before in range(3):
            for own in range(3):
                scores = [q.NEXT[before][v] + q.THIRD[third][v] for v in range(3)]
                moves.append(own if scores[own] == max(scores) else scores.index(max(scores)))
    digit = lambda k: f"(sig // {3 ** (k % links)}) % 3"
    step = " + ".join(f"list_extract({moves}, CAST(9 * ({digit(k - 3)}) + 3 * ({digit(k - 1)}) + {digit(k)} + 1 AS INTEGER)) * {3**k}" for k in range(links))
    parts = [f"f0 AS (SELECT CAST({step} AS BIGINT) AS sig, count(*) AS w FROM (SELECT range AS sig FROM range({3**links})) GROUP BY 1)"]
    parts += [f"f{k} AS (SELECT CAST({step} AS BIGINT) AS sig, sum(w) AS w FROM f{k - 1} GROUP BY 1)" for k in range(1, rounds)]
    return f"""WITH {', '.join(parts)}, z AS (SELECT sig, w, {step} = sig AS still FROM f{rounds - 1})
SELECT sig AS fp, CAST(w AS BIGINT) AS basin_size FROM z WHERE still UNION ALL SELECT CAST(NULL AS BIGINT), CAST(coalesce(sum(w), 0) AS BIGINT) FROM z WHERE NOT still"""


def oracle_sql() -> dict[str, str]:
    balance = (q.BALANCE_SQL, q.OWN_SQL)
    start = q.chain(SMALL, *balance)
    walked = q.chain(SMALL, *balance, q.step_sql(), q.walk_sql(7))
    islands = q.chain(ISLANDS, *balance, q.step_sql(), q.walk_sql(7))
    levers = walks_sql()
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
    names = ", ".join(f"({k}, {j}, {quoted(d)}, {quoted(v)})" for k, d in enumerate(SMALL.descriptors) for j, v in enumerate(SMALL.variants[k]))
    named = f"nm(k, j, descriptor, variant) AS (VALUES {names})"
    said = " || '/' || ".join(f"(SELECT variant FROM nm WHERE nm.k = {k} AND nm.j = (r.fp // {p}) % {n})" for k, (p, n) in enumerate(zip(SMALL.places, SMALL.sizes, strict=True)))
    comma = said.replace("'/'", "','")
    ranked = f"{walked}, {named}, z AS ({_basins()}), r AS (SELECT row_number() OVER (ORDER BY basin_size DESC, fp) AS rank, fp, basin_size FROM z WHERE fp IS NOT NULL)"
    threes = ", ".join(f"({n}, '{3**n}', {quoted(3**n - 1) if 3**n - 1 < 2**63 else 'NULL'})" for n in (1, 20, 39, 41, 70))
    z, hits = z_for(0.95), ((13, 1369), (16, 5483), (20, 16720), (21, 2788), ("NULL", 23640))
    pins = {0: ("53175d61490b23df", "61da6f3dc380d507", "5c0fdf91ec9a7bfc", "02eebf8c3bbe5e1a"), 42: ("d0764d4f4476689f", "519e4174576f3791", "fbe07cfb0c24ed8c", "b37d9f600cd835b8")}
    words = ", ".join(f"({seed}, {k}, '{w}')" for seed, pinned in pins.items() for k, w in enumerate(pinned))
    solutions = ", ".join(f"({k}, {a - 1 + 3 * (b - 1) + 9 * (c - 1)})" for x, y in ((0, 1), (1, 2), (2, 0)) for k, (a, b, c) in enumerate(((x + 1, y + 1, 1), (y + 1, 3, x + 1))))
    cells = ", ".join(map(str, frames.impact_rows(SMALL)))
    records = lambda chain: f"{chain}, z AS ({_basins()}), k AS (SELECT t.sig FROM t WHERE t.sig = t.succ) SELECT CAST(NULL AS VARCHAR) AS error, CAST(row_number() OVER (ORDER BY fp) - 1 AS INTEGER) AS scenario, fp AS sig, basin_size FROM z WHERE fp IS NOT NULL"
    order = """p AS (SELECT a, b, sum(x) AS pull FROM (SELECT src_desc AS a, tgt_desc AS b, abs(impact) AS x FROM m UNION ALL SELECT tgt_desc, src_desc, abs(impact) FROM m) WHERE a <> b GROUP BY a, b),
o1 AS (SELECT a AS k FROM p GROUP BY a ORDER BY sum(pull) DESC, a LIMIT 1), o2 AS (SELECT a AS k FROM p WHERE b IN (SELECT k FROM o1) ORDER BY pull DESC, a LIMIT 1), o3 AS (SELECT k FROM d WHERE k NOT IN (SELECT k FROM o1 UNION SELECT k FROM o2))"""
    home = "(SELECT target FROM e WHERE start = 0)"
    return {
        "scenario_counts": f"SELECT CAST(a AS INTEGER) AS descriptors, b AS scenarios, c AS last FROM (VALUES {threes}) v(a, b, c)",
        "named_balance": f"{start.rstrip()}, {named}, top AS (SELECT sig, tgt_desc, max(score) AS most FROM b GROUP BY ALL) SELECT b.sig, nm.descriptor, nm.variant, b.score, b.tgt_var = o.own_var AS selected, o.own >= top.most AS consistent FROM b JOIN o USING (sig, tgt_desc) JOIN top USING (sig, tgt_desc) JOIN nm ON nm.k = b.tgt_desc AND nm.j = b.tgt_var",
        "named_impacts": f"{start.rstrip()}, {named} SELECT x.descriptor AS source, x.variant AS source_variant, y.descriptor AS target, y.variant AS target_variant, CAST(m.impact AS INTEGER) AS impact FROM m JOIN nm x ON x.k = m.src_desc AND x.j = m.src_var JOIN nm y ON y.k = m.tgt_desc AND y.j = m.tgt_var",
        "resolved_scenarios": "SELECT CAST(range AS INTEGER) AS k, CAST(0 + 2 * 3 + 1 * 9 AS BIGINT) AS sig FROM range(5)",
        "signature_sort": "SELECT range AS sig, CAST(range + 1 AS INTEGER) AS place FROM range(36)",
        "json_counts": "SELECT n, CASE WHEN n > 9007199254740992 THEN '\"' || n || '\"' ELSE CAST(n AS VARCHAR) END AS said, CAST(n AS VARCHAR) AS again FROM (VALUES (0::BIGINT), (36), (9007199254740991), (9007199254740992), (9007199254740993), (4611686018427387904)) v(n)",
        "generator": f"SELECT CAST(a AS INTEGER) AS seed, CAST(b AS INTEGER) AS k, c AS word FROM (VALUES {words}) v(a, b, c)",
        "descriptor_order": f"WITH {q.values_sql(SMALL)}, {order} SELECT CAST(place AS INTEGER) AS place, CAST(k AS INTEGER) AS descriptor FROM (SELECT 0 AS place, k FROM o1 UNION ALL SELECT 1, k FROM o2 UNION ALL SELECT 2, k FROM o3)",
        "consistency": f"{start.rstrip()}, {CONSISTENT.format(margin=0)} SELECT range AS sig, range IN (SELECT sig FROM k) AS consistent FROM range(36)",
        "wide_kernel": f"SELECT sig FROM (VALUES ('0'), ('{2**70 - 1}')) v(sig)",
        "kernel_sizes": f"SELECT 'small' AS model, CAST((SELECT count(*) FROM ({start.rstrip()}, {CONSISTENT.format(margin=0)} SELECT sig FROM k)) AS BIGINT) AS size UNION ALL SELECT 'islands', CAST((SELECT count(*) FROM ({q.chain(ISLANDS, *balance).rstrip()}, {CONSISTENT.format(margin=0)} SELECT sig FROM k)) AS BIGINT)",
        "constant_scores": f"WITH {q.values_sql(ISLANDS)} SELECT CAST(tgt_desc AS INTEGER) AS tgt_desc, CAST(tgt_var AS INTEGER) AS tgt_var, CAST(sum(impact) AS BIGINT) AS score FROM m WHERE src_var = 0 GROUP BY ALL",
        "islands_split": "SELECT CAST(a AS INTEGER) AS first, CAST(b AS BIGINT) AS scenarios FROM (VALUES (0, 2 * 3), (2, 2 * 2), (4, 2)) v(a, b)",
        "solutions_read": f"SELECT CAST(a AS BIGINT) AS scenario_id, CAST(b AS BIGINT) AS sig FROM (VALUES {solutions}) v(a, b)",
        "model_source": f"SELECT CAST(a AS INTEGER) AS src_desc, CAST(b AS INTEGER) AS src_var, CAST(c AS INTEGER) AS tgt_desc, CAST(d AS INTEGER) AS tgt_var, CAST(x AS INTEGER) AS impact FROM (VALUES {cells}) v(a, b, c, d, x)",
        "models_batch": f"SELECT * FROM ({records(walked)}) UNION ALL SELECT * FROM ({records(islands)}) UNION ALL SELECT 'ValueError: no variants: this is not a model file', NULL, NULL, NULL",
        "shares_read": walked + _basins(),
        "shares_faults": """WITH r(first, last) AS (VALUES (5, 9), (10, 19), (25, 39), (35, 50), (51, 90)), s AS (SELECT first, last, lag(last) OVER (ORDER BY first) AS before, lead(first) OVER (ORDER BY first) AS next FROM r)
SELECT CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, fault FROM (SELECT first, last, CASE WHEN before IS NULL AND first <> 0 OR first > before + 1 THEN 'gap' WHEN first <= before THEN 'overlap' WHEN next IS NULL AND last <> 99 THEN 'end' END AS fault FROM s) WHERE fault IS NOT NULL""",
        "shares_streamed": walked + _basins(),
        "trace_table": f"{levers} SELECT CAST(p.start AS BIGINT) AS start, CAST(p.k AS INTEGER) AS step, CAST(p.sig AS BIGINT) AS sig, CAST(l.size AS INTEGER) AS cycle_length FROM path p JOIN loop l ON l.start = p.start AND p.k <= l.second",
        "lever_steps": f"{levers} SELECT CAST(one.sig AS BIGINT) AS sig, CAST(descriptor AS INTEGER) AS descriptor, CAST(variant AS INTEGER) AS variant, CAST(e.target AS BIGINT) AS target, e.still, e.steps FROM one JOIN f ON f.sig = one.sig JOIN e ON e.start = one.changed WHERE e.target <> one.sig",
        "lever_pairs": f"""{levers}, two AS (SELECT a.sig, a.descriptor AS d1, a.variant AS v1, b.descriptor AS d2, b.variant AS v2, a.changed + b.changed - a.sig AS changed FROM one a JOIN one b ON b.sig = a.sig AND a.descriptor < b.descriptor JOIN f ON f.sig = a.sig)
SELECT CAST(two.sig AS BIGINT) AS sig, CAST(d1 AS INTEGER) AS descriptor_1, CAST(v1 AS INTEGER) AS variant_1, CAST(d2 AS INTEGER) AS descriptor_2, CAST(v2 AS INTEGER) AS variant_2, CAST(e.target AS BIGINT) AS target, e.still, e.steps FROM two JOIN e ON e.start = two.changed
WHERE e.target <> two.sig AND NOT EXISTS (SELECT 1 FROM one JOIN e x ON x.start = one.changed WHERE one.sig = two.sig AND x.target = e.target)""",
        "lever_robustness": f"{levers}, c AS (SELECT one.sig, round(count(*) FILTER (e.target = one.sig) / 7.0::DOUBLE, 6) AS robustness FROM one JOIN f ON f.sig = one.sig JOIN e ON e.start = one.changed GROUP BY one.sig) SELECT CAST(sig AS BIGINT) AS sig, robustness, CAST(row_number() OVER (ORDER BY robustness DESC, sig) AS INTEGER) AS rank FROM c",
        "lever_world": f"""{levers} SELECT CAST(NULL AS INTEGER) AS descriptor, CAST(NULL AS INTEGER) AS variant, CAST(target AS BIGINT) AS target, still, steps FROM e WHERE start = 0 AND target <> 0
UNION ALL SELECT CAST(descriptor AS INTEGER), CAST(variant AS INTEGER), CAST(e.target AS BIGINT), e.still, e.steps FROM one JOIN e ON e.start = one.changed WHERE one.sig = 0 AND e.target <> {home}""",
        "basin_lines": f"{ranked} SELECT 0 AS line, concat_ws(chr(9), 'rank', 'signature', 'basin_size', 'basin_pct', 'scenario') AS text UNION ALL SELECT CAST(rank AS INTEGER), concat_ws(chr(9), rank, fp, basin_size, printf('%.4f', 100 * basin_size / 36.0::DOUBLE), {said}) FROM r",
        "basin_csv_lines": f"{ranked} SELECT CAST(rank - 1 AS INTEGER) AS line, concat_ws(',', rank, fp, {comma}, basin_size, CAST(round(100 * basin_size / 36.0::DOUBLE, 4) AS VARCHAR)) AS text FROM r",
        "composed_largest": f"{islands} SELECT fp, basin_size FROM ({_basins()}) WHERE fp IS NOT NULL ORDER BY basin_size DESC, fp LIMIT 10",
        "large_ring_kernel": ring_kernel_sql(15),
        "large_ring_basins": ring_basins_sql(15, 48),
        "estimate_shares": f"""WITH h(fp, hits) AS (VALUES {', '.join(f'({a}, {b})' for a, b in hits)}), s AS (SELECT CAST(fp AS BIGINT) AS fp, CAST(hits AS BIGINT) AS hits, hits / 50000.0::DOUBLE AS share, {z!r}::DOUBLE * {z!r}::DOUBLE / 50000 AS w FROM h),
c AS (SELECT *, (share + w / 2) / (1 + w) AS middle, {z!r}::DOUBLE * sqrt(share * (1 - share) / 50000 + w / (4 * 50000)) / (1 + w) AS half FROM s)
SELECT fp, hits, round(share, 6) AS share, round(greatest(0.0::DOUBLE, middle - half), 6) AS ci_low, round(least(1.0::DOUBLE, middle + half), 6) AS ci_high, round(share * 36, 6) AS size_estimate FROM c""",
    }
