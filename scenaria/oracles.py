"""DuckDB SQL that gives the rows of the engine's queries by plain relational means."""

from __future__ import annotations

from . import queries as q
from .sources.frames import impact_rows

CONSISTENT = "k AS (SELECT sig FROM (SELECT b.sig, max(b.score - o.own) AS lead FROM b JOIN o USING (sig, tgt_desc) GROUP BY b.sig) WHERE lead <= {margin})"


def _basins(where: str = "") -> str:
    return f"""SELECT CAST(fp AS BIGINT) AS fp, CAST(count(sig) AS BIGINT) AS basin_size FROM (SELECT sig, fp FROM w {where}) WHERE fp IS NOT NULL GROUP BY fp
UNION ALL SELECT CAST(NULL AS BIGINT), CAST(count(*) AS BIGINT) FROM w {where or 'WHERE true'} AND fp IS NULL"""


def _observed() -> str:
    """CTEs of the derived model: x (line items), c (tally), then m, d and s as for a given one."""
    columns = q.COLUMNS
    places, sizes = [], []
    names = ",\n".join(f"v{k} AS (SELECT {c} AS name, CAST(row_number() OVER (ORDER BY {c}) - 1 AS BIGINT) AS var FROM (SELECT DISTINCT {c} FROM c))" for k, c in enumerate(columns))
    for k in range(len(columns)):
        places.append(" * ".join(["1", *(f"(SELECT count(*) FROM v{j})" for j in range(k))]))
        sizes.append(f"(SELECT count(*) FROM v{k})")
    d = " UNION ALL ".join(f"SELECT {k} AS k, {sizes[k]} AS n, {places[k]} AS place" for k in range(len(columns)))
    single = " UNION ALL ".join(f"SELECT {k} AS descr, v.var, CAST(sum(c.n) AS HUGEINT) AS n FROM c JOIN v{k} v ON v.name = c.{col} GROUP BY v.var" for k, col in enumerate(columns))
    pairs = " UNION ALL ".join(
        f"SELECT {i} AS a, x.var AS av, {j} AS b, y.var AS bv, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS n FROM v{i} x CROSS JOIN v{j} y LEFT JOIN c ON c.{columns[i]} = x.name AND c.{columns[j]} = y.name GROUP BY x.var, y.var"
        for i in range(len(columns))
        for j in range(len(columns))
        if i != j
    )
    up = " ".join(f"WHEN e >= {s} THEN {k}" for k, s in reversed(list(enumerate(q.STEPS, 1))))
    down = " ".join(f"WHEN e <= {-s} THEN {-k}" for k, s in reversed(list(enumerate(q.STEPS, 1))))
    own = " UNION ALL ".join(f"SELECT {k}, x.var, {k}, y.var, 0 FROM v{k} x CROSS JOIN v{k} y" for k in range(len(columns)))
    return f"""WITH x AS (SELECT {', '.join(columns)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT {', '.join(columns)}, count(*) AS n FROM x GROUP BY ALL),
{names},
d AS ({d}),
one AS ({single}),
two AS ({pairs}),
e AS (SELECT a, av, b, bv, CAST(two.n * (SELECT sum(n) FROM c) * 1000 // (p.n * r.n) - 1000 AS BIGINT) AS e FROM two JOIN one p ON p.descr = a AND p.var = av JOIN one r ON r.descr = b AND r.var = bv),
m(src_desc, src_var, tgt_desc, tgt_var, impact) AS (SELECT a, av, b, bv, CASE {up} {down} ELSE 0 END FROM e UNION ALL {own}),
s AS (SELECT g.range AS sig, d.k AS descr, CAST((g.range // d.place) % d.n AS BIGINT) AS var FROM range((SELECT CAST(product(n) AS BIGINT) FROM d)) g, d),
{q.BALANCE_SQL},
{q.OWN_SQL}"""


def oracle_sql() -> dict[str, str]:
    small = q.SMALL
    balance = (q.BALANCE_SQL, q.OWN_SQL)
    start = q.chain(small, *balance)
    stepped = q.chain(small, *balance, q.step_sql())
    walked = q.chain(small, *balance, q.step_sql(), q.walk_sql(7))
    ring = q.chain_model()
    digits = ", ".join(f"CAST((sig // {p}) % {n} AS INTEGER) AS d{k}" for k, (p, n) in enumerate(zip(small.places, small.sizes, strict=True)))
    named = " || '/' || ".join(f"list_extract({list(v)!r}, d{k} + 1)" for k, v in enumerate(small.variants))
    kernel = q.chain(small, *balance, CONSISTENT.format(margin=0))
    single = f"""{walked},
f AS (SELECT sig FROM t WHERE succ = sig),
p AS (SELECT f.sig, d.k AS descriptor, v.range AS variant, f.sig + (v.range - (f.sig // d.place) % d.n) * d.place AS changed FROM f, d, range(10) v WHERE v.range < d.n AND v.range <> (f.sig // d.place) % d.n),
g AS (SELECT p.sig, p.descriptor, p.variant, w.fp FROM p JOIN w ON w.sig = p.changed)
""".replace("WITH", "WITH", 1)
    pinned = q.chain(small.fix("WSEC", "Mod"), *balance, CONSISTENT.format(margin=0))
    islands = q.ISLANDS
    edge = "e AS (SELECT src_desc, tgt_desc FROM (SELECT src_desc, tgt_desc, tgt_var, max(impact) <> min(impact) AS acts FROM m GROUP BY ALL) GROUP BY ALL HAVING bool_or(acts))"
    components = f"""WITH RECURSIVE {q.values_sql(islands)},
{edge},
u AS (SELECT src_desc AS a, tgt_desc AS b FROM e UNION SELECT tgt_desc, src_desc FROM e UNION SELECT k, k FROM d),
r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b),
free AS (SELECT k FROM d WHERE k NOT IN (SELECT tgt_desc FROM e)),
z AS (SELECT tgt_desc AS k, tgt_var, sum(impact) AS score FROM m WHERE src_var = 0 GROUP BY ALL),
flat AS (SELECT k, max(score) = min(score) AS even FROM z GROUP BY k)
SELECT CAST(d.k AS INTEGER) AS descriptor, CAST((SELECT min(b) FROM r WHERE r.a = d.k) AS INTEGER) AS component, d.k IN (SELECT k FROM free) AND even AS dial, d.k IN (SELECT k FROM free) AND NOT even AS forced FROM d JOIN flat USING (k)"""
    cell = (0, 0, 2, 3)
    swept = ", ".join(f"({v})" for v in range(-3, 6))
    sweep = f"""WITH {q.values_sql(small)},
x(value) AS (VALUES {swept}),
b AS (SELECT x.value, s.sig, m.tgt_desc, m.tgt_var, sum(CASE WHEN (m.src_desc, m.src_var, m.tgt_desc, m.tgt_var) = {cell} THEN x.value ELSE m.impact END) AS score FROM x, s JOIN m ON m.src_desc = s.descr AND m.src_var = s.var GROUP BY ALL),
o AS (SELECT b.value, b.sig, b.tgt_desc, b.score AS own FROM b JOIN s ON s.sig = b.sig AND s.descr = b.tgt_desc AND s.var = b.tgt_var)
SELECT CAST(value AS BIGINT) AS value, CAST(sig AS BIGINT) AS signature FROM (SELECT b.value, b.sig, max(b.score - o.own) AS lead FROM b JOIN o USING (value, sig, tgt_desc) GROUP BY ALL) WHERE lead <= 0"""
    variants = ", ".join(f"('{d}', '{v}', {k}, {j}, {small.offsets[k] + j})" for k, d in enumerate(small.descriptors) for j, v in enumerate(small.variants[k]))
    derived = _observed()
    sig_of = " + ".join(f"v{k}.var * (SELECT place FROM d WHERE k = {k})" for k in range(len(q.COLUMNS)))
    placed = "FROM c " + " ".join(f"JOIN v{k} ON v{k}.name = c.{c}" for k, c in enumerate(q.COLUMNS))
    ternary = lambda k, v: sum(v * 3**j for j in range(k))
    wide = ", ".join(f"({k}, {v}, '{ternary(k, v)}')" for k in range(1, 61) for v in (1, 2))
    pick = lambda w: f"(CASE {' '.join(f'WHEN m{w} = {k} THEN {chr(39)}{c}{chr(39)}' for k, c in enumerate(q.COLUMNS))} END)"
    name_of = " UNION ALL ".join(f"SELECT {k} AS descr, var, name FROM v{k}" for k in range(len(q.COLUMNS)))
    return {
        "encoding": f"SELECT sig, {', '.join(f'd{k}' for k in range(3))}, again, {named} AS named FROM (SELECT range AS sig, range AS again, {digits.replace('(sig //', '(range //')} FROM range(36))",
        "wide_signature": f"SELECT CAST(k AS BIGINT) AS k, CAST(v AS INTEGER) AS v, sig FROM (VALUES {wide}) t(k, v, sig)",
        "impact_balance": start + "SELECT sig, CAST(tgt_desc AS INTEGER) AS tgt_desc, CAST(tgt_var AS INTEGER) AS tgt_var, score FROM b",
        "inner_product": kernel + "SELECT u.sig AS u, v.sig AS v, CAST(sum(b.score) AS BIGINT) AS product FROM k u, k v JOIN s ON s.sig = v.sig JOIN b ON b.sig = u.sig AND b.tgt_desc = s.descr AND b.tgt_var = s.var GROUP BY ALL",
        "step_global": stepped + "SELECT sig, succ FROM t",
        "step_threshold": q.chain(small, *balance, q.step_sql(2)) + "SELECT sig, succ FROM t",
        "step_sequential": q.chain(small, *balance, q.sequential_sql(small)) + "SELECT sig, succ FROM t",
        "kernel_sweep": kernel + "SELECT sig FROM k",
        "kernel_threshold": q.chain(small, *balance, CONSISTENT.format(margin=2)) + "SELECT sig FROM k",
        "kernel_branch_and_bound": kernel + "SELECT sig FROM k",
        "kernel_generic_scan": q.chain(small, *balance, q.sequential_sql(small)) + "SELECT sig FROM t WHERE succ = sig",
        "find_basins_global": walked + _basins(),
        "find_basins_sequential": q.chain(small, *balance, q.sequential_sql(small), q.walk_sql(7)) + _basins(),
        "find_basins_range": walked + _basins("WHERE sig BETWEEN 7 AND 29"),
        "basins_merged": walked + _basins(),
        "basins_ranked": walked + f", z AS ({_basins()}) SELECT CASE WHEN fp IS NOT NULL THEN CAST(row_number() OVER (ORDER BY fp IS NULL, basin_size DESC, fp) AS INTEGER) END AS rank, fp, basin_size, round(basin_size / 36.0::DOUBLE, 6) AS fraction FROM z",
        "walk_destinations": walked + "SELECT sig, fp FROM w",
        "trace": stepped.replace("WITH ", "WITH RECURSIVE ", 1) + ", r(step, sig, seen, done) AS (SELECT 0, CAST(0 AS BIGINT), [CAST(0 AS BIGINT)], false UNION ALL SELECT step + 1, t.succ, list_append(seen, t.succ), list_contains(seen, t.succ) FROM r JOIN t ON t.sig = r.sig WHERE NOT done) SELECT CAST(step AS INTEGER) AS step, sig, CAST((SELECT len(seen) - list_position(seen, sig) FROM r WHERE done) AS INTEGER) AS cycle_length FROM r",
        "influence_edges": f"WITH {q.values_sql(islands)}, {edge} SELECT CAST(src_desc AS INTEGER) AS src_desc, CAST(tgt_desc AS INTEGER) AS tgt_desc FROM e",
        "influence_components": components,
        "fixed_descriptor": pinned + "SELECT CAST(sig % 3 + 3 + (sig // 3) * 9 AS BIGINT) AS sig FROM k",
        "product_of_islands": q.chain(islands, *balance, q.step_sql(), q.walk_sql(7)) + _basins(),
        "lever_counts": single + "SELECT CAST(sig AS BIGINT) AS sig, CAST(count(*) FILTER (fp = sig) AS INTEGER) AS returned, CAST(count(*) FILTER (fp <> sig) AS INTEGER) AS moved, CAST(count(*) FILTER (fp IS NULL) AS INTEGER) AS destabilized FROM g GROUP BY sig",
        "lever_edges": single + "SELECT CAST(sig AS BIGINT) AS sig, CAST(descriptor AS INTEGER) AS descriptor, CAST(variant AS INTEGER) AS variant, CAST(fp AS BIGINT) AS target FROM g WHERE fp <> sig",
        "sweep_of_a_cell": sweep,
        "edited_cell": "SELECT CAST(a AS INTEGER) AS src_desc, CAST(b AS INTEGER) AS src_var, CAST(c AS INTEGER) AS tgt_desc, CAST(d AS INTEGER) AS tgt_var, CAST(CASE WHEN (a, b, c, d) = (0, 0, 2, 3) THEN -2 ELSE x END AS BIGINT) AS impact FROM (VALUES " + ", ".join(map(str, impact_rows(small))) + ") t(a, b, c, d, x)",
        "model_round_trip": f"SELECT d AS descriptor, v AS variant, CAST(k AS INTEGER) AS descriptor_idx, CAST(j AS INTEGER) AS variant_idx, CAST(dim AS INTEGER) AS dim FROM (VALUES {variants}) t(d, v, k, j, dim)",
        "solutions_parsed": "SELECT CAST(i AS INTEGER) AS scenario_id, CAST((a - 1) + 3 * (b - 1) + 9 * (c - 1) AS BIGINT) AS sig FROM (VALUES (0, 2, 3, 2), (1, 3, 1, 3)) t(i, a, b, c)",
        "report_json": walked + f", z AS ({_basins()}) SELECT '{{\"fp\":' || fp || ',\"basin_size\":' || basin_size || '}}' AS value FROM z WHERE fp IS NOT NULL",
        "derived_impacts": derived + f", nm AS ({name_of}) SELECT {pick('.src_desc')} AS source, p.name AS source_variant, {pick('.tgt_desc')} AS target, r.name AS target_variant, CAST(m.impact AS BIGINT) AS impact FROM m JOIN nm p ON p.descr = m.src_desc AND p.var = m.src_var JOIN nm r ON r.descr = m.tgt_desc AND r.var = m.tgt_var WHERE m.src_desc <> m.tgt_desc",
        "derived_kernel": derived + ", " + CONSISTENT.format(margin=0) + " SELECT sig FROM k",
        "derived_basins": derived + ", " + q.step_sql() + ", " + q.walk_sql(10) + " " + _basins(),
        "observed_scenarios": derived + ", " + CONSISTENT.format(margin=0) + ", " + q.step_sql() + f", i AS (SELECT {sig_of} AS sig, c.n {placed}) SELECT CAST(i.sig AS BIGINT) AS sig, i.n AS n_items, i.sig IN (SELECT sig FROM k) AS consistent, t.succ FROM i JOIN t ON t.sig = i.sig",
        "observed_basins": derived + ", " + q.step_sql() + ", " + q.walk_sql(10) + f", i AS (SELECT {sig_of} AS sig, c.n {placed}) SELECT CAST(w.fp AS BIGINT) AS fp, CAST(sum(i.n) AS BIGINT) AS n_items FROM i JOIN w ON w.sig = i.sig GROUP BY w.fp",
        "ring_kernel": q.chain(ring, *balance, CONSISTENT.format(margin=0)) + "SELECT sig FROM k",
        "ring_basins": q.chain(ring, *balance, q.step_sql(), q.walk_sql(13)) + _basins(),
    }
