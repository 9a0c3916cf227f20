import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scenaria.functions import columns as C
from scenaria.functions import random as R
from scenaria.model import Model
from scenaria.operators import basins, batch, estimate, kernel, structure, transitions
from scenaria.plans.dynamics import Space, TooMany, resolve, step_signatures
from scenaria.plans.rules import GLOBAL, SEQUENTIAL, Threshold
from scenaria.queries import ISLANDS, SMALL, chain_model
from scenaria.sources import frames

from . import naive


class Custom:
    """The sequential rule without any promise."""

    def step(self, digits, model):
        return SEQUENTIAL.step(digits, model)


def forcing_chain(n):
    """Binary descriptors, each forced by the one before it: all zero or all one."""
    m = np.zeros((2 * n, 2 * n), int)
    for k in range(n):
        to = (k + 1) % n
        for v in range(2):
            m[2 * k + v, 2 * to + v] = 1
    return Model.build((2,) * n, m)


# -- without Spark ---------------------------------------------------------------


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000))
def test_space_and_bounds_against_naive(seed):
    model = naive.random_model(seed, own=seed % 5 == 0, low=-1 if seed % 3 == 0 else -3, high=1 if seed % 3 == 0 else 3)
    for margin in (0, 2):
        expected = naive.kernel(model, lambda m, u, k=margin: naive.step(m, u, k))
        assert kernel.branch_and_bound(model, margin) == expected
        space = Space(model)
        found = [int(s) for k in range(-(-model.scenario_count() // space.low)) for s in space.consistent(k, margin)]
        assert [model.inv_signature(s) for s in found] == expected
    every = np.arange(model.scenario_count())
    space = Space(model)
    assert np.array_equal(np.concatenate([space.successors(k) for k in range(model.scenario_count() // space.low)]), step_signatures(every, model))
    ends = resolve(every, model)
    for s in every[:: max(1, len(every) // 40)]:
        still, at = naive.end(model, model.inv_signature(int(s)))
        assert ends[s] == (model.signature(at) if still else -1)


def test_special_models():
    assert len(kernel.branch_and_bound(Model.build((2, 3, 2), np.zeros((7, 7))))) == 12
    wide = naive.random_model(3, -5000, 5000)
    assert Space(wide).type is np.int64 and kernel.branch_and_bound(wide) == naive.kernel(wide)
    for sizes in ((1, 3, 2), (2, 1, 1, 3), (1, 1, 4), (3, 1, 2, 1, 2)):
        n = sum(sizes)
        model = Model.build(sizes, np.random.default_rng(n).integers(-3, 4, (n, n)))
        assert kernel.branch_and_bound(model) == naive.kernel(model)
    for n in (7, 63, 70):
        assert kernel.branch_and_bound(forcing_chain(n)) == [(0,) * n, (1,) * n]
    assert kernel.branch_and_bound(chain_model(8), budget=10) is None


def test_generator():
    pins = {0: [0x53175D61490B23DF, 0x61DA6F3DC380D507, 0x5C0FDF91EC9A7BFC, 0x02EEBF8C3BBE5E1A], 42: [0xD0764D4F4476689F, 0x519E4174576F3791, 0xFBE07CFB0C24ED8C, 0xB37D9F600CD835B8]}
    for seed, expected in pins.items():
        stream = R.Stream(seed)
        assert [stream.next() for _ in range(4)] == expected
    assert R.block_stream(R.SEED, 3).next() == 0x5D7BDCB55D4BCDD7
    digits, stream = R.block_digits(5, 1, 50, (2, 3, 7)), R.block_stream(5, 1)
    assert digits.tolist() == [[stream.below(n) for n in (2, 3, 7)] for _ in range(50)]
    assert abs(R.z_for(0.95) - 1.959964) < 1e-5 and abs(R.normal_quantile(0.001) + 3.090232) < 1e-5
    low, high = R.wilson(0, 100, R.z_for(0.95))
    assert low == 0 and 0.03 < high < 0.04
    for bad in (lambda: R.z_for(1.0), lambda: R.wilson(5, 4, 1.0)):
        with pytest.raises(ValueError):
            bad()


# -- with Spark --------------------------------------------------------------------


def test_find_consistent(spark):
    assert [SMALL.signature(u) for u in kernel.find_consistent(spark, SMALL)] == [13, 16, 20, 21]
    assert kernel.find_consistent(spark, SMALL, algorithm="bnb") == kernel.find_consistent(spark, SMALL, algorithm="sweep")
    assert kernel.find_consistent(spark, SMALL, Custom()) == naive.kernel(SMALL, naive.sequential)
    assert kernel.find_consistent(spark, SMALL, Threshold(5)) == naive.kernel(SMALL, lambda m, u: naive.step(m, u, 5))
    for bad in (lambda: kernel.find_consistent(spark, SMALL, Custom(), algorithm="bnb"), lambda: kernel.find_consistent(spark, SMALL, algorithm="best")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(OverflowError):
        kernel.find_consistent(spark, forcing_chain(70), node_budget=5)
    with pytest.raises(OverflowError):
        kernel.find_consistent(spark, forcing_chain(70), Custom())


def test_spread_search(spark, monkeypatch):
    monkeypatch.setattr(kernel, "ALONE", 50)
    monkeypatch.setattr(kernel, "SHARE", 40)
    model = chain_model(8)
    expected = [model.inv_signature(int(r[0])) for r in kernel.sweep(spark, model).orderBy("sig").collect()]
    assert kernel.find_consistent(spark, model, algorithm="bnb") == expected
    assert kernel.find_consistent(spark, Model.build((2, 3, 2, 2), np.zeros((9, 9))), algorithm="bnb") == list(naive.scenarios(Model.build((2, 3, 2, 2), np.zeros((9, 9)))))
    with pytest.raises(OverflowError):
        kernel.find_consistent(spark, forcing_chain(70), node_budget=60)


def test_the_budget_is_shared(spark, monkeypatch):
    """A search that costs n nodes is done with a budget of n and a little, wherever its deep subtrees lie."""
    monkeypatch.setattr(kernel, "ALONE", 100)
    for seed in range(3):
        draw = np.random.default_rng(seed)
        m = draw.integers(-3, 4, (45, 45)) * (draw.random((45, 45)) < 0.25)
        model = Model.build((3,) * 15, m)
        bounds, digits, scores, _ = kernel._begin(model, 0)
        found, nodes, left = bounds.search(digits, scores)
        assert nodes > 500 and not left
        got = kernel.branch_and_bound_frame(spark, model, 0, nodes + 50)
        assert got is not None and got.count() == sum(map(len, found))
        assert kernel.branch_and_bound_frame(spark, model, 0, nodes // 2) is None


def test_wide_kernel_frame(spark):
    rows = kernel.consistent_frame(spark, forcing_chain(70)).collect()
    assert sorted((int(r["sig"]), set(r["digits"])) for r in rows) == [(0, {0}), (2**70 - 1, {1})]


def test_basins(spark):
    found = basins.find_basins(spark, SMALL)
    assert found.sizes == (1, 4, 12, 2) and found.cycle_count == 17 and found.starts == 36
    assert basins.find_basins(spark, SMALL, SEQUENTIAL).sizes == (3, 12, 17, 4)
    assert [r["signature"] for r in found.records()] == [20, 16, 21, 13]
    for rule, f in ((GLOBAL, naive.step), (Custom(), naive.sequential)):
        model = naive.random_model(17, most=200)
        sizes, cycles = naive.basins(model, f)
        got = basins.find_basins(spark, model, rule)
        assert dict(zip(got.fixed_points, got.sizes)) == {u: n for u, n in sizes.items()} and got.cycle_count == cycles
    for bad in ((5, 3), (0, 36), (-1, 3)):
        with pytest.raises(ValueError):
            basins.find_basins(spark, SMALL, GLOBAL, *bad)
    with pytest.raises(OverflowError, match="estimate_basins"):
        basins.find_basins(spark, forcing_chain(63))


def test_basins_by_rounds_and_pointers(spark, monkeypatch):
    """The distributed rounds and, when they do not shrink enough, the doubled pointers give what the short way gives."""
    model = chain_model(7)
    short = basins.find_basins(spark, model)
    monkeypatch.setattr(basins, "FEW", 3)
    monkeypatch.setattr(basins, "ROUNDS", 3)
    assert basins.basins_frame(spark, model).orderBy("fp").collect() == short.frame(spark).orderBy("fp").collect()


def test_basins_where_a_task_reaches_too_much(spark, monkeypatch):
    """States that a task cannot follow to the end go on in rounds; without enough of them, by doubled pointers."""
    model = chain_model(7)
    short = basins.basins_frame(spark, model).orderBy("fp").collect()
    with pytest.raises(TooMany):
        resolve(np.arange(0, 2187, 7), model, most=400)
    for rounds in (2, 500):
        monkeypatch.setattr(basins, "REACHED", 10 if rounds == 2 else 40)
        monkeypatch.setattr(basins, "ROUNDS", rounds)
        assert basins.basins_frame(spark, model).orderBy("fp").collect() == short


def test_results_do_not_depend_on_partitions(spark):
    """The same rows whatever the number of shuffle partitions, and of samples' tasks."""
    model = chain_model(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    try:
        for n in ("1", "3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found = basins.basins_frame(spark, model).orderBy("fp").collect()
            share = estimate.estimate_basins(spark, SMALL, samples=70_000)
            seen.add((tuple(map(tuple, found)), share.hits, share.cycle_hits, tuple(kernel.find_consistent(spark, model))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_partials(spark, tmp_path):
    from scenaria.sources.sinks import partial_tsv, write_text

    whole = {r["fp"]: r["basin_size"] for r in basins.find_basins(spark, SMALL).frame(spark).collect()}
    for k, (a, b) in enumerate(((0, 11), (12, 30), (31, 35))):
        write_text(str(tmp_path / f"{k}.tsv"), partial_tsv("small", a, b, basins.find_basins(spark, SMALL, GLOBAL, a, b)))
    shares = basins.read_partials(spark, str(tmp_path))
    assert {r["fp"]: r["basin_size"] for r in basins.merge_partials(shares, 36).collect()} == whole
    for bad, why in ((shares.filter("first <> 12"), "gap"), (shares.filter("first <> 31"), "end"), (shares.union(shares.filter("first = 12").withColumn("first", F.lit(20).cast("bigint"))), "overlap")):
        with pytest.raises(ValueError, match=why):
            basins.merge_partials(bad, 36)


def test_estimates(spark):
    est = estimate.estimate_basins(spark, SMALL, samples=50_000)
    assert est.hits == (1369, 5483, 16720, 2788) and est.cycle_hits == 23640
    few = estimate.estimate_basins(spark, SMALL, samples=20)
    assert len(few.hits) == 4 and all(h > 0 for h in few.ci_high)
    again = estimate.estimate_basins(spark, SMALL, samples=70_000, kernel=[])
    assert sum(again.hits) + again.cycle_hits == 70_000
    row = est.frame(spark).filter("hits = 1369").first()
    assert math.isclose(row["ci_low"], est.ci_low[0]) and math.isclose(row["size_estimate"], est.size_estimates[0])
    frame = {r["digits"] and tuple(r["digits"]): r["hits"] for r in estimate.estimate_frame(spark, SMALL, samples=20).collect()}
    assert frame == dict(zip(few.fixed_points, few.hits)) | {None: few.cycle_hits}
    for bad in ({"samples": 0}, {"confidence": 1.0}, {"kernel": [[0, 0]]}, {"kernel": [[0, 0, 0]]}):
        with pytest.raises(ValueError):
            estimate.estimate_basins(spark, SMALL, **bad)
    for u in naive.scenarios(SMALL):
        ends, still, _ = estimate.walk_ends(np.array([u]), SMALL, GLOBAL)
        good, at = naive.end(SMALL, u)
        assert still[0] == good and (not good or tuple(ends[0]) == at)


def brent_steps(model, u, f=naive.step):
    """Steps of the method, one by one."""
    anchor, now, steps = u, f(model, u), 1
    power = stretch = 1
    while now != anchor:
        if power == stretch:
            anchor, power, stretch = now, power * 2, 0
        now, steps, stretch = f(model, now), steps + 1, stretch + 1
    return steps + stretch - 1


def test_walks_count_steps():
    for seed in range(12):
        model = naive.random_model(seed, most=300)
        every = np.array(list(naive.scenarios(model)))
        ends, still, steps = estimate.walk_ends(every, model, GLOBAL, names=True)
        for u, e, s, n in zip(every.tolist(), ends, still, steps):
            assert (bool(s), tuple(map(int, e))) == naive.end(model, tuple(u)) and n == brent_steps(model, tuple(u)) >= 1


def test_lever_frames(spark, monkeypatch):
    for model, radius in ((SMALL, 2), (naive.random_model(5, most=200), 2), (ISLANDS, 1)):
        g = transitions.transition_graph(spark, model, radius=radius)
        nodes = kernel.consistent_frame(spark, model)
        counts, edges = transitions.lever_frames(spark, model, GLOBAL, nodes, radius)
        of = {tuple(r["digits"]): (r["returned"], r["moved"], r["destabilized"]) for r in counts.collect()}
        assert of == {u: (a, b, c) for u, a, b, c, r in zip(g.nodes, g.returned, g.moved, g.destabilized, g.robustness) if not math.isnan(r)}
        got = sorted((tuple(r["source"]), tuple(r["target"]), r["still"], tuple(map(tuple, r["changes"])), r["steps"]) for r in edges.collect())
        assert got == sorted((g.nodes[e.source], g.nodes[e.target], g.kinds[e.target] == "attractor", e.changes, e.steps) for e in g.edges)
        assert all(e.steps >= 1 for e in g.edges)
    with pytest.raises(ValueError):
        transitions.lever_frames(spark, SMALL, GLOBAL, nodes, 3)
    small = transitions.transition_graph(spark, SMALL, radius=2)
    monkeypatch.setattr(transitions, "HERE", 2)
    assert transitions.transition_graph(spark, SMALL, radius=2) == small


def test_structure(spark):
    s = structure.influence_structure(spark, ISLANDS)
    assert s.components == ((0, 1), (2, 3), (4,)) and s.dials == () and s.forced == ((4, (1,)),)
    dial = structure.influence_structure(spark, Model.build((2, 2), np.zeros((4, 4))))
    assert dial.dials == (0, 1) and dial.edges == ()
    c = structure.product_basins(spark, ISLANDS)
    sizes, cycles = naive.basins(ISLANDS)
    assert dict(zip(c.fixed_points, c.sizes)) == {u: n for u, n in sizes.items()} and c.cycle_count == cycles
    with pytest.raises(ValueError):
        structure.split(ISLANDS, ((0, 1), (2, 3)))
    with pytest.raises(ValueError):
        structure.product_basins(spark, ISLANDS, Custom())


def test_slices_of_a_dial_add_up(spark):
    """A descriptor that nothing moves cuts the space into independent slices."""
    model = naive.random_model(8)
    m = model.matrix.copy()
    m[:, : model.sizes[0]] = 0
    model = Model(model.descriptors, model.variants, m)
    parts = [basins.find_basins(spark, model.fix(0, v)) for v in range(model.sizes[0])]
    assert basins.find_basins(spark, model).cycle_count == sum(p.cycle_count for p in parts)


def test_transitions(spark):
    g = transitions.transition_graph(spark, SMALL)
    assert list(zip(g.signatures, g.kinds, g.returned, g.moved, g.destabilized)) == [(12, "cycle", 0, 0, 0), (13, "attractor", 0, 2, 5), (16, "attractor", 1, 1, 5), (20, "attractor", 5, 0, 2), (21, "attractor", 1, 3, 3)]
    assert math.isnan(g.robustness[0]) and g.robustness[3] == 5 / 7 and len(g.edges) == 21
    world = transitions.transition_graph(spark, SMALL, world=(0, 0, 0), radius=2)
    assert world.kinds[world.world] == "world"
    for e in world.edges:
        u = transitions._changed(world.nodes[e.source], e.changes)
        still, at = naive.end(SMALL, u)
        assert at == world.nodes[e.target] and still == (world.kinds[e.target] == "attractor")
    assert world == transitions.transition_graph(spark, SMALL, world=["FT", "Rlx", "Decl"], radius=2)
    own = transitions.transition_graph(spark, SMALL, world=SMALL.inv_signature(20))
    assert own.kinds[own.world] == "attractor"
    with pytest.raises(ValueError):
        transitions.transition_graph(spark, SMALL, kernel=[])


def test_batch(spark, tmp_path):
    from scenaria.sources import to_scw

    (tmp_path / "good.scw").write_text(to_scw(SMALL))
    (tmp_path / "bad.scw").write_text("nothing")
    rows = batch.run_models(spark, str(tmp_path), "basins").collect()
    assert sorted((r["signature"], r["basin_size"]) for r in rows if not r["error"]) == [(13, 1), (16, 4), (20, 12), (21, 2)]
    assert [r["error"] for r in rows if r["error"]] == ["ValueError: no variants: this is not a model file"]
    swept = batch.sweep_impact(spark, SMALL, (0, 0), (2, 3), [-3, 3]).collect()
    assert sorted(r["signature"] for r in swept if r["value"] == 3) == [13, 16, 20, 21]
    with pytest.raises(Exception, match="not a model file"):
        batch.run_models(spark, str(tmp_path), on_error="raise").collect()


def test_batch_of_large_models(spark, tmp_path, monkeypatch):
    """Wide models are searched in their task; models that are too large for a task go to the cluster."""
    from scenaria.sources import to_scw

    (tmp_path / "wide.scw").write_text(to_scw(forcing_chain(70)))
    (tmp_path / "ring.scw").write_text(to_scw(chain_model(7)))
    rows = batch.run_models(spark, str(tmp_path)).collect()
    assert sorted(int(r["signature"]) for r in rows if "wide" in r["path"]) == [0, 2**70 - 1] and not any(r["error"] for r in rows)
    (tmp_path / "wide.scw").unlink()
    alone = sorted(map(tuple, batch.run_models(spark, str(tmp_path), "basins").drop("names").collect()))
    swept = batch.sweep_impact(spark, forcing_chain(70), (0, 0), (1, 0), [0, 1])
    assert sorted((r["value"], int(r["signature"])) for r in swept.collect() if r["value"] == 1) == [(1, 0), (1, 2**70 - 1)]
    small = sorted(map(tuple, batch.sweep_impact(spark, chain_model(7), (0, 0), (1, 0), [0, 1]).collect()))
    monkeypatch.setattr(batch, "analyse_alone", _too_large)
    assert sorted(map(tuple, batch.run_models(spark, str(tmp_path), "basins").drop("names").collect())) == alone
    assert sorted(map(tuple, batch.sweep_impact(spark, chain_model(7), (0, 0), (1, 0), [0, 1]).collect())) == small


def _too_large(model, basins):
    raise batch.TooLarge("for this test")


def test_frames_and_source(spark, tmp_path):
    from scenaria.sources import to_scw

    again = frames.model_from_frames(frames.variants_frame(spark, SMALL), frames.impacts_frame(spark, SMALL), frames.descriptors_frame(spark, SMALL))
    assert again.same_as(SMALL)
    (tmp_path / "a.scw").write_text(to_scw(SMALL))
    frames.register(spark)
    table = spark.read.format("scw").load(str(tmp_path))
    assert table.count() == 100 and table.filter("source = 'WTRD' and source_variant = 'FT' and target_variant = 'RpdGr'").first()["impact"] == 3
    for k in range(3):
        (tmp_path / f"{k}.sl").write_text(f'$ x\n" 2 3 {k + 1}",4\n\n" 1 1 1",5\n')
    rows = frames.read_solutions(spark, str(tmp_path / "*.sl")).collect()
    assert sorted((r["path"][-4:], r["scenario_id"], r["digits"]) for r in rows) == sorted((f"{k}.sl", n, d) for k in range(3) for n, d in ((0, [1, 2, k]), (1, [0, 0, 0])))


def test_columns(spark):
    of = [F.col(f"d{k}") for k in range(3)]
    rows = C.space(spark, SMALL).select("sig", C.encode(SMALL, C.step(SMALL, of)).alias("to"), C.digits("sig", SMALL).alias("digits")).collect()
    for r in rows:
        u = SMALL.inv_signature(r["sig"])
        assert tuple(r["digits"]) == u and r["to"] == SMALL.signature(naive.step(SMALL, u))
    n = spark.createDataFrame([(2**53,), (2**53 + 1,)], "n bigint").select(C.json_count(F.col("n"))).collect()
    assert [r[0] for r in n] == [str(2**53), f'"{2**53 + 1}"']
