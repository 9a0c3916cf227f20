import numpy as np
import pytest

from scenaria.model import Model, signature_order
from scenaria.plans.rules import SEQUENTIAL, Threshold, succession_step, succession_trace
from scenaria.queries import SMALL
from scenaria.sources import expand_paths, load_from_text, load_scw, load_solutions, parse_scw, parse_solutions, to_scw

from . import naive


def test_signatures():
    assert SMALL.scenario_count() == 36 and SMALL.max_signature() == 35
    for s in range(36):
        assert SMALL.signature(SMALL.inv_signature(s)) == s
    assert SMALL.inv_signature(1) == (1, 0, 0)
    assert signature_order([(0, 0, 1), (2, 2, 0)]) == [(2, 2, 0), (0, 0, 1)]
    with pytest.raises(ValueError):
        SMALL.signature((0, 0))
    with pytest.raises(ValueError):
        SMALL.inv_signature(36)


def test_wide_spaces():
    big = Model.build((3,) * 41, np.zeros((123, 123)))
    assert big.scenario_count() == 3**41
    with pytest.raises(OverflowError, match="branch and bound"):
        big.max_signature()
    assert Model.build((2,) * 63, np.zeros((126, 126))).max_signature() == 2**63 - 1
    with pytest.raises(OverflowError):
        Model.build((10,) * 39, np.zeros((390, 390))).scenario_count()


def test_balance_and_trace():
    assert SMALL.impact_balance((0, 0, 0)).tolist() == [-2, 2, 0, -2, 3, -1, -5, -3, 4, 4]
    states, length = succession_trace(SMALL, (0, 0, 0))
    assert states == [(0, 0, 0), (1, 1, 2), (0, 1, 1), (1, 1, 2)] and length == 2
    assert succession_trace(SMALL, SMALL.inv_signature(13)) == ([SMALL.inv_signature(13)] * 2, 1)
    assert succession_trace(SMALL, (0, 0, 0), max_steps=1)[1] == 0


def test_rules_against_naive():
    for seed in range(12):
        model = naive.random_model(seed, own=seed % 5 == 0)
        for u in naive.scenarios(model):
            assert succession_step(model, u) == naive.step(model, u)
            assert succession_step(model, u, SEQUENTIAL) == naive.sequential(model, u)
            assert succession_step(model, u, Threshold(2)) == naive.step(model, u, 2)


def test_names_and_edits():
    assert SMALL.resolve({"WECO": "ModGr", "WTRD": 0, "WSEC": "Mod"}) == (0, 1, 2)
    assert SMALL.resolve(["FT", 1, "ModGr"]) == (0, 1, 2)
    assert SMALL.names((0, 1, 2)) == {"WTRD": "FT", "WSEC": "Mod", "WECO": "ModGr"}
    for bad in ({"WTRD": "FT"}, ["FT", "Mod"], {"WTRD": 0, 0: 1, "WSEC": 0, "WECO": 0}):
        with pytest.raises(ValueError):
            SMALL.resolve(bad)
    with pytest.raises(KeyError, match="Available"):
        SMALL.variant_index("WTRD", "nothing")
    with pytest.raises(IndexError):
        SMALL.descriptor_index(5)
    cell = ("WTRD", "FT"), ("WECO", 3)
    edited = SMALL.with_impact(*cell, 9)
    assert edited.get_impact(*cell) == 9 and SMALL.get_impact(*cell) == 3
    pinned = SMALL.fix("WSEC", "Mod")
    assert pinned.sizes == (3, 1, 4) and pinned.kernel is None
    assert SMALL.permuted((2, 0, 1)).permuted((1, 2, 0)).same_as(SMALL)
    with pytest.raises(ValueError):
        SMALL.matrix[0, 0] = 1


def test_named_balance():
    u = SMALL.inv_signature(20)
    assert SMALL.is_consistent(u) and not SMALL.is_consistent((0, 0, 0))
    said = SMALL.named_balance((0, 0, 0))
    assert said["WTRD"]["selected"] == "FT" and said["WTRD"]["scores"] == {"FT": -2, "Ntl": 2, "Mix": 0}


def test_files(tmp_path):
    text = to_scw(SMALL)
    assert parse_scw(text).same_as(SMALL) and load_from_text(text).same_as(SMALL)
    spaced = text.replace("\n", "\n\n").replace(",", " , ")
    assert parse_scw(spaced).same_as(SMALL)
    (tmp_path / "a.scw").write_text(text)
    (tmp_path / "a.sl").write_text('$ ScenarioWizard 3.0\nSolution set\n 2\n\n" 2 3 2",4,0,""\n" 3 1 3",12,""\n')
    assert load_solutions(tmp_path / "a.sl") == [(1, 2, 1), (2, 0, 2)] == parse_solutions((tmp_path / "a.sl").read_text())
    assert load_scw(tmp_path / "a.scw", sl_file=tmp_path / "a.sl").kernel == ((1, 2, 1), (2, 0, 2))
    assert load_scw(tmp_path / "a.scw", sl_file=tmp_path / "a.sl", kernel=[]).kernel == ()
    assert expand_paths(str(tmp_path)) == [str(tmp_path / "a.scw")] == expand_paths(str(tmp_path / "*.scw"))
    lines = text.splitlines()
    for bad in ("no model", "\n".join(lines[:-3]), text.replace("0,0,0,1", "0,0,1", 1), text.replace("&WSEC", "&WTRD")):
        with pytest.raises(ValueError):
            parse_scw(bad)
    with pytest.raises(FileNotFoundError):
        load_scw(tmp_path / "none.scw")
