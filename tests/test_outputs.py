import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from scenaria.operators import basins, estimate, structure, transitions
from scenaria.queries import ISLANDS, SMALL
from scenaria.sources import sinks
from scenaria.streaming import merged_stream


def rows_of(text):
    return list(csv.reader(x for x in io.StringIO(text) if not x.startswith("#")))


def test_basin_outputs(spark):
    b = basins.find_basins(spark, SMALL)
    table = rows_of(sinks.basin_csv(b))
    assert table[0] == ["rank", "signature", "WTRD", "WSEC", "WECO", "basin_size", "basin_fraction_pct"]
    assert table[1][:2] == ["1", "20"] and table[1][-2:] == ["12", "33.3333"]
    assert "(33.33%)" in sinks.basin_text(b) and sinks.basin_tsv(b).splitlines()[1].startswith("1\t20\t12\t33.3333\t")
    ranked = sinks.ranked_basins(b.frame(spark)).orderBy("rank").collect()
    assert [(r["rank"], r["fp"]) for r in ranked] == [(None, None), (1, 20), (2, 16), (3, 21), (4, 13)]


def test_quoting():
    assert sinks.csv_row(['a,b', 'c"d', "e\nf", 5]) == '"a,b","c""d","e\nf",5\n'
    assert sinks.significant(0.0012345, 3) == 0.00123 and sinks.significant(0.0, 3) == 0


def test_estimate_outputs(spark):
    e = estimate.estimate_basins(spark, SMALL, samples=2_000)
    assert len(rows_of(sinks.estimate_csv(e))) == 5 and "Estimated shares of an exact kernel" in sinks.estimate_text(e)


def test_graph_outputs(spark):
    odd = type(SMALL)(('W"TRD', "WS\\EC", "WECO"), SMALL.variants, SMALL.matrix)
    g = transitions.transition_graph(spark, odd, world=(0, 0, 0), radius=2)
    dot = sinks.to_dot(g)
    assert dot.count(" -> ") == len(g.edges) and 'W\\"TRD' in dot and "WS\\\\EC" in dot and "(default)" in dot
    assert len(rows_of(sinks.transition_csv(g))) == len(g.edges) + 1
    assert "robustness" in sinks.transition_text(g)
    assert g.node_frame(spark).count() == len(g.nodes) and g.edge_frame(spark).count() == len(g.edges)


def test_reports(spark):
    for mode in ("consistent", "basins", "estimate", "structure", "transitions"):
        said = json.loads(sinks.to_json(sinks.analyse(spark, SMALL, mode, samples=1_000)))
        assert said["mode"] == mode and said["total"] == 36
    assert "island 1" in sinks.structure_text(structure.influence_structure(spark, ISLANDS))
    assert "into cycles" in sinks.composed_text(structure.product_basins(spark, ISLANDS), ISLANDS)
    assert sinks.trace_text(SMALL, (0, 0, 0)).endswith("cycle of 2")
    assert "[selected]" in sinks.balance_text(SMALL, (0, 0, 0)) and "would win" in sinks.balance_text(SMALL, (0, 0, 0))
    assert sinks.json_ready({"n": 2**60, "x": float("nan"), "t": (1, True)}) == {"n": str(2**60), "x": None, "t": [1, True]}
    assert sinks.list_kernel(spark, SMALL, most=2) == (None, 4)


def test_stream_of_shares(spark, tmp_path):
    folder = str(tmp_path / "shares")

    def merged():
        query = merged_stream(spark, folder).writeStream.format("memory").queryName("merged").outputMode("complete").trigger(availableNow=True).start()
        query.awaitTermination()
        return {r["fp"]: r["basin_size"] for r in spark.table("merged").collect()}

    for a, b in ((0, 20), (0, 20), (21, 35)):  # one share is written twice
        basins.partial_basins(spark, SMALL, "small", a, b).write.mode("append").parquet(folder)
    assert merged() == {r["fp"]: r["basin_size"] for r in basins.basins_frame(spark, SMALL).collect()}
    basins.partial_basins(spark, SMALL, "small", 0, 20).withColumn("count", F.col("count") + 1).write.mode("append").parquet(folder)
    with pytest.raises(Exception, match="written again with other counts"):
        merged()


def test_csv_sink(spark, tmp_path):
    b = basins.find_basins(spark, SMALL).frame(spark)
    sinks.write_csv(b, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 5
    assert [json.loads(r["value"])["basin_size"] for r in sinks.json_rows(b.filter("fp = 20")).collect()] == [12]


def test_table_function_and_command_line(spark, tmp_path):
    from scenaria.__main__ import main
    from scenaria.functions.table import register_trace
    from scenaria.sources import to_scw

    register_trace(spark, SMALL)
    rows = spark.sql("SELECT * FROM succession_trace(0) ORDER BY step").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 2), (1, 22, 2), (2, 12, 2), (3, 22, 2)]
    (tmp_path / "a.scw").write_text(to_scw(SMALL))
    assert json.loads(main([str(tmp_path / "a.scw"), "--mode", "basins"]))["cycles"] == 17
    world = json.loads(main([str(tmp_path / "a.scw"), "--mode", "transitions", "--world", '{"WTRD": "FT", "WSEC": 0, "WECO": "Decl"}']))
    assert sum(n["kind"] == "world" for n in world["nodes"]) == 1
    main(["--content", to_scw(SMALL), "--mode", "basins", "--csv", str(tmp_path / "b.csv")])
    assert rows_of((tmp_path / "b.csv").read_text())[1][:2] == ["1", "20"]
    for mode in ("estimate", "transitions"):
        main([str(tmp_path / "a.scw"), "--mode", mode, "--samples", "1000", "--csv", str(tmp_path / "c.csv")])
        assert len(rows_of((tmp_path / "c.csv").read_text())) > 4
    for bad in ([], [str(tmp_path / "a.scw"), "--content", "x"], [str(tmp_path / "a.scw"), "--mode", "structure", "--csv", "x"]):
        with pytest.raises(ValueError):
            main(bad)


def test_json_input():
    from scenaria.sources import files, to_scw

    assert files.load_model(file_path=None, scw_content=to_scw(SMALL)).same_as(SMALL)
    said = files.model_to_json(SMALL.with_kernel([(1, 1, 1)]))
    again = files.model_from_json(said)
    assert again.same_as(SMALL) and again.kernel == ((1, 1, 1),)
    assert files.scenario_from_json(SMALL, '["FT", 2, "Decl"]') == (0, 2, 0)
    assert files.scenario_from_json(SMALL, '{"WSEC": 2, "WTRD": "FT", "WECO": "Decl"}') == (0, 2, 0)
    assert files.signature_from(str(2**60)) == 2**60 and files.signature_from(13) == 13
    assert files.scenario_from_json(SMALL, "13") == files.scenario_from_json(SMALL, '"13"') == SMALL.inv_signature(13)
    for bad in (lambda: files.signature_from("x1"), lambda: files.signature_from(-1), lambda: files.signature_from(True), lambda: files.scenario_from_json(SMALL, "[0]"), lambda: files.scenario_from_json(SMALL, "{"), lambda: files.model_from_json("[]"), lambda: files.load_model(None, None)):
        with pytest.raises(ValueError):
            bad()


def test_forecast(spark):
    from scenaria.operators.forecast import forecast_basins

    f = forecast_basins(spark, SMALL)
    assert f.scenarios == 36 and f.starts_per_second > 0 and f.seconds > 0
