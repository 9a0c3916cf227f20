"""Many models, and one model under many values of a cell."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import INT64, Model, signature_order
from ..plans.dynamics import Space, TooMany, resolve, stretch
from ..plans.rules import GLOBAL
from ..session import ship
from ..sources.files import expand_paths, load_scw, parse_scw
from ..storage import materialise
from .basins import basins_frame
from .kernel import BUDGET, SMALL, branch_and_bound, consistent_frame

RECORDS = "path string, error string, scenario int, signature decimal(38,0), basin_size bigint, names map<string,string>"
#: Scenarios, and nodes of branch and bound, up to which a model is analysed whole in the task of its file.
ALONE_SCENARIOS, ALONE_NODES = 5_000_000, 5_000_000


class TooLarge(Exception):
    """More than one task should do."""


def kernel_alone(model: Model) -> list[tuple[int, ...]]:
    """The consistent scenarios, on one machine: small spaces are swept, others searched by branch and bound."""
    count = model.scenario_count()
    if count >= SMALL:
        found = branch_and_bound(model, 0, min(ALONE_NODES, count // BUDGET))
        if found is not None:
            return found
        if count > ALONE_SCENARIOS:
            raise TooLarge(f"{count} scenarios")
    space = Space(model)
    found = np.concatenate([space.consistent(k) for k in range(-(-count // space.low))])
    return [model.inv_signature(int(s)) for s in found]


def analyse_alone(model: Model, basins: bool) -> list[tuple[int, int | None]]:
    """(signature, basin size) of the consistent scenarios, on one machine; TooLarge where that is too much."""
    if not basins:
        return [(model.signature(u), None) for u in kernel_alone(model)]
    n = model.scenario_count()
    if n > ALONE_SCENARIOS:
        raise TooLarge(f"{n} scenarios")
    weight = dict.fromkeys((model.signature(u) for u in kernel_alone(model)), 0)
    for part in stretch(Space(model), 0, n - 1, GLOBAL):
        states, counts = np.unique(part, return_counts=True)
        try:
            ends = resolve(states, model, most=ALONE_SCENARIOS)
        except TooMany as e:
            raise TooLarge(str(e)) from e
        for s, c in zip(ends.tolist(), counts.tolist(), strict=True):
            if s >= 0:
                weight[s] += c
    return sorted(weight.items())


def run_models(spark: SparkSession, paths: str | Iterable[str] | DataFrame, analysis: str = "consistent", on_error: str = "record") -> DataFrame:
    """One row per file and consistent scenario; a file without any, or with an error, gives one row.

    paths: files that every executor can open, or a table of path and content, as
    spark.read.text(..., wholetext=True) gives them from any file system. Files run side by side, each in a task of its own. A model that is too large for
    one task is handed back, and then analysed by the whole cluster. on_error="raise"
    stops at the first bad file.
    """
    if analysis not in ("consistent", "basins") or on_error not in ("record", "raise"):
        raise ValueError("analysis: consistent or basins; on_error: record or raise")
    files = paths.select("path", "content") if isinstance(paths, DataFrame) else ship(spark).createDataFrame([(p, None) for p in expand_paths(paths)], "path string, content string")
    handed_back = "larger than a task"

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                model = _model(path, content)
                got = analyse_alone(model, analysis == "basins")
                rows += [(path, None, k, str(s), n, model.names(model.inv_signature(s))) for k, (s, n) in enumerate(got)] or [(path, None, None, None, None, None)]
            except TooLarge:
                rows.append((path, handed_back, None, None, None, None))
            except Exception as e:
                if on_error == "raise":
                    raise
                rows.append((path, f"{type(e).__name__}: {e}", None, None, None, None))
        out = pd.DataFrame(rows, columns=["path", "error", "scenario", "signature", "basin_size", "names"])
        return out.astype({"scenario": "Int32", "basin_size": "Int64"})

    ship(spark)
    alone = materialise(files.groupBy("path").applyInPandas(run, RECORDS.replace("signature decimal(38,0)", "signature string")))
    out = alone.filter(F.coalesce(F.col("error") != handed_back, F.lit(True))).withColumn("signature", F.col("signature").cast("decimal(38,0)"))
    for r in files.join(alone.filter(F.col("error") == handed_back).select("path"), "path", "left_semi").orderBy("path").collect():  # a few of the files
        out = out.unionByName(_large(spark, r["path"], r["content"], analysis, on_error))
    return out


def _model(path: str, content: str | None) -> Model:
    return load_scw(path, kernel=[]) if content is None else parse_scw(content)


def _large(spark: SparkSession, path: str, content: str | None, analysis: str, on_error: str) -> DataFrame:
    """The records of one model, analysed by the whole cluster."""
    try:
        model = _model(path, content)
        found = consistent_frame(spark, model)
        # number and names need all scenarios in order; kernels of single files are lists
        kernel = signature_order(r["digits"] for r in found.select("digits").collect())
        sizes = {r["fp"]: r["basin_size"] for r in basins_frame(spark, model).collect()} if analysis == "basins" else {}
    except Exception as e:
        if on_error == "raise":
            raise
        rows = [(path, f"{type(e).__name__}: {e}", None, None, None, None)]
    else:
        rows = [(path, None, k, str(model.signature(u)), sizes.get(model.signature(u)), model.names(u)) for k, u in enumerate(kernel)] or [(path, None, None, None, None, None)]
    table = spark.createDataFrame(rows, RECORDS.replace("signature decimal(38,0)", "signature string"))
    return table.withColumn("signature", F.col("signature").cast("decimal(38,0)"))


def sweep_impact(spark: SparkSession, model: Model, source, target, values: Sequence[int]) -> DataFrame:
    """value, signature of every consistent scenario for each value of one cell; the model itself is not touched.

    Values run side by side, each in a task of its own; where the model is too large for that, one after the other over the whole cluster.
    """
    cell = model.cell(source, target)
    wide = model.scenario_count() - 1 > INT64
    kind = "decimal(38,0)" if wide else "bigint"

    def changed(value: int) -> Model:
        m = model.matrix.copy()
        m[cell] = value
        return Model(model.descriptors, model.variants, m)

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for value in batch["value"]:
            try:
                rows += [(value, str(s)) for s, _ in analyse_alone(changed(value), False)]
            except TooLarge:
                rows.append((value, None))
        return pd.DataFrame(rows, columns=["value", "signature"]).astype({"value": "int64", "signature": "string"})

    frame = ship(spark).createDataFrame([(int(v),) for v in dict.fromkeys(values)], "value bigint")
    alone = materialise(frame.groupBy("value").applyInPandas(run, "value bigint, signature string"))
    out = alone.filter("signature is not null").withColumn("signature", F.col("signature").cast(kind))
    for r in alone.filter("signature is null").orderBy("value").collect():
        found = consistent_frame(spark, changed(r["value"]))
        out = out.unionByName(found.select(F.lit(r["value"]).cast("bigint").alias("value"), F.col("sig").cast(kind).alias("signature")))
    return out
