"""Models as DataFrames, and back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import Model

DESCRIPTORS = "descriptor_idx int, descriptor string, n_variants int, offset int"
VARIANTS = "descriptor_idx int, variant_idx int, variant string, dim int"
IMPACTS = "src_desc int, src_var int, tgt_desc int, tgt_var int, impact int"


def descriptors_frame(spark: SparkSession, model: Model) -> DataFrame:
    return spark.createDataFrame([(k, d, n, o) for k, (d, n, o) in enumerate(zip(model.descriptors, model.sizes, model.offsets, strict=True))], DESCRIPTORS)


def variants_frame(spark: SparkSession, model: Model) -> DataFrame:
    return spark.createDataFrame([(k, j, v, model.offsets[k] + j) for k, vs in enumerate(model.variants) for j, v in enumerate(vs)], VARIANTS)


def impact_rows(model: Model) -> list[tuple[int, int, int, int, int]]:
    at = [(k, j) for k, n in enumerate(model.sizes) for j in range(n)]
    return [(*a, *b, int(model.matrix[i, j])) for i, a in enumerate(at) for j, b in enumerate(at)]


def impacts_frame(spark: SparkSession, model: Model) -> DataFrame:
    """One row per cell: as many as the square of the variants, at most some ten thousands."""
    return spark.createDataFrame(impact_rows(model), IMPACTS)


def model_from_frames(variants: DataFrame, impacts: DataFrame, descriptors: DataFrame) -> Model:
    """From the three frames, which are of the size of one matrix; cells that are missing count 0."""
    names = [r["descriptor"] for r in descriptors.orderBy("descriptor_idx").collect()]
    by: dict[int, list[str]] = {}
    for r in variants.orderBy("descriptor_idx", "variant_idx").collect():
        by.setdefault(r["descriptor_idx"], []).append(r["variant"])
    listed = tuple(tuple(by[k]) for k in range(len(names)))
    model = Model(tuple(names), listed, np.zeros((sum(map(len, listed)),) * 2))
    m = model.matrix.copy()
    for r in impacts.collect():
        m[model.offsets[r["src_desc"]] + r["src_var"], model.offsets[r["tgt_desc"]] + r["tgt_var"]] = r["impact"]
    return Model(model.descriptors, listed, m)


def read_solutions(spark: SparkSession, path: str) -> DataFrame:
    """path, scenario_id, digits of solution lists, read by Spark; a scenario's number is its place in its file, from 0."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\\r?\\n").alias("lines"))
    quoted = files.select("path", F.posexplode(F.filter("lines", lambda x: x.startswith('"'))).alias("scenario_id", "line"))
    digits = F.transform(F.split(F.trim(F.regexp_extract("line", '^"([^"]+)"', 1)), r"\s+"), lambda x: x.cast("int") - 1)
    return quoted.select("path", F.col("scenario_id").cast("bigint").alias("scenario_id"), digits.alias("digits"))


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """path, content of model files, read by Spark from any file system."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


class _ModelFiles(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        from .files import load_scw

        model = load_scw(partition.value, kernel=[])
        for a, b, c, d, x in impact_rows(model):
            yield partition.value, model.descriptors[a], model.variants[a][b], model.descriptors[c], model.variants[c][d], a, b, c, d, x


class ScwSource(DataSource):
    """spark.read.format("scw").load(path, folder or pattern): one row per matrix cell."""

    @classmethod
    def name(cls) -> str:
        return "scw"

    def schema(self) -> str:
        return "path string, source string, source_variant string, target string, target_variant string, " + IMPACTS

    def reader(self, schema) -> DataSourceReader:
        from .files import expand_paths

        return _ModelFiles(expand_paths(self.options["path"]))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ScwSource)
