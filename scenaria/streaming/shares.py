"""Structured Streaming over a folder of basin shares.

The engine has no event time; what arrives over time are the shares of a space
that many machines count. A stream over their folder keeps the sums by fixed
point up to date. A share is known by its model and range: its rows are kept by
range, so written again it counts once, and written again with other counts it
stops the stream. The state is as large as the shares' own table: one row for each
share and fixed point that it reached, whatever is written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.basins import PARTIALS


def merged_stream(spark: SparkSession, path: str) -> DataFrame:
    """kind, fp, basin_size of the Parquet shares under path, as a streaming frame for the output mode complete."""
    shares = spark.readStream.schema(PARTIALS).parquet(path)
    kept = shares.groupBy("model", "kind", "fp").agg(F.collect_set(F.struct("first", "last", "count")).alias("shares"))
    ranges = F.array_distinct(F.transform("shares", lambda x: F.struct(x["first"], x["last"])))
    differ = F.raise_error(F.concat(F.lit("a share was written again with other counts, for the fixed point "), F.coalesce(F.col("fp").cast("string"), F.lit("of cycles"))))
    total = F.aggregate("shares", F.lit(0).cast("bigint"), lambda s, x: s + x["count"])
    return kept.select("model", "kind", "fp", F.when(F.size(ranges) == F.size("shares"), total).otherwise(differ.cast("bigint")).alias("basin_size"))
