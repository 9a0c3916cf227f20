"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs on this machine, as in tests, a temporary folder of this session."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="scenaria-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at), at


def materialise(df: DataFrame) -> DataFrame:
    """df written once and read back: computed once, without lineage, and safe from lost executors."""
    return _written(df)[0]


class Scratch:
    """Tables that are deleted at the end of the block, but for those that were kept.

    Only what nothing reads any more may go: a frame that outlives the block must
    be made of kept tables and of other sources.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def __enter__(self) -> Scratch:
        return self

    def write(self, df: DataFrame) -> DataFrame:
        table, at = _written(df)
        self.tables.append((table, at))
        return table

    def keep(self, *tables: DataFrame) -> None:
        self.tables = [x for x in self.tables if not any(x[0] is t for t in tables)]

    def drop(self, *tables: DataFrame) -> None:
        """Delete these at once."""
        for table, at in self.tables:
            if any(table is t for t in tables):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        self.keep(*tables)

    def __exit__(self, *raised: object) -> None:
        self.drop(*(t for t, _ in self.tables))
