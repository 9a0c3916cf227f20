import os
import subprocess
import sys

from ..conftest import ROOT

#: One worker serves all of this, so what a stage leaves in it is what the probe finds.
SCRIPT = """
import re
import sys
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scenaria.llm import near_dup, packing, quality_fm
from scenaria.session import ship

spark = ship(SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")


def look(batches):
    for _ in batches:
        from scenaria.llm import near_dup, packing, quality_fm

        held = sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024
        yield pa.RecordBatch.from_pylist([{"mb": held, "near": len(near_dup._hash), "quality": len(quality_fm._place), "packing": packing._encoder.cache_info().currsize}])


def probe():
    return spark.range(1).coalesce(1).mapInArrow(look, "mb long, near long, quality long, packing long").first()


# the words are the same everywhere, so what is remembered is small and the texts are large
text = F.concat(F.col("id").cast("string"), F.lit(" " + "some words of a long text, " * 400))
docs = spark.range(6000).coalesce(1).select(F.col("id").alias("doc_id"), text.alias("text"))
labels = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
few = docs.limit(50)
STAGES = {
    "near": lambda d: near_dup._signatures(d.select(near_dup.node_of(F.col("text")).alias("node"), "text"), 0.8),
    "packing": packing.token_pieces,
    "quality": lambda d: quality_fm.keep_good(d, labels),
}
for name, stage in STAGES.items():
    stage(few).count()
    before = probe()
    stage(docs).count()
    after = probe()
    print("FOUND", name, after["mb"] - before["mb"], *(x for x in STAGES if after[x]))
"""


def test_workers_give_memory_back(tmp_path):
    """After a task on 65 MB of text a worker holds little more than after one on half a MB, and nothing of other operators."""
    env = os.environ | {"PYTHONPATH": os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))}
    ran = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    found = {x[1]: (int(x[2]), x[3:]) for x in map(str.split, ran.stdout.splitlines()) if x[:1] == ["FOUND"]}
    assert set(found) == {"near", "packing", "quality"}, ran.stderr[-2000:]
    for name, (mb, remembered) in found.items():
        assert remembered == [name] and mb < 25, found
