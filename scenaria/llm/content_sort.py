"""Exact dedup by sorting content.

Texts are equal when they are identical after deleting white space. Splitters
sampled from the data range-partition the normalised text: the key is its first
characters, then its digest, which tells apart texts that share a beginning
without sending whole texts to the driver as samples. Within a partition an
external sort on the whole normalised text places equals adjacent, and
neighbours are compared in full, which bounds each run of equals. Of a run, the
row with the most code points stays, then that with the smallest identifier.

A group of copies may hold a third of all rows. A first pass counts digests with
map-side partial sums. The groups of `least_hot` rows or more, but no more than the
`most_hot` largest, are dealt over one run for each `least_hot` of their rows, by the
number of the row, so equal identifiers are split too; the first pass also says
which row of theirs stays. Any other group has fewer than `least_hot` rows or less
than 1 / most_hot of all.

Null counts as empty, and empty texts form one group; very long texts are compared
whole. A null identifier ranks after all others. Rows that agree in everything are
interchangeable: exactly one stays. An empty table gives an empty one. Other columns
are carried inside one struct and cannot clash. The numbers of rows are those of
their places in the input, so give a table and not a computation in random order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITESPACE


def normalised(text: Column) -> Column:
    return F.translate(text, WHITESPACE, "")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def ranked_groups(docs: DataFrame, payload: list[str], id_col: str = "doc_id", text_col: str = "text", least_hot: int = 1024, most_hot: int = 1000) -> DataFrame:
    """Every row with its group: payload (struct of the columns named), doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in payload)).alias("payload"), F.col(id_col).alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    keyed = rows.select("payload", "doc_id", "text", "row", digest(F.col("text")).alias("sha"), F.substring(normalised(F.col("text")), 1, 16).alias("head"), F.char_length("text").cast("long").alias("size"))
    first = F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    sums = keyed.groupBy("sha").agg(F.count("*").alias("n"), F.min(first).alias("first"))
    largest = sums.filter(F.col("n") >= least_hot).orderBy(F.desc("n"), "sha").limit(most_hot)
    hot = [(r["sha"], r["n"], -(-r["n"] // least_hot), r["first"]["doc_id"], r["first"]["row"]) for r in largest.collect()]
    kind = docs.schema[id_col].dataType.simpleString()
    # at most most_hot rows
    table = F.broadcast(docs.sparkSession.createDataFrame(hot, f"sha string, hot_n bigint, salts bigint, hot_lead {kind}, hot_row bigint"))
    # a constant salt would stand in the way of matching the window with the range partitioning
    keys = ["head", "sha", *(["salt"] if hot else [])]
    salt = F.coalesce(F.pmod(F.xxhash64("row"), F.col("salts")), F.lit(0))
    salted = keyed.join(table.select("sha", "salts"), "sha", "left").withColumn("salt", salt).drop("salts") if hot else keyed
    dealt = salted.repartitionByRange(*keys).withColumn("norm", normalised(F.col("text"))).drop("text")
    same = Window.partitionBy(*keys, "norm")
    order = same.orderBy(F.desc("size"), F.asc_nulls_last("doc_id"), "row")
    lead = F.first(F.struct("doc_id", "row")).over(order)
    runs = dealt.select("payload", "doc_id", "sha", "row", lead.alias("lead"), F.count("*").over(same).alias("n"))
    known = runs.join(table, "sha", "left")
    split = F.col("hot_n").isNotNull()
    return known.select(
        "payload",
        "doc_id",
        F.when(split, F.col("hot_lead")).otherwise(F.col("lead.doc_id")).alias("keep_id"),
        F.coalesce("hot_n", "n").alias("group_size"),
        (F.col("row") == F.when(split, F.col("hot_row")).otherwise(F.col("lead.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_groups(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return ranked_groups(docs, [], **options).drop("payload")


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with the columns of docs."""
    kept = ranked_groups(docs, docs.columns, **options).filter("kept")
    return kept.select(*(F.col("payload").getField(c).alias(c) for c in docs.columns))
