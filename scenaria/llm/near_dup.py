"""Near-duplicates by Order MinHash and banded alignment.

A text is its sequence of five-word shingles (lower-cased words `\\w+`; a text of
fewer words is one shingle), each labelled with its occurrence number, so that
all are distinct. A sketch takes some shingles of least hash and keeps them in the
order of the text; texts that share a sketch are candidates, so the chance to meet
falls with edits and with changed order alike. Texts of 64 shingles or more have
32 sketches of 6, by which two of similarity 0.8 miss each other with a chance of
6 in 100,000, and less above it; shorter ones, for which 6 of all shingles are too
many, have 24 of 4. Texts that may be similar to one on the other side of that
border have both.

Candidates are verified by alignment: matches of equal shingles at places that
differ by no more than the band (a fifth of the longer text, beyond which no
alignment can reach the threshold), and the longest chain of them in both
orders. Similarity is chain / (shingles of both - chain), at least 0.8.

Identical texts are one node. A set is the nodes that share a sketch:

1. Each node is compared with the leader of each of its sets: the node that meets
   most others over all sets, which in a group of copies is near to the original.
   That is one row for each node and set.
2. Sets whose nodes, but for the leader, then lie in several components are not
   settled. Their nodes are met exactly, by a prefix filter: two sequences of
   similarity 0.8 share four fifths of either's shingles, so in any one order of
   all shingles their first common shingle is among the first fifth of both, at a
   place that leaves enough behind it. The order is from rare to frequent, so that
   copies with changes of their own, which differ too much, have nothing in common
   there. Within the nodes listed under a shingle, those outside the most frequent
   component there are joined with the others.

No link that shares a sketch is lost, and nothing is capped. Sets, shingles and
texts that many rows need are split over tasks. Sets of texts that all share rare
shingles and are yet not similar would still be joined in pairs, in step 2; their
rows are filtered there by place, length and component before anything is aligned.

Null counts as empty. Texts without a word are joined only to identical ones, very
long ones are read whole, an empty table gives none. Repeated rows are rows of one
class. Ids may be null or repeated; the class id is the least id. No other column
is read by near_duplicates; near_dedup gives back the columns of docs.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, hot_bound, spread_join, thrifty
from .word_bpe import Remembered

WORDS = 5
LEAST = 0.8
#: (sketches, shingles in each) of texts with fewer shingles than SHORT, and of the others.
SHORT = 64
FAMILIES = ((24, 4), (32, 6))
#: Rows listed under one shingle, or pairs that need one text, in a task.
IN_A_TASK = 2000
#: Nodes (16 bytes each) up to which their list is broadcast; beyond it is shuffled.
BROADCAST_NODES = 1_000_000

_WORD = re.compile(r"\w+")
_hash = Remembered(xxhash.xxh3_64_intdigest, 100_000)
_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)


def forget() -> None:
    _hash.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str) -> np.ndarray:
    """Occurrence-labelled hashes of the five-word shingles, in order."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(_hash.__getitem__, words), _U, len(words))
    n = max(1, len(h) - WORDS + 1)
    s = np.zeros(n, _U)
    for k in range(min(WORDS, len(h))):
        s += mix(h[k : k + n] ^ _ODD[k]) * _ODD[k]
    if len(h) < WORDS:
        s += _U(len(h))
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if first.all():
        return mix(s)
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    label = np.empty(n, _U)
    label[order] = (np.arange(n) - begin).astype(_U)
    return mix(s + label * _ODD[0])


_SEEDS = [mix(np.arange(1, n + 1, dtype=_U) * _ODD[1 + k]) for k, (n, _) in enumerate(FAMILIES)]


def sketches(s: np.ndarray, family: int) -> np.ndarray:
    """One number for each sketch: the least-hashed shingles, hashed in text order. Two sketches share none."""
    number, per = FAMILIES[family]
    out = np.empty(number, _U)
    step = max(1, 2_000_000 // max(1, len(s)))  # so many sketches at a time
    for a in range(0, number, step):
        seeds = _SEEDS[family][a : a + step]
        if len(s) > per:
            least = np.sort(np.argpartition(mix(s[None, :] ^ seeds[:, None]), per - 1, axis=1)[:, :per], axis=1)
            chosen = s[least]
        else:
            chosen = np.broadcast_to(s, (len(seeds), len(s)))
        key = seeds.copy()
        for k in range(chosen.shape[1]):
            key = mix(key * _ODD[2] + chosen[:, k])
        out[a : a + step] = key
    return out


def keys_of(s: np.ndarray, least: float = LEAST) -> np.ndarray:
    """All sketches of a text: of the two lengths that a similar pair may have, both have one family in common."""
    families = [0] * (len(s) * least < SHORT) + [1] * (len(s) >= SHORT)
    return np.concatenate([sketches(s, k) for k in families])


def similarity(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Of the banded alignment; 0 where it cannot reach `least`."""
    big, small = max(len(a), len(b)), min(len(a), len(b))
    if not small or small < least * big:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= np.ceil((1 - least) * big)
    i, j = i[near], j[near]
    if len(i) < least * big:
        return 0.0
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        chain = len(j)
    else:
        ends: list[int] = []
        for x in j.tolist():
            at = bisect_left(ends, x)
            ends[at : at + 1] = [x]
        chain = len(ends)
    return chain / (len(a) + len(b) - chain)


def node_of(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def _signatures(rows: DataFrame, least: float) -> DataFrame:
    """node, n, keys of every row that has a word."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, n, keys = [], [], []
            for k, t in enumerate(batch.column(1)):
                s = shingles(t.as_py())
                if len(s):
                    keep.append(k)
                    n.append(len(s))
                    keys.append(keys_of(s, least).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["node", "n", "keys"])

    return rows.mapInArrow(thrifty(sign, forget), "node binary, n int, keys array<bigint>")


def _texts(scratch: Scratch, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """node, text, num (a number of its own) of the nodes listed. nodes: a table."""
    chosen = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    found = rows.join(chosen, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    return scratch.write(found.withColumn("num", F.monotonically_increasing_id()))


def _verified(scratch: Scratch, pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts align. pairs, texts: tables.

    A text that many pairs need as b is given once for each IN_A_TASK of them.
    """
    needs = pairs.groupBy("b").agg(F.count("*").alias("needs")).filter(F.col("needs") >= hot_bound(pairs.count()))
    needs = F.broadcast(needs.select("b", F.ceil(F.col("needs") / IN_A_TASK).cast("int").alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    dealt = pairs.join(needs, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), copies).cast("int").alias("copy"))
    given = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).join(needs, "b", "left").select("b", "text_b", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    both = dealt.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(given, ["b", "copy"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = ("", np.zeros(0, _U))
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.as_py(), y.as_py()
                if last[0] != y:
                    last = y, shingles(y)
                good.append(similarity(shingles(x), last[1], least) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return scratch.write(both.select("a", "b", "text_a", "text_b").mapInArrow(thrifty(align, forget), "a binary, b binary"))


def _spelt(texts: DataFrame) -> DataFrame:
    """shingle, num for every shingle of every text."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for num, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(t.as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(np.full(len(s), num), pa.int64())], ["shingle", "num"])

    return texts.select("num", "text").mapInArrow(thrifty(spell, forget), "shingle bigint, num bigint")


def prefix_pairs(scratch: Scratch, spelt: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(x, y): nums of different roots that may be similar, by the shingles that come first from rare to frequent.

    spelt: a table of shingle, num; nodes: a table of num, n, root.
    """
    # shingles are distinct within a text, so a count is one of texts; those of one text come first and meet none
    common = scratch.write(spelt.groupBy("shingle").agg(F.count("*").alias("texts")).filter("texts > 1"))
    whole = Window.partitionBy("num")
    place = F.col("n") - F.count("*").over(whole) + F.row_number().over(whole.orderBy("texts", "shingle")) - 1
    placed = spread_join(spelt, common, "shingle", "texts").join(nodes.select("num", "n", "root"), "num").withColumn("place", place)
    first = scratch.write(placed.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9)).select("shingle", "num", "n", "root", "place"))
    per_root = first.groupBy("shingle", "root").agg(F.count("*").alias("c")).groupBy("shingle")
    lists = per_root.agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.sum("c").alias("size"), F.count("*").alias("roots")).filter("roots > 1")
    listed = scratch.write(spread_join(first, scratch.write(lists.select("shingle", "main", "size")), "shingle", "size"))
    # a long list is dealt over tasks, to each of which all rows outside the main component go
    parts = F.ceil(F.col("size") / IN_A_TASK).cast("int")
    x = listed.filter("root != main").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    y = listed.select("shingle", *(F.col(c).alias(f"{c}_y") for c in ("num", "n", "root", "place")), F.pmod(F.xxhash64("num"), parts).cast("int").alias("part"))
    # the first common shingle leaves, in both, at least as many as they must share
    enough = F.least(F.col("n") - F.col("place"), F.col("n_y") - F.col("place_y")) * (1 + least) >= (F.col("n") + F.col("n_y")) * least - 1e-6
    once = (F.col("root_y") == F.col("main")) | (F.col("num") < F.col("num_y"))
    met = x.join(y, ["shingle", "part"]).filter((F.col("root") != F.col("root_y")) & once & enough)
    return met.select(F.least("num", "num_y").alias("x"), F.greatest("num", "num_y").alias("y")).distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (a, b), as a table.

    Each round gives a node the least root among its neighbours and then that
    root's own root; rounds grow with the logarithm of the longest path.
    """
    both = scratch.write(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct())
    roots = scratch.write(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root"), F.count("*").alias("degree")))
    while True:
        known = roots.select(F.col("node").alias("other"), "root", "degree")
        near = spread_join(both, known, "other", "degree").groupBy("node").agg(F.min("root").alias("near"))
        moved = scratch.write(roots.join(near, "node").select("node", "degree", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        size = moved.groupBy("root").agg(F.count("*").alias("size"))
        heads = scratch.write(size.join(moved.select(F.col("node").alias("root"), F.col("root").alias("far")), "root"))
        done = scratch.write(spread_join(moved, heads, "root", "size").select("node", "degree", "old", F.least("root", "far").alias("root")))
        scratch.drop(roots, moved, heads)
        roots = done
        if done.filter("old != root").isEmpty():
            scratch.drop(both)
            return done.select("node", "root")


def node_classes(scratch: Scratch, rows: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the linked nodes and the verified edges (a, b). rows: node, text."""
    signed = scratch.write(_signatures(rows, least).groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys")))
    each = signed.select("node", "n", F.explode("keys").alias("key"))
    sets = scratch.write(each.groupBy("key").agg(F.min("node").alias("one"), F.max("node").alias("other"), F.count("*").alias("size")).filter("one != other").select("key", "size"))
    members = scratch.write(spread_join(each, sets, "key", "size"))
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    leads = scratch.write(members.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("lead"), F.count("*").alias("size")))
    led = spread_join(members.drop("size"), leads, "key", "size").filter("node != lead")
    first = scratch.write(led.select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct())
    scratch.drop(signed, sets)
    edges = _verified(scratch, first, _texts(scratch, _ends(scratch, first), rows), least)
    roots = components(scratch, edges)
    placed = scratch.write(led.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")))
    several = placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("q"), F.count("*").alias("size")).filter("r != q")
    still = scratch.write(spread_join(placed, scratch.write(several.select("key", "size")), "key", "size").select("node", "n", "root").distinct())
    if still.isEmpty():
        return roots, edges
    texts = _texts(scratch, still.select("node"), rows)
    nodes = scratch.write(still.join(texts.select("node", "num"), "node"))
    pairs = prefix_pairs(scratch, scratch.write(_spelt(texts)), nodes, least)
    ends = pairs.join(nodes.select(F.col("num").alias("x"), F.col("node").alias("a")), "x").join(nodes.select(F.col("num").alias("y"), F.col("node").alias("b")), "y")
    more = _verified(scratch, scratch.write(ends.select("a", "b").join(first.union(first.select("b", "a")), ["a", "b"], "left_anti")), texts, least)
    if more.isEmpty():
        return roots, edges
    edges = edges.union(more)
    return components(scratch, edges), edges


def _ends(scratch: Scratch, pairs: DataFrame) -> DataFrame:
    return scratch.write(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_checked_links, kept.

    class_id: the least id of the class. n_checked_links: links of the text to
    different texts that were verified on the way to the classes, and no count of its
    similar texts: these links span each class, and pairs that are in one class by
    other links are never aligned. kept: true for one row of each class, with that
    least id.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select("doc_id", node_of(F.col("text")).alias("node"), "text")
    with Scratch(docs.sparkSession) as scratch:
        roots, edges = node_classes(scratch, rows.select("node", "text"), least)
        # a number of its own tells apart rows that share both text and id
        out = scratch.write(rows.select("doc_id", "node", F.monotonically_increasing_id().alias("row")))
        first = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
        nodes = out.groupBy("node").agg(F.min(first).alias("first"), F.count("*").alias("n")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        nodes = scratch.write(nodes.select("node", "root", "n", "first"))
        classes = scratch.write(nodes.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("class_size"), F.count("*").alias("texts")))
        links = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_checked_links"))
        known = spread_join(nodes.select("node", "root", "n"), classes, "root", "texts").join(links, "node", "left")
        known = scratch.write(known.select("node", "n", F.col("first")["doc_id"].alias("class_id"), "class_size", F.coalesce("n_checked_links", F.lit(0)).alias("n_checked_links"), F.col("first")["row"].alias("kept_row")))
        scratch.keep(out, known)
        return spread_join(out, known, "node", "n").select("doc_id", "class_id", "class_size", "n_checked_links", (F.col("row") == F.col("kept_row")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """docs with one row of each class, that of the least id."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("payload"), F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("node", node_of(F.col("text")))
    with Scratch(docs.sparkSession) as scratch:
        roots, _ = node_classes(scratch, rows.select("node", "text"), least)
        linked = scratch.write(rows.select("doc_id", "node").groupBy("node").agg(F.min("doc_id").alias("least_id")).join(roots, "node"))
        first = scratch.write(linked.groupBy("root").agg(F.min(F.struct(F.col("least_id").isNull(), "least_id", "node"))["node"].alias("first_node"), F.count("*").alias("texts")))
        gone = scratch.write(spread_join(linked, first, "root", "texts").filter("node != first_node").select("node"))
        scratch.keep(gone)
        # identical texts: the least id, one row of it, chosen before anything is joined
        one = rows.groupBy("node").agg(F.min_by("payload", F.struct(F.col("doc_id").isNull(), F.col("doc_id"))).alias("payload"))
        return one.join(gone, "node", "left_anti").select(*(F.col("payload").getField(c).alias(c) for c in docs.columns))
