import os
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from scenaria.llm import near_dup, pii, quality_fm, queries

from .test_dedup import BLANK, brute_near, changed, words
from .test_pii import made_up, slow_pseudonymise

DATA, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
STAGE = dict(corpus_pipeline.STAGES)


def test_contract():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    names = queries.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


@pytest.fixture(scope="module")
def odd_docs(spark):
    """The tiny documents and hard rows, with columns named like those the operators use inside."""
    given = spark.read.parquet(f"{TINY}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in given.collect()]
    base = " ".join(words(120, 4))
    texts = [base, base.upper(), changed(base, 1, 5), changed(base, 2, 6), base.replace(" ", "\n", 3), base, " ".join(words(3000, 9)) + " ok", "", "", " ", None, "one two", " / ".join(map(str, made_up(1))) + " " + base, "x" * 100_000]
    rows += [(1_000_000 + k, t, None, None, None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[0], rows[1], (None, rows[2][1], "en", "s", 7), (None, None, None, None, None)]
    random.Random(3).shuffle(rows)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema)
    assert given.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    extra = ["node", "payload", "row", "score", "sha", "__found", "key"]
    return spark.createDataFrame([(*r, *[k] * len(extra)) for k, r in enumerate(rows)], kinds + "".join(f", `{c}` bigint" for c in extra)).repartition(3)


def kept(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_scores(machine, texts):
    """Without the identity: the whole matrix of pairs."""
    out = []
    for t in texts:
        seen, weights, statistics = quality_fm.features(t or "")
        at = np.concatenate([seen, (1 << quality_fm.BITS) + np.arange(quality_fm.STATISTICS)])
        x = np.concatenate([weights, machine.standard(statistics)])
        v = machine.factors[at] * x[:, None]
        pairs = v @ v.T
        raw = machine.bias + machine.linear[at] @ x + (pairs.sum() - np.trace(pairs)) / 2
        out.append(1 / (1 + np.exp(-np.clip(raw, -30, 30))))
    return out


def test_quality_stage(spark, odd_docs):
    docs = corpus_pipeline.Scratch(spark).write(odd_docs)
    machine = quality_fm.fit(docs, spark.read.parquet(f"{TINY}/labels.parquet"))
    rows = [tuple(r) for r in docs.collect()]
    scores = plain_scores(machine, [r[1] for r in rows])
    assert all(abs(s - quality_fm.CUT) > 1e-9 for s in scores)
    want = [r for r, s in zip(rows, scores) if s >= quality_fm.CUT]
    got = STAGE["quality"](spark, docs, TINY)
    assert got.columns == docs.columns and kept(got) == sorted(want, key=repr) and 0 < len(want) < len(rows)


def test_exact_stage(spark, odd_docs):
    docs = corpus_pipeline.Scratch(spark).write(odd_docs)
    groups = {}
    for r in docs.collect():
        groups.setdefault((r["text"] or "").translate(BLANK), []).append(r)
    order = lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0)
    got = STAGE["exact_dedup"](spark, docs, TINY)
    rows = {(r["text"] or "").translate(BLANK): r for r in got.collect()}
    assert got.columns == docs.columns and got.count() == len(groups) == len(rows)
    for norm, members in groups.items():
        first = min(map(order, members))
        assert order(rows[norm]) == first and rows[norm] in members


def test_near_stage(spark, odd_docs):
    docs = corpus_pipeline.Scratch(spark).write(odd_docs)
    rows = docs.collect()
    classes = brute_near([r["text"] for r in rows], near_dup.similarity)
    got = STAGE["near_dedup"](spark, docs, TINY)
    left = got.collect()
    assert got.columns == docs.columns and len(left) == len(set(classes))
    members = {}
    for r, c in zip(rows, classes):
        members.setdefault(c, []).append(r)
    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    of = {repr(r): c for r, c in zip(rows, classes)}
    for r in left:
        assert order(r) == min(map(order, members[of[repr(r)]]))
    assert len({of[repr(r)] for r in left}) == len(left)


def test_pii_stage(spark, odd_docs):
    spark.conf.set(pii.KEY_SETTING, "k")
    try:
        got = STAGE["pii"](spark, odd_docs, TINY)
        at = odd_docs.columns.index
        want = []
        for r in odd_docs.collect():
            new = slow_pseudonymise(r["text"], "k")[0]
            row = list(r)
            row[at("text")] = new
            row[at("n_chars")] = r["n_chars"] if new is None else len(new)
            want.append(tuple(row))
        assert got.columns == odd_docs.columns and kept(got) == sorted(want, key=repr)
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def check_pieces(pieces, docs):
    """Every id of every row lies in one piece; sequences are filled from 0 without gaps."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = sorted((repr(r["doc_id"]), len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in docs)
    starts = sorted((repr(p["doc_id"]), p["doc_tokens"]) for p in pieces if p["start"] == 0)
    assert starts == sizes and sum(p["length"] for p in pieces) == sum(n for _, n in sizes)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096


def test_packing_stage(spark, odd_docs):
    pieces = STAGE["packing"](spark, odd_docs, TINY)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check_pieces(pieces.collect(), odd_docs.collect())


def test_empty_tables(spark, odd_docs):
    none = odd_docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, TINY)
        assert out.count() == 0 and (name == "packing" or out.columns == odd_docs.columns)


def test_run_is_its_stages(spark, odd_docs, tmp_path):
    at = str(tmp_path)
    odd_docs.write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{TINY}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    spark.conf.set(pii.KEY_SETTING, "k")
    try:
        docs = spark.read.parquet(f"{at}/documents.parquet")
        with corpus_pipeline.Scratch(spark) as scratch:
            n = docs.count()
            for name, stage in corpus_pipeline.STAGES[:-1]:
                docs = scratch.write(stage(spark, docs, at))
                assert docs.columns == odd_docs.columns and docs.count() <= n, name
                n = docs.count()
            rows = docs.collect()
            pieces = corpus_pipeline.run(spark, at).collect()
        check_pieces(pieces, rows)
    finally:
        spark.conf.unset(pii.KEY_SETTING)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df, sql = queries.queries()[name](spark, DATA), con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    rows = lambda names, found: sorted(([r[names.index(c)] for c in columns] for r in found), key=repr)
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())
