import array
import base64
import hashlib
import os
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from scenaria.llm import byte_bpe, packing, pii, quality_rules, secret_scan, token_count, url_filter
from scenaria.llm.word_bpe import LibraryEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", None, "it's 'street we'll''s <|endoftext|>X", "Σ ΑΣ ŐŰ 日本語 ١٢ Ⅷ ½ ﬁ c̄", "a\x1cb\x85c\u3000d\u200be", "<|startoftext|>", "'", "'r", "x" * 5000, "a  b\n\n c\t'd ", "\r\n x\n", "q\u0301 e\u0301", "\ua7cb\u1c89 \ua7cb", "\u0130\u1e9e \U00010400\U0001e921"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return token_count.TokenCounter(WORDS, chunk=5, run=3)


@pytest.fixture(scope="module")
def encoder():
    return LibraryEncoder(WORDS)


TEXT = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.characters(exclude_categories=["Cs"], max_codepoint=0x2FFF), st.sampled_from("etaoin shrdlu'.,\n ")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_counts_and_ids_are_the_library_s(library, counter, encoder, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert counter.count(text) == len(ids)
    assert encoder.encode(text) == array.array("I", ids).tobytes()


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_byte_bpe_is_tiktoken_s(tik, text):
    bpe = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    ids = bpe.encode(text)
    assert ids == array.array("I", tik.encode_ordinary(text)).tobytes() and bpe.decode(ids) == text.encode()


def test_minimal_perfect_hash():
    keys = [str(k).encode() for k in range(5000)]
    h = byte_bpe.MinimalPerfectHash(keys)
    assert sorted(map(h.slot, keys)) == list(range(5000))


def test_transducer_survives_a_reset(counter):
    t = token_count.Transducer(counter.vocabulary, most_states=5)
    for w in ("hello", "tokenization", "zzzqqq", "hello"):
        assert t.read(counter.vocabulary.spell(w)) == (token_count.START, len(counter.vocabulary.merge(counter.vocabulary.spell(w))))


def test_maps_compose():
    a, b = {0: (1, 2), 1: (0, 1)}, {0: (0, 5), 1: (1, 7)}
    a, b = token_count.StateMap(a), token_count.StateMap(b)
    assert token_count.compose(a, b) == {0: (1, 9), 1: (0, 6)}
    maps = [a, b, a, b, a]
    assert token_count.scan(maps)[-1] == token_count.compose(token_count.compose(token_count.compose(token_count.compose(a, b), a), b), a)
    assert token_count.scan([]) == []
    asked = []
    part = token_count.StateMap({0: (0, 1)}, lambda entry: asked.append(entry) or (0, 10))
    assert token_count.compose(a, part) == {0: (0, 12), 1: (0, 2)} and asked == [1]


def test_long_pieces_are_read_in_chunks(library):
    import random

    draw = random.Random(6)
    letters = ["".join(draw.choice("etaoinshrdlu") for _ in range(3000)), "ab" * 1500, "x" * 3000, "".join(draw.choice("abc1.é日") for _ in range(3000)), "the" * 1000]
    for chunk, most_states in ((1, 400_000), (7, 50), (100, 400_000), (1000, 200)):
        counter = token_count.TokenCounter(WORDS, chunk=chunk, most_states=most_states)
        several = 0
        for text in [*letters, f"a {letters[0]} b<|endoftext|>{letters[3]}"]:
            assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), (chunk, text[:20])
            assert len(counter.transducer.live) <= most_states + max(chunk, max(token_count.BEFORE)) * 2 + 2
            maps = list(counter.state_maps(text))
            several += sum(len(m) > 1 for m in maps)
        assert several or chunk > 100


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")


def test_op1_frame(spark, library):
    rows = token_count.token_counts(frame(spark, ODD), limit=3).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = ODD[r["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 3)
    assert token_count.token_counts(frame(spark, [])).count() == 0


def test_op9_frame(spark, tik):
    for r in byte_bpe.byte_bpe(frame(spark, ODD), with_ids=True).collect():
        text = ODD[r["doc_id"]] or ""
        ids = array.array("I", tik.encode_ordinary(text)).tobytes()
        assert bytes(r["ids"]) == ids and r["n_tokens"] == len(ids) // 4
        assert r["ids_sha256"] == hashlib.sha256(ids).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_another_pattern_is_not_cut_at_spaces():
    words = r"\w+ \w+|\s|\S"
    bpe = byte_bpe.ByteBpe(RANKS, words)
    other = tiktoken.Encoding("other", pat_str=words, mergeable_ranks=bpe.ranks, special_tokens={})
    for text in ("one two three four", "a b", "x, y z\nq r"):
        assert bpe.encode(text) == array.array("I", other.encode_ordinary(text)).tobytes()


OPERATORS = {
    "op1": token_count.token_counts,
    "op2": quality_rules.ledger,
    "op3": packing.token_pieces,
    "op4": secret_scan.secret_spans,
    "op6": lambda d: pii.pseudonymise(d, "k", found_col="found"),
    "op8": lambda d: url_filter.url_verdicts(d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "url")),
    "op9": byte_bpe.byte_bpe,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_hard_rows(spark, name):
    """Nulls, empty and long texts, repeated rows and clashing names: every row gives what its text gives."""
    texts = [None, "", " ", "see http://a.org/x and 10.0.0.1, password=abcdefgh", "word " * 60_000, "z" * 300_000]
    names = ["token", "host", "tokens", "best", "size", "fail_bits", "w", "spans", "__found", "row"]
    rows = [(k, t, *[1] * len(names)) for k, t in enumerate(texts)] + [(3, texts[3], *[1] * len(names))] * 3 + [(None, texts[3], *[1] * len(names))] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{c}` int" for c in names)).repartition(2)
    run, of, times = OPERATORS[name], {}, {}
    for r in rows:
        times[r[0]] = times.get(r[0], 0) + 1
    for r in run(docs).collect():
        of.setdefault(r[0], []).append(repr(tuple(r)[1:]))
    long = {3: len(of[4]), 5: len(of[5])} if name == "op3" else {}
    assert {k: len(v) for k, v in of.items()} == times | ({4: long[3], 5: long[5]} if long else {})
    assert len(set(of[3])) == 1 and set(of[None]) == set(of[3])
    none = run(docs.limit(0))
    assert none.count() == 0 and none.columns == run(docs).columns


# -- packing -----------------------------------------------------------------------


def test_knapsack_and_plan():
    import numpy as np

    worth, taken = packing.knapsack(np.array([0.4, 0.55]), np.array([3, 4]), 10)
    assert abs(worth - 1.35) < 1e-9 and taken.tolist() == [2, 1]
    draw = np.random.default_rng(1)
    for n in (1, 30, 400):
        histogram = {}
        for s in draw.integers(1, 65, n):
            histogram[int(s)] = histogram.get(int(s), 0) + 1
        patterns = packing.plan(histogram, 64)
        held = {}
        for pattern, copies in patterns:
            assert sum(s * a for s, a in pattern.items()) <= 64 and copies > 0
            for s, a in pattern.items():
                held[s] = held.get(s, 0) + a * copies
        assert held == histogram
        least = -(-sum(s * a for s, a in histogram.items()) // 64)
        assert sum(c for _, c in patterns) <= least * 1.12 + 4
    assert packing.plan({}) == []


def test_op3_frame(spark, library):
    texts = [*ODD, *ODD, "the cat sat " * 4000, "one two three " * 700]
    rows = packing.pack_documents(frame(spark, texts)).collect()
    encoder = LibraryEncoder(WORDS)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert len(by_doc) == len(texts)
    for k, text in enumerate(texts):
        ids = array.array("I", [*library.encode(text or "", add_special_tokens=False).ids, 2]).tobytes()
        assert encoder.encode(text or "") + b"\2\0\0\0" == ids
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) // 4
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert packing.pack_documents(frame(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_little_padding(spark):
    rows = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("sequence_id").sum("length").collect()
    used = [r[1] for r in rows]
    assert sum(4096 - n for n in used if n & (n - 1)) < 0.02 * sum(used)
