import hashlib
import random

from pyspark.sql import functions as F

from scenaria.llm import common, content_sort, near_dup

SCHEMA = "doc_id bigint, text string, kept string, row int"
BLANK = {ord(c): None for c in " \t\n\v\f\r"}


def words(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(n)]


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(BLANK), []).append((i, t or ""))
    out = []
    for norm, members in groups.items():
        first = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0]))
        kept = False
        for i, t in members:
            mine = (i, t) == first and not kept
            kept |= mine
            out.append((i, first[0], len(members), mine, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def exact_rows():
    rows = [(k, " ".join(words(20, k % 7))) for k in range(40)]
    rows += [(100 + k, f"a b{' ' * (k % 3)}c") for k in range(60)]
    rows += [(7, None), (8, ""), (9, " \n"), (None, "lonely"), (None, "lonely"), (5, "abc"), (5, "abc"), (200, "x" * 300_000), (201, "x" * 299_999 + " x"), (202, "é\u00a0é"), (203, "éé")]
    return rows


def test_exact_against_brute_force(spark):
    rows = exact_rows()
    docs = spark.createDataFrame([(i, t, "c", k) for k, (i, t) in enumerate(rows)], SCHEMA)
    for options in ({}, {"least_hot": 5}, {"least_hot": 4, "most_hot": 2}):
        got = content_sort.exact_groups(docs, **options).collect()
        assert sorted([tuple(r) for r in got], key=repr) == brute_exact(rows)
        left = content_sort.exact_dedup(docs, **options)
        assert left.columns == docs.columns and left.count() == sum(r[3] for r in brute_exact(rows))
    assert content_sort.exact_groups(docs.limit(0)).count() == 0


def test_a_hot_group_is_split_whatever_its_ids(spark):
    rows = [(None, "one text")] * 3000 + [(7, "other text")] * 2000 + [(k, f"text {k}") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    ranked = content_sort.ranked_groups(docs, ["text"])
    assert "salts" in ranked._jdf.queryExecution().analyzed().toString()
    got = ranked.groupBy("text_sha256").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept"), F.min("group_size"), F.max("group_size"), F.count("keep_id").alias("ids")).collect()
    assert sorted((r[1], r[2], r[3], r[4]) for r in got)[-2:] == [(2000, 1, 2000, 2000), (3000, 1, 3000, 3000)] and all(r["kept"] == 1 for r in got)
    salts = spark.range(3000).select(F.pmod(F.xxhash64("id"), F.lit(3))).distinct().count()
    assert salts == 3


def test_exact_plan_has_one_exchange_of_texts(spark):
    docs = spark.createDataFrame([(1, "a", "c", 1)], SCHEMA)
    plan = content_sort.exact_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan and "Python" not in plan


def changed(text, n, seed):
    draw, w = random.Random(seed), text.split()
    for k in draw.sample(range(len(w)), n):
        w[k] = "changed" + str(k)
    return " ".join(w)


def near_rows():
    rows = []
    for g in range(9):
        base = " ".join(words(100, 1000 + g))
        rows.append(base)
        rows += [changed(base, 1 + k % 3, g * 100 + k) for k in range(g)]
        rows += [base.upper(), base] if g % 3 == 0 else []
    rows += [" ".join(words(150, 5000 + k)) for k in range(30)]
    shared = " ".join(words(60, 77))
    rows += [f"{' '.join(words(60, 6000 + k))} {shared}" for k in range(10)]
    rows += ["", None, "!!!", "?!", "one two", "one two", "one two three", "la " * 400, "la " * 390, "x" * 100_000]
    return rows


def brute_near(texts, similarity=None):
    """Class by least row number, from all pairs."""
    similarity = similarity or (lambda a, b: slow_similarity(a.tolist(), b.tolist()))
    s = [near_dup.shingles(t or "") for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if (texts[a] or "") == (texts[b] or "") or similarity(s[a], s[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]


def slow_similarity(a, b):
    if not a or not b or not set(a) & set(b):
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1] / (len(a) + len(b) - row[-1])


def test_similarity_is_that_of_the_full_alignment():
    base = " ".join(words(120, 3))
    for n in range(0, 9):
        a, b = near_dup.shingles(base), near_dup.shingles(changed(base, n, n))
        slow = slow_similarity(a.tolist(), b.tolist())
        fast = near_dup.similarity(a, b)
        assert fast == slow if slow >= 0.8 else fast < 0.8
    assert near_dup.similarity(near_dup.shingles(base), near_dup.shingles(" ".join(reversed(base.split())))) == 0
    assert len(near_dup.shingles("a b c")) == 1 and len(near_dup.shingles("")) == 0 and len(set(near_dup.shingles("la " * 50).tolist())) == 46


def test_near_against_brute_force(spark):
    texts = near_rows()
    docs = spark.createDataFrame([(k, t, "c", k) for k, t in enumerate(texts)], SCHEMA)
    expected = brute_near(texts)
    got = near_dup.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(expected))
    assert sorted(r["doc_id"] for r in got if r["kept"]) == sorted(set(expected))
    assert all(r["class_size"] == expected.count(r["class_id"]) for r in got)
    left = near_dup.near_dedup(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(set(expected))


def test_near_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", "c", 1), (None, "a b c d e f", "c", 1), (3, "a b c d e f", "c", 1), (3, "a b c d e f", "c", 1), (4, None, "c", 2)], SCHEMA)
    rows = near_dup.near_duplicates(docs).collect()
    assert len(rows) == 5 and sum(r["kept"] for r in rows) == 2 and near_dup.near_dedup(docs).count() == 2
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def related_rows():
    """Copies of two texts with so many changes that most are nearly, but not, similar to each other."""
    rows = []
    for g in range(2):
        base = " ".join(words(110, 9000 + g))
        rows += [changed(base, k % 7, 100 * g + k) for k in range(90)]
        # copies of copies, which are similar by changes that they share
        far = changed(base, 6, 7000 + g)
        rows += [changed(far, k % 3, 8000 + k) for k in range(6)]
    return rows + [" ".join(words(n, 9100 + k)) for k in range(3) for n in (8, 70, 90)]


def test_related_texts_against_brute_force(spark, monkeypatch):
    texts = related_rows()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    expected = dict(enumerate(brute_near(texts, near_dup.similarity)))  # which a test above holds against full alignments
    for hot, task in ((common.LEAST_HOT, near_dup.IN_A_TASK), (3, 4)):
        monkeypatch.setattr(common, "LEAST_HOT", hot)
        monkeypatch.setattr(near_dup, "IN_A_TASK", task)
        got = near_dup.near_duplicates(docs).collect()
        assert {r["doc_id"]: r["class_id"] for r in got} == expected


def test_prefix_pairs_lose_nothing(spark):
    s = [near_dup.shingles(t) for t in related_rows()]
    roots = [k % 5 for k in range(len(s))]
    with common.Scratch(spark) as scratch:
        spelt = scratch.write(spark.createDataFrame([(int(h), k) for k, x in enumerate(s) for h in x.view("int64")], "shingle bigint, num bigint"))
        nodes = spark.createDataFrame([(k, len(x), bytes([roots[k]])) for k, x in enumerate(s)], "num bigint, n int, root binary")
        got = [tuple(sorted(r)) for r in near_dup.prefix_pairs(scratch, spelt, nodes, 0.8).collect()]
    alike = {(a, b) for b in range(len(s)) for a in range(b) if roots[a] != roots[b] and near_dup.similarity(s[a], s[b]) >= 0.8}
    assert len(got) == len(set(got)) and alike <= set(got) and len(got) < 5 * len(alike)


def test_similar_pairs_share_a_sketch():
    missed = pairs = 0
    for n in (9, 20, 60, 66, 75, 90, 200):
        for k in range(60):
            base = " ".join(words(n, 50 * n + k))
            other = " ".join(changed(base, 1 + k % 5, k).split()[: n - k % 2])
            a, b = near_dup.shingles(base), near_dup.shingles(other)
            if near_dup.similarity(a, b) >= 0.8:
                pairs += 1
                missed += not set(near_dup.keys_of(a).tolist()) & set(near_dup.keys_of(b).tolist())
    assert pairs > 100 and missed <= 0.01 * pairs


def test_components(spark):
    edges = [(b, a) for a, b in ((bytes([k]), bytes([k + 1])) for k in range(20))] + [(b"\x65", b"\x66")]
    with common.Scratch(spark) as scratch:
        found = near_dup.components(scratch, spark.createDataFrame(edges, "a binary, b binary")).collect()
    roots = {bytes(r["node"]): bytes(r["root"]) for r in found}
    assert set(roots.values()) == {b"\0", b"\x65"} and len(roots) == 23
