"""The queries of this folder, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import byte_bpe, content_sort, near_dup, packing, pii, quality_fm, quality_rules, secret_scan, token_count, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each version of the policy and each of its rules: documents that fail it, and that fail nothing else."""
    return quality_rules.ablation(quality_rules.ledger(_table(spark, sf_dir, "documents")), *quality_rules.POLICIES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality_fm.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_fm.score(docs, machine).select("doc_id", "held_out", "score", "predicted")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark), found_col="found")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_groups(_table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(_table(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.byte_bpe(_table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_counts, op2_quality_rules, quality_ablation, op3_packing, op4_secret_scans, op5_quality_classifier, op6_pii, op7_exact_dedup, op8_url_filters, op9_byte_bpe, op10_near_dedup, pipeline)
    return {f.__name__: f for f in found}


def _ledger_sql() -> str:
    """Common tables up to f: the measurements and fail_bits of every document."""
    ws = r"[\x20\x09-\x0D]+"
    bits = " + ".join(f"CASE WHEN {r.failed} THEN {1 << k} ELSE 0 END" for k, r in enumerate(quality_rules.RULES))
    letters = lambda p: f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))"
    return f"""WITH a AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, list_filter(regexp_split_to_array(t, '{ws}'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM a),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM b WHERE len(w) >= 3),
h AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM g),
z AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM h),
y AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM z WHERE n >= 2) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST({letters('[^' + ws[1:])} AS BIGINT) AS word_chars, CAST({letters('[#*$%&|<>]+')} AS BIGINT) AS n_symbols,
 CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(y.n, 0) AS BIGINT) AS n_repeat_words,
 CAST({letters(chr(92) + 'p{Lu}+')} AS BIGINT) AS n_upper, CAST({letters(chr(92) + 'p{L}+')} AS BIGINT) AS n_letters, CAST({letters('[.!?。！？।؟]+')} AS BIGINT) AS n_stops FROM b LEFT JOIN y USING (r)),
f AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)"""


def _op2_sql() -> str:
    fails = lambda name: f"(fail_bits & {quality_rules.mask(quality_rules.POLICIES[name])}) <> 0"
    return f"""{_ledger_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {fails('base')} AS base_failed, NOT ({fails('base')} OR {fails('v1')}) AS kept, fail_bits FROM f"""


def _ablation_sql() -> str:
    rows = ", ".join(f"('{v}', '{n}', {quality_rules.mask(names)}, {quality_rules.mask((n,))})" for v, names in quality_rules.POLICIES.items() for n in names)
    return f"""{_ledger_sql()}, p(version, rule, whole, own) AS (VALUES {rows}), n AS (SELECT fail_bits, count(*) AS n FROM f GROUP BY fail_bits)
SELECT version, rule, CAST(sum(CASE WHEN fail_bits & own <> 0 THEN n ELSE 0 END) AS BIGINT) AS failed, CAST(sum(CASE WHEN fail_bits & whole = own THEN n ELSE 0 END) AS BIGINT) AS only
FROM p CROSS JOIN n GROUP BY version, rule"""


def _op7_sql() -> str:
    norm = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')"
    return f"""WITH a AS (SELECT doc_id, {norm} AS norm, length(coalesce(text, '')) AS size FROM documents),
b AS (SELECT *, row_number() OVER o AS place, first_value(doc_id) OVER o AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM a WINDOW o AS (PARTITION BY norm ORDER BY size DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM b"""


def _op8_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ", ".join(f"({quoted(r.text)}, {quoted(r.action)}, {quoted(r.pattern)}, {len(r.text)}, {int(r.action == 'block')})" for r in url_filter.RULES)
    rest = "substr(url, strpos(url, '://') + 3)"
    return f"""WITH v(rule, action, pattern, size, blocks) AS (VALUES {rules}),
a AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') ELSE '' END AS host,
 CASE WHEN strpos(url, '://') > 0 THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
b AS (SELECT a.*, v.*, row_number() OVER (PARTITION BY a.r ORDER BY v.size DESC, v.blocks DESC, v.rule DESC) AS place FROM a LEFT JOIN v ON regexp_matches(a.host || a.path, v.pattern))
SELECT page_id, host, path, nullif(rule, '') AS rule, coalesce(action, 'allow') AS verdict FROM b WHERE place = 1"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _op2_sql(), "quality_ablation": _ablation_sql(), "op7_exact_dedup": _op7_sql(), "op8_url_filters": _op8_sql()}
