r"""URL filters: pattern rules indexed by their rarest literal token.

A rule is an action and a regular expression over host + path (the path is empty
or starts with `/`, so the two cannot be confused), with the literal tokens that
any URL it fits must contain whole. Tokens are runs of `[a-z0-9]` of the
lower-cased host and path. Each rule is filed under that of its tokens which the
fewest URLs contain; the tokens of a URL fetch candidate rules from this index,
and only those run their expressions. Of the rules that fit, the one of the
longest text wins (on a tie, block). Rules without a text, such as those on words
of a host, are not reported and give way to all others; where none fits, the
verdict is `default`.
A rule without a whole literal token is filed under the empty token, which every
URL has.

The index is a constant of the query: a table of buckets, each with the rules filed
under the tokens that hash to it. So a token finds its rules by one look-up, and no
page is shuffled. It grows with the rules given, never with the pages. Token counts
are summed map-side over all pages for the rules' own tokens only.

A null or relative URL (no `://`) has an empty host and path; very long ones are read
whole. Every row gives one row, repeated and null ids too; an empty table gives none.
No other column of the input is read.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """text: what is reported, and whose length ranks rules."""

    action: str
    text: str
    pattern: str
    tokens: tuple[str, ...]


def path_rule(action: str, text: str) -> Rule:
    """A host with all its subdomains and the start of a path, like `example.org/en/1`."""
    host, slash, path = text.partition("/")
    host, path = host.translate(str.maketrans(UPPER, LOWER)), slash + path
    # the last run of the path may go on in the URL, unless something follows it in the rule
    whole = re.sub(r"[A-Za-z0-9]+\Z", "", path)
    tokens = re.findall("[a-z0-9]+", host) + re.findall("[a-z0-9]+", whole.translate(str.maketrans(UPPER, LOWER)))
    return Rule(action, text, rf"^(?:[^/]*\.)?{_quote(host)}{_quote(path) if path else chr(40) + '?:/|' + chr(92) + 'z)'}", tuple(dict.fromkeys(tokens)))


def _quote(literal: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", literal)


def host_word_rule(action: str, word: str) -> Rule:
    """A word that stands by itself in the host."""
    return Rule(action, "", rf"^(?:[^/]*[^a-z0-9/])?{word}(?:[^a-z0-9]|\z)", (word,))


def phrase_rule(action: str, *words: str) -> Rule:
    """Words that follow each other, anywhere in host and path, with nothing but marks between."""
    return Rule(action, "", "(?:^|[^a-z0-9])" + "[^a-z0-9]+".join(words) + r"(?:[^a-z0-9]|\z)", words)


def read_rules(table: DataFrame) -> tuple[Rule, ...]:
    """Rules from a table of action and text (host and path). They are given to every task, so mind their number."""
    return tuple(path_rule(r["action"], r["text"]) for r in table.select("action", "text").collect())


#: Words that block where they stand alone in a host.
BAD_WORDS = ("casino", "casinos", "poker", "bet", "bets", "betting", "slots", "jackpot", "porn", "xxx", "adult", "escort", "escorts", "viagra", "cialis", "pills", "warez", "torrent", "torrents", "spam", "ads", "adserver", "malware", "phishing")
#: Words that block anywhere behind one of OFFERS: by themselves each may be harmless.
GOODS = ("casino", "poker", "betting", "slots", "jackpot", "lottery", "porn", "escorts", "viagra", "cialis", "pills", "steroids", "replica", "warez", "torrents", "keygen", "crack", "serial", "loan", "loans", "followers", "backlinks")
OFFERS = ("free", "online", "best", "cheap", "buy", "live", "discount", "instant", "download", "hot")
#: Pairs of words in the paths of advertisements and trackers.
SERVED = (("ad", "click"), ("ads", "click"), ("banner", "click"), ("pixel", "track"), ("track", "click"), ("popup", "ad"), ("wp", "login"), ("affiliate", "redirect"))
#: Fixed values of the contract, then the method's own rules.
RULES = (
    path_rule("allow", "org/"),
    path_rule("block", "example.org/es/"),
    path_rule("block", "example.org/en/1"),
    path_rule("allow", "com/fr/"),
    path_rule("block", "com/de/"),
    *(host_word_rule("block", w) for w in BAD_WORDS),
    *(phrase_rule("block", offer, good) for offer in OFFERS for good in GOODS),
    *(phrase_rule("block", *pair) for pair in SERVED),
)


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end; A-Z lower-cased."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(u, locate('://', u) + 3)"))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule (null where none fits), verdict."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("u"))
    rows = rows.withColumn("host", host_of(F.col("u"))).withColumn("path", F.when(F.locate("://", F.col("u")) > 0, F.regexp_extract(F.expr("substring(u, locate('://', u) + 3)"), r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(""))
    address = F.concat("host", "path")
    tokens = F.array_distinct(F.split(F.translate(address, UPPER, LOWER), "[^a-z0-9]+"))
    rows = rows.select("page_id", "host", "path", address.alias("address"), F.array_union(tokens, F.array(F.lit(""))).alias("tokens"))
    index, size = rule_index(spark, rules, rows)
    here = F.from_json(F.lit(index), f"array<array<{FILED}>>")
    fetched = F.flatten(F.transform("tokens", lambda t: F.filter(F.get(here, bucket_of(t, size)), lambda r: r["token"] == t)))
    fits = F.filter(fetched, lambda r: F.call_function("regexp_like", F.col("address"), r["pattern"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["length"], r["blocks"], r["rule"], r["action"])))
    judged = rows.select("page_id", "host", "path", best.alias("best"))
    return judged.select("page_id", "host", "path", F.when(F.col("best.rule") != "", F.col("best.rule")).alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


#: A rule in the index.
FILED = "struct<token: string, rule: string, action: string, pattern: string, length: int, blocks: int>"


def bucket_of(token: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(size)).cast("int")


def rarest_tokens(spark: SparkSession, rules: tuple[Rule, ...], rows: DataFrame) -> list[str]:
    """For each rule, that of its tokens which the fewest rows contain; of equally rare ones the first by name."""
    literal = sorted({t for r in rules for t in r.tokens})
    counts = rows.select(F.explode("tokens").alias("token")).filter(F.col("token").isin(literal)).groupBy("token").agg(F.count("*").alias("n"))
    n = {r["token"]: r["n"] for r in counts.collect()}  # as many as the rules have tokens
    return [min(r.tokens, key=lambda t: (n.get(t, 0), t), default="") for r in rules]


def rule_index(spark: SparkSession, rules: tuple[Rule, ...], rows: DataFrame) -> tuple[str, int]:
    """The buckets as JSON, and their number: each rule under its rarest token."""
    size = 1 << max(4, (2 * len(rules)).bit_length())
    filed = rarest_tokens(spark, rules, rows)
    place = {r["t"]: r["b"] for r in spark.createDataFrame([(t,) for t in sorted(set(filed))], "t string").select("t", bucket_of(F.col("t"), size).alias("b")).collect()}
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for rule, token in zip(rules, filed, strict=True):
        buckets[place[token]].append({"token": token, "rule": rule.text, "action": rule.action, "pattern": rule.pattern, "length": len(rule.text), "blocks": int(rule.action == "block")})
    return json.dumps(buckets), size
