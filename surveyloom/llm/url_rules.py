"""URL rules found by their rarest literal token.

A rule is a regular expression over ``host + path`` or over the whole url, with a verdict. Its literal tokens are those
runs of letters and digits that every matching url must hold as whole tokens. The rule is filed under the one that the
urls at hand hold least often. A url's tokens fetch the rules filed under them, and only these run their expressions.
Rules without a whole literal token are filed under the empty token, which every url fetches.

Matching rules compete: host rules beat patterns, then the longest rule wins, then the smallest rule text.
Where none matches, the verdict is the default.

Cases: a null url, or one without ``://``, has empty host and path; patterns see the url itself (null: empty). Null ids and
repeated rows come back as often as they came in. Empty tables and rule lists are fine. Other columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.schema import require_columns

ALLOW, BLOCK = "allow", "block"

# A rule table of at most this size (rules, each of at most MAX_RULE_CHARS) is broadcast; a larger one is joined by shuffle.
MAX_BROADCAST_RULES = 20_000
MAX_RULE_CHARS = 500


@dataclass(frozen=True)
class Rule:
    text: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    on_host_path: bool


def host_rule(verdict: str, text: str) -> Rule:
    """``host/path-prefix`` for a host and all its subdomains."""
    host, slash, rest = text.partition("/")
    path = slash + rest
    tokens = re.findall(r"[A-Za-z0-9]+", host)
    tokens += re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)  # the last run may go on in the url
    return Rule(text, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", verdict, tuple(tokens), True)


def phrase_rule(verdict: str, phrase: str) -> Rule:
    """Words (joined by ``-``, ``_``, ``.`` or ``/``) that stand in the url as whole tokens."""
    words = phrase.split()
    pattern = r"(?i)(?<![A-Za-z0-9])" + "[-_./]".join(map(re.escape, words)) + r"(?![A-Za-z0-9])"
    return Rule(phrase, pattern, verdict, tuple(w.lower() for w in words), False)


# The site rules of the production query.
SITE_RULES = (
    host_rule(ALLOW, "org/"),
    host_rule(BLOCK, "example.org/es/"),
    host_rule(BLOCK, "example.org/en/1"),
    host_rule(ALLOW, "com/fr/"),
    host_rule(BLOCK, "com/de/"),
)

# Phrases whose sites are not wanted.
SPAM_PHRASES = (
    "spam farm", "link farm", "cheap pills", "online pharmacy", "free casino", "casino bonus", "online casino", "payday loan",
    "adult dating", "free porn", "xxx", "buy followers", "replica watches", "essay writing service", "weight loss miracle",
)
PATTERN_RULES = tuple(phrase_rule(BLOCK, p) for p in SPAM_PHRASES)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(text: Column) -> Column:
    """Distinct runs of letters and digits in lower case, and the empty token."""
    runs = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.concat(F.array(F.lit("")), runs))


def _rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    """The rules as rows, with their tokens; made on the JVM side."""
    empty = "array<struct<rule:string,pattern:string,verdict:string,tokens:array<string>,on_host_path:boolean>>"
    rows = [
        F.struct(
            F.lit(r.text).alias("rule"),
            F.lit(r.pattern).alias("pattern"),
            F.lit(r.verdict).alias("verdict"),
            F.array(F.lit(""), *[F.lit(t.lower()) for t in r.tokens]).alias("tokens"),
            F.lit(r.on_host_path).alias("on_host_path"),
        )
        for r in rules
    ]
    whole = F.array(*rows) if rows else F.array().cast(empty)
    return spark.range(1).select(F.inline(whole))


def rarest_token_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` with the token each is filed under. ``urls`` has a column ``tokens``.

    The counts cover all urls. The empty token is left to rules that have no other.
    """
    wanted = rules.select(F.explode("tokens").alias("token")).where("token != ''").distinct()
    seen = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    counts = wanted.join(seen, "token", "left").select("token", F.coalesce("urls", F.lit(0)).alias("urls"))
    each = rules.withColumn("token", F.explode("tokens")).join(counts, "token", "left")
    # The empty token has no count and goes last; ties go to the longer, then the smaller token.
    order = F.struct(F.coalesce("urls", F.lit(2**62)), -F.length("token"), "token")
    filed = each.groupBy("rule", "pattern", "verdict", "on_host_path").agg(F.min_by("token", order).alias("token"))
    return filed


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = ALLOW,
) -> DataFrame:
    """(id, host, path, rule, verdict, matched): one row per row of ``pages``.

    ``rule`` is the host rule that won (else null), ``matched`` the text of the winning rule of either kind.
    """
    require_columns(pages, id_col, url_col)
    rows = pages.select(F.col(id_col).alias(id_col), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    # Equal rows are judged once and come back as often as they came in.
    rows = rows.groupBy(id_col, "url").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.select(id_col, "url", "copies", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("tokens", tokens_of(F.col("url")))
    table = _rule_table(pages.sparkSession, rules)
    filed = rarest_token_index(rows, table)
    if len(rules) <= MAX_BROADCAST_RULES and all(len(r.pattern) <= MAX_RULE_CHARS for r in rules):
        filed = F.broadcast(filed)
    fetched = rows.withColumn("token", F.explode("tokens")).drop("tokens").join(filed, "token", "left")
    subject = F.when(F.col("on_host_path"), F.concat("host", "path")).otherwise(F.col("url"))
    hit = F.col("pattern").isNotNull() & F.call_function("rlike", subject, F.col("pattern"))
    rank = F.struct(
        F.col("on_host_path").cast("int").alias("host_first"),
        F.length("rule").alias("length"),
        F.col("rule").alias("matched"),
        F.col("verdict").alias("verdict"),
    )
    # A url's rows lie together, so the map-side half of this aggregation leaves one row per url.
    best = fetched.groupBy(id_col, "url", "copies", "host", "path").agg(F.max(F.when(hit, rank)).alias("best"))
    out = best.select(
        id_col, "host", "path",
        F.when(F.col("best.host_first") == 1, F.col("best.matched")).alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
        F.col("best.matched").alias("matched"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    return out.drop("copy")
