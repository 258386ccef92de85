"""Quality rules per document and per host.

Each document is measured on its own. Failures are then counted by host, each host's failure rate is shrunk towards
the rate of all hosts by a beta prior fitted to the hosts' rates by moments, and hosts whose shrunk rate is too high
take all their documents with them.

Words are runs outside space and the control characters 9 to 13. ``n_repeat_words`` counts the words covered by windows of
three words that occur at least twice in the text; windows are compared by 64 bits of hash within one text.

Cases: a null text has no word and one empty line. A null host is no host: such documents are judged on their own.
Repeated rows and null ids are rows like any other. An empty table gives an empty table. With fewer than two hosts, or
hosts of one rate, the prior has no spread and every host gets the common rate. Other columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.columns import let, text_of
from surveyloom.schema import require_columns
from surveyloom.session import materialize

SPACE = r"\x20\x09-\x0D"
SYMBOLS = r"[#*$%&|<>]"


def _repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that occur at least twice."""

    def windows(w: Column) -> Column:
        def at(i: Column) -> Column:
            return F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))

        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), at))

    def repeated(s: Column) -> Column:
        """Places of windows that equal a neighbour in hash order."""
        last = F.size(s) - 1
        near = F.filter(
            F.sequence(F.lit(0), last),
            lambda k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == s[k]["h"]))
            | ((k < last) & (s[F.least(k + 1, last)]["h"] == s[k]["h"])),
        )
        return F.sort_array(F.transform(near, lambda k: s[k]["i"]))

    def covered(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), p, lambda b, a: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g)

    return F.when(F.size(words) >= 3, let(let(let(words, windows), repeated), covered)).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), a row per document and no shuffle."""
    require_columns(docs, id_col, text_col, host_col)
    rows = docs.select(F.col(id_col), F.col(host_col).alias("host"), text_of(text_col).alias("body"))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).alias("n_repeat_words"),
        )

    words = F.filter(F.split("body", f"[{SPACE}]+", -1), lambda w: w != "")
    filled = F.filter(F.split("body", "\n", -1), lambda x: F.call_function("rlike", x, F.lit(f"[^{SPACE}]")))
    rows = rows.select(
        id_col, "host",
        let(words, of).alias("m"),
        F.regexp_count("body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(filled, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    return rows.select(id_col, "host", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words")


@dataclass(frozen=True)
class BetaPrior:
    failures: float
    passes: float

    def rate(self, failed: Column, total: Column) -> Column:
        return (failed + self.failures) / (total + self.failures + self.passes)


#: Strength of the prior where hosts do not differ, in documents; no host has so many.
FIRM = 1e12


def fit_prior(hosts: DataFrame) -> BetaPrior:
    """Beta prior with the mean and variance of the hosts' rates; ``hosts`` has ``docs`` and ``failed``."""
    rate = F.col("failed") / F.col("docs")
    mean, var = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    if mean is None:
        return BetaPrior(1.0, 1.0)
    strength = mean * (1 - mean) / var - 1 if var and mean * (1 - mean) > var else FIRM
    return BetaPrior(mean * strength, (1 - mean) * strength)


def host_verdicts(judged: DataFrame, max_rate: float) -> DataFrame:
    """(host, docs, failed, rate, host_failed) of documents with ``host`` and boolean ``base_failed``."""
    hosts = (
        judged.where("host is not null")
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    )
    rate = fit_prior(hosts).rate(F.col("failed"), F.col("docs"))
    return hosts.select("host", "docs", "failed", rate.alias("rate"), (rate > max_rate).alias("host_failed"))


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def judge_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    failed: Column | None = None,
    max_rate: float = 0.5,
) -> DataFrame:
    """The measures with ``base_failed`` and ``kept``. The measures are stored once, for the count and the join."""
    rows = measure(docs, id_col, text_col, host_col)
    rows = rows.withColumn("base_failed", base_failed() if failed is None else failed)
    rows = materialize(rows, "quality")
    # Only the hosts that fail take part; their number is unknown, so adaptive execution picks the join by its size.
    bad = host_verdicts(rows, max_rate).where("host_failed").select(F.col("host").alias("bad_host"))
    joined = rows.join(bad, rows["host"] == bad["bad_host"], "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("bad_host").isNull()).drop("bad_host")
