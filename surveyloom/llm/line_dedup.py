"""Line dedup by overlapping windows of consecutive lines.

A window is ``width`` consecutive lines; texts with fewer lines have none. A window that occurred before,
earlier in the order (id, line), marks its lines; marked lines of overlapping windows merge, and what is not marked
stays. Windows are compared by 128 bits of hash over the lines as they are.

Cases: null text is empty text (one empty line). Null ids come first in the order. Rows equal in id and text are copies of
one row: none of them counts as earlier than another, and all get the same result. Rows with one id and different texts
are ordered by a hash of the text. An empty table gives an empty table. Other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.columns import let, row_digest, same, spare_names, text_of
from surveyloom.schema import require_columns


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _window_hashes(text: Column, width: int) -> Column:
    """One struct (line, a, b) per window."""

    def of(lines: Column) -> Column:
        def at(i: Column) -> Column:
            parts = [lines[i + k] for k in range(width)]
            return F.struct(
                i.alias("line"), F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(29), *parts).alias("b")
            )

        return F.when(F.size(lines) >= width, F.transform(F.sequence(F.lit(0), F.size(lines) - width), at))

    return let(_lines(text), of)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc, digest, lines): per row the first lines of its windows that occurred before, in ascending order."""
    require_columns(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc"), text_of(text_col).alias("body"))
    rows = rows.select("doc", row_digest(F.col("doc"), F.col("body")).alias("digest"), "body")
    found = rows.select("doc", "digest", F.explode(_window_hashes(F.col("body"), width)).alias("w"))
    found = found.select("doc", "digest", "w.line", "w.a", "w.b")
    place = F.struct("doc", "digest", "line")
    # Partial minima leave the map side, so a window held by a third of all rows is a few rows per task here.
    firsts = (
        found.groupBy("a", "b")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first < last")
        .select(F.col("a").alias("fa"), F.col("b").alias("fb"), "first")
    )
    later = found.join(firsts, (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb"))).where(place > F.col("first"))
    return later.groupBy("doc", "digest").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    total_col: str = "n_lines",
    removed_col: str = "n_removed",
) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and two more columns (replacing any of the same name)."""
    digest, starts, hit_doc, hit_digest, done = spare_names(docs, "row_digest", "window_starts", "hit_doc", "hit_digest", "line_result")
    hits = repeated_windows(docs, id_col, text_col, width).select(
        F.col("doc").alias(hit_doc), F.col("digest").alias(hit_digest), F.col("lines").alias(starts)
    )
    keyed = docs.withColumn(digest, row_digest(F.col(id_col), text_of(text_col)))
    joined = keyed.join(hits, same(keyed, hits, [(id_col, hit_doc), (digest, hit_digest)]), "left")
    marked = F.array_distinct(
        F.flatten(F.transform(F.col(starts), lambda s: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: s + k)))
    )

    def cut(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), marked)
        return F.struct(
            F.array_join(F.transform(stay, lambda i: lines[i]), "\n").alias("text"),
            F.size(lines).cast("long").alias("total"),
            F.size(marked).cast("long").alias("removed"),
        )

    whole = F.struct(
        text_of(text_col).alias("text"), F.size(_lines(text_of(text_col))).cast("long").alias("total"), F.lit(0).cast("long").alias("removed")
    )
    joined = joined.withColumn(done, F.when(F.col(starts).isNull(), whole).otherwise(let(_lines(text_of(text_col)), cut)))
    added = {text_col: F.col(f"{done}.text"), total_col: F.col(f"{done}.total"), removed_col: F.col(f"{done}.removed")}
    names = [c for c in docs.columns if c not in (total_col, removed_col)] + [total_col, removed_col]
    return joined.select(*[added[c].alias(c) if c in added else F.col(c) for c in names])
