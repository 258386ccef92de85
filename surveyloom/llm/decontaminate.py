"""Benchmark decontamination with spaced seeds.

A mask is a set of word offsets; words between them are ignored, so a seed still hits where one of those was replaced. Every
place of every benchmark item gives a hash per mask, and so does every place of a document whose masked words all occur
in the benchmark. Equal hashes are hits; each names an item and a shift between document and item. Around a hit, words are
compared along that shift without gaps, and the longest stretch that begins and ends with equal words and agrees in
at least ``agree`` of its words counts. A document is contaminated if such a stretch has ``least`` words (or the item's, if
it has fewer).

With the masks below, every stretch of 12 words with 2 replaced, 15 with 3 or 16 with 3 holds a hit (the tests try all).
Items of fewer than 12 words count as a whole only, so they have masks by their size, laid at their first word: the words between the first and the last are cut into one group more
than may be replaced, and each mask takes one group (all but a part of it for 5 words).

The benchmark is taken in blocks of bounded size, each sent to the tasks; the documents are scanned once per block and
are not shuffled. Only hits travel.

Words are runs between white space, lower-cased, without what is neither letter nor digit; runs with none are no words.

Cases: null and empty texts are clean. Items with fewer than ``short`` words are too short to tell and match nothing.
Items of one text match alike, and the smallest item id is reported, null as the last. Rows equal in id and text get the same result. Null
ids are ids, of items too. Text of one repeated word meets an item of such text at each shift once, however many places agree. Empty tables on either side are fine. Further columns of documents pass through ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.llm.arrow_text import Words, lean_slices, split_words
from surveyloom.llm.columns import row_digest, same, spare_names, text_of
from surveyloom.schema import require_columns
from surveyloom.session import materialize

MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 3, 7, 9, 10), (0, 1, 5, 6, 8, 9), (0, 1, 2, 3, 4, 6))
#: By the number of words of an item: first, last and, of the groups that the others are cut into, one or (5 words) all but one.
SHORT_MASKS = {
    5: ((0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4)),
    6: ((0, 1, 2, 5), (0, 3, 4, 5)),
    7: ((0, 1, 2, 3, 6), (0, 4, 5, 6)),
    8: ((0, 1, 2, 3, 7), (0, 4, 5, 6, 7)),
    9: ((0, 1, 2, 3, 4, 8), (0, 5, 6, 7, 8)),
    10: ((0, 1, 2, 3, 9), (0, 4, 5, 6, 9), (0, 7, 8, 9)),
    11: ((0, 1, 2, 3, 10), (0, 4, 5, 6, 10), (0, 7, 8, 9, 10)),
}
BLOCK_CHARS = 4 << 20  # characters of items in a block
HIT_CHUNK = 1 << 20  # hits that are looked at together


@dataclass(frozen=True)
class Rules:
    least: int = 12
    agree: Fraction = Fraction(4, 5)
    short: int = 5


def normal_words(texts: pa.Array) -> Words:
    """The words of each text in their compared form; codes of different raw words may share a form."""
    words = split_words(texts)
    low = pc.replace_substring_regex(pc.utf8_lower(words.vocabulary), r"[^\p{L}\p{N}]+", "")
    words.vocabulary = low
    return words.keep(pc.not_equal(low, "").to_numpy(zero_copy_only=False)[words.codes])


def seed_hash(ids: np.ndarray, at: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(at), salt, np.uint64)
        for offset in mask:
            h = (h ^ ids[at + offset].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _seeds(ids: np.ndarray, texts: np.ndarray, mask: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose masked words are all known and lie in one text, and their hashes. Known words have ids above 0."""
    last = mask[-1]
    at = np.flatnonzero(ids[: max(0, len(ids) - last)] > 0)
    for offset in mask[1:]:
        at = at[ids[at + offset] > 0]
    at = at[texts[at] == texts[at + last]]
    return at, seed_hash(ids, at, mask, salt)


def _runs(at: np.ndarray, h: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first place, number of places) of neighbouring places of one text that share a hash."""
    if not len(at):
        return h, at, at
    opens = np.concatenate(([True], (np.diff(at) != 1) | (h[1:] != h[:-1]) | (texts[1:] != texts[:-1])))
    begin = np.flatnonzero(opens)
    return h[begin], at[begin], np.diff(np.append(begin, len(at)))


class Block:
    """Some benchmark items, ready to be matched."""

    def __init__(self, item_ids: list[tuple[int, int | None]], texts: list[str], rules: Rules):
        words = normal_words(pa.array(texts, pa.string()))
        forms = words.vocabulary.dictionary_encode()
        self.known = forms.dictionary
        self.rules, self.item_ids = rules, item_ids  # (number, id) of each
        self.ids = (forms.indices.to_numpy(zero_copy_only=False)[words.codes] + 1).astype(np.int32)
        self.starts = words.starts
        sizes = np.diff(words.starts)
        whole = [(n, m) for n, masks in SHORT_MASKS.items() if n >= rules.short and (sizes == n).any() for m in masks]
        self.masks = [*MASKS, *(m for _, m in whole)]
        enough = sizes >= rules.short
        items = words.texts
        self.tables = []
        for salt, (size, mask) in enumerate([*((None, m) for m in MASKS), *whole]):
            at, h = _seeds(self.ids, items, mask, salt)
            used = enough[items[at]] if size is None else (sizes[items[at]] == size) & (at == words.starts[items[at]])
            at, h = at[used], h[used]
            h, first, size = _runs(at, h, items[at])
            order = np.argsort(h, kind="stable")
            self.tables.append((h[order], first[order], size[order]))
        self.items = items

    def shifts(self, ids: np.ndarray, texts: np.ndarray) -> Iterator[np.ndarray]:
        """Numbers of (text, item, shift) with a hit, in chunks, each sorted and without repeats.

        Neighbouring places of one hash are a run, in documents and items. Two runs meet at as many shifts as both have places together, less one, so
        text that repeats itself costs its length and not its square.
        """
        for salt, (mask, (hashes, first, size)) in enumerate(zip(self.masks, self.tables, strict=True)):
            at, h = _seeds(ids, texts, mask, salt)
            h, begin, length = _runs(at, h, texts[at])
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            some = low < high
            begin, length, low, count = begin[some], length[some], low[some], (high - low)[some]
            ends = np.cumsum(count)
            done = 0
            while done < len(begin):
                before = ends[done - 1] if done else 0
                stop = max(done + 1, int(np.searchsorted(ends, before + HIT_CHUNK, "right")))
                part = count[done:stop]
                k = np.repeat(low[done:stop], part) + np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
                place, many = np.repeat(begin[done:stop], part), np.repeat(length[done:stop], part)
                least, width = place - (first[k] + size[k] - 1), many + size[k] - 1
                text, item = texts[place], self.items[first[k]]
                each = np.repeat(least, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                yield np.unique(np.repeat(text * len(self.item_ids) + item, width) * (len(ids) + len(self.ids)) + each + len(self.ids))
                done = stop

    def named(self, number: np.ndarray, words: int) -> list[tuple[int, int, int]]:
        """The (text, item, shift) that a number stands for, in texts of so many words."""
        pair, shift = np.divmod(number, words + len(self.ids))
        return list(zip(*(x.tolist() for x in np.divmod(pair, len(self.item_ids))), (shift - len(self.ids)).tolist(), strict=True))

    def find(self, words: Words) -> list[tuple[int, int, int, int]]:
        """(text, item number, item id, words, equal words) of the stretches that count, the longest per text and item."""
        place = pc.index_in(words.vocabulary, value_set=self.known)
        ids = (pc.fill_null(place, -1).to_numpy(zero_copy_only=False) + 1).astype(np.int32)[words.codes]
        texts = words.texts
        best: dict[tuple[int, int], tuple[int, int]] = {}
        seen = np.empty(0, np.int64)
        for numbers in self.shifts(ids, texts):
            new = np.setdiff1d(numbers, seen, assume_unique=True)
            seen = np.union1d(seen, new)
            for text, item, shift in self.named(new, len(ids)):
                a, b = int(self.starts[item]), int(self.starts[item + 1])
                low = max(a, int(words.starts[text]) - shift)
                high = min(b, int(words.starts[text + 1]) - shift)
                have = best.get((text, item), (0, 0))
                if high - low < max(have[0], min(self.rules.least, b - a)) or have[1] == b - a:
                    continue  # no stretch of this shift can be longer
                equal = self.ids[low:high] == ids[low + shift : high + shift]
                stretch, agreed = longest_stretch(equal, self.rules.agree)
                if stretch >= min(self.rules.least, b - a) and (stretch, agreed) > have:
                    best[text, item] = (stretch, agreed)
        return [(text, *self.item_ids[item], *size) for (text, item), size in best.items()]


def longest_stretch(equal: np.ndarray, agree: Fraction) -> tuple[int, int]:
    """Length and equal words of the longest stretch that begins and ends with an equal word and agrees enough."""
    total = np.concatenate(([0], np.cumsum(equal)))
    score = agree.denominator * total - agree.numerator * np.arange(len(total))
    opens, closes = np.flatnonzero(equal), np.flatnonzero(equal) + 1
    if not len(opens):
        return 0, 0
    # A stretch (a, b) agrees enough if score[b] >= score[a]. The first open with a score that low is the best one for b.
    lowest = np.minimum.accumulate(score[opens])
    first = np.searchsorted(-lowest, -score[closes], "left")
    length = closes - opens[np.minimum(first, len(opens) - 1)]
    length[first >= len(opens)] = 0
    k = int(np.argmax(length))
    return int(length[k]), int(total[closes[k]] - total[closes[k] - length[k]])


_HITS = T.StructType(
    [
        T.StructField("doc", T.LongType()),
        T.StructField("digest", T.LongType()),
        T.StructField("number", T.LongType()),
        T.StructField("item", T.LongType()),
        T.StructField("overlap", T.IntegerType()),
        T.StructField("agreed", T.IntegerType()),
    ]
)


def _match(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        for batch in lean_slices(batches):
            found = items.find(normal_words(batch.column("text")))
            if found:
                at = pa.array([f[0] for f in found])
                columns = [batch.column("doc").take(at), batch.column("digest").take(at)]
                columns += [pa.array([f[k] for f in found], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()), (4, pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in _HITS])

    return run


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, rules: Rules, block_chars: int) -> Iterator[Block]:
    """The items in blocks of about ``block_chars`` characters, each collected on its own."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), text_of(text_col).alias("text"))
    items = items.select(F.xxhash64("item", "text").alias("number"), "item", "text").dropDuplicates(["number"])
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for k in range(blocks):
        part = items.where(F.pmod("number", F.lit(blocks)) == k).orderBy("item", "number").collect()
        yield Block([(r["number"], r["item"]) for r in part], [r["text"] for r in part], rules)


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rules: Rules = Rules(),
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc, digest, number, item, overlap, agreed): a row per document and item that overlap, stored. ``number`` tells items of one id or of none apart."""
    require_columns(docs, id_col, text_col)
    require_columns(benchmark, item_col, item_text_col)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text"))
    rows = rows.select("doc", row_digest(F.col("doc"), F.col("text")).alias("digest"), "text")
    found = spark.createDataFrame([], _HITS)
    for block in benchmark_blocks(benchmark, item_col, item_text_col, rules, block_chars):
        sent = spark.sparkContext.broadcast(block)
        found = found.union(materialize(rows.mapInArrow(_match(sent), _HITS), "benchmark-hits"))
    return found.distinct()


def contaminated_documents(overlaps: DataFrame) -> DataFrame:
    """(doc, digest, n_items, item, overlap, agreed): one row per contaminated document with its longest overlap."""
    longest = F.struct(F.col("overlap"), F.col("agreed"), F.col("item").isNotNull().alias("known"), (-F.col("item")).alias("back"))
    return (
        overlaps.groupBy("doc", "digest")
        .agg(F.count_distinct("number").alias("n_items"), F.max(longest).alias("best"))
        .select("doc", "digest", "n_items", (-F.col("best.back")).alias("item"), "best.overlap", "best.agreed")
    )


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """(id, contaminated, n_items, item_id, overlap_words, equal_words): one row per document."""
    hits = contaminated_documents(find_overlaps(docs, benchmark, id_col, text_col, **more))
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), row_digest(F.col(id_col).cast("long"), text_of(text_col)).alias("row"))
    joined = rows.join(hits, same(rows, hits, [("row_id", "doc"), ("row", "digest")]), "left")
    return joined.select(
        F.col("row_id").alias(id_col),
        F.col("digest").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.col("item").alias("item_id"),
        F.coalesce("overlap", F.lit(0)).alias("overlap_words"),
        F.coalesce("agreed", F.lit(0)).alias("equal_words"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``docs`` without the contaminated rows."""
    hits = find_overlaps(docs, benchmark, id_col, text_col, **more)
    hits = hits.select(F.col("doc").alias("hit_doc"), F.col("digest").alias("hit_row")).distinct()
    [row] = spare_names(docs, "row_digest")
    keyed = docs.withColumn(row, row_digest(F.col(id_col).cast("long"), text_of(text_col)))
    return keyed.join(hits, same(keyed, hits, [(id_col, "hit_doc"), (row, "hit_row")]), "left_anti").drop(row)
