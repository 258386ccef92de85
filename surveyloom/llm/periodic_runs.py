"""Periodic runs of words: found in tiles of every scale, stitched per document and period, and collapsed.

Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A run is a stretch of at least ``LEAST_WORDS`` words, and at least ``LEAST_TIMES`` times its
smallest period q, in which words q apart are equal and which no neighbouring word extends. Collapsing drops each word that
lies in a run behind that run's first q words; the words left are joined by one space.

Scales: periods are searched by octave, q from S to 2S - 1 (from 1 to 7 and 8 to 15 with S = 8). Each octave has a boundary every S words. A run of
an octave holds a boundary b with b + q + S words inside, so only boundaries whose S words return q words later are looked
at; equal words have equal block hashes, so that choice loses nothing. Neighbouring boundaries form a tile, a row of
its own with the words around them; tiles overlap and are dealt to tasks regardless of their document, so a long text is the work
of many. In a tile, a Z-function forward from each boundary tells how far q-periodicity goes to the right, and one of the
reversed words how far to the left; roots that are powers of a shorter word are left to the shorter period.

Stitching: fragments of one run in neighbouring places overlap by at least q words, those of different runs of the same period by less.
Fragments are shuffled by document and period, joined where they overlap so far, and judged by their full length. To be collapsed, texts meet
their runs by one shuffled hash join at every size: runs grow with the texts, so they are never broadcast, and texts aren't sorted.

Cases: null and empty texts have no words and no runs, and null is kept as empty text. A null id is an id. Rows that agree in id and text are
copies and get the same result, each on its own row. Texts of any length and of one repeated word are fine: work grows
with words times octaves. Empty tables are fine. Result columns replace columns of the same name; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.arrow_text import slices, split_words
from surveyloom.llm.columns import text_of
from surveyloom.schema import require_columns
from surveyloom.session import materialize

LEAST_TIMES = 3
SMALLEST = 8  # words between boundaries at the finest scale
LEAST_WORDS = LEAST_TIMES * SMALLEST
#: Boundaries in a tile, pairs of places compared at once, and bytes of text handled at once.
TILE = 16
PAIRS = 1 << 20
SLICE = 4 << 20

TILES = "id {0}, digest long, step long, low long, first long, origin long, length long, boundaries long, codes binary"
RUNS = "array<struct<start:long,length:long,period:long>>"


def octaves(longest: int) -> Iterator[tuple[int, int]]:
    """(step, least period): periods from there to below twice the step (below the step, for the first)."""
    yield SMALLEST, 1
    step = SMALLEST
    while LEAST_TIMES * step <= longest:
        yield step, step
        step *= 2


def above(step: int, low: int) -> int:
    return step if low < step else 2 * step


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _doubled(blocks: np.ndarray, size: int) -> np.ndarray:
    """Hashes of blocks of twice ``size`` words from those of ``size``; those that would pass the end are of no use."""
    if len(blocks) <= size:
        return blocks
    return np.concatenate([_mixed(blocks[:-size], blocks[size:]), blocks[-size:]])


def returning(blocks: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, boundary) of all boundaries whose block of ``step`` words is found again at a period of the octave."""
    fit = np.where(sizes >= max(LEAST_WORDS, LEAST_TIMES * low), (sizes - low - step) // step + 1, 0)
    text = np.repeat(np.arange(len(sizes)), fit)
    local = (np.arange(len(text)) - np.repeat(np.cumsum(fit) - fit, fit)) * step
    periods = np.arange(low, above(step, low))
    hit = np.zeros(len(text), bool)
    rows = max(1, PAIRS // len(periods))
    for a in range(0, len(text), rows):
        part = slice(a, a + rows)
        at = (starts[text[part]] + local[part])[:, None]
        room = (sizes[text[part]] - local[part] - step)[:, None]
        later = np.minimum(at + periods, len(blocks) - 1)
        hit[part] = ((blocks[later] == blocks[at]) & (periods <= room)).any(axis=1)
    return text[hit], local[hit]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "digest", "step", "low", "first", "origin", "length", "boundaries", "codes"]
    for batch in slices(batches, most=SLICE):
        words = split_words(batch.column("text"))
        words = words.keep(pc.not_equal(words.vocabulary, "").to_numpy(zero_copy_only=False)[words.codes])
        codes, starts = words.codes.astype(np.int32), words.starts[:-1]
        sizes = np.diff(words.starts)
        if not len(codes) or sizes.max() < LEAST_WORDS:
            continue
        blocks = _mixed(codes.astype(np.uint64) + np.uint64(1), np.full(len(codes), 7, np.uint64))
        held = 1
        for step, low in octaves(int(sizes.max())):
            while held < step:
                blocks, held = _doubled(blocks, held), 2 * held
            text, local = returning(blocks, starts, sizes, step, low)
            if not len(text):
                continue
            breaks = np.flatnonzero((np.diff(text) != 0) | (np.diff(local) != step)) + 1
            edges = [0, *breaks.tolist(), len(text)]
            cuts = [a for lo, hi in zip(edges, edges[1:], strict=False) for a in range(lo, hi, TILE)]
            ends = [min(a + TILE, hi) for lo, hi in zip(edges, edges[1:], strict=False) for a in range(lo, hi, TILE)]
            doc, first, last = text[cuts], local[cuts], local[np.array(ends) - 1]
            origin, stop = np.maximum(0, first - step), np.minimum(sizes[doc], last + 4 * step)
            held_words = [codes[starts[d] + a : starts[d] + b].tobytes() for d, a, b in zip(doc, origin, stop, strict=True)]
            rows = pa.array(doc)
            numbers = [np.full(len(doc), step), np.full(len(doc), low), first, origin, stop - origin, (last - first) // step + 1]
            cols = [batch.column("id").take(rows), batch.column("digest").take(rows), *(pa.array(x.astype(np.int64)) for x in numbers)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(held_words, pa.binary())], names=names)


def z_function(word: list[int]) -> list[int]:
    """For each place, how many elements from there on equal the beginning."""
    n = len(word)
    out = [0] * n
    if n:
        out[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < n and word[k] == word[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        out[i] = k
    return out


def prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def around(words: list[int], b: int, step: int, low: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the periodic stretches through boundary ``b`` for the periods of the octave, seen as far
    as ``step`` words to the left and four times as many to the right; stretches of less than two periods are left out."""
    ahead = z_function(words[b : b + 4 * step])
    back: list[int] = []
    out = []
    begin, high = max(0, b - step), above(step, low)
    for q in range(low, min(high, len(ahead))):
        right = ahead[q]
        if right < step:
            continue
        if any(ahead[q // p] >= q - q // p for p in prime_factors(q)):
            continue  # the root is a power: the shorter period finds it
        if not back:
            pattern = words[begin:b][::-1]
            back = z_function([*pattern, -1, *words[begin : b + high][::-1]])[len(pattern) + 1 :]
            past = min(b + high, len(words))
        left = min(back[past - (b + q)], b - begin) if b > begin else 0
        if left + right >= q:
            out.append((q, b - left, b + q + right))
    return out


def solve(words: list[int], first: int, boundaries: int, step: int, low: int) -> list[tuple[int, int, int]]:
    """The stretches of a tile; those that several of its boundaries see are put together."""
    out: list[tuple[int, int, int]] = []
    last: dict[int, int] = {}  # period -> its latest stretch in ``out``
    for b in range(first, first + boundaries * step, step):
        for q, start, end in around(words, b, step, low):
            k = last.get(q)
            if k is not None and start + q <= out[k][2]:
                out[k] = (q, min(start, out[k][1]), max(end, out[k][2]))
            else:
                last[q] = len(out)
                out.append((q, start, end))
    return out


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner: list[int] = []
        found: list[tuple[int, int, int]] = []
        numbers = [batch.column(c).to_pylist() for c in ("step", "low", "first", "origin", "boundaries")]
        for row, (step, low, first, origin, boundaries) in enumerate(zip(*numbers, strict=True)):
            words = np.frombuffer(batch.column("codes")[row].as_buffer(), np.int32).tolist()
            for q, start, end in solve(words, first - origin, boundaries, step, low):
                owner.append(row)
                found.append((q, origin + start, origin + end))
        if found:
            rows = pa.array(owner)
            period, start, end = (pa.array(x, pa.int64()) for x in zip(*found, strict=True))
            cols = [batch.column("id").take(rows), batch.column("digest").take(rows), period, start, end]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "digest", "period", "start", "end"])


def stitch(fragments: DataFrame) -> DataFrame:
    """Fragments (id, digest, period, start, end) put together where they overlap by at least a period; runs only."""
    order = Window.partitionBy("id", "digest", "period").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") + F.col("period") > before), 1).otherwise(0)
    marked = fragments.withColumn("opens", opens)
    numbered = marked.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("id", "digest", "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start")
    runs = joined.select("id", "digest", "start", length.alias("length"), "period")
    return runs.where(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_TIMES * F.col("period")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, start, length, period) of every run; ``digest`` is the hash of the text."""
    require_columns(docs, id_col, text_col)
    keyed = _keyed(docs, id_col, text_col)
    id_type = keyed.schema["id"].dataType.simpleString()
    tiles = keyed.mapInArrow(_tiles, TILES.format(id_type))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # tiles are few bytes and much work, so none are put together
    dealt = tiles.repartition(parts, "id", "digest", "step", "low", "first")
    fragments = dealt.mapInArrow(_solve, f"id {id_type}, digest long, period long, start long, end long")
    return stitch(fragments)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=SLICE):
        lists = pc.ascii_split_whitespace(batch.column("text"))
        flat = lists.flatten()
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        before = np.concatenate(([0], np.cumsum(real)))
        starts = before[offsets - offsets[0]]  # first word of each text
        words = flat.filter(pa.array(real))
        runs = batch.column("runs")
        size = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
        start, length, period = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in runs.flatten().flatten())
        base = np.repeat(starts[:-1], size)
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, base + start + period, 1)
        np.add.at(depth, base + start + length, -1)
        kept = np.cumsum(depth[:-1]) == 0
        left = np.concatenate(([0], np.cumsum(kept)))[starts]
        texts = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.filter(pa.array(kept)))
        cols = [*batch.columns[2:], pa.array(np.diff(starts)), pc.binary_join(texts, " ")]
        yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[2:], "n_words", "kept"])


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) with ``runs`` (by start, then period), ``n_words`` and the collapsed text ``kept``."""
    results = ("runs", "n_words", "kept")
    passed = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    safe = {c: f"c{k}" for k, c in enumerate(passed)}
    each = F.collect_list(F.struct("start", "period", "length"))
    lists = find_runs(docs, id_col, text_col).groupBy("id", "digest").agg(F.array_sort(each).alias("found"))
    ordered = F.transform("found", lambda r: F.struct(r.start.alias("start"), r.length.alias("length"), r.period.alias("period")))
    runs = materialize(lists.select(F.col("id").alias("run_id"), F.col("digest").alias("run_digest"), ordered.alias("runs")), "periodic-runs")
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"), *[F.col(c).alias(s) for c, s in safe.items()])
    match = F.col("id").eqNullSafe(F.col("run_id")) & (F.col("digest") == F.col("run_digest"))
    none = F.array().cast(RUNS)
    joined = rows.join(runs.hint("shuffle_hash"), match, "left").select("text", F.coalesce("runs", none).alias("runs"), *safe.values(), F.coalesce("runs", none).alias("found"))
    schema = joined.select(*safe.values(), "found", F.lit(0).cast("long").alias("n_words"), F.lit("").alias("kept")).schema
    out = joined.mapInArrow(_collapse, schema)
    return out.select(*[F.col(s).alias(c) for c, s in safe.items()], F.col("found").alias("runs"), "n_words", "kept")
