"""Removal of byte strings that occurred before, by suffix sorting around sampled anchors.

Every byte that a string of ``WINDOW`` bytes covers which also starts earlier (at a smaller id, or earlier in the same text) is removed.

1. Each window of WINDOW bytes picks the least-hashed of its strings of ``SEED`` bytes, the leftmost of equals, as its anchor.
   Equal windows pick it at the same place, so equal windows are found where anchors are equal; about one byte in 35 is an anchor.
2. Around an anchor lie all windows that may pick it: REACH bytes to the left, WINDOW bytes to the right. Anchors are
   shuffled by their seed's hash. Of those whose surroundings agree as a whole, the first stays and the others' windows all
   occurred before. Copies within one slice of a task are settled before the shuffle.
3. Seeds that remain with several surroundings get these as bytes. The suffixes that begin at the anchors are sorted
   deep-shallow: multikey quicksort over the seed, blind tries for the groups that agree in it; the reversed left sides too.
   From the common prefixes in both orders follows, for each distance s, which anchors share s bytes to the left and
   WINDOW - s to the right; all but the first have a window that occurred before. Windows around one anchor overlap, so
   each anchor contributes one stretch.
4. Stretches are united per document and cut out.

Texts travel twice: to the anchors in question (3) and to the stretches (4), and only those of documents that a fixed-size
table of hash bits lets through. The table holds at most ``FILTER_ROWS`` rows; when it fills up, more texts travel.

Texts are compared as UTF-8 bytes, by 64-bit hashes of seed and surroundings in step 2 and byte by byte in step 3. What stays may
not be UTF-8, so it is returned as bytes. A task of step 3 holds at most the HOT_SEED distinct surroundings of one seed at once.
A seed with more, such as one at the edge of a passage that very many documents share, is not given to one task: the
WINDOW-byte strings around its anchors are grouped by 128 bits of hash instead, with partial minima before the shuffle.

Cases: null texts are empty; texts under WINDOW bytes lose nothing. Null ids come first, as the least long. Rows that
share an id are ordered by a hash of their text; rows equal in both are one document and get the same result. An empty table
gives an empty table. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.arrow_text import slices
from surveyloom.llm.columns import row_digest, text_of
from surveyloom.llm.deep_shallow import as_words, blind_order, multikey_quicksort
from surveyloom.llm.weighted_minhash import mix
from surveyloom.schema import require_columns
from surveyloom.session import materialize

WINDOW, SEED = 100, 32
REACH = WINDOW - SEED
SCAN_BYTES = 2 << 20
CHUNK_ANCHORS = 40_000
HOT_SEED = 50_000
FILTER_ROWS = 1 << 21
NO_ID = -(1 << 63)


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """A polynomial hash of the SEED bytes from each place on, by doubling."""
    h, step, factor = data.astype(np.uint64) + np.uint64(1), 1, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while step < SEED:
            h = h[:-step] * factor + h[step:]
            factor, step = factor * factor, step * 2
    return h


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the text, seed hash, surroundings hash) of every anchor of texts laid end to end."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    raw = seed_hashes(data)
    mask = np.uint64((1 << 31) - 1)
    least = (mix(raw) & ~mask) | np.arange(len(raw), dtype=np.uint64)
    width = 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    sizes = np.diff(starts)
    texts = np.repeat(np.arange(len(sizes)), np.maximum(sizes - WINDOW + 1, 0))
    first = np.cumsum(np.maximum(sizes - WINDOW + 1, 0)) - np.maximum(sizes - WINDOW + 1, 0)
    windows = np.arange(len(texts)) - first[texts] + starts[texts]
    at = (least[windows] & mask).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (texts[1:] != texts[:-1])
    at, texts = at[new], texts[new]
    low, high = np.maximum(starts[texts], at - REACH), np.minimum(starts[texts + 1], at + WINDOW)
    around = ((at - low) * (WINDOW + 1) + (high - at)).astype(np.uint64)
    with np.errstate(over="ignore"):
        for place in (*range(-REACH, WINDOW - SEED, SEED), WINDOW - SEED):
            around = mix(around * np.uint64(0xD1342543DE82EF95) + raw[np.clip(at + place, low, high - SEED)])
    return texts, at - starts[texts], mix(raw[at]), around


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts end to end, and where each begins. Texts are not null."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


_ANCHORS = "seed long, around long, doc long, row int, place int, settled boolean"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors. Those whose surroundings occurred before in the slice are settled; their seed is only a number to deal them by."""
    for batch in slices(batches):
        found = []
        for k, small in enumerate(slices(iter([batch]), most=SCAN_BYTES)):
            text, place, seed, around = anchors(*_bytes(small.column("text")))
            found.append([small.column("doc").to_numpy()[text], small.column("row").to_numpy()[text], place, seed, around])
        doc, row, place, seed, around = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((place, row, doc, around, seed))
        doc, row, place, seed, around = (c[order] for c in (doc, row, place, seed, around))
        settled = np.zeros(len(doc), bool)
        settled[1:] = (seed[1:] == seed[:-1]) & (around[1:] == around[:-1])
        same = np.zeros(len(doc), bool)  # rows that are copies of one document hold the same anchor
        same[1:] = settled[1:] & (doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (place[1:] == place[:-1])
        with np.errstate(over="ignore"):
            seed = np.where(settled, mix(doc.astype(np.uint64) * np.uint64(1_000_003) + place.astype(np.uint64)), seed)
        columns = [seed.view(np.int64), around.view(np.int64), doc, row, place.astype(np.int32), settled]
        yield pa.RecordBatch.from_arrays([pa.array(c[~same]) for c in columns], names=["seed", "around", "doc", "row", "place", "settled"])


_JUDGED = "seed long, doc long, row int, place int, known boolean"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by seed, surroundings, document and place. Out come anchors whose surroundings occurred before (known), and the first
    anchor of each of several surroundings of a seed."""
    names = ["seed", "doc", "row", "place"]
    last: list | None = None  # the last row seen: seed, around, doc, row, place
    waiting: tuple | None = None  # the first anchor of the only surroundings of the last seed so far
    for batch in batches:
        settled = batch.column("settled").to_numpy(zero_copy_only=False)
        free = batch.filter(pa.array(~settled))
        done = batch.filter(pa.array(settled))
        if done.num_rows:
            yield pa.RecordBatch.from_arrays([*(done.column(n) for n in names), pa.array(np.ones(done.num_rows, bool))], names=[*names, "known"])
        if not free.num_rows:
            continue
        seed, around, doc, row, place = (free.column(n).to_numpy() for n in ("seed", "around", "doc", "row", "place"))
        n = len(seed)
        before = last or [None] * 5
        same_seed, same_around, same_row = np.empty(n, bool), np.empty(n, bool), np.empty(n, bool)
        same_seed[0] = before[0] == seed[0]
        same_around[0] = same_seed[0] and before[1] == around[0]
        same_row[0] = same_around[0] and before[2:] == [doc[0], row[0], place[0]]
        same_seed[1:] = seed[1:] == seed[:-1]
        same_around[1:] = same_seed[1:] & (around[1:] == around[:-1])
        same_row[1:] = same_around[1:] & (doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (place[1:] == place[:-1])
        # A copy of the row before it (equal id, text and place) takes that row's part; the first of a class stays so.
        opens = ~same_around  # first anchor of its surroundings
        known = same_around & ~same_row
        heads = np.flatnonzero(opens)
        head_seed = seed[heads]
        again = np.empty(len(heads), bool)  # a head whose seed had surroundings before
        if len(heads):
            again[0] = last is not None and before[0] == head_seed[0]
            again[1:] = head_seed[1:] == head_seed[:-1]
        follows = np.append(again[1:], False)  # a head whose seed has further surroundings in this batch
        out = []
        if len(heads) and again[0] and waiting is not None:
            out.append(waiting)
            waiting = None
        several = again | follows
        chosen = heads[several]
        if len(heads):
            waiting = None if several[-1] else tuple(int(c[heads[-1]]) for c in (seed, doc, row, place))
        at = np.concatenate([np.flatnonzero(known), chosen])
        flag = np.concatenate([np.ones(int(known.sum()), bool), np.zeros(len(chosen), bool)])
        columns = [np.append(c[at], np.array([o[k] for o in out], c.dtype)) for k, c in enumerate((seed, doc, row, place))]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.append(flag, np.zeros(len(out), bool)))], names=[*names, "known"])
        last = [int(c[-1]) for c in (seed, around, doc, row, place)]


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes left (reversed) and right of the anchors asked for."""
    for batch in slices(batches):
        out: list[tuple] = []
        for doc, row, text, asked in zip(*(batch.column(n) for n in ("doc", "row", "text", "asked")), strict=True):
            data = text.as_buffer().to_pybytes()
            for a in asked.as_py():
                at = a["place"]
                out.append((a["seed"], doc.as_py(), row.as_py(), at, data[max(0, at - REACH) : at][::-1], data[at : at + WINDOW]))
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        columns = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["seed", "doc", "row", "place", "left", "right"])


def repeated_reach(left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For anchors in document order: the greatest and least s for which an earlier anchor of the same seed shares s bytes to the left
    and WINDOW - s to the right; -1 where there is none."""
    n = len(left)
    order, groups = multikey_quicksort(as_words(right, SEED))
    r_order, r_common = order.copy(), np.zeros(n, np.int64)
    l_order, l_common = order.copy(), np.full(n, -1, np.int64)
    for low, high in groups:
        members = np.sort(order[low:high])
        deep, common = blind_order([right[m] for m in members.tolist()], WINDOW)
        r_order[low:high], r_common[low:high] = members[deep], common
        r_common[low] = 0
        deep, common = blind_order([left[m] for m in members.tolist()], REACH)
        l_order[low:high], l_common[low:high] = members[deep], common
        l_common[low] = -1
    l_size, r_size = np.fromiter(map(len, left), np.int64, n), np.fromiter(map(len, right), np.int64, n)
    most, least = np.full(n, -1), np.full(n, -1)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for s in range(REACH + 1):
        r_class[r_order] = np.cumsum(r_common < WINDOW - s)
        l_class[l_order] = np.cumsum(l_common < s)
        able = np.flatnonzero((l_size >= s) & (r_size >= WINDOW - s))
        if len(able) < 2:
            continue
        key = r_class[able] * (n + 1) + l_class[able]
        by_key = np.argsort(key, kind="stable")
        later = by_key[1:][key[by_key[1:]] == key[by_key[:-1]]]
        most[able[later]] = s
        fresh = able[later][least[able[later]] < 0]
        least[fresh] = s
    return most, least


_STRETCHES = "doc long, row int, begin int, finish int"


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by seed, document and place; whole seeds are sorted together."""

    def stretches(rows: pa.Table) -> pa.RecordBatch:
        doc, row, place, seed = (rows.column(n).to_numpy() for n in ("doc", "row", "place", "seed"))
        once = np.ones(len(doc), bool)  # copies of a row ask for the same anchors
        once[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (place[1:] != place[:-1]) | (seed[1:] != seed[:-1])
        rows = rows.filter(pa.array(once))
        most, least = repeated_reach(rows.column("left").to_pylist(), rows.column("right").to_pylist())
        hit = np.flatnonzero(most >= 0)
        place = place[once][hit]
        columns = [doc[once][hit], row[once][hit], place - most[hit], place + WINDOW - least[hit]]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "row", "begin", "finish"])

    held: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        if held.num_rows >= CHUNK_ANCHORS:
            seed = held.column("seed").to_numpy()
            whole = int(np.searchsorted(seed, seed[-1], "left"))  # the last seed may go on
            if whole:
                yield stretches(held.slice(0, whole))
                held = held.slice(whole)
    if held is not None and held.num_rows:
        yield stretches(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every WINDOW-byte string around each anchor, as a hash, with its distance s to the left."""
    for batch in batches:
        for doc, row, place, left, right in zip(*(batch.column(n).to_pylist() for n in ("doc", "row", "place", "left", "right")), strict=True):
            around = left[::-1] + right
            reach = range(max(0, WINDOW - len(right)), len(left) + 1)
            whole = [xxhash.xxh3_128_intdigest(around[len(left) - s : len(left) - s + WINDOW]) for s in reach]
            raw = np.frombuffer(b"".join([w.to_bytes(16, "little") for w in whole]), np.int64).reshape(-1, 2)
            columns = [pa.array(raw[:, 0]), pa.array(raw[:, 1]), pa.array([doc] * len(raw), pa.int64())]
            columns += [pa.array([v] * len(raw), pa.int32()) for v in (row, place)] + [pa.array(list(reach), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["w1", "w2", "doc", "row", "place", "s"])


def _hot_stretches(around: DataFrame) -> DataFrame:
    """The stretches of anchors of seeds with very many surroundings, by grouping their windows."""
    windows = around.mapInArrow(_windows, "w1 long, w2 long, doc long, row int, place int, s int")
    start = F.struct("doc", "row", (F.col("place") - F.col("s")).alias("start"))
    firsts = windows.groupBy("w1", "w2").agg(F.min(start).alias("first"), F.max(start).alias("last")).where("first < last")
    firsts = firsts.select(F.col("w1").alias("f1"), F.col("w2").alias("f2"), "first")
    later = windows.join(firsts, (F.col("w1") == F.col("f1")) & (F.col("w2") == F.col("f2"))).where(start > F.col("first"))
    reach = later.groupBy("doc", "row", "place").agg(F.min("s").alias("least"), F.max("s").alias("most"))
    return reach.select("doc", "row", (F.col("place") - F.col("most")).alias("begin"), (F.col("place") + WINDOW - F.col("least")).alias("finish"))


def _with_guess(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: whether (doc, row) may be among the keys, by 64 hash bits per line of at most FILTER_ROWS lines."""
    h = F.xxhash64(F.lit(41), "doc", "row")
    line, bit = F.pmod(h, F.lit(FILTER_ROWS)).cast("int"), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    table = keys.select(line.alias("line"), one.alias("bits")).groupBy("line").agg(F.bit_or("bits").alias("bits"))
    joined = rows.withColumn("own_line", line).withColumn("own_bit", one).join(F.broadcast(table), F.col("own_line") == F.col("line"), "left")
    maybe = F.coalesce(F.col("bits").bitwiseAND(F.col("own_bit")) != 0, F.lit(False))
    return joined.select(*rows.columns, maybe.alias("maybe"))


_CUT = "doc long, row int, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for text, places, begins, ends in zip(*(batch.column(n) for n in ("text", "places", "begins", "ends")), strict=True):
            data = text.as_buffer().to_pybytes()
            places = np.array(places.as_py(), np.int64)
            low = np.concatenate([places - REACH, np.array(begins.as_py(), np.int64)])
            high = np.concatenate([places + WINDOW, np.array(ends.as_py(), np.int64)])
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, np.maximum(low, 0), 1)
            np.add.at(change, np.minimum(high, len(data)), -1)
            gone = np.cumsum(change[:-1]) > 0
            spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
            out.append((len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
        n, removed, spans, kept = zip(*out, strict=True)
        columns = [batch.column("doc"), batch.column("row"), *(pa.array(c, pa.int64()) for c in (n, removed, spans)), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "row", "n_bytes", "n_removed", "n_spans", "kept"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, row, text): the id with null as NO_ID, 31 bits of a digest that orders rows of one id, and the text."""
    digest: Column = F.col("digest").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("digest", row_digest(F.col("id"), F.col("text")))
    return rows.select(F.coalesce("id", F.lit(NO_ID)).alias("doc"), digest.alias("row"), "text")


def repeated_stretches(rows: DataFrame) -> DataFrame:
    """(doc, row, places, begins, ends) per document with repeats: anchors all of whose windows occurred before, and single stretches."""
    order = ["seed", "around", "doc", "row", "place"]
    found = rows.where(F.octet_length("text") >= WINDOW).mapInArrow(_scan, _ANCHORS)
    judged = found.repartition("seed").sortWithinPartitions(*order).mapInArrow(_judge, _JUDGED)
    judged = materialize(judged, "suffix-anchors")
    open_ = judged.where(~F.col("known"))
    hot = open_.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_SEED).select(F.col("seed").alias("hot_seed"))
    hot = materialize(hot, "suffix-hot")
    asked = open_.groupBy("doc", "row").agg(F.collect_list(F.struct("seed", "place")).alias("asked"))
    asked = asked.withColumnsRenamed({"doc": "ad", "row": "ar"})
    texts = _with_guess(rows, open_.select("doc", "row")).where("maybe")
    texts = texts.join(asked, (F.col("doc") == F.col("ad")) & (F.col("row") == F.col("ar"))).select("doc", "row", "text", "asked")
    around = texts.mapInArrow(_surroundings, "seed long, doc long, row int, place int, left binary, right binary")
    if not hot.isEmpty():
        around = materialize(around.join(hot, F.col("seed") == F.col("hot_seed"), "left"), "suffix-around")
        crowded = _hot_stretches(around.where("hot_seed is not null"))
        around = around.where("hot_seed is null").drop("hot_seed")
    sorted_ = around.repartition("seed").sortWithinPartitions("seed", "doc", "row", "place").mapInArrow(_sort, _STRETCHES)
    part = materialize(sorted_ if hot.isEmpty() else sorted_.union(crowded), "suffix-stretches")
    whole = judged.where("known").select("doc", "row", "place", F.lit(None).cast("int").alias("begin"), F.lit(None).cast("int").alias("finish"))
    both = whole.union(part.select("doc", "row", F.lit(None).cast("int").alias("place"), "begin", "finish"))
    lists = both.groupBy("doc", "row").agg(
        F.collect_list("place").alias("places"), F.collect_list(F.struct("begin", "finish")).alias("parts")
    )
    parts = F.filter("parts", lambda p: p["begin"].isNotNull())
    lists = lists.select(
        "doc", "row", "places",
        F.transform(parts, lambda p: p["begin"]).alias("begins"), F.transform(parts, lambda p: p["finish"]).alias("ends"),
    )
    return materialize(lists, "suffix-lists")


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept), a row per row of ``docs``; ``kept`` holds the remaining bytes."""
    require_columns(docs, id_col, text_col)
    rows = _rows(docs, id_col, text_col)
    lists = repeated_stretches(rows)
    guessed = _with_guess(rows, lists.select("doc", "row"))
    listed = lists.withColumnsRenamed({"doc": "ld", "row": "lr"})
    # Documents that cannot be listed keep all their bytes where they are; only the others travel.
    joined = guessed.where("maybe").join(listed, (F.col("doc") == F.col("ld")) & (F.col("row") == F.col("lr")), "left")
    none = F.array().cast("array<int>")
    joined = joined.select("doc", "row", "text", *[F.coalesce(c, none).alias(c) for c in ("places", "begins", "ends")])
    cut = joined.mapInArrow(_cut, _CUT)
    zero = F.lit(0).cast("long")
    clean = guessed.where(~F.col("maybe")).select(
        "doc", "row", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.col("text").cast("binary").alias("kept"),
    )
    name = F.when(F.col("doc") != NO_ID, F.col("doc")).alias(id_col)
    return cut.union(clean).select(name, "n_bytes", "n_removed", "n_spans", "kept")
