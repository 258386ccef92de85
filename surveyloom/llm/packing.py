"""Best-fit packing in a tree of partitions.

Tasks encode the documents and cut those longer than a sequence into full pieces and a rest. The pieces, rows of a few numbers, are dealt
to leaves by hash, so that every leaf sees the mix of lengths, however the documents were stored. A leaf packs its pieces
best-fit, longest first. Bins with hardly any room left are emitted. The others go up a tree as single items: each inner
node packs the bins of its children best-fit again, and emits what is nearly full, until the root emits all. A leaf of very many
pieces packs them in batches, which are leaves of the tree like any other.

At most one bin of a node is at most half full (two of them would have been put together), so a node has use for no more
roomy bins than there are leaves; it hands on the ``max_up`` roomiest and emits the rest, which bounds every node.

Cases: a null or empty text is the end id alone. Repeated rows and null ids are documents like any other. An empty table
gives an empty table. Other columns are not carried. Sequence numbers have no meaning beyond being different.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.llm import token_ids
from surveyloom.llm.arrow_text import lean_slices
from surveyloom.schema import require_columns
from surveyloom.session import materialize

#: Pieces that a task packs together at most; a task with more packs several times.
LEAF_PIECES = 200_000


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the filled length of each bin.

    Open bins are stacked by the room they have; the bits of ``rooms`` say which stacks hold any.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        wide = rooms >> need
        if wide:
            room = need + (wide & -wide).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(used), capacity
            used.append(0)
        bins[k], offsets[k] = b, used[b]
        used[b] += need
        if room > need:
            stacks[room - need].append(b)
            rooms |= 1 << (room - need)
    return bins, offsets, np.array(used, np.int64)


def goes_up(used: np.ndarray, capacity: int, slack: int, max_up: int) -> np.ndarray:
    """Which bins a node hands on: those with more room than ``slack``, the roomiest first."""
    up = used < capacity - slack
    if up.sum() > max_up:
        up[np.argsort(used, kind="stable")[max_up:]] = False
    return up


_PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
_PLACED = T.StructType(
    [
        *_PIECES,
        T.StructField("leaf", T.LongType()),
        T.StructField("bin", T.LongType()),
        T.StructField("place", T.LongType()),
        T.StructField("used", T.LongType()),
        T.StructField("up", T.BooleanType()),
    ]
)


def _cut(path: str, end_id: int, capacity: int):
    """The pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean_slices(batches):
            ids, starts = token_ids.with_end(*token_ids.encoder(path).encode(batch.column("text")), end_id)
            sizes = np.diff(starts)
            pieces = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = piece * capacity
            length = np.minimum(sizes[doc] - begin, capacity)
            raw = memoryview(ids.astype("<u4").tobytes())
            at = (starts[doc] + begin) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(doc)), piece.astype(np.int32), begin, length, np.array(crc, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_PIECES.names)

    return run


def _leaf(capacity: int, slack: int, max_up: int, most: int):
    def pack(cuts: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        items = pa.Table.from_batches(cuts).combine_chunks().to_batches()[0]
        bins, places, used = best_fit(items.column("length").to_numpy(), capacity)
        up = goes_up(used, capacity, slack, max_up)
        leaf = (np.int64(TaskContext.get().partitionId()) << 16) + number
        more = [np.full(len(bins), leaf), (leaf << 20) + bins, places, used[bins], up[bins]]
        return pa.RecordBatch.from_arrays([*items.columns, *map(pa.array, more)], names=_PLACED.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts: list[pa.RecordBatch] = []
        held = number = 0
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                batch = whole.slice(at, most)
                if cuts and held + batch.num_rows > most:
                    yield pack(cuts, number)
                    cuts, held, number = [], 0, number + 1
                cuts.append(batch)
                held += batch.num_rows
        if held:
            yield pack(cuts, number)

    return run


def _node(capacity: int, slack: int, max_up: int):
    """One inner node: bins as items. ``target`` is the bin whose number the merged bin takes on."""

    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["used", "bin"], ascending=[False, True], kind="stable").reset_index(drop=True)
        bins, places, used = best_fit(items["used"].to_numpy(), capacity)
        first = pd.Series(items["bin"].to_numpy()[places == 0], index=bins[places == 0])
        return pd.DataFrame(
            {
                "bin": items["bin"], "target": first.loc[bins].to_numpy(), "shift": places, "node": items["node"],
                "target_used": used[bins], "target_up": goes_up(used, capacity, slack, max_up)[bins],
            }
        )

    return run


_MERGED = "bin long, target long, shift long, node int, target_used long, target_up boolean"


def merge_up(bins: DataFrame, capacity: int, slack: int, max_up: int, fan_in: int) -> DataFrame:
    """(bin, target, shift) for the leaf bins (bin, node, used) that go up: where each ends after the root."""
    spark = bins.sparkSession
    moved = bins.select("bin", F.col("bin").alias("target"), F.lit(0).cast("long").alias("shift"))
    top = bins.agg(F.max("node")).first()[0]
    current = bins
    while top:
        current = current.withColumn("node", F.floor(F.col("node") / fan_in).cast("int"))
        fitted = materialize(current.groupBy("node").applyInPandas(_node(capacity, slack, max_up), _MERGED), "packing-node")
        step = fitted.select(F.col("bin").alias("old"), F.col("target").alias("new"), F.col("shift").alias("by"))
        moved = moved.join(step, moved["target"] == step["old"], "left").select(
            "bin", F.coalesce("new", "target").alias("target"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift")
        )
        moved = materialize(moved, "packing-moved")
        current = fitted.where("target_up and shift = 0").select(
            F.col("target").alias("bin"), "node", F.col("target_used").alias("used")
        )
        top //= fan_in
    return moved


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    slack: int = 16,
    max_up: int = 4096,
    fan_in: int = 16,
    leaf_pieces: int = LEAF_PIECES,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece.

    ``tokenizer`` is the path of a tokenizers file that every executor has. ``slack`` is the room that counts as none.
    """
    require_columns(docs, id_col, text_col)
    if not 0 < leaf_pieces <= 1 << 20:
        raise ValueError("leaf_pieces must be 1 to 2^20")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = rows.mapInArrow(_cut(tokenizer, end_id, capacity), _PIECES)
    draw = F.xxhash64("doc_id", "piece", "length", "ids_crc32")
    dealt = pieces.repartition(draw).sortWithinPartitions(draw)  # every batch of a leaf sees the mix, too
    placed = materialize(dealt.mapInArrow(_leaf(capacity, slack, max_up, leaf_pieces), _PLACED), "packing-leaf")
    leaves = sorted(r["leaf"] for r in placed.select("leaf").distinct().collect())  # one per task and batch
    numbers = docs.sparkSession.createDataFrame(list(zip(leaves, range(len(leaves)), strict=True)), "number_of long, node int")
    bins = placed.where("up and place = 0").join(F.broadcast(numbers), F.col("leaf") == F.col("number_of")).select("bin", "node", "used")
    moved = merge_up(bins, capacity, slack, max_up, fan_in).where("bin != target or shift != 0").withColumnRenamed("bin", "moved_bin")
    joined = placed.join(moved, placed["bin"] == moved["moved_bin"], "left")
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("target", "bin").alias("sequence_id"),
        (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
