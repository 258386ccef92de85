"""Near-duplicate classes by weighted MinHash.

Documents are sets of shingles of five words weighted by 1 + ln(count) times inverse document frequency (scaled to 1..2). The frequency is that of the
shingle itself, told apart by 48 bits, counted over all rows. Texts are packed into slices; a slice sends its distinct shingles to blocks of the hash
range, whose number grows with the text, each block is summed in one task and sends the sums back to the slices. Texts of equal words are one node. Nodes whose signatures
agree in a band are candidates; a candidate pair is a link if its weighted Jaccard similarity is at least ``threshold``, and a
class is a connected component of links.

No bucket is expanded into pairs of rows. Its nodes are first compared with a leader, the node that shares most places with others over all
bands; in a large group of copies that is a text close to the original. Buckets whose nodes are in one component by then, or that have
no two nodes besides the leader, are done. What is left of the others is compared completely, but in blocks: a bucket is cut into
blocks of bounded size, each task gets two blocks, counts what their texts share by matrix products and hands out only a
spanning forest of the links between components. So no link among candidates is lost, and rows grow with nodes times blocks.

Words are as in ``decontaminate``. A text of one to four words is a single shingle.

Cases: texts without words (null and empty ones too) are classes by equal text. Rows equal in id and text are one document
and share all results. Null ids take part, after all others in the order; a class of null ids only has a null id. An empty table
gives an empty table. Further columns pass through ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm import weighted_minhash as wm
from surveyloom.llm.arrow_text import give_back, lean_slices
from surveyloom.llm.columns import row_digest, same, spare_names, text_of
from surveyloom.llm.components import components
from surveyloom.schema import require_columns
from surveyloom.session import discard, materialize

#: Bytes of text whose shingles are summed in one block, and the bits of the least number of blocks.
SUM_BYTES, LEAST_BITS = 4 << 20, 6
#: Nodes that one task compares with a leader at once; a leader of more is sent to several tasks.
SALT_NODES = 400
#: Nodes and bytes of text of a block.
BLOCK_NODES, BLOCK_BYTES = 512, 2 << 20
#: Bytes of text whose shingles are held at once.
SCAN_BYTES = 3 << 20
COLUMNS = 2_048


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per slice of documents, compressed."""
    first = TaskContext.get().partitionId() << 32
    for k, batch in enumerate(lean_slices(batches, most=SCAN_BYTES)):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        size = pc.sum(pc.binary_length(batch.column("text"))).as_py()
        columns = [pa.array([first + k]), pa.array([batch.num_rows]), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["slice", "docs", "bytes", "packed"])


def _unpack(packed: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed.as_buffer()).read_next_batch()


def _count(bits: int):
    """Per slice and block (leading ``bits`` bits of hash) the distinct shingles, as gaps, and the slice's documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.uint64(wm.KNOWN_BITS - bits)
        for batch in batches:
            for own, packed in zip(batch.column("slice").to_pylist(), batch.column("packed"), strict=True):
                known, held = np.unique(wm.Shingles(_unpack(packed).column("text")).known(), return_counts=True)
                block = (known >> rest).astype(np.int64)
                cuts = np.flatnonzero(np.diff(block, prepend=-1))
                gaps = np.diff(known, prepend=np.uint64(0))
                gaps[cuts] = known[cuts] & ((np.uint64(1) << rest) - np.uint64(1))
                rows = []
                for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(known)], strict=False):
                    part = gaps[low:high]
                    width = np.uint32 if part.max() < 1 << 32 else np.uint64
                    rows.append((int(block[low]), own, part.astype(width).tobytes(), held[low:high].astype(np.uint32).tobytes()))
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                types = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["block", "slice", "gaps", "held"])
                give_back()

    return run


def _block_sums(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of a block, their documents, and the place of each shingle of the parts among them."""
    known, place = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    return known, np.bincount(place, np.concatenate([p[2] for p in parts])).astype(np.uint32), place


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Rows come sorted by block; one block is held at a time."""
    block, parts = None, []
    for batch in batches:
        columns = (batch.column("block").to_pylist(), batch.column("slice").to_pylist(), batch.column("gaps"), batch.column("held"))
        for k, own, gaps, held in zip(*columns, strict=True):
            if k != block:
                if parts:
                    yield block, parts
                block, parts = k, []
            held = np.frombuffer(held.as_buffer(), np.uint32)
            width = np.uint32 if gaps.as_buffer().size == 4 * len(held) else np.uint64
            parts.append((own, np.cumsum(np.frombuffer(gaps.as_buffer(), width), dtype=np.uint64), held))
    if parts:
        yield block, parts


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of all slices that hold the shingles of a slice and block."""
    for block, parts in _by_block(batches):
        _, total, place = _block_sums(parts)
        ends = np.cumsum([len(p[1]) for p in parts])
        sums = [zstandard.compress(total[at].tobytes()) for at in np.split(place, ends[:-1])]
        columns = [pa.array([p[0] for p in parts], pa.int64()), pa.array([block] * len(parts), pa.int32()), pa.array(sums, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["slice", "block", "data"])
        give_back()


def _whole_sums(bits: int):
    """The same per block, for all slices together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _by_block(batches):
            known, total, _ = _block_sums(parts)
            known = known | (np.uint64(block) << np.uint64(wm.KNOWN_BITS - bits))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([known.tobytes()]), pa.array([total.tobytes()])], names=["block", "known", "held"])

    return run


def _packed(rows: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Stored slices of (doc, digest, text), what they send to the blocks, the bits that tell blocks apart, and the number of documents."""
    schema = "slice long, docs long, bytes long, packed binary"
    stored = materialize(rows.mapInArrow(_pack, schema), "near-slices")
    size = stored.agg(F.sum("docs").alias("docs"), F.sum("bytes").alias("bytes")).first()
    bits = max(LEAST_BITS, (-(-(size["bytes"] or 0) // SUM_BYTES) - 1).bit_length())
    parts = stored.select("slice", "packed").mapInArrow(_count(bits), "block int, slice long, gaps binary, held binary")
    return stored, parts.repartition("block").sortWithinPartitions("block"), bits, size["docs"] or 0


def inverse_frequencies(rows: DataFrame) -> wm.Frequencies:
    """The documents of all shingles of a table that the driver can hold, to look at weights outside of the operator."""
    _, parts, bits, docs = _packed(rows.select("text"))
    found = parts.mapInArrow(_whole_sums(bits), "block int, known binary, held binary").orderBy("block").collect()
    known, held = (np.frombuffer(b"".join(r[c] for r in found), t) for c, t in (("known", np.uint64), ("held", np.uint32)))
    return wm.Frequencies(known, held, docs)


def _inverse(s: wm.Shingles, batch: pa.RecordBatch, idf: int | np.ndarray | wm.Frequencies) -> np.ndarray:
    """By the frequencies that come with the texts, of ``idf`` documents, or else by ``idf`` itself."""
    if "freq" not in batch.schema.names:
        return s.inverse(idf)
    return wm.inverse_frequency(_numbers(batch.column("freq").to_pylist()), idf)


def _numbers(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(zstandard.decompress, parts)), np.uint32)


def _sign(docs: int):
    """Rows come sorted by slice and block, the documents first; one slice is held at a time."""

    def close(batch: pa.RecordBatch, sums: list[bytes]) -> pa.RecordBatch:
        s = wm.Shingles(batch.column("text"))
        known, place = np.unique(s.known(), return_inverse=True)
        total = _numbers(sums)
        if len(total) != len(known):
            raise ValueError("sums of shingles are missing")
        freq = total[place]
        keys = wm.signatures(s.hashes, wm.term_weight(s.counts) * wm.inverse_frequency(freq, docs), s.starts)
        bands = [k if n else None for k, n in zip(keys.view(np.int64), s.n_words, strict=True)]
        exact = s.exact.copy()
        for k in np.flatnonzero(s.n_words == 0).tolist():  # told apart by the text itself
            exact[k] = [xxhash.xxh3_64_intdigest(batch.column("text")[k].as_py(), seed) for seed in (1, 2)]
        exact = exact.view(np.int64)
        held = pa.array([zstandard.compress(freq[a:b].tobytes()) for a, b in zip(s.starts, s.starts[1:], strict=False)], pa.binary())
        columns = [batch.column("doc"), batch.column("digest"), pa.array(exact[:, 0]), pa.array(exact[:, 1])]
        names = ["doc", "digest", "e1", "e2", "bands", "freq"]
        return pa.RecordBatch.from_arrays([*columns, pa.array(bands, pa.list_(pa.int64())), held], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, sums = None, []
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                if block >= 0:
                    sums.append(data.as_py())
                    continue
                if packed is not None:
                    yield close(_unpack(packed), sums)
                    give_back()
                packed, sums = data, []
        if packed is not None:
            yield close(_unpack(packed), sums)

    return run


def _compare(sent):
    """Rows come sorted by leader and salt, the leader's own text first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, kept = None, None
        for batch in lean_slices(batches, most=SCAN_BYTES):
            s = wm.Shingles(batch.column("text"))
            weights = wm.term_weight(s.counts) * _inverse(s, batch, sent.value)
            out = []
            for k, (a, node) in enumerate(zip(batch.column("a").to_pylist(), batch.column("node").to_pylist(), strict=True)):
                own = s.hashes[s.starts[k] : s.starts[k + 1]], weights[s.starts[k] : s.starts[k + 1]]
                if node == a:
                    leader, kept = a, own
                elif leader == a:
                    out.append((a, node, wm.similarity(kept, own)))
                else:
                    raise ValueError(f"the text of leader {a} is missing")
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["a", "node", "sim"]
            )

    return run


def compare(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """(a, node, sim) of the distinct pairs (a, node), stored. Leaders with many nodes are dealt over several tasks."""
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("a", "c")
    dealt = pairs.join(sizes, F.col("a") == F.col("c")).select(
        "a", "node", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / SALT_NODES)).alias("salt")
    )
    held = [c for c in texts.columns if c != "node"]
    members = dealt.join(texts, "node").select("a", "salt", "node", *held)
    heads = dealt.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "c"), F.col("a") == F.col("c"))
    rows = members.union(heads.select("a", "salt", F.col("a").alias("node"), *held))
    order = ["a", "salt", F.col("node") != F.col("a")]
    rows = rows.repartition("a", "salt").sortWithinPartitions(*order).select("a", "node", *held)
    return materialize(rows.mapInArrow(_compare(idf), "a long, node long, sim double"), "near-compared")


def _shared_weights(members: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sums of the lesser weights of all pairs of (hashes, counts, idf), by products over the shingles that two of them hold.

    A shingle counted c times is c features whose weights add up to its own; texts share the features that both have.
    """
    sizes = [int(c.sum()) for _, c, _ in members]
    owner = np.repeat(np.arange(len(members)), sizes)
    hashes = np.concatenate([np.repeat(h, c) for h, c, _ in members])
    weight = np.concatenate([np.repeat(i, c) for _, c, i in members])
    counts = np.concatenate([c for _, c, _ in members])
    turn = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    weight *= np.where(turn > 0, np.log((turn + 1) / np.maximum(turn, 1)), 1.0)
    with np.errstate(over="ignore"):
        feature = wm.mix(hashes + turn.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    _, column, held = np.unique(feature, return_inverse=True, return_counts=True)
    both = held[column] > 1
    owner, weight = owner[both], weight[both]
    _, column = np.unique(column[both], return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, weight, column = owner[order], weight[order], column[order]
    shared = np.zeros((len(members), len(members)))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, [first, first + COLUMNS])
        part = np.zeros((len(members), COLUMNS))
        part[owner[low:high], column[low:high] - first] = np.sqrt(weight[low:high])
        shared += part @ part.T
    return shared


def block_links(nodes: list[int], roots: list[int], members: list[tuple], threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between nodes of different components."""
    shared = _shared_weights(members)
    weight = np.array([float((wm.term_weight(c) * i).sum()) for _, c, i in members])
    total = weight[:, None] + weight[None, :] - shared
    linked = np.triu(shared >= threshold * total, 1) & (total > 0)
    top = {r: r for r in roots}

    def find(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    out = []
    for a, b in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        x, y = find(roots[a]), find(roots[b])
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((nodes[a], nodes[b]))
    return out


def _blocks(sent, threshold: float):
    """Rows come sorted by bucket and block pair; one pair of blocks is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, roots, members = None, [], [], []

        def close() -> pa.RecordBatch:
            links = block_links(nodes, roots, members, threshold) if len(set(roots)) > 1 else []
            columns = list(zip(*links, strict=True)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

        for batch in lean_slices(batches, most=SCAN_BYTES):
            s = wm.Shingles(batch.column("text"))
            idf = _inverse(s, batch, sent.value)
            keys = zip(*(batch.column(c).to_pylist() for c in ("g", "i", "j")), strict=True)
            rows = zip(keys, batch.column("node").to_pylist(), batch.column("root").to_pylist(), strict=True)
            for k, (own, node, root) in enumerate(rows):
                if own != key:
                    if len(nodes) > 1:
                        yield close()
                    key, nodes, roots, members = own, [], [], []
                at = slice(s.starts[k], s.starts[k + 1])
                nodes.append(node)
                roots.append(root)
                members.append((s.hashes[at], s.counts[at], idf[at]))
        if len(nodes) > 1:
            yield close()

    return run


def _mixed_links(open_: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """(a, b) of a spanning forest of the links that the buckets (g, node, root) hold between components."""
    sized = open_.join(texts.select("node", F.octet_length("text").alias("bytes")), "node")
    blocks = sized.groupBy("g").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
    )
    placed = open_.join(blocks.withColumnRenamed("g", "bg"), F.col("g") == F.col("bg"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = placed.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root").join(texts, "node")
    rows = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "node").select("g", "i", "j", "node", "root", *(c for c in texts.columns if c != "node"))
    return materialize(rows.mapInArrow(_blocks(idf, threshold), "a long, b long"), "near-block-links")


def link(buckets: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """(node, root): the components of the links of at least ``threshold`` between nodes of one bucket (g, node); roots are not listed.

    ``idf`` is sent to all: the number of documents if ``texts`` (node, text) have a column ``freq``, the documents of each of their shingles.
    """
    sizes = buckets.groupBy("g").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("g", "sg")
    central = buckets.join(sizes, F.col("g") == F.col("sg")).groupBy("node").agg(F.sum("size").alias("score")).withColumnRenamed("node", "cn")
    scored = buckets.join(central, F.col("node") == F.col("cn")).select("g", "node", "score")
    heads = scored.groupBy("g").agg(F.max_by("node", F.struct("score", "node")).alias("a")).withColumnRenamed("g", "hg")
    seats = materialize(buckets.join(heads, F.col("g") == F.col("hg")).where("node != a").select("g", "a", "node"), "near-seats")
    compared = compare(seats.select("a", "node").distinct(), texts, idf)
    roots = components(compared.where(F.col("sim") >= threshold).select("a", F.col("node").alias("b")))
    named = seats.join(roots, "node", "left").select("g", "node", F.coalesce("root", "node").alias("root"))
    mixed = named.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(F.col("g").alias("mg"))
    open_ = materialize(named.join(mixed, F.col("g") == F.col("mg")).select("g", "node", "root"), "near-open")
    more = _mixed_links(open_, texts, idf, threshold)
    if more.isEmpty():
        return roots
    known = open_.select("node", "root").distinct()
    a, b = (known.select(F.col("node").alias(f"{c}_node"), F.col("root").alias(f"{c}_root")) for c in "ab")
    between = more.join(a, F.col("a") == F.col("a_node")).join(b, F.col("b") == F.col("b_node"))
    upper = components(between.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    upper = upper.select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = roots.join(upper, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    return moved.union(upper.select(F.col("old").alias("node"), F.col("new").alias("root")))


def signed(rows: DataFrame) -> tuple[DataFrame, int]:
    """(doc, digest, e1, e2, bands, freq) of (doc, digest, text), stored, and the number of rows. ``freq`` holds the documents of each distinct shingle."""
    stored, parts, _, n = _packed(rows)
    sums = parts.mapInArrow(_sum, "slice long, block int, data binary")
    whole = sums.union(stored.select("slice", F.lit(-1).alias("block"), F.col("packed").alias("data")))
    whole = whole.repartition("slice").sortWithinPartitions("slice", "block")
    schema = "doc long, digest long, e1 long, e2 long, bands array<long>, freq binary"
    out = materialize(whole.mapInArrow(_sign(n), schema), "near-signed")
    discard(stored)
    return out, n


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc, digest, class_id, first): a row per document (distinct id and text), stored.

    ``class_id`` is the class's least id; ``first`` marks the one document of a class that stands for it.
    """
    require_columns(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text"))
    rows = rows.select("doc", row_digest(F.col("doc"), F.col("text")).alias("digest"), "text")
    signs, n = signed(rows)
    idf = docs.sparkSession.sparkContext.broadcast(n)
    # Texts of equal words are one node; its documents are all signed alike.
    place = F.struct(F.col("doc").isNull().alias("last"), F.col("doc").alias("doc"), F.col("digest").alias("digest"))
    nodes = signs.groupBy("e1", "e2").agg(F.min(place).alias("rep"), F.any_value("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    spread = nodes.select("node", F.explode("bands").alias("g"))
    crowded = spread.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("g").alias("cg"))
    buckets = materialize(spread.join(crowded, F.col("g") == F.col("cg")).select("g", "node"), "near-buckets")
    wanted = buckets.select("node").distinct().join(nodes.select("node", "rep"), "node").select("node", F.col("rep.doc").alias("wd"), F.col("rep.digest").alias("wg"))
    texts = rows.join(wanted, same(rows, wanted, [("doc", "wd"), ("digest", "wg")])).select("node", "text").dropDuplicates(["node"])
    held = signs.join(wanted, same(signs, wanted, [("doc", "wd"), ("digest", "wg")])).select("node", "freq").dropDuplicates(["node"])
    texts = texts.join(held, "node")
    roots = link(buckets, materialize(texts, "near-texts"), idf, threshold)
    placed = nodes.select("node", "e1", "e2", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = placed.groupBy("root").agg(F.min("rep").alias("best")).withColumnRenamed("root", "fr")
    by_words = placed.join(firsts, F.col("root") == F.col("fr")).select(F.col("e1").alias("k1"), F.col("e2").alias("k2"), "best")
    out = signs.join(by_words, (F.col("e1") == F.col("k1")) & (F.col("e2") == F.col("k2"))).select("doc", "digest", "best")
    first = F.col("doc").eqNullSafe(F.col("best.doc")) & (F.col("digest") == F.col("best.digest"))
    return materialize(out.select("doc", "digest", F.col("best.doc").alias("class_id"), first.alias("first")).distinct(), "near-classes")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(id, class_id, kept), a row per row of ``docs``."""
    classes = near_classes(docs, id_col, text_col, threshold)
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), row_digest(F.col(id_col).cast("long"), text_of(text_col)).alias("row"))
    joined = rows.join(classes, same(rows, classes, [("row_id", "doc"), ("row", "digest")]))
    return joined.select(F.col("row_id").alias(id_col), "class_id", F.col("first").alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each class."""
    gone = near_classes(docs, id_col, text_col, threshold).where(~F.col("first")).select(F.col("doc").alias("gone_doc"), F.col("digest").alias("gone_row"))
    [row] = spare_names(docs, "row_digest")
    keyed = docs.withColumn(row, row_digest(F.col(id_col).cast("long"), text_of(text_col)))
    return keyed.join(gone, same(keyed, gone, [(id_col, "gone_doc"), (row, "gone_row")]), "left_anti").drop(row)
