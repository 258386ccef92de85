"""Token ids in binary files: one zstandard frame per document, one dictionary for all.

A dictionary is trained on the serialized id arrays of a bounded sample of whole documents (``sample_bytes`` of text). Documents are sorted by id over
ordered partitions; each partition's task encodes its documents and writes one file:

    magic (8 bytes) | frames | index | footer
    index:  per document  id (i8), id is null (u1), frame offset (u8), number of ids (u4), each column on its own
    footer: sha-256 of the dictionary (32) | bytes per id (u1) | documents (u8) | index offset (u8) | crc32 of the index (u4) | magic (8)

All numbers are little-endian. A document is read by its index entry, its frame and the dictionary alone.
The manifest, a table, lists the files with their first id, documents and ids before them.

Cases: a null or empty text is the end id alone. Null doc ids come first. Rows that share an id are ordered by a hash of the text;
equal rows are written as often as they come. An empty table gives no files and an empty table. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions.hashing import uniform
from surveyloom.llm import files, token_ids
from surveyloom.llm.arrow_text import slices
from surveyloom.llm.columns import row_digest
from surveyloom.schema import require_columns
from surveyloom.session import materialize

MAGIC = b"SLTOKEN1"
FOOTER = "<32sBQQI8s"
LEVEL = 3


@dataclass(frozen=True)
class TokenFiles:
    folder: str
    manifest: DataFrame  # file, part, first_id, last_id, docs, ids, bytes, docs_before, ids_before
    dictionary: bytes

    @property
    def dictionary_hash(self) -> str:
        return hashlib.sha256(self.dictionary).hexdigest()


def train_dictionary(docs: DataFrame, tokenizer: str, id_type: str, size: int, sample_bytes: int) -> bytes:
    """Trained on the id arrays of whole documents: those of the smallest hash of id and text, about as many as hold ``sample_bytes`` of text together.

    Documents longer than that are not drawn. Only sizes depend on the dictionary; samples too small to train on give none.
    """
    length = F.octet_length("text")
    fitting = docs.where(length.between(1, sample_bytes))
    total = fitting.agg(F.sum(length)).first()[0]
    if not total:
        return b""
    drawn = fitting.where(uniform(3, F.col("doc_id"), F.col("text")) < min(1.0, 1.2 * sample_bytes / total))
    rows = drawn.select("text", length.alias("length")).orderBy(uniform(3, F.col("doc_id"), F.col("text"))).collect()  # sample_bytes and a fifth
    ends = np.cumsum([r["length"] for r in rows])
    texts = [r["text"] for r, end in zip(rows, ends, strict=True) if end <= sample_bytes]
    ids, starts = token_ids.encoder(tokenizer).encode(pa.array(texts, pa.string()))
    raw = ids.astype(id_type).tobytes()
    width = np.dtype(id_type).itemsize
    arrays = [raw[a * width : b * width] for a, b in zip(starts, starts[1:], strict=False) if b > a]
    try:
        return zstandard.train_dictionary(size, arrays, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


_WRITTEN = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("last_id", T.LongType()),
        T.StructField("docs", T.LongType()),
        T.StructField("ids", T.LongType()),
        T.StructField("bytes", T.LongType()),
    ]
)


class Writer:
    """One file of the format."""

    def __init__(self, uri: str, dictionary: bytes, id_type: str):
        self.uri, self.sink, self.at = uri, files.create(uri), len(MAGIC)
        self.sink.write(MAGIC)
        self.width = np.dtype(id_type).itemsize
        self.digest = hashlib.sha256(dictionary).digest()
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        self.names: list[int | None] = []
        self.offsets: list[int] = []
        self.counts: list[int] = []

    def add(self, name: int | None, ids: memoryview) -> None:
        frame = self.press.compress(ids)
        self.sink.write(frame)
        self.names.append(name)
        self.offsets.append(self.at)
        self.counts.append(len(ids) // self.width)
        self.at += len(frame)

    def close(self) -> None:
        index = b"".join(
            [
                np.array([n or 0 for n in self.names], "<i8").tobytes(),
                np.array([n is None for n in self.names], "u1").tobytes(),
                np.array(self.offsets, "<u8").tobytes(),
                np.array(self.counts, "<u4").tobytes(),
            ]
        )
        self.sink.write(index)
        self.sink.write(struct.pack(FOOTER, self.digest, self.width, len(self.names), self.at, zlib.crc32(index), MAGIC))
        self.sink.close()


class Reader:
    """Documents of one file by place or by id."""

    def __init__(self, uri: str, dictionary: bytes):
        self.source = files.seekable(uri)
        end = self.source.size() - struct.calcsize(FOOTER)
        self.source.seek(end)
        digest, width, docs, at, crc, magic = struct.unpack(FOOTER, self.source.read(struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        self.source.seek(at)
        index = self.source.read(end - at)
        if zlib.crc32(index) != crc:
            raise ValueError(f"{uri} has a damaged index")
        self.id_type = {2: "<u2", 4: "<u4"}[width]
        self.names = np.frombuffer(index, "<i8", docs)
        self.null = np.frombuffer(index, "u1", docs, 8 * docs).astype(bool)
        self.ends = np.append(np.frombuffer(index, "<u8", docs, 9 * docs), np.uint64(at)).astype(np.int64)
        self.counts = np.frombuffer(index, "<u4", docs, 17 * docs).astype(np.int64)
        self.open = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, place: int) -> np.ndarray:
        self.source.seek(int(self.ends[place]))
        frame = self.source.read(int(self.ends[place + 1] - self.ends[place]))
        ids = np.frombuffer(self.open.decompress(frame), self.id_type)
        if len(ids) != self.counts[place]:
            raise ValueError(f"document {place} has {len(ids)} ids, not {self.counts[place]}")
        return ids

    def places(self, name: int) -> range:
        """Places of the documents with that id; ids are sorted after the nulls."""
        nulls = int(self.null.sum())
        found = np.searchsorted(self.names[nulls:], [name, name + 1]) + nulls
        return range(int(found[0]), int(found[1]))


def _write(folder: str, tokenizer: str, end_id: int, id_type: str, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        writer: Writer | None = None
        first = last = None
        for batch in slices(batches):
            if writer is None:
                writer = Writer(files.unique_name(folder, f"part-{part:05d}", ".tokens"), dictionary, id_type)
            ids, starts = token_ids.with_end(*token_ids.encoder(tokenizer).encode(batch.column("text")), end_id)
            raw = memoryview(ids.astype(id_type).tobytes())
            at = (starts * writer.width).tolist()
            for name, a, b in zip(batch.column("doc_id").to_pylist(), at, at[1:], strict=False):
                writer.add(name, raw[a:b])
                if name is not None:
                    first, last = name if first is None else first, name
        if writer:
            writer.close()
            row = [writer.uri, part, first, last, len(writer.names), sum(writer.counts), writer.at]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, [pa.string(), pa.int32(), *[pa.int64()] * 5], strict=True)],
                names=[f.name for f in _WRITTEN],
            )

    return run


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    dictionary_size: int = 65_536,
    sample_bytes: int = 4 << 20,
) -> TokenFiles:
    """Write all documents in ascending id order. ``tokenizer`` is the path of a tokenizers file that every executor has."""
    require_columns(docs, id_col, text_col)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = "<u2" if max(token_ids.encoder(tokenizer).vocabulary_size, end_id + 1) <= 1 << 16 else "<u4"
    dictionary = train_dictionary(rows, tokenizer, id_type, dictionary_size, sample_bytes)
    folder = files.fresh_folder(spark, "tokens")
    with files.create(f"{folder}/{hashlib.sha256(dictionary).hexdigest()}.dictionary") as sink:
        sink.write(dictionary)
    order = ["doc_id", row_digest(F.col("doc_id"), F.col("text"))]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    written = materialize(sorted_rows.mapInArrow(_write(folder, tokenizer, end_id, id_type, dictionary), _WRITTEN), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    manifest = written.select(
        "*",
        F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids_before"),
    )
    return TokenFiles(folder, materialize(manifest, "token-manifest"), dictionary)


_DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column("file").to_pylist(), batch.column("ids_before").to_pylist(), strict=True):
                reader = Reader(uri, dictionary)
                crc = [zlib.crc32(reader.ids(k).astype("<u4").tobytes()) for k in range(len(reader.names))]
                starts = before + np.cumsum(reader.counts) - reader.counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.names, mask=reader.null), pa.array(starts), pa.array(reader.counts), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_digests(tokens: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read from the files. ids_crc32 is over unsigned 32-bit little-endian ids."""
    listed = tokens.manifest.select("file", "ids_before")
    return listed.repartition(max(1, tokens.manifest.count())).mapInArrow(_read(tokens.dictionary), _DIGESTS)


def _fetch(dictionary: bytes, wanted: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                reader = Reader(uri, dictionary)
                found = [(n, reader.ids(k).tolist()) for n in wanted for k in reader.places(n)]
                names, ids = [f[0] for f in found], [f[1] for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return run


def fetch(spark: SparkSession, tokens: TokenFiles, doc_ids: Iterable[int]) -> DataFrame:
    """(doc_id, ids) of a few documents; only files whose id range holds one are opened, and only their frames are read."""
    wanted = sorted(set(doc_ids))
    inside = F.lit(False)
    for name in wanted:
        inside = inside | F.lit(name).between(F.col("first_id"), F.col("last_id"))
    return tokens.manifest.where(inside).select("file").mapInArrow(_fetch(tokens.dictionary, wanted), "doc_id long, ids array<long>")
