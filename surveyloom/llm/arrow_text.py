"""Texts in Arrow batches: slices of bounded size, and their words as codes into a small vocabulary.

Each distinct word of a slice is handled once and the rest is array work, so cost follows the vocabulary, not the text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 16 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def give_back() -> None:
    """Return memory that is free, but kept by the allocators, to the system; workers live on for other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean_slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """As ``slices``; what a slice has used is given back before the next one."""
    for part in slices(batches, text, most):
        yield part
        give_back()


@dataclass
class Words:
    codes: np.ndarray  # a code per word, in reading order
    vocabulary: pa.Array  # the word of each code; may hold the empty word
    starts: np.ndarray  # first word of each text, and the number of words at the end

    @property
    def texts(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def keep(self, mask: np.ndarray) -> Words:
        """Only the words at which ``mask`` holds."""
        before = np.concatenate(([0], np.cumsum(mask)))
        return Words(self.codes[mask], self.vocabulary, before[self.starts])


def split_words(texts: pa.Array) -> Words:
    """Words between runs of ASCII white space; null is the empty text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy()
    encoded = lists.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    return Words(codes, encoded.dictionary, (offsets - offsets[0]).astype(np.int64))


def gather(codes: np.ndarray, flat: np.ndarray, firsts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[firsts[c] : firsts[c] + lengths[c]]`` of all codes c in a row, and where each of them ends."""
    size = lengths[codes]
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(firsts[codes] - (ends - size), size)
    return flat[at], ends
