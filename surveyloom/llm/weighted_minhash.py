"""Signatures of weighted shingle sets by improved consistent weighted sampling (Ioffe 2010).

Each of ``BANDS * ROWS`` samples draws, for a shingle, r and c from Gamma(2, 1) and b from U(0, 1) by the shingle's hash. With
t = floor(ln w / r + b) and a = c / exp(r (t - b + 1)), the shingle of least a is the sample, and two sets agree in it, shingle and t, with
the probability of their weighted Jaccard similarity. ln a takes a value of its own for each shingle and t, so the least
ln a stands for the sample. The draws come from tables that the hash's bits index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from surveyloom.llm.arrow_text import Words
from surveyloom.llm.decontaminate import normal_words

SHINGLE = 5
BANDS, ROWS = 10, 3
IDF_BITS = 20
#: Leading bits of a shingle's hash by which its documents are counted.
KNOWN_BITS = 48
CHUNK = 1 << 15

_draw = np.random.default_rng(20240101)
_SMALL, _LARGE = 12, 16
R = _draw.gamma(2.0, 1.0, 1 << _SMALL).astype(np.float32)
B = _draw.random(1 << _SMALL).astype(np.float32)
LN_C = np.log(_draw.gamma(2.0, 1.0, 1 << _LARGE)).astype(np.float32)
ODD = _draw.integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ONE_R = (1.0 / R).astype(np.float32)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingles:
    """The distinct shingles of some texts with their counts, sorted by text; a text of one to four words is one shingle."""

    def __init__(self, texts: pa.Array):
        words = normal_words(texts)
        self.n_words = np.diff(words.starts)
        per_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.vocabulary.to_pylist()), np.uint64, len(words.vocabulary))
        hashed = per_word[words.codes]
        owner = words.texts
        self.exact = self._exact(words, hashed, owner)
        with np.errstate(over="ignore"):
            size = max(0, len(hashed) - SHINGLE + 1)
            h = np.zeros(size, np.uint64)
            for k in range(SHINGLE):
                h = h * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + size]
        whole = owner[:size] == owner[SHINGLE - 1 :] if size else np.zeros(0, bool)
        h, at = mix(h[whole]), owner[:size][whole]
        short = np.flatnonzero((self.n_words > 0) & (self.n_words < SHINGLE))
        h, at = np.concatenate([h, self.exact[short, 0]]), np.concatenate([at, short])
        key = (at.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
        order = np.argsort(key)
        key = key[order]
        if ((key[1:] == key[:-1]) & (h[order[1:]] != h[order[:-1]])).any():  # the order must not depend on the other texts
            order = np.lexsort((h, at))
        h, at = h[order], at[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
        begin = np.flatnonzero(first)
        self.hashes, self.texts = h[begin], at[begin]
        self.counts = np.diff(np.append(begin, len(h)))
        self.starts = np.searchsorted(self.texts, np.arange(len(self.n_words) + 1))

    @staticmethod
    def _exact(words: Words, hashed: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """128 bits per text over its words in order."""
        place = (np.arange(len(hashed)) - words.starts[owner]).astype(np.uint64)
        out = np.zeros((len(words.starts) - 1, 2), np.uint64)
        filled = np.flatnonzero(np.diff(words.starts))
        with np.errstate(over="ignore"):
            for k, salt in enumerate((0x51ED2701, 0x2545F491)):
                each = mix(mix(hashed + np.uint64(salt)) + place * np.uint64(0xD1342543DE82EF95))
                if len(filled):
                    out[filled, k] = np.add.reduceat(each, words.starts[:-1][filled])
        return mix(out + np.diff(words.starts).astype(np.uint64)[:, None])

    def buckets(self) -> np.ndarray:
        return (self.hashes >> np.uint64(64 - IDF_BITS)).astype(np.int64)

    def known(self) -> np.ndarray:
        return self.hashes >> np.uint64(64 - KNOWN_BITS)

    def inverse(self, idf: np.ndarray | Frequencies) -> np.ndarray:
        """``idf`` holds values by leading hash bits, or counted documents."""
        return idf.inverse(self.known()) if isinstance(idf, Frequencies) else idf[self.buckets()]

    def weights(self, idf: np.ndarray | Frequencies) -> np.ndarray:
        return term_weight(self.counts) * self.inverse(idf)


@dataclass(frozen=True)
class Frequencies:
    """Documents per shingle; ``known`` is sorted."""

    known: np.ndarray
    held: np.ndarray
    docs: int

    def inverse(self, known: np.ndarray) -> np.ndarray:
        return inverse_frequency(self.held[np.searchsorted(self.known, known)], self.docs)


def term_weight(counts: np.ndarray) -> np.ndarray:
    """1 + ln(count): one phrase said hundreds of times does not make two texts alike."""
    return 1.0 + np.log(counts)


def inverse_frequency(held: np.ndarray, docs: int) -> np.ndarray:
    """1 + ln(docs / frequency) / ln(docs + 1), from 1 (in every document) to 2.

    The plain logarithm would let the edits in a large group of copies outweigh what its members share, whose frequency
    the group itself makes high.
    """
    docs = max(docs, 1)
    return 1.0 + np.log(docs / np.clip(held, 1, docs)) / np.log(docs + 1)


def signatures(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One band key per text and band; texts without shingles have meaningless keys."""
    n = len(starts) - 1
    least = np.zeros((BANDS * ROWS, n), np.float32)
    ln_w = np.log(weights).astype(np.float32)
    low, large = np.uint64((1 << _SMALL) - 1), np.uint64((1 << _LARGE) - 1)
    filled = np.flatnonzero(np.diff(starts))
    at = 0
    while at < len(filled):
        base = starts[filled[at]]
        stop = max(at + 1, int(np.searchsorted(starts[filled + 1], base + CHUNK, "right")))
        part = filled[at:stop]
        end = starts[part[-1] + 1]
        h, w, cuts = hashes[base:end], ln_w[base:end], starts[part] - base
        for k in range(BANDS * ROWS):
            with np.errstate(over="ignore"):
                x = h * ODD[k]
                x ^= x >> np.uint64(32)
                x *= np.uint64(0x94D049BB133111EB)
                x >>= np.uint64(20)
            i = (x & low).astype(np.int32)
            b = B[((x >> np.uint64(_SMALL)) & low).astype(np.int32)]
            t = np.floor(w * ONE_R[i] + b)
            ln_a = LN_C[((x >> np.uint64(2 * _SMALL)) & large).astype(np.int32)] - R[i] * (t - b + np.float32(1))
            least[k, part] = np.minimum.reduceat(ln_a, cuts)
        at = stop
    bits = least.view(np.uint32).astype(np.uint64)
    keys = np.empty((n, BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(n, band + 1, np.uint64)
            for row in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bits[band * ROWS + row])
            keys[:, band] = key
    return keys


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (hashes, weights), each sorted by hash."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    shared = float(np.minimum(a[1][at[same]], b[1][same]).sum())
    total = float(a[1].sum() + b[1].sum()) - shared
    return shared / total if total else 0.0
