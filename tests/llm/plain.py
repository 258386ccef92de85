"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def cut_repeats(docs: list[tuple[int, str]]) -> dict[int, tuple[int, int, int, str]]:
    """Per document: bytes, removed bytes, removed runs, hash of the rest. ``docs`` are in order."""
    seen, out = set(), {}
    for name, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(data[i : i + 100])
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
        rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[name] = (len(data), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest())
    return out


def drop_lines(docs: list[tuple[int, str]], width: int = 3) -> dict[int, str]:
    """The text left of each document, by id, in id order."""
    seen, out = set(), {}
    for name, text in sorted(docs):
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - width + 1):
            window = tuple(lines[i : i + width])
            if window in seen:
                gone.update(range(i, i + width))
            seen.add(window)
        out[name] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def words(text: str) -> list[str]:
    found = (re.sub(r"[^\w]|_", "", w.lower()) for w in re.split(r"[ \t\n\x0b\f\r]+", text))
    return [w for w in found if w]


def shingle_counts(text: str) -> collections.Counter:
    """Runs of five words with their counts; a text of one to four words is one shingle."""
    own = words(text or "")
    if 0 < len(own) < 5:
        return collections.Counter([tuple(own)])
    return collections.Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))


def shingle_weights(docs: list[tuple[int, str]]) -> list[dict[tuple, float]]:
    """(1 + ln count) times (1 + ln(documents / documents with it) / ln(documents + 1)) of each document's shingles."""
    counted = [shingle_counts(t) for _, t in docs]
    held = collections.Counter(s for c in counted for s in c)
    n = len(docs)
    return [{s: (1 + math.log(k)) * (1 + math.log(n / held[s]) / math.log(n + 1)) for s, k in c.items()} for c in counted]


def weighted_jaccard(a: dict[tuple, float], b: dict[tuple, float]) -> float:
    shared = sum(min(w, b[s]) for s, w in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


def near_classes(docs: list[tuple[int, str]], threshold: float = 0.8) -> dict[int, int]:
    """Class of each id by comparing all documents that share a shingle; nothing here comes from the operator."""
    sets = shingle_weights(docs)
    holders = collections.defaultdict(list)
    for k, own in enumerate(sets):
        for s in own:
            holders[s].append(k)
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    pairs = {p for held in holders.values() for p in itertools.combinations(held, 2)}
    by_text = collections.defaultdict(list)
    for k, (_, text) in enumerate(docs):
        if not sets[k]:
            by_text[text or ""].append(k)
    pairs |= {(held[0], k) for held in by_text.values() for k in held[1:]}
    for a, b in pairs:
        if not sets[a] or weighted_jaccard(sets[a], sets[b]) >= threshold:
            a, b = sorted((find(a), find(b)), key=lambda k: docs[k][0])
            root[b] = a
    return {docs[k][0]: docs[find(k)][0] for k in range(len(docs))}


def contaminated(text: str, items: list[str], least: int = 12) -> bool:
    """Whether some stretch of the text agrees with an item in at least 4 of 5 words and is long enough; all shifts are tried."""
    have = words(text)
    for item in items:
        want = words(item)
        if len(want) < 5:
            continue
        need = min(least, len(want))
        for shift in range(-len(want) + 1, len(have)):
            low, high = max(0, -shift), min(len(want), len(have) - shift)
            equal = [want[i] == have[i + shift] for i in range(low, high)]
            if sum(equal) * 5 < need * 4:
                continue
            for a in range(len(equal)):
                for b in range(a + need, len(equal) + 1):
                    if equal[a] and equal[b - 1] and 5 * sum(equal[a:b]) >= 4 * (b - a):
                        return True
    return False


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(rows, ids: dict[int, list[int]], capacity: int) -> int:
    """Every piece is there and right, sequences are gapless and not too long. Returns the number of sequences."""
    sequences = collections.defaultdict(list)
    seen = collections.Counter()
    for r in rows:
        piece = ids[r.doc_id][r.piece * capacity : (r.piece + 1) * capacity]
        assert (r.start, r.length, r.ids_crc32) == (r.piece * capacity, len(piece), crc(piece))
        sequences[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id, r.piece] += 1
    assert set(seen) == {(d, k) for d, v in ids.items() for k in range(-(-len(v) // capacity))}
    assert set(seen.values()) <= {1}
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)
