"""Token ids of whole texts, with the tokenizers library.

``TextEncoder.encode`` equals ``Tokenizer.encode(text, add_special_tokens=False)``. Where the tokenizer's own description says
that white space only separates, texts are cut there, each distinct word is encoded once per slice and the ids are put together.
Plain words, of Latin letters, digits and ASCII signs, go to the model piece by piece; any other word goes through the whole
tokenizer. Tokenizers of another description get whole texts.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from surveyloom.llm.arrow_text import gather, split_words

# The description under which white space only separates words.
SEPARATING_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
SEPARATING_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_LOW = "a-zß-öø-ÿ"
_PLAIN = rf"^[A-ZÀ-ÖØ-Þ{_LOW}0-9!-/:;=>?@\[-`{{-~]+$"  # "<" may begin a special token
_PIECE = rf"('s|'t|'re|'ve|'m|'ll|'d|[{_LOW}]+|[0-9]|[^{_LOW}0-9]+)"

#: Word pieces whose ids a worker keeps between slices.
KEPT_PIECES = 400_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class TextEncoder:
    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.vocabulary_size = self.whole.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_words = (
            (spec.get("normalizer") or {}).get("normalizers") == SEPARATING_NORMALIZERS
            and (splits[0].get("pattern") or {}).get("Regex") == SEPARATING_SPLIT
            and [s.get("type") for s in splits] == ["Split", "ByteLevel"]
            and not splits[1].get("add_prefix_space")
        )
        self._letters, self._tokenize = _byte_letters(), self.whole.model.tokenize
        self._forget()

    def _forget(self) -> None:
        """``_codes`` numbers the pieces seen; their ids lie in ``_flat``."""
        self._codes: dict[str, int] = {}
        self._flat, self._sizes = array("I"), array("q")

    def _number(self, pieces: list[str], ids_of: Callable[[str], list[int]], mark: str) -> np.ndarray:
        """Numbers of the pieces; new ones are encoded. ``mark`` keeps the two kinds of pieces apart."""
        known = self._codes
        keys = [mark + p for p in pieces] if mark else pieces
        for key, piece in zip(keys, pieces, strict=True):
            if key not in known:
                ids = ids_of(piece)
                known[key] = len(self._sizes)
                self._flat.extend(ids)
                self._sizes.append(len(ids))
        return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))

    def _piece(self, piece: str) -> list[int]:
        shown = piece if piece.isascii() else "".join([self._letters[b] for b in piece.encode()])
        return [t.id for t in self._tokenize(shown)]

    def _word(self, word: str) -> list[int]:
        return self.whole.encode(word, add_special_tokens=False).ids

    def _ids_by_word(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        if len(self._codes) > KEPT_PIECES:
            self._forget()
        plain = pc.match_substring_regex(vocabulary, _PLAIN)
        low = pc.utf8_lower(vocabulary.filter(plain))
        parts = pc.ascii_split_whitespace(pc.utf8_rtrim(pc.replace_substring_regex(low, _PIECE, "\\1 "), " "))
        split = parts.flatten().dictionary_encode()
        of_plain = self._number(split.dictionary.to_pylist(), self._piece, "")[split.indices.to_numpy()]
        of_other = self._number(vocabulary.filter(pc.invert(plain)).to_pylist(), self._word, " ")
        is_plain = plain.to_numpy(zero_copy_only=False)
        counts = np.ones(len(vocabulary), np.int64)
        counts[is_plain] = np.diff(parts.offsets.to_numpy())
        numbers = np.empty(counts.sum(), np.int64)
        inside = np.repeat(is_plain, counts)
        numbers[inside], numbers[~inside] = of_plain, of_other
        sizes = np.frombuffer(self._sizes, np.int64)
        ids, ends = gather(numbers, np.frombuffer(self._flat, np.uint32), np.cumsum(sizes) - sizes, sizes)
        return ids, np.diff(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row as uint32, and where each text begins (and the last ends)."""
        if not self.by_words:
            found = self.whole.encode_batch(["" if t is None else t for t in texts.to_pylist()], add_special_tokens=False)
            starts = np.cumsum([0, *(len(e.ids) for e in found)], dtype=np.int64)
            return np.array([i for e in found for i in e.ids], dtype=np.uint32), starts
        words = split_words(texts)
        flat, lengths = self._ids_by_word(words.vocabulary)
        ids, ends = gather(words.codes, flat, np.cumsum(lengths) - lengths, lengths)
        return ids, np.concatenate(([0], ends))[words.starts]


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for the vocabulary file.

    Task functions reach it through the module, so that they don't carry a copy of the table along.
    """
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with ``end_id`` after each text."""
    return np.insert(ids, starts[1:], np.uint32(end_id)), starts + np.arange(len(starts))
