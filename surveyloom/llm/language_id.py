"""Language identification by sparse multinomial logistic regression over TF-IDF character n-grams.

A document's features are the n-grams (``MIN_N`` to ``MAX_N`` characters) of its lower-cased words, marked at both ends and stripped of
signs; words without a letter have none. A feature's value is its count over the count of all n-grams of the document, times
``SCALE`` times its inverse document frequency ln((1 + documents) / (1 + documents with it)) + 1. Margins are thus sums over words, so
scoring needs each distinct word of a slice of texts once. N-grams are known by 64 bits of hash.

The weights are trained by follow-the-regularised-leader (McMahan et al. 2013) with per-coordinate rates, and an
elastic-net penalty, whose l1 part leaves most weights at zero. A fifth of the sample takes no part in that; on it the margins
are divided by the temperature that gives the least log loss, so that scores are probabilities.

Fitting reads a sample of at most ``max_rows`` documents (or one per language, if there are more languages), the same
number for each language, those with the smallest hash of their id, with whole texts. N-grams are counted in tasks; the driver
sees ``features`` numbers per row at most. Prediction reads everything and shuffles nothing.

Cases: a text that is null or has no letter is ``und`` with score 0. So is every text if nothing could be learned. With one learned language
all other texts are that language with score 1. Texts whose n-grams are all unknown get the language of the largest intercept. Equal
margins go to the first language in order. Documents without language, text or letter teach nothing; null ids hash like
empty text. Repeated rows get the same result, and empty tables are fine. Result columns replace columns of the same name; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.arrow_text import Words, gather, slices, split_words
from surveyloom.llm.columns import text_of
from surveyloom.schema import require_columns
from surveyloom.session import materialize

MIN_N, MAX_N = 1, 4
SCALE = 100.0
UNKNOWN = "und"
#: Bytes of text handled at once in fitting and scoring.
COUNT_BYTES, SCORE_BYTES = 1 << 20, 4 << 20
EDGES = r"^[^\p{L}]+|[^\p{L}]+$"


def letter_words(texts: pa.Array) -> Words:
    """Lower-cased words that hold a letter, without signs and digits at their ends."""
    words = split_words(texts)
    forms = pc.replace_substring_regex(pc.utf8_lower(words.vocabulary), EDGES, "").dictionary_encode()
    codes = forms.indices.to_numpy(zero_copy_only=False)[words.codes]
    out = Words(codes, forms.dictionary, words.starts)
    return out.keep(pc.not_equal(forms.dictionary, "").to_numpy(zero_copy_only=False)[codes])


def n_grams(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of all n-grams of the marked words, with repeats; an n-gram is known by 64 bits of hash from here on."""
    marked = np.frombuffer("".join(f"<{w}>" for w in vocabulary.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    word = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(marked))  # characters from here to the end of the word
    hashes, owners = [], []
    held = np.full(len(marked), 0x51_7C_C1_B7_27_22_0A_95, np.uint64)
    for n in range(1, MAX_N + 1):
        last = max(0, len(marked) - n + 1)
        held = (held[:last] ^ marked[n - 1 : n - 1 + last]) * np.uint64(0x9E3779B97F4A7C15)
        held ^= held >> np.uint64(29)
        if n >= MIN_N:
            whole = left[:last] >= n
            hashes.append(held[whole].view(np.int64))
            owners.append(word[:last][whole])
    return np.concatenate(hashes), np.concatenate(owners)


def gram_counts(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of the texts, and (text, number of the n-gram, count) of all that occur, in the order of texts."""
    size = max(1, len(words.vocabulary))
    pairs, times = np.unique(words.texts * size + words.codes, return_counts=True)
    hashes, word = n_grams(words.vocabulary)
    index, number = np.unique(hashes, return_inverse=True)
    sizes = np.bincount(word, minlength=size)
    flat = number[np.argsort(word, kind="stable")]
    held, ends = gather(pairs % size, flat, np.cumsum(sizes) - sizes, sizes)
    each = np.diff(np.concatenate(([0], ends)))
    width = max(1, len(index))
    keys, back = np.unique(np.repeat(pairs // size, each) * width + held, return_inverse=True)
    counts = np.bincount(back, np.repeat(times, each), minlength=len(keys))
    return index, keys // width, keys % width, counts


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # hashes, in rising order
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # by n-gram and language, inverse document frequency included
    intercepts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0

    def margins(self, texts: pa.Array) -> np.ndarray:
        words = letter_words(texts)
        hashes, word = n_grams(words.vocabulary)
        size, n = max(1, len(words.vocabulary)), len(texts)
        at = np.searchsorted(self.grams, hashes)
        known = np.flatnonzero(self.grams[np.minimum(at, len(self.grams) - 1)] == hashes) if len(self.grams) else np.zeros(0, np.int64)
        row, owner = at[known], word[known]
        adds = [np.bincount(owner, col[row], minlength=size) for col in self.weights.T]  # of one occurrence of each word
        adds.append(np.bincount(word, minlength=size))  # its number of n-grams
        sums = np.column_stack([np.bincount(words.texts, add[words.codes], minlength=n) for add in adds])
        return SCALE * sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.intercepts


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def sampled_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_rows: int) -> DataFrame:
    """(text, lang, draw) of the documents with the smallest ``draw`` of each language, stored."""
    known = docs.select(
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
        F.pmod(F.xxhash64(F.lit(29), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 53)).alias("draw"),
    ).where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    quota = max(1, max_rows // max(1, len(counts)))
    # Twice the share that is wanted, and a thousand rows, pass here; the exact cut is left to the window on what remains.
    limits = [(lang, int(min(1.0, (2 * quota + 1000) / n) * (1 << 53))) for lang, n in counts.items()]
    bounds = docs.sparkSession.createDataFrame(limits, "bound_lang string, bound long")
    near = known.join(F.broadcast(bounds), F.col("lang") == F.col("bound_lang")).where("draw <= bound")
    first = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"))
    drawn = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= quota)
    return materialize(drawn.select("text", "lang", "draw"), "language-sample", spread=True)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each n-gram, per slice."""
    for batch in slices(batches, most=COUNT_BYTES):
        grams, _, gram, _ = gram_counts(letter_words(batch.column("text")))
        counts = np.bincount(gram, minlength=len(grams))
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], names=["gram", "docs"])


def _features(sent):
    """Per document: its known n-grams and their shares of all its n-grams, as packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in slices(batches, most=COUNT_BYTES):
            grams, text, gram, count = gram_counts(letter_words(batch.column("text")))
            at = np.minimum(np.searchsorted(index, grams), len(index) - 1)
            number = np.where(index[at] == grams, at, -1).astype(np.int32)
            share = count / np.bincount(text, count, minlength=batch.num_rows)[text]
            known = number[gram] >= 0
            edges = np.searchsorted(text[known], np.arange(batch.num_rows + 1))
            numbers, shares = number[gram][known], share[known]
            packed = [[x[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)] for x in (numbers, shares)]
            cols = [batch.column("lang"), batch.column("draw"), *(pa.array(p, pa.binary()) for p in packed)]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "draw", "grams", "shares"])

    return run


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, width: int, classes: int,
    l1: float, l2: float, rate: float, epochs: int, seed: int = 1,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and intercepts; each row is (feature numbers, values), the order is drawn anew per epoch."""
    pull, spread = np.zeros((width, classes)), np.zeros((width, classes))
    own_pull, own_spread = np.zeros(classes), np.zeros(classes)

    def solved(z: np.ndarray, n: np.ndarray, first: float, second: float) -> np.ndarray:
        return np.where(np.abs(z) <= first, 0.0, (np.sign(z) * first - z) / ((1 + np.sqrt(n)) / rate + second))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, value = rows[k]
            z, n = pull[at], spread[at]
            w, b = solved(z, n, l1, l2), solved(own_pull, own_spread, 0.0, 0.0)
            error = softmax((value @ w + b)[None])[0]
            error[labels[k]] -= 1.0
            slope = value[:, None] * error
            square = slope * slope
            pull[at] = z + slope - (np.sqrt(n + square) - np.sqrt(n)) / rate * w
            spread[at] = n + square
            square = error * error
            own_pull += error - (np.sqrt(own_spread + square) - np.sqrt(own_spread)) / rate * b
            own_spread += square
    return solved(pull, spread, l1, l2), solved(own_pull, own_spread, 0.0, 0.0)


def best_temperature(margins: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm; the loss has one valley."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(margins / np.exp(log_t))[np.arange(len(labels)), labels]
        return -float(np.log(np.maximum(p, 1e-300)).mean())

    low, high, part = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_rows: int = 4_000,
    features: int = 6_000,
    min_docs: int = 3,
    l1: float = 0.05,
    l2: float = 0.01,
    rate: float = 0.2,
    epochs: int = 2,
) -> Model:
    """Fit to the documents with a language; leave those out that must not teach."""
    require_columns(docs, id_col, text_col, lang_col)
    rows = sampled_rows(docs, id_col, text_col, lang_col, max_rows)
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if len(languages) < 2:
        return Model(languages, weights=np.zeros((0, len(languages))), intercepts=np.zeros(len(languages)))
    total = rows.count()
    counted = rows.mapInArrow(_documents, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))
    common = counted.where(F.col("docs") >= min(min_docs, max(1, total // 10))).orderBy(F.desc("docs"), "gram").limit(features).collect()
    common.sort(key=lambda r: r["gram"])
    index = np.array([r["gram"] for r in common], np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(index)
    rarity = np.log((1 + total) / (1 + np.array([r["docs"] for r in common], float))) + 1
    packed = rows.mapInArrow(_features(sent), "lang string, draw long, grams binary, shares binary").collect()  # at most max_rows rows
    packed.sort(key=lambda r: (r["draw"], r["lang"], r["grams"], r["shares"]))
    grams = [np.frombuffer(r["grams"], np.int32) for r in packed]
    held = [(g, SCALE * np.frombuffer(r["shares"], np.float64) * rarity[g]) for g, r in zip(grams, packed, strict=True)]
    labels = np.array([languages.index(r["lang"]) for r in packed])
    kept_out = np.array([r["draw"] % 5 == 0 for r in packed])
    taught = [k for k in range(len(held)) if not kept_out[k]] or list(range(len(held)))
    weights, intercepts = train_ftrl([held[k] for k in taught], labels[taught], len(index), len(languages), l1, l2, rate, epochs)
    margins = np.array([value @ weights[at] + intercepts for at, value in held])
    temperature = best_temperature(margins[kept_out], labels[kept_out])
    used = np.flatnonzero(weights.any(axis=1))
    return Model(languages, index[used], weights[used] * rarity[used, None], intercepts, temperature)


def _predict(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array(model.languages, object)
        for batch in slices(batches, most=SCORE_BYTES):
            margins = model.margins(batch.column("text"))
            best = margins.argmax(axis=1)
            score = softmax(margins / model.temperature)[np.arange(len(best)), best]
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
            lang = pa.array(np.where(lettered, names[best], UNKNOWN), pa.string())
            cols = [*batch.columns[2:], lang, pa.array(np.where(lettered, score, 0.0))]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[2:], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) with ``lang_pred`` and ``score``, in place; no shuffle."""
    passed = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    if not model.languages:
        return docs.select(*passed, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    safe = {c: f"c{k}" for k, c in enumerate(passed)}
    rows = docs.select(text_of(text_col).alias("text"), has_letter(F.col(text_col).cast("string")).alias("lettered"), *[F.col(c).alias(s) for c, s in safe.items()])
    schema = rows.select(*safe.values(), F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most ``features`` n-grams
    scored = rows.mapInArrow(_predict(sent), schema)
    return scored.select(*[F.col(s).alias(c) for c, s in safe.items()], "lang_pred", "score")


def held_out(id_col: Column) -> Column:
    """A quarter of the ids; their languages are for checking only."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2
