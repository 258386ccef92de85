"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A document has a feature for each n-gram (``MIN_N`` to ``MAX_N`` characters, within words marked at both ends) that it holds.
From labelled texts, counts of documents per class and n-gram give a ratio r = log((p / |p|) / (q / |q|)) with one added
to each count; the n-grams whose classes differ most (by chi-square, at least ``min_docs`` documents) stay, a present
feature has the value r, and a logistic regression with a ridge penalty is fitted to these values. A score is the logistic
of the model's margin over all n-grams of the whole text.

Fitting reads a sample of at most ``max_rows`` labelled documents, those with the smallest hash of their id, with their
whole texts; the counting is done in tasks, and the model fit sees ``features`` numbers per row at most. Scoring reads everything.

Cases: null and empty texts have no feature and get the logistic of the intercept. Documents without a label, a null
id, or a null label teach nothing; of several labels for an id the largest counts. With one class only or no labels there is
no model: the score is the share of label 1 with half a row of label 0 added (0 without labels). Repeated rows get the same
score. Empty tables are fine. Other columns pass through ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.arrow_text import Words, gather, lean_slices, split_words
from surveyloom.llm.columns import text_of
from surveyloom.schema import require_columns
from surveyloom.session import materialize

MIN_N, MAX_N = 3, 6
#: Bytes of text whose n-grams, and whose words, are held at once.
COUNT_BYTES, SCORE_BYTES = 2 << 20, 4 << 20
TRIM = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def marked_words(texts: pa.Array) -> Words:
    """Lower-cased words without signs at their ends; the vocabulary has every form once."""
    words = split_words(texts)
    forms = pc.replace_substring_regex(pc.utf8_lower(words.vocabulary), TRIM, "").dictionary_encode()
    codes = forms.indices.to_numpy(zero_copy_only=False)[words.codes]
    out = Words(codes, forms.dictionary, words.starts)
    return out.keep(pc.not_equal(forms.dictionary, "").to_numpy(zero_copy_only=False)[codes])


def n_grams(word: str) -> set[str]:
    marked = f"<{word}>"
    return {marked[i : i + n] for n in range(MIN_N, MAX_N + 1) for i in range(len(marked) - n + 1)}


def _words_by_text(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, word) pairs."""
    size = max(1, len(words.vocabulary))
    pairs = np.unique(words.texts * size + words.codes)
    return pairs // size, pairs % size


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  # margin that an n-gram adds where it is present
    intercept: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        words = marked_words(texts)
        index = {g: k for k, g in enumerate(self.weights)}
        found = [[index[g] for g in n_grams(w) if g in index] for w in words.vocabulary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((k for f in found for k in f), np.int64, int(sizes.sum()))
        text, word = _words_by_text(words)
        held, ends = gather(word, flat, np.cumsum(sizes) - sizes, sizes)
        owner = np.repeat(text, np.diff(np.concatenate(([0], ends))))
        size = max(1, len(index))
        pairs = np.unique(owner * size + held)
        weight = np.fromiter(self.weights.values(), float, len(index))
        return np.bincount(pairs // size, weight[pairs % size], minlength=len(texts)) + self.intercept


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(text, label) of at most ``max_rows`` documents, those with the smallest hash of their id; stored."""
    known = labels.select(F.col(id_col).alias("known"), F.col(label_col).cast("int").alias("label")).where("known is not null and label is not null")
    known = known.groupBy("known").agg(F.max("label").alias("label"))
    drawn = known.orderBy(F.xxhash64(F.lit(17), "known"), "known").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text"))
    joined = rows.join(F.broadcast(drawn), F.col("doc") == F.col("known"))  # at most max_rows short rows
    return materialize(joined.select("text", "label"), "toxicity-sample", spread=True)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class per n-gram, summed over the batch."""
    for batch in lean_slices(batches, most=COUNT_BYTES):
        words = marked_words(batch.column("text"))
        text, word = _words_by_text(words)
        grams: dict[str, int] = {}
        found = [[grams.setdefault(g, len(grams)) for g in n_grams(w)] for w in words.vocabulary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((k for f in found for k in f), np.int64, int(sizes.sum()))
        held, ends = gather(word, flat, np.cumsum(sizes) - sizes, sizes)
        owner = np.repeat(text, np.diff(np.concatenate(([0], ends))))
        pairs = np.unique(owner * max(1, len(grams)) + held)
        positive = batch.column("label").to_numpy(zero_copy_only=False)[pairs // max(1, len(grams))] > 0
        gram = pairs % max(1, len(grams))
        counts = [np.bincount(gram[m], minlength=len(grams)) for m in (positive, ~positive)]
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), *map(pa.array, counts)], names=["gram", "pos", "neg"])


def n_gram_ratios(rows: DataFrame, features: int, min_docs: int) -> dict[str, float]:
    """The naive Bayes log-count ratio of the ``features`` n-grams that tell the classes apart best."""
    grams = rows.mapInArrow(_count, "gram string, pos long, neg long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    grams = materialize(grams, "toxicity-grams")
    pos, neg = rows.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    p_all, q_all = grams.agg(F.sum(F.col("pos") + 1), F.sum(F.col("neg") + 1)).first()
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    gap = a * F.lit(float(neg)) - b * F.lit(float(pos))
    chi = gap * gap / ((a + b) * (F.lit(float(pos + neg)) - a - b + 1))
    ratio = F.log((a + 1) / F.lit(float(p_all))) - F.log((b + 1) / F.lit(float(q_all)))
    best = grams.where(a + b >= min_docs).orderBy(chi.desc(), "gram").limit(features)
    return {r["gram"]: r["ratio"] for r in best.select("gram", ratio.alias("ratio")).collect()}


def _present(ratios: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {g: k for k, g in enumerate(ratios)}
        for batch in lean_slices(batches, most=COUNT_BYTES):
            words = marked_words(batch.column("text"))
            found = [[index[g] for g in n_grams(w) if g in index] for w in words.vocabulary.to_pylist()]
            rows: list[set[int]] = [set() for _ in range(batch.num_rows)]
            for text, word in zip(*(x.tolist() for x in _words_by_text(words)), strict=True):
                rows[text].update(found[word])
            held = pa.array([sorted(r) for r in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([held, batch.column("label")], names=["held", "label"])

    return run


def fit_ridge_logistic(
    held: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, penalty: float, steps: int, lift: float = 1.0
) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent. Returns weights per feature and intercept.

    ``held`` lists the present features of each row; rows of label 1 weigh ``lift`` times as much as the others.
    """
    sizes = np.array([len(h) for h in held])
    cols = np.concatenate([*held, np.empty(0, np.int64)]).astype(np.int64)
    rows = np.repeat(np.arange(len(held)), sizes)
    values = ratios[cols]
    n, width = len(held), len(ratios)

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(rows, values * w[cols], minlength=n)

    def back(x: np.ndarray) -> np.ndarray:
        return np.bincount(cols, values * x[rows], minlength=width)

    probe = np.ones(width)
    for _ in range(20):  # largest eigenvalue of the square of the matrix, for the step
        probe = back(times(probe))
        size = np.linalg.norm(probe) or 1.0
        probe /= size
    mass = np.where(labels > 0, lift, 1.0)
    mass /= mass.sum()
    step = 1.0 / (0.25 * (size + n) * mass.max() + penalty)
    w = v = np.zeros(width)
    b = u = float(np.log((lift * labels.sum() + 0.5) / (n - labels.sum() + 0.5)))
    for k in range(steps):
        error = (_logistic(times(v) + u) - labels) * mass
        w_next, b_next = v - step * (back(error) + penalty * v), u - step * error.sum()
        pull = k / (k + 3)
        v, u = w_next + pull * (w_next - w), b_next + pull * (b_next - b)
        w, b = w_next, b_next
    return w * ratios, b


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 8_000,
    features: int = 3_000,
    min_docs: int = 5,
    penalty: float = 1e-3,
    steps: int = 600,
    lift: float = 5.0,
) -> Model:
    """Fit to the labelled documents; leave those out that must not teach."""
    require_columns(docs, id_col, text_col)
    require_columns(labels, id_col, label_col)
    rows = labelled_rows(docs, labels, id_col, text_col, label_col, max_rows)
    total, positive = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    positive = positive or 0
    if positive in (0, total):
        share = positive / (positive + 0.5) if positive else 0.0
        return Model({}, float(np.log(share / (1 - share))) if share else -500.0)
    ratios = n_gram_ratios(rows, features, min_docs)
    seen = rows.mapInArrow(_present(ratios), "held array<int>, label int").collect()  # at most max_rows rows of at most ``features`` numbers
    held = [np.array(r["held"], np.int64) for r in seen]
    weights, intercept = fit_ridge_logistic(held, np.array([r["label"] for r in seen], float), np.array(list(ratios.values())), penalty, steps, lift)
    return Model(dict(zip(ratios, weights.tolist(), strict=True)), float(intercept))


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in lean_slices(batches, most=SCORE_BYTES):
            score = _logistic(model.margins(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score)], names=[*batch.schema.names[1:], "score"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """The columns ``keep`` (default: all) and the score, in place; no shuffle."""
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if keep is None else keep) if c != score_col]
    safe = {c: f"c{k}" for k, c in enumerate(kept)}
    rows = docs.select(text_of(text_col).alias("text"), *[F.col(c).alias(s) for c, s in safe.items()])
    schema = rows.select(*safe.values(), F.lit(0.0).alias("score")).schema
    scored = rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), schema)
    return scored.select(*[F.col(s).alias(c) for c, s in safe.items()], F.col("score").alias(score_col))


def held_out(id_col: Column) -> Column:
    """A fifth of the ids; their labels are for checking only."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0
