"""Centroid clustering, periodic runs and language identification against plain Python, and on odd tables."""

import hashlib
import re
import zlib

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from surveyloom.llm import centroids, language_id, periodic_runs
from surveyloom.llm.registry import QUERIES, planted_periods

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- clusters


def plain_clusters(rows, k, rounds, scale):
    """Exact integer clustering without any filter."""
    vecs = [(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v, i) for i, v in rows]
    ints = lambda v: [max(-(2**27), min(2**27, int(np.floor(scale * x)))) for x in v]
    centres = [ints(v) for _, v, _ in sorted(vecs, key=lambda r: r[:2])[:k]]
    points = [(i, ints(v)) for _, v, i in vecs]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in points]

    for _ in range(rounds):
        got = assign()
        for n in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(points, got) if c == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own)]
    got = assign()
    return sorted(((i, c, d) for (i, _), (d, c) in zip(points, got)), key=str), centres


@pytest.mark.parametrize("pivots", [1, 3, 16])
def test_clusters_equal_plain_ones(spark, pivots):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (5, 6))
    points = np.concatenate([base[rng.integers(0, 5, 300)] + rng.normal(0, 0.05, (300, 6)), np.round(rng.normal(0, 1, (60, 6)))])
    rows = [(k, [float(x) for x in p]) for k, p in enumerate(points)]
    rows += [(None, rows[0][1]), (7, rows[1][1]), (7, rows[1][1]), (500, [1e300] * 6), (501, [-1e300] * 6), (502, [0.0] * 6)]
    df = spark.createDataFrame(rows, "cluster long, vec array<double>").repartition(5)
    out = centroids.cluster(df, "cluster", "vec", k=9, rounds=3, dims=6, scale=64.0, pivots=pivots)
    assert out.columns == ["cluster", "cluster_", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = out.collect()
    wanted, centres = plain_clusters(rows, 9, 3, 64.0)
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == wanted
    own = {}
    for _, c, d in wanted:
        own[c] = own.get(c, 0) + d
    fits = lambda x: x if x < 1 << 63 else None
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (fits(own[r.cluster_]), fits(sum(own.values())))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster_])).encode()).hexdigest()


def test_odd_vectors_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [1.0, -inf]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("parts", F.lit(1)).withColumn("id", F.lit("x"))
    got = centroids.cluster(df, k=4, dims=2).collect()
    assert sorted((r.vec_id, r.cluster, r.distance, r.inertia) for r in got) == [(1, 0, 0, 0), (2, 0, 0, 0)]
    assert centroids.cluster(df.where("false"), dims=2).collect() == []
    assert centroids.cluster(df.where("vec_id > 2"), dims=2).count() == 0


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(1)
    base = rng.integers(-4000, 4000, (12, 64))
    points = base[rng.integers(0, 12, 2000)] + rng.integers(-60, 60, (2000, 64))
    centres = base + rng.integers(-30, 30, base.shape)
    simplex = centroids.Simplex.over(points[:12])
    apexes = simplex.project(points)
    maybe = centroids.candidates(simplex, apexes, centres)
    exact = np.column_stack([centroids.squared(points, c) for c in centres])
    assert maybe[np.arange(len(points)), exact.argmin(axis=1)].all()
    assert maybe.mean() < 0.4  # clustered vectors: most centroids are never compared
    again = centroids.Simplex.over(np.concatenate([points[:12], points[:12], points[:3] + 0]))
    assert len(again.pivots) == len(simplex.pivots)
    at, off = centroids.nearest(simplex, points, apexes, centres)
    assert (at == exact.argmin(axis=1)).all() and (off == exact.min(axis=1)).all()


# ---------------------------------------------------------------- periodic runs


def plain_runs(words):
    """All runs by the definition: per period the maximal stretches, without those of a smaller period."""
    found, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            if length >= max(24, 3 * q) and not any(all(words[j] == words[j + d] for j in range(s, s + length - d)) for d in range(1, q)):
                found.append((s, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), zlib.crc32(str(doc_id).encode()) // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def digests(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *first, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periods_of_the_query_equal_plain_ones(spark):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    rows = plain.read(spark, SMALL, "documents")
    assert len(got) == len(rows)
    periodic = 0
    for r in rows:
        words = plain_row(r.doc_id, r.text)
        if len(words) <= 1500:
            runs = plain_runs(words)
            assert got[r.doc_id] == digests(words, runs), r.doc_id
            periodic += bool(runs)
    assert periodic >= 15


def _runs(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in periodic_runs.collapse_runs(df, **more).collect()}


def test_random_texts_of_few_words(spark):
    rng = np.random.default_rng(5)
    texts = []
    for k in range(120):
        parts = []
        for _ in range(rng.integers(1, 6)):
            root = rng.choice(["a", "b", "c"][: 2 + k % 2], rng.integers(1, 40)).tolist()
            parts += (root * int(rng.integers(1, 9)))[: int(rng.integers(5, 160))]
        texts.append(" ".join(parts))
    got = _runs(spark, texts)
    assert sum(len(r.runs) for r in got.values()) > 80
    for k, text in enumerate(texts):
        words = text.split()
        runs = plain_runs(words)
        assert [(r.start, r.length, r.period) for r in got[k].runs] == runs, k
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert got[k].kept == " ".join(w for i, w in enumerate(words) if i not in gone)
        assert got[k].n_words == len(words)


def test_runs_near_every_bound(spark):
    """Roots of distinct words: lengths around the least one and around tile edges, at every place of the grid."""
    cases = []
    for q in (1, 2, 7, 8, 9, 15, 16, 17, 33, 64, 100):
        for before in (0, 1, q, 13):
            for length in (max(24, 3 * q) - 1, max(24, 3 * q), 3 * q + 25, 11 * q + 24):
                cases.append((q, before, length))
    texts = [" ".join([f"x{i}" for i in range(b)] + [f"w{i % q}" for i in range(length)] + ["y", "z"]) for q, b, length in cases]
    got = _runs(spark, texts)
    for k, (q, before, length) in enumerate(cases):
        wanted = [(before, length, q)] if length >= max(24, 3 * q) else []
        assert [(r.start, r.length, r.period) for r in got[k].runs] == wanted, cases[k]


def test_odd_texts(spark):
    long = " ".join(["same"] * 60_000)
    wide = " ".join(f"w{i % 20_000}" for i in range(60_001))
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a " * 30), (4, long), (5, wide), (6, "a " * 24), (6, "a " * 24), (6, "a " * 23), (7, "\u00a0 " * 25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(5)).withColumn("Kept", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("id", F.lit(2))
    out = periodic_runs.collapse_runs(df.repartition(4))
    assert out.columns == ["doc_id", "text", "digest", "id", "runs", "n_words", "kept"]
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.kept if len(r.kept) < 50 else len(r.kept.split())) for r in out.collect()), key=str)
    a24 = (6, 24, [(0, 24, 1)], "a")
    assert got == sorted(
        [
            (0, 30, [(0, 30, 1)], "a"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 60_000, [(0, 60_000, 1)], "same"),
            (5, 60_001, [(0, 60_001, 20_000)], 20_000), a24, a24, (6, 23, [], " ".join(["a"] * 23)), (7, 25, [(0, 25, 1)], "\u00a0"),
        ],
        key=str,
    )
    assert periodic_runs.collapse_runs(df.where("false")).count() == 0


def test_planted_texts(spark):
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows = [(k, " ".join(f"w{i}" for i in range(5 + k))) for k in ids] + [(ids[0] + 10_000, "a b"), (None, "a  b"), (ids[1], None), (ids[1], "")]
    got = planted_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (k, text), r in zip(rows, got, strict=True):
        if k in ids and text:
            assert r.text.split() == plain_row(k, text)
        elif k is None or text is None:
            assert r.text == text


def test_z_function():
    rng = np.random.default_rng(2)
    for _ in range(200):
        word = rng.integers(0, 2, rng.integers(0, 30)).tolist()
        wanted = [next((j for j in range(len(word) - i) if word[j] != word[i + j]), len(word) - i) for i in range(len(word))]
        assert periodic_runs.z_function(word) == wanted


# ---------------------------------------------------------------- languages


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op13_language_id"](spark, sf).collect()}
    rows = plain.read(spark, sf, "documents")
    assert len(got) == len(rows)
    hits = [got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out]
    assert sum(hits) / len(hits) > 0.98
    for r in rows:
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0.0 <= g.score <= 1.0
        assert (g.lang_pred == "und") == (not any(ch.isalpha() for ch in r.text or ""))


VOCABULARY = {"aa": ["kali", "mopo", "talu", "kinu"], "bb": ["schwer", "grund", "strich", "sprung"], "cc": ["été", "naïve", "garçon", "où"]}


@pytest.fixture(scope="module")
def taught(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(600):
        lang = ["aa", "bb", "cc"][0 if k % 10 else 1 + k % 20 // 10]  # one language holds nine of ten documents
        rows.append((k, " ".join(rng.choice(VOCABULARY[lang], rng.integers(3, 30))), lang))
    rows += [(None, "grund strich", "bb"), (700, None, "aa"), (701, "grund", None), (702, "123 --", "cc"), (5, "kali mopo", "aa")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(7)).withColumn("draw", F.lit("x"))


def test_languages_of_odd_texts(spark, taught):
    model = language_id.fit(taught.repartition(3), max_rows=150)
    texts = ["Kali MOPO!", "der Grund, schwer", "été été", None, "", "12 34 --", "中", "kali " * 300_000, "Kali MOPO!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("Score", F.lit(1)).withColumn("lang", F.lit("zz"))
    out = language_id.predict(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = [(r.lang_pred, r.score) for r in out.orderBy("doc_id").collect()]
    assert [g for g, _ in got[:6]] == ["aa", "bb", "cc", "und", "und", "und"] and got[7][0] == "aa"
    assert [s for _, s in got[3:6]] == [0.0] * 3 and got[6][0] in VOCABULARY and got[8] == got[0]
    assert language_id.predict(df.where("false"), model).count() == 0
    same = language_id.fit(taught.repartition(7), max_rows=150)  # the model doesn't depend on the layout
    assert np.allclose(model.weights, same.weights) and model.languages == same.languages


def test_languages_with_little_to_learn(spark, taught):
    none = language_id.fit(taught.where("false"))
    assert none.languages == [] and {(r.lang_pred, r.score) for r in language_id.predict(taught, none).collect()} == {("und", 0.0)}
    one = language_id.fit(taught.where("lang = 'bb'"))
    assert {r.lang_pred for r in language_id.predict(taught.where("doc_id < 100"), one).collect()} == {"bb"}


def test_ftrl_is_sparse_and_finds_the_classes():
    rng = np.random.default_rng(6)
    truth = rng.integers(0, 3, 900)
    rows = [(np.concatenate(([y], 3 + rng.choice(200, 5, replace=False))), np.ones(6)) for y in truth]
    weights, intercepts = language_id.train_ftrl(rows, truth, 203, 3, l1=3.0, l2=0.1, rate=0.3, epochs=2)
    margins = np.array([v @ weights[at] + intercepts for at, v in rows])
    assert (margins.argmax(axis=1) == truth).mean() > 0.99
    assert (weights[:3].diagonal() > 0).all() and (weights[3:] != 0).mean() < 0.2  # noise gets no weight


def test_temperature_gives_the_least_loss():
    rng = np.random.default_rng(8)
    margins = rng.normal(0, 1, (4000, 3))
    p = language_id.softmax(margins)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert 0.85 < language_id.best_temperature(margins, labels) < 1.15
    assert 2.6 < language_id.best_temperature(3 * margins, labels) < 3.4  # overconfident margins are cooled


def test_grams_are_those_of_the_marked_words():
    words = pa.array(["ab", "é\U0001f600x"])
    hashes, owner = language_id.n_grams(words)
    plain_grams = [[f"<{w}>"[i : i + n] for n in range(1, 5) for i in range(len(w) + 3 - n)] for w in words.to_pylist()]
    assert np.bincount(owner).tolist() == [len(g) for g in plain_grams]
    assert len(set(hashes.tolist())) == len({g for grams in plain_grams for g in grams})
