"""Line dedup, URL rules, quality rules, decontamination and toxicity on small and odd tables."""

import itertools
import math
import time

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from surveyloom.llm import decontaminate, line_dedup, quality_rules, toxicity, url_rules

LONG = "\n".join(f"line {i} of a long text" for i in range(30_000))
CLASH = ("digest", "row_digest", "hit_doc", "lines", "score", "maybe", "host", "word", "node", "first", "n_removed")


@pytest.fixture(scope="module")
def messy(spark):
    """Nulls, empty and long texts, repeated rows, repeated ids, and columns that clash with names of ours."""
    texts = [
        (1, "a\nb\nc\nd", "s"), (2, "x\na\nb\nc\ny", "s"), (2, "x\na\nb\nc\ny", "s"), (3, None, None), (4, "", "s"), (None, "a\nb\nc", "t"),
        (5, LONG, "s"), (6, LONG, "t"), (7, "same\nsame\nsame\nsame\nsame", "t"), (7, "other text", None), (8, "a\nb", "s"),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(9) for c in CLASH}).repartition(3)


def _empty(df):
    return df.where("false")


def test_lines(messy):
    rows = line_dedup.dedup_lines(messy).collect()
    assert len(rows) == messy.count()
    got = sorted(((r.doc_id or -1, r.text, r.n_lines, r.n_removed) for r in rows if r.doc_id not in (5, 6)), key=str)
    assert got == sorted(
        [
            (-1, "a\nb\nc", 3, 0), (1, "d", 4, 3), (2, "x\ny", 5, 3), (2, "x\ny", 5, 3), (3, "", 1, 0), (4, "", 1, 0),
            (7, "same", 5, 4), (7, "other text", 1, 0), (8, "a\nb", 2, 0),
        ],
        key=str,
    )
    assert [(r.n_removed, r.text) for r in rows if r.doc_id == 6] == [(30_000, "")]
    assert [r.text for r in rows if r.doc_id == 5] == [LONG]
    assert line_dedup.dedup_lines(_empty(messy)).count() == 0


def test_lines_keep_other_columns(messy):
    out = line_dedup.dedup_lines(messy)
    assert sorted(out.columns) == sorted([*messy.columns, "n_lines"])
    assert {r.score for r in out.collect()} == {9}


def _judge(spark, urls, rules, **more):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    return {r.page_id: r for r in url_rules.judge_urls(pages, rules, **more).collect()}


def test_url_parts_and_rules(spark):
    urls = [
        "http://A.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://example.org/en/2", "https://xorg/", "http://b.com/de/1", "http://b.com/FR/",
        None, "no scheme", "http://", "x://h?q/es/", "http://example.org", "http://www.cheap-pills.net/", "http://a.net/cheap_pills.html", "http://cheappills.net/",
    ]
    got = _judge(spark, urls, [*url_rules.SITE_RULES, *url_rules.PATTERN_RULES])
    assert [(got[k].host, got[k].path) for k in (0, 6, 7, 8, 9, 10)] == [
        ("a.example.org", "/es/x"), ("", ""), ("", ""), ("", ""), ("h", ""), ("example.org", ""),
    ]
    assert [got[k].rule for k in range(6)] == ["example.org/es/", "example.org/en/1", "org/", None, "com/de/", None]
    assert [got[k].verdict for k in range(len(urls))] == (
        ["block", "block", "allow", "allow", "block", "allow"] + ["allow"] * 5 + ["block", "block", "allow"]
    )


def test_url_repeats_nulls_and_empty_tables(spark):
    pages = spark.createDataFrame([(None, "http://a.org/"), (None, "http://a.org/"), (1, None)], "page_id long, url string")
    assert url_rules.judge_urls(pages, url_rules.SITE_RULES).count() == 3
    assert url_rules.judge_urls(pages, []).where("verdict = 'allow'").count() == 3
    assert url_rules.judge_urls(_empty(pages), url_rules.SITE_RULES).count() == 0


def test_url_rule_goes_under_its_rarest_token(spark):
    urls = spark.createDataFrame([(["", "casino", "x"],), (["", "casino"],), (["", "bonus"],)], "tokens array<string>")
    table = url_rules._rule_table(spark, [url_rules.phrase_rule("block", "casino bonus"), url_rules.Rule("any", ".", "block", (), False)])
    filed = {r.rule: r.token for r in url_rules.rarest_token_index(urls, table).collect()}
    assert filed == {"casino bonus": "bonus", "any": ""}


def test_url_rule_without_token_is_tried_on_every_url(spark):
    got = _judge(spark, ["http://a.org/q7", "http://b.org/"], [url_rules.Rule("digit", "[0-9]", "block", (), False)])
    assert [got[k].verdict for k in (0, 1)] == ["block", "allow"]


def test_quality_measures(spark):
    docs = [
        (1, "a b c a b c", "h"), (2, None, "h"), (3, "  \n\nx$ \nx$ \n\t", "h"), (4, "a a a a", None), (5, "a b", "g"),
        (6, "é\u00a0ü ok", "g"), (7, "a\x0bb\x1cc", "g"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("host", F.lit(0))
    got = {r.doc_id: tuple(r)[2:] for r in quality_rules.measure(df).collect()}
    assert got == {
        1: (6, 6, 0, 0, 6), 2: (0, 0, 0, 0, 0), 3: (2, 4, 2, 1, 0), 4: (4, 4, 0, 0, 4), 5: (2, 2, 0, 0, 0), 6: (2, 5, 0, 0, 0), 7: (2, 4, 0, 0, 0),
    }


def test_quality_hosts_are_shrunk_and_take_their_documents(spark):
    rows = [("bad", True)] * 90 + [("bad", False)] * 10 + [("good", False)] * 100 + [("tiny", True)] + [(None, False)]
    rows += [(f"h{k}", False) for k in range(20)]
    df = spark.createDataFrame(rows, "host string, base_failed boolean")
    verdicts = {r.host: r for r in quality_rules.host_verdicts(df, 0.5).collect()}
    assert verdicts["bad"].host_failed and not verdicts["good"].host_failed
    assert verdicts["tiny"].rate < 1.0 and None not in verdicts
    prior = quality_rules.fit_prior(df.where("false").groupBy("host").agg(F.count("*").alias("docs"), F.lit(0).alias("failed")))
    assert (prior.failures, prior.passes) == (1.0, 1.0)


def test_quality_odd_rows(messy):
    out = quality_rules.judge_quality(messy)
    assert out.count() == messy.count()
    assert out.where("doc_id = 7 and n_words = 2 and host is null").count() == 1
    assert quality_rules.judge_quality(_empty(messy)).count() == 0


ITEM = " ".join(f"w{i}" for i in range(20))


def _swap(text, *places):
    parts = text.split()
    for p in places:
        parts[p] = "changed"
    return " ".join(parts)


def test_masks_hit_every_tolerated_pattern():
    for size, errors in ((12, 2), (15, 3), (16, 3)):
        for wrong in itertools.combinations(range(size), errors):
            assert any(
                all(at + o not in wrong for o in mask) for mask in decontaminate.MASKS for at in range(size - mask[-1])
            ), (size, wrong)


@pytest.mark.parametrize("size", range(5, 12))
def test_short_items_are_hit_at_every_tolerated_pattern(size):
    """All sets of replaced words, and one more than is tolerated."""
    draw = np.random.default_rng(size)
    item = " ".join(f"w{i}" for i in range(size))
    block = decontaminate.Block([(1, 7), (2, 8)], [item, ITEM.replace("w", "v")], decontaminate.Rules())
    for n in range(size // 5 + 2):
        for wrong in itertools.combinations(range(size), n):
            text = f"some {_swap(item, *wrong)} words" if draw.random() < 0.5 else _swap(item, *wrong)
            found = block.find(decontaminate.normal_words(pa.array(["w1 w2", text])))
            right = n <= size // 5 and not {0, size - 1} & {*wrong}
            assert plain.contaminated(text, [item]) == right
            assert found == ([(1, 1, 7, size, size - n)] if right else []), wrong


def test_short_items_in_the_report(spark):
    items = {n: " ".join(f"i{n}w{k}" for k in range(n)) for n in range(4, 12)}
    docs = [(n, f"a text with {_swap(t, 2, *([5] if n > 9 else []))} in it") for n, t in items.items()]
    docs += [(n + 100, f"a text with {_swap(t, 1, 2, *([5] if n > 9 else []))} in it") for n, t in items.items()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.overlap_words, r.equal_words) for r in decontaminate.report(df, benchmark).collect() if r.contaminated}
    assert got == {n: (n, n, n - (2 if n > 9 else 1)) for n in range(5, 12)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, benchmark).collect()} == {d for d, _ in docs} - set(got)


def test_longest_stretch_against_all_stretches():
    draw = np.random.default_rng(3)
    for _ in range(300):
        equal = draw.random(draw.integers(0, 25)) < 0.7
        best = max(
            (b - a for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if equal[a] and equal[b - 1] and 5 * equal[a:b].sum() >= 4 * (b - a)),
            default=0,
        )
        assert decontaminate.longest_stretch(equal, decontaminate.Rules().agree)[0] == best


def test_contaminated_documents(spark):
    docs = {
        1: f"before it {ITEM} after", 2: _swap(ITEM, 3, 9, 15), 3: " ".join(ITEM.split()[:6]) + " and then other words", 4: None, 5: "", 6: ITEM.upper().replace(" ", ",\n"),
        7: " ".join(ITEM.split()[4:16]), 8: _swap(ITEM, *range(0, 20, 3)), 9: "one two three four five", 10: "one two three four", 11: "filler " * 50_000 + ITEM,
    }
    items = [(1, ITEM), (2, None), (3, "one two three four five"), (4, "one two"), (None, "filler filler"), (5, ITEM)]
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumns({c: F.lit(9) for c in CLASH})
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for chars in (decontaminate.BLOCK_CHARS, 60):  # one block, several blocks
        got = {r.doc_id: r for r in decontaminate.report(df, benchmark, block_chars=chars).collect()}
        assert {k for k, r in got.items() if r.contaminated} == {k for k, t in docs.items() if plain.contaminated(t or "", [t for _, t in items if t])}
        assert (got[1].n_items, got[1].item_id, got[1].overlap_words, got[1].equal_words) == (2, 1, 20, 20)
        assert (got[2].overlap_words, got[2].equal_words) == (20, 17)
    kept = decontaminate.drop_contaminated(df, benchmark)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if not r.contaminated}


def test_contamination_odd_tables(spark, messy):
    benchmark = spark.createDataFrame([(1, "line 5 of a long text line 6 of a long text")], "item_id long, text string")
    got = decontaminate.report(messy, benchmark)
    assert got.count() == messy.count()
    assert {r.doc_id for r in got.where("contaminated").collect()} == {5, 6}
    assert decontaminate.report(_empty(messy), benchmark).count() == 0
    assert decontaminate.report(messy, benchmark.where("false")).where("contaminated").count() == 0


@pytest.fixture(scope="module")
def spoken(spark):
    draw = np.random.default_rng(1)
    rows, labels = [], []
    for k in range(600):
        toxic = k % 5 == 0
        text = [str(draw.choice(["the", "river", "runs", "slowly", "home", "again"])) for _ in range(int(draw.integers(5, 60)))]
        if toxic:
            text[int(draw.integers(len(text)))] = str(draw.choice(["Idiotic!", "idiot,", "scumbag", "scum"]))
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    labels += [(None, 1), (1, None), (5, 0), (10_000, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_and_scores_like_plain_python(spoken):
    docs, labels = spoken
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs.withColumns({"score": F.lit(1), "c0": F.lit(2), "margin": F.lit(3)}), model)
    assert sorted(scored.columns) == ["c0", "doc_id", "margin", "score", "text"]
    rows = scored.collect()
    for r in rows:
        grams = set().union(*(toxicity.n_grams(w) for w in r.text.lower().replace("!", "").replace(",", "").split()))
        margin = model.intercept + sum(model.weights.get(g, 0.0) for g in grams)
        assert math.isclose(r.score, 1 / (1 + math.exp(-margin)), rel_tol=1e-9)
        assert (r.score >= 0.5) == (r.doc_id % 5 == 0)


def test_toxicity_without_a_model(spark, spoken, messy):
    docs, labels = spoken
    for some, expected in ((labels.where("false"), 0.0), (labels.where("toxic = 0"), 0.0)):
        model = toxicity.fit(docs, some)
        assert {round(r.score, 6) for r in toxicity.score(docs, model).collect()} == {expected}
    model = toxicity.fit(docs, labels.where("toxic = 1"))
    assert all(0.5 < r.score < 1 for r in toxicity.score(docs, model).collect())


def test_toxicity_odd_rows(spoken, messy):
    model = toxicity.fit(*spoken)
    rows = toxicity.score(messy, model, keep=["doc_id"]).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
    empty = 1 / (1 + math.exp(-model.intercept))
    assert all(math.isclose(r.score, empty) for r in rows if r.doc_id in (3, 4))
    assert toxicity.score(_empty(messy), model).count() == 0


def test_marked_words_strip_signs():
    words = toxicity.marked_words(pa.array(["«Hey», you! -- it's", None, ""]))
    assert [words.vocabulary[c].as_py() for c in words.codes] == ["hey", "you", "it's"]
    assert words.starts.tolist() == [0, 3, 3, 3]


def test_items_without_an_id_are_items(spark):
    docs = [(1, f"before it {ITEM} after"), (2, "clean words"), (3, _swap(ITEM, 3).replace("w", "v"))]
    other = ITEM.replace("w", "v")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, ITEM), (None, other), (None, ITEM), (9, other)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(df, benchmark).collect()}
    assert {k: (r.contaminated, r.n_items, r.item_id, r.overlap_words) for k, r in got.items()} == {1: (True, 1, None, 20), 2: (False, 0, None, 0), 3: (True, 2, 9, 20)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, benchmark).collect()} == {2}


def test_text_that_repeats_itself():
    """One word thousands of times against an item of the same: linear in both; the report is that of all shifts."""
    block = decontaminate.Block([(1, 7), (2, 8)], ["x " * 800, "a b " * 40], decontaminate.Rules())
    began = time.perf_counter()
    assert block.find(decontaminate.normal_words(pa.array(["x " * 20_000, "y " * 20_000]))) == [(0, 1, 7, 800, 800)]
    assert time.perf_counter() - began < 2.0
    assert block.find(decontaminate.normal_words(pa.array(["b a " * 3000, "x " * 13 + "q " + "x " * 3]))) == [(0, 2, 8, 80, 80), (1, 1, 7, 17, 16)]


def test_random_repetitive_texts_against_all_shifts():
    draw = np.random.default_rng(12)
    for _ in range(60):
        items = [" ".join(draw.choice(["a", "b", "c"], draw.integers(5, 30), p=[0.8, 0.15, 0.05])) for _ in range(3)]
        texts = [" ".join(draw.choice(["a", "b", "c", "d"], draw.integers(0, 40), p=[0.7, 0.15, 0.1, 0.05])) for _ in range(6)]
        block = decontaminate.Block([(k, k) for k in range(3)], items, decontaminate.Rules())
        found = {(text, item) for text, item, *_ in block.find(decontaminate.normal_words(pa.array(texts)))}
        assert found == {(i, j) for i, t in enumerate(texts) for j, item in enumerate(items) if plain.contaminated(t, [item])}
