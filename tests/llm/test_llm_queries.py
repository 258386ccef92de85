"""The registered queries and the pipeline over the small tables."""

import base64
import collections
import hashlib
import math
import zlib

import plain
import public_tokenizers
import pytest
from compare import check, duck
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
import corpus_pipeline
from surveyloom.llm import toxicity
from surveyloom.llm.oracle import ORACLES
from surveyloom.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r.doc_id, r.text) for r in plain.read(spark, SMALL, "documents"))


@pytest.fixture(scope="module")
def ids(docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {d: library.encode(t, add_special_tokens=False).ids for d, t in docs}


def _run(spark, name):
    return {r[0]: r for r in QUERIES[name](spark, SMALL).collect()}


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry_module.queries())
    assert set(ORACLES) <= set(entry_module.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    check(spark, duck(SMALL), name, QUERIES[name], ORACLES[name], SMALL)


def test_token_files(spark, docs, ids):
    got, at = _run(spark, "op3_token_files"), 0
    for name, _ in docs:
        own = [*ids[name], 1]
        assert tuple(got[name]) == (name, at, len(own), plain.crc(own))
        at += len(own)


def test_contamination(spark, docs):
    items = [r.text for r in plain.read(spark, SMALL, "benchmark")]
    got = _run(spark, "op4_benchmark_decontamination")
    assert {k for k, r in got.items() if r.contaminated} == {d for d, t in docs if plain.contaminated(t, items)}
    assert len(got) == len(docs)


def test_bytes(spark, docs):
    got = _run(spark, "op6_suffix_array_dedup")
    assert {k: tuple(r)[1:] for k, r in got.items()} == plain.cut_repeats(docs)


def test_archives(spark):
    pages = plain.read(spark, SMALL, "pages")
    best = collections.defaultdict(int)
    for p in pages:
        best[p.html] = max(best[p.html], p.page_id)
    got = _run(spark, "op7_warc")
    assert len(got) == len(pages)
    for p in pages:
        data, keeper = p.html.encode(), best[p.html]
        kind = ("response", None) if keeper == p.page_id else ("revisit", keeper)
        assert tuple(got[p.page_id]) == (p.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *kind)


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, sf).collect()}
    labels = plain.read(spark, sf, "labels")
    held = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in held)
    assert all(r.predicted == (r.score >= 0.5) for r in got.values())
    caught = sum(got[r.doc_id].predicted for r in held if r.toxic)
    wrong = sum(got[r.doc_id].predicted for r in held if not r.toxic)
    assert caught / sum(r.toxic for r in held) > 0.85 and wrong / len(held) < 0.01


def test_near_classes(spark, docs):
    got = _run(spark, "op9_minhash_near_dedup")
    assert {k: r.class_id for k, r in got.items()} == plain.near_classes(docs)
    assert all(r.kept == (r.class_id == k) for k, r in got.items())


def test_packing(spark, ids):
    rows = QUERIES["op10_best_fit_packing"](spark, SMALL).collect()
    whole = {d: [*v, 0] for d, v in ids.items()}
    assert plain.check_packing(rows, whole, 2048) <= -(-sum(map(len, whole.values())) // 2048) + 1


def test_pipeline_equals_plain_python(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.fit(table, labels.where(~toxicity.held_out(F.col("doc_id"))))
    left = {}
    for r in table.collect():
        words = (w.lower() for w in r.text.split())
        clean = ("".join(w).strip("".join(c for c in set(w) if not c.isalnum())) for w in words)
        grams = set().union(*(toxicity.n_grams(w) for w in clean if w))
        if model.intercept + sum(model.weights.get(g, 0.0) for g in grams) < 0:
            left[r.doc_id] = r.text
    left = plain.drop_lines(list(left.items()))
    classes = plain.near_classes(sorted(left.items()))
    items = [r.text for r in plain.read(spark, SMALL, "benchmark")]
    left = {d: t for d, t in left.items() if classes[d] == d and not plain.contaminated(t, items)}
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 0] for d, t in left.items()}
    assert plain.check_packing(rows, ids, 2048) <= math.ceil(sum(map(len, ids.values())) / 2048) + 1


def test_stages_keep_columns_and_clean_documents(spark):
    odd = spark.createDataFrame(
        [(1, "a clean text of a few words", "en", "s", 27, 5), (2, None, None, None, None, 6), (None, "", "en", "s", 0, 7)],
        "doc_id long, text string, lang string, source string, n_chars long, score int",
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SMALL)
        assert out.columns == odd.columns
        assert out.where("doc_id = 1").collect() == odd.where("doc_id = 1").collect()
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SMALL).count() == 3
