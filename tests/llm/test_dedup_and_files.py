"""Byte and near-duplicate removal, token files, archives and packing against plain Python."""

import base64
import collections
import gzip
import hashlib
import io
import random

import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from surveyloom.llm import components, deep_shallow, files, near_dedup, packing, suffix_dedup, token_files, token_ids, warc
from surveyloom.llm import weighted_minhash as wm
from surveyloom.llm.arrow_text import slices

PATH = public_tokenizers.path("word_bpe_49k.json")
CLASH = ("digest", "row", "doc", "maybe", "bits", "node", "place", "leaf", "bin", "gone_doc", "part", "score")
TEXTS = "doc_id long, text string"


def _clashing(df):
    return df.withColumns({c: F.lit(9) for c in CLASH})


def _odd(spark):
    """Nulls, empty and long texts, repeated rows and repeated ids."""
    long = " ".join(f"w{i} x{i % 7}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, long), (4, long), (4, long), (None, long), (None, None), (5, "just four words here"), (6, "Just four, words here!"), (6, "else")]
    return _clashing(spark.createDataFrame(rows, TEXTS)).repartition(3)


def test_multikey_quicksort_and_blind_tries_sort_suffixes():
    draw = random.Random(4)
    text = bytes(draw.choice(b"ab\x00") for _ in range(400)) * 2 + b"abab" * 60
    suffixes = [text[i : i + 60] for i in range(len(text))]
    order, groups = deep_shallow.multikey_quicksort(deep_shallow.as_words(suffixes, 16))
    for low, high in groups:
        members = order[low:high].copy()
        deep, common = deep_shallow.blind_order([suffixes[m] for m in members], 60)
        order[low:high] = members[deep]
        for k in range(1, len(deep)):
            a, b = suffixes[members[deep[k - 1]]], suffixes[members[deep[k]]]
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert common[k] == same
    padded = [suffixes[k].ljust(60, b"\0") for k in order]
    assert padded == sorted(padded)


def _planted(seed, n):
    draw = random.Random(seed)
    base = ["".join(draw.choice("abcd é") for _ in range(size)) for size in (99, 100, 101, 150, 260, 500)]
    parts = [lambda: "x" * draw.randint(0, 300), lambda: draw.choice(base), lambda: draw.choice(base)[draw.randint(0, 60) :], lambda: "ab" * draw.randint(0, 120)]
    parts += [lambda: str(draw.random()), lambda: draw.choice(base)[: draw.randint(90, 300)]]
    return [(k, "".join(draw.choice(parts)() for _ in range(draw.randint(0, 5)))) for k in range(n)]


@pytest.mark.parametrize(("seed", "hot"), [(1, 50_000), (2, 50_000), (2, 3), (4, 0)])
def test_repeated_bytes(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_SEED", hot)  # seeds of more surroundings are grouped by windows
    docs = _planted(seed, 150)
    rows = suffix_dedup.dedup_bytes(_clashing(spark.createDataFrame(docs, TEXTS)).repartition(5)).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows}
    assert got == plain.cut_repeats(docs)


def test_repeated_bytes_with_small_slices_and_chunks(spark, monkeypatch):
    docs = _planted(3, 80)
    data = pa.RecordBatch.from_arrays(
        [pa.array([d for d, _ in docs]), pa.array([0] * len(docs), pa.int32()), pa.array([t for _, t in docs])], names=["doc", "row", "text"]
    )
    whole = pa.Table.from_batches(suffix_dedup._scan(iter([data]))).num_rows
    monkeypatch.setattr(suffix_dedup, "SCAN_BYTES", 300)
    assert pa.Table.from_batches(suffix_dedup._scan(iter([data]))).num_rows == whole
    assert sum(b.num_rows for b in slices(iter([data]), most=300)) == len(docs)


def test_judging_does_not_depend_on_batches():
    draw = np.random.default_rng(2)
    n = 400
    rows = pa.table(
        {
            "seed": draw.integers(0, 40, n), "around": draw.integers(0, 3, n), "doc": draw.integers(0, 30, n), "row": np.zeros(n, np.int32),
            "place": draw.integers(0, 3, n).astype(np.int32), "settled": draw.random(n) < 0.1,
        }
    ).sort_by([(c, "ascending") for c in ("seed", "around", "doc", "row", "place")])
    results = []
    for size in (1, 2, 7, 400):
        out = pa.Table.from_batches(suffix_dedup._judge(iter(rows.to_batches(max_chunksize=size)))).to_pylist()
        results.append(collections.Counter(tuple(r.values()) for r in out))
    assert all(r == results[0] for r in results)


def test_repeated_bytes_odd_rows(spark):
    df = _odd(spark)
    rows = suffix_dedup.dedup_bytes(df).collect()
    assert len(rows) == df.count()
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.n_bytes > 0, r.n_removed == 0, bytes(r.kept) == b""))
    assert by[None] == {(True, True, False), (False, True, True)}  # null ids come first and keep their bytes
    assert by[3] == by[4] == {(True, False, True)} and by[1] == by[2] == {(False, True, True)}
    assert suffix_dedup.dedup_bytes(df.where("false")).count() == 0


def test_signatures_agree_as_often_as_sets_are_similar():
    draw = np.random.default_rng(7)
    hashes = np.sort(draw.integers(0, 1 << 63, 3_000, dtype=np.uint64) * np.uint64(2))
    weights = draw.random(3_000) * 9 + 1
    keep = draw.random(3_000) < 0.8
    other = weights[keep] * np.where(draw.random(int(keep.sum())) < 0.9, 1.0, 0.5)
    want = wm.similarity((hashes, weights), (hashes[keep], other))
    agree = []
    for k in range(40):  # other hashes are other draws
        h = wm.mix(hashes + np.uint64(k))
        a = wm.signatures(h, weights, np.array([0, len(h)]))
        b = wm.signatures(h[keep], other, np.array([0, int(keep.sum())]))
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - want**wm.ROWS) < 0.08
    shared = {int(h): min(w, v) for h, w, v in zip(hashes[keep], weights[keep], other, strict=True)}
    assert np.isclose(want, sum(shared.values()) / (weights.sum() + other.sum() - sum(shared.values())))


def _near_docs(seed, groups, size):
    draw = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(3_000)]
    out = []
    for _ in range(groups):
        base = [draw.choice(vocabulary) for _ in range(150)]
        for _ in range(size):
            text = list(base)
            for _ in range(draw.randint(0, 5)):
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
            out.append(" ".join(text))
    out += [" ".join(draw.choice(vocabulary) for _ in range(100)) for _ in range(40)] + ["Some exact copy, of six words!"] * 5 + ["some exact copy of six words"]
    draw.shuffle(out)
    return list(enumerate(out))


def test_near_classes_equal_those_of_all_pairs(spark):
    docs = _near_docs(5, 6, 25)
    df = _clashing(spark.createDataFrame(docs, TEXTS)).repartition(4)
    got = {r.doc_id: r for r in near_dedup.report(df).collect()}
    expected = plain.near_classes(docs)
    assert {k: r.class_id for k, r in got.items()} == expected
    assert {k for k, r in got.items() if r.kept} == set(expected.values())
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(expected.values())


@pytest.mark.parametrize("block", [512, 2])
def test_blocks_find_links_that_the_leader_misses(spark, monkeypatch, block):
    """A chain of versions, each near the next one only, two other texts, and one that is near none."""
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", block)
    draw = random.Random(1)
    chain = [[f"a{draw.random()}" for _ in range(400)]]
    for k in range(6):
        chain.append([*chain[-1][: 40 * k], *(f"b{draw.random()}" for _ in range(40)), *chain[-1][40 * k + 40 :]])
    far = [f"c{draw.random()}" for _ in range(400)]
    texts = [*chain, far, [*far[:390], *far[:10]], [f"d{k}" for k in range(50)], ["e"] * 60]
    nodes = spark.createDataFrame([(k, " ".join(v)) for k, v in enumerate(texts)], "node long, text string")
    idf = spark.sparkContext.broadcast(np.ones(1 << wm.IDF_BITS))
    buckets = spark.createDataFrame([(7, k) for k in range(len(texts))], "g long, node long")
    got = {r.node: r.root for r in near_dedup.link(buckets, nodes, idf, 0.8).collect()}
    assert got == {**{k: 0 for k in range(1, 7)}, 8: 7}


def _true_weights(texts):
    """Weights of the shingles of each text, from sets of words as they are."""
    shingles = []
    for text in texts:
        w = plain.words(text)
        shingles.append(collections.Counter(tuple(w[k : k + wm.SHINGLE]) for k in range(max(1, len(w) - wm.SHINGLE + 1)) if w))
    held = collections.Counter(x for s in shingles for x in s)
    n = len(texts)
    idf = {x: 1 + np.log(n / c) / np.log(n + 1) for x, c in held.items()}
    return held, [sorted((1 + np.log(c)) * idf[x] for x, c in s.items()) for s in shingles]


@pytest.mark.parametrize("bits", [6, 9])
def test_documents_are_counted_per_shingle(spark, monkeypatch, bits):
    """One long text does not raise the frequencies of the others' shingles, and a shingle twice in a text counts once."""
    monkeypatch.setattr(near_dedup, "LEAST_BITS", bits, raising=False)
    docs = [*(t for _, t in _near_docs(8, 3, 12)), " ".join(f"x{k}" for k in range(60_000)), "a b c d e f a b c d e f", None, "", "one two"]
    docs = [t or "" for t in docs]
    df = spark.createDataFrame(list(enumerate(docs)), TEXTS).repartition(5)
    held, weights = _true_weights(docs)
    s = wm.Shingles(pa.array(docs))
    got = s.weights(near_dedup.inverse_frequencies(df))
    for a, b, want in zip(s.starts, s.starts[1:], weights, strict=False):
        assert np.allclose(np.sort(got[a:b]), want)
    rows = near_dedup.signed(df.select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("digest"), "text"))[0].collect()
    found = {r.doc: sorted(near_dedup._numbers([r.freq]).tolist()) for r in rows}
    for k, text in enumerate(docs):
        w = plain.words(text)
        own = {tuple(w[i : i + wm.SHINGLE]) for i in range(max(1, len(w) - wm.SHINGLE + 1)) if w}
        assert found[k] == sorted(held[x] for x in own)


def test_shared_weights_equal_those_of_pairs():
    draw = np.random.default_rng(9)
    members = []
    for _ in range(12):
        hashes = np.unique(draw.integers(0, 60, 40, dtype=np.uint64))
        members.append((hashes, draw.integers(1, 4, len(hashes)), 1.0 + hashes.astype(float)))
    shared = near_dedup._shared_weights(members)
    for a, (ha, ca, ia) in enumerate(members):
        for b, (hb, cb, ib) in enumerate(members):
            other = dict(zip(hb.tolist(), (wm.term_weight(cb) * ib).tolist(), strict=True))
            expected = sum(min(w, other.get(h, 0.0)) for h, w in zip(ha.tolist(), (wm.term_weight(ca) * ia).tolist(), strict=True))
            assert a == b or np.isclose(shared[a, b], expected)


def test_near_odd_rows(spark):
    df = _odd(spark)
    rows = near_dedup.report(df).collect()
    assert len(rows) == df.count()
    classes = collections.defaultdict(set)
    for r in rows:
        classes[r.class_id].add(r.doc_id)
    assert dict(classes) == {1: {1, 2, None}, 3: {3, 4, None}, 5: {5, 6}, 6: {6}}
    assert near_dedup.report(df.where("false")).count() == 0


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1_000, 1_060)] + [(5_000, 5_000 + k) for k in range(1, 200)]
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root if find(k) != k}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


STRANGE = [
    None, "", "  ", "<|endoftext|> a<|startoftext|>b", "Don't  we'LL İstanbul ŉ ſ ﬁ 12 3a b2 ²³ ½ ª  á é a\x0bb\x1cc d <b> x<y",
    "ÀÉŒœ×÷_a__b..,!?'s''ve", "日本語 テスト 😀😀 ́x", " ́a", "ΣΑΣ K Å ẞ",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    texts = [*STRANGE, *(t for _, t in _near_docs(2, 2, 3))]
    ids, starts = token_ids.TextEncoder(path).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [
        library.encode(t or "", add_special_tokens=False).ids for t in texts
    ]


def _ids(docs, end):
    library = Tokenizer.from_file(PATH)
    return {d: [*library.encode(t or "", add_special_tokens=False).ids, end] for d, t in docs}


def test_token_files_round_trip(spark):
    docs = [(k * 3, t) for k, t in enumerate([*STRANGE, *(t for _, t in _near_docs(2, 4, 5))])]
    df = _clashing(spark.createDataFrame(docs, TEXTS)).repartition(4)
    tokens = token_files.write_tokens(df, PATH)
    ids, at = _ids(docs, 1), 0
    got = {r.doc_id: r for r in token_files.read_digests(tokens).collect()}
    for name in sorted(ids):
        assert tuple(got[name]) == (name, at, len(ids[name]), plain.crc(ids[name]))
        at += len(ids[name])
    few = {r.doc_id: r.ids for r in token_files.fetch(spark, tokens, [0, 30, 31, 60]).collect()}
    assert few == {k: ids[k] for k in (0, 30, 60)}


def test_dictionary_is_trained_on_whole_documents(spark):
    docs = [(k, t) for k, (_, t) in enumerate(_near_docs(9, 30, 20))]
    df = spark.createDataFrame(docs, TEXTS)
    small, same = (token_files.train_dictionary(df.repartition(k), PATH, "<u2", 4096, 1 << 20) for k in (1, 6))
    assert 0 < len(small) <= 4096 and small == same
    assert token_files.train_dictionary(df, PATH, "<u2", 4096, 10) == b""  # no document is that short
    plain_size, size = (sum(r["bytes"] for r in token_files.write_tokens(df, PATH, sample_bytes=n).manifest.collect()) for n in (1, 1 << 20))
    assert size < plain_size


def test_token_files_odd_rows_and_damage(spark):
    df = _odd(spark)
    tokens = token_files.write_tokens(df, PATH)
    rows = sorted(token_files.read_digests(tokens).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 3, 4, 4, 5, 6, 6]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert token_files.read_digests(token_files.write_tokens(df.where("false"), PATH)).count() == 0
    uri = tokens.manifest.first()["file"]
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.Reader(uri, b"not it")
    data = bytearray(files.stream(uri).read())
    data[-60 - 20] ^= 1  # inside the index
    with files.create(f"{uri}.damaged") as sink:
        sink.write(bytes(data))
    with pytest.raises(ValueError, match="damaged index"):
        token_files.Reader(f"{uri}.damaged", tokens.dictionary)


def _page_rows():
    rows = [(k, f"http://h/{k}\r\nX: y", f"<p>{k % 4} ünï\r\n\r\n</p>" * (1 + k % 3)) for k in range(40)]
    return [*rows, (50, None, None), (51, "u", ""), (52, "u", "z" * 300_000), (None, "u", "z" * 300_000), (52, "u", "z" * 300_000), (None, "u", "only null ids")]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(_page_rows(), "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "payload", "keeper", "id")})
    manifest = warc.write_archives(pages.repartition(3), archive_bytes=2_000)
    assert manifest.count() > 3
    rows = warc.read_archives(manifest).collect()
    assert len(rows) == len(_page_rows())
    best = collections.defaultdict(lambda: -1)
    for name, _, html in _page_rows():
        best[html or ""] = max(best[html or ""], -1 if name is None else name)
    expected = collections.Counter()
    for name, _, html in _page_rows():
        data = (html or "").encode()
        keeper = best[html or ""]
        first = keeper in (-1, name)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected[name, len(data), digest, "response" if first else "revisit", None if first else keeper, data if first else b""] += 1
    got = collections.Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in rows)
    assert got == expected
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0
    few = warc.read_archives(warc.write_archives(pages, min_bytes=1_000), keep_payload=False)
    assert {r.record_type for r in few.where("payload_bytes < 1000").collect()} == {"response"}


def test_archives_are_plain_gzip_members_and_damage_is_found():
    payload = b"<p>hello</p>" * 40_000
    record = warc.encode_record(7, "http://h/", payload, hashlib.sha1(payload).digest(), None)
    raw = gzip.decompress(record)
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(payload + b"\r\n\r\n")
    [back] = warc.read_records(io.BytesIO(record))
    assert (back.name, bytes(back.payload), back.http["content-length"]) == (7, payload, str(len(payload)))
    for wrong, error in ((raw.replace(b"hello", b"hallo", 1), "digest"), (raw[:-40] + raw[-4:], "shorter|digest"), (raw + b"x", "does not end")):
        with pytest.raises(warc.DamagedRecord, match=error):
            list(warc.read_records(io.BytesIO(gzip.compress(wrong))))
    with pytest.raises(warc.DamagedRecord, match="inside a gzip member"):
        list(warc.read_records(io.BytesIO(record[: len(record) // 2])))


def test_best_fit():
    draw = np.random.default_rng(6)
    lengths = draw.integers(1, 101, 500)
    bins, places, used = packing.best_fit(lengths, 100)
    assert used.max() <= 100 and used.sum() == lengths.sum() and len(used) <= -(-lengths.sum() // 100) * 1.1
    for b in range(len(used)):
        mine = sorted((p, n) for p, n in zip(places[bins == b], lengths[bins == b], strict=True))
        assert [p for p, _ in mine] == np.concatenate(([0], np.cumsum([n for _, n in mine])))[:-1].tolist()


def test_packing_pieces_and_tree(spark):
    docs = [(k, t) for k, t in enumerate([*STRANGE, *(t for _, t in _near_docs(8, 10, 20))])]
    df = _clashing(spark.createDataFrame(docs, TEXTS)).repartition(20)
    ids = _ids(docs, 0)
    for capacity, fan_in in ((64, 2), (2048, 4)):
        rows = packing.pack(df, PATH, capacity=capacity, fan_in=fan_in, slack=0).collect()
        whole = packing.pack(df.coalesce(1), PATH, capacity=capacity, slack=0).collect()
        n, best = plain.check_packing(rows, ids, capacity), plain.check_packing(whole, ids, capacity)
        assert -(-sum(map(len, ids.values())) // capacity) <= best <= n <= 1.05 * best + 1


@pytest.mark.parametrize("layout", ["sorted", "two parts", "one part", "mixed"])
@pytest.mark.parametrize("leaf_pieces,more", [(200_000, 1.01), (37, 1.1)])  # leaves of a few pieces can't all hold half long ones
def test_packing_does_not_depend_on_how_lengths_are_stored(spark, layout, leaf_pieces, more):
    """Long documents in one part and short ones in another need as few sequences as one best fit over all pieces."""
    docs = [(k, " ".join(["the"] * (1100 if k < 200 else 900))) for k in range(400)]
    ids = _ids(docs, 0)
    lengths = np.array([len(v) for v in ids.values()])
    best = len(packing.best_fit(lengths, 2048)[2])
    assert best == 200
    df = spark.createDataFrame(docs, TEXTS)
    df = {"sorted": df.repartitionByRange(8, "doc_id"), "two parts": df.repartitionByRange(2, "doc_id"), "one part": df.coalesce(1), "mixed": df.repartition(8)}[layout]
    rows = packing.pack(df, PATH, leaf_pieces=leaf_pieces, fan_in=4).collect()
    assert plain.check_packing(rows, ids, 2048) <= more * best


def test_tree_puts_half_full_bins_together(spark):
    bins = spark.createDataFrame([(k << 40, k, 900) for k in range(9)], "bin long, node int, used long")
    moved = packing.merge_up(bins, 2048, 16, 4096, 2).collect()
    assert len({r.target for r in moved}) == 5
    assert len({(r.target, r.shift) for r in moved}) == 9


def test_packing_odd_rows(spark):
    df = _odd(spark)
    rows = packing.pack(df, PATH).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, None}
    assert sorted(r.length for r in rows if r.doc_id in (1, 2)) == [1, 1]
    assert packing.pack(df.where("false"), PATH).count() == 0
