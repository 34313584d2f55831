"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import impact_search, kneser_ney, mixing, near_dup, packing, suffix_dedup, token_store, tokens, toxicity, url_filter, vector_tree
from siltstone.llm.registry import URL_RULES, tokenizer_path
from siltstone.llm.shared import new_path

DOCS = "doc_id long, text string, source string, lang string, n_chars long, size long, score double, row int, kind string, shard int, c int"


def make_docs(spark, rows, sources=None):
    """Rows (id, text), with extra columns whose names the operators use themselves."""
    sources = sources or [f"s{(i or 0) % 3}" for i, _ in rows]
    data = [(i, t, s, "en", len(t or ""), 1, 0.5, 7, "text", 2, 3) for (i, t), s in zip(rows, sources, strict=True)]
    return spark.createDataFrame(data, DOCS).repartition(3)


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    line = " ".join(rng.choice(words) for _ in range(40))
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(0, 160))]
        if i % 4 == 1 and rows:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = "Changed"
        text = " ".join(w)
        rows.append((i * 3 + 1, f"{text}\n{line} {i}" if i % 5 == 0 else text))
    return rows


ODD = [(1000, None), (1001, ""), (1002, "   \n\t "), (1003, "one"), (1004, "One two"), (1005, "é" * 300), (1006, "x" * 40_000), (1007, "aß\x0b日本 " * 4000), (1008, "one"), (1009, "a\x1cb c\x85d e f g")]


@pytest.fixture(scope="module")
def rows():
    return corpus() + ODD


def test_url_filter(spark):
    urls = [(1, "https://A.B.net/x"), (2, "http://example.net/en/q?x#y"), (3, "ftp://m.Example.com/de/"), (4, "https://example.com/de"), (5, None), (6, "no scheme"), (7, "https://org/fr/a"), (8, "https://notexample.com/de/"), (9, "https://x.net"), (9, "https://x.net"), (10, ""), (11, "https://net/"), (12, "http://ÄB.net/é?" + "y" * 30_000)]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in urls], "page_id long, url string, host string, rule string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(df, URL_RULES).collect()}
    assert got == {(1, "a.b.net", "/x", "net/", "block"), (2, "example.net", "/en/q", "example.net/en/", "allow"), (3, "m.example.com", "/de/", "example.com/de/", "block"), (4, "example.com", "/de", None, "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "org", "/fr/a", "org/fr/", "allow"), (8, "notexample.com", "/de/", None, "allow"), (9, "x.net", "", None, "allow"), (10, "", "", None, "allow"), (11, "net", "/", "net/", "block"), (12, "Äb.net", "/é", "net/", "block")}
    assert url_filter.url_filter(df, URL_RULES).count() == len(urls)
    assert url_filter.url_filter(df.limit(0), URL_RULES).collect() == [] and url_filter.url_filter(df, []).where("verdict <> 'allow'").count() == 0


def test_digests_that_collide_are_told_apart(tmp_path):
    same = lambda s: len(s)
    path = str(tmp_path / "rules")
    url_filter.DigestArray.build(path, ["aa", "bb", "ccc"], [0, 1, 2], [1], key=same)
    index = url_filter.DigestArray(path)
    assert [index.stored(i) if i >= 0 else None for i in index.probe([b"bb", b"zz", b"ccc", b"aa", b"d"], key=same)] == [b"bb", None, b"ccc", b"aa", None]


def test_url_rules_in_many_files(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARD", 7)
    rules = [(f"h{i}.org", "/a/" if i % 2 else "", f"v{i % 3}") for i in range(60)] + [("h3.org", "/a/", "last")]
    df = spark.createDataFrame([(i, f"http://www.h{i}.org/a/b") for i in range(80)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(df, rules).collect()}
    want = {i: (f"h{i}.org" + ("/a/" if i % 2 else ""), f"v{i % 3}") if i < 60 else (None, "allow") for i in range(80)}
    assert got == want | {3: ("h3.org/a/", "last")}
    assert len(url_filter.shared_files(spark, ["a"] * 9, [0] * 9, [0] * 9)) == 2
    for bad in (("a/b", "/", "x"), ("a", "b", "x")):
        with pytest.raises(ValueError, match="isn't a host and a path"):
            url_filter.url_filter(df, [bad])


def test_near_duplicates(spark, rows):
    docs = make_docs(spark, rows + [(None, "n n n n n n")])
    got = [r for r in near_dup.near_duplicates(docs).collect()]
    want = brute.near_duplicates(rows)
    assert len(got) == len(rows) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dup.without_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c} | {None}
    twice = near_dup.near_duplicates(docs.unionByName(docs)).collect()
    assert len(twice) == 2 * len(got) and {(r.doc_id, r.component_id) for r in twice} == {(r.doc_id, r.component_id) for r in got}
    assert near_dup.near_duplicates(docs.limit(0)).collect() == []


def test_near_duplicates_of_a_large_group_around_the_threshold(spark):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(260):
        w = list(base)
        for k in rng.sample(range(120), rng.randint(0, 4)):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(make_docs(spark, rows)).collect()}
    assert got == brute.near_duplicates(rows)


@pytest.mark.parametrize("reheads", [0, 2])
def test_near_duplicates_compared_in_many_blocks(spark, monkeypatch, reheads):
    """Two groups of one head that no member of the first links, but some of the others do; and texts that stay apart."""
    for name, size in (("REHEADS", reheads), ("SLOT", 3), ("SIGNED", 4), ("BLOCK", 3), ("BITS", 1 << 10)):
        monkeypatch.setattr(near_dup, name, size)
    rng = random.Random(7)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in range(0, (i % 30) * 2, 2):  # a chain: neighbours are alike, the ends aren't
            w[k] = f"y{k}"
        if i >= 60:
            w[100:140] = [f"z{k}" for k in range(40)]
        if rng.random() < 0.5:
            w[rng.randrange(150, 200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    want = brute.near_duplicates(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(make_docs(spark, rows)).collect()}
    assert got == want and 1 < len({c for _, c in want.values()}) < 90


def test_ids_that_are_not_whole_numbers(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for operator in (near_dup.near_duplicates, suffix_dedup.deduplicated):
        with pytest.raises(TypeError, match="whole numbers"):
            operator(docs)


def test_suffix_dedup(spark, rows):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(900))
    more = rows + [(2000, long), (2001, "q" + long[100:700] + "r"), (2002, long[:99] + "|" + long[300:450]), (2003, "ab" * 300), (2004, long + long), (2005, "e" * 500)]
    docs = make_docs(spark, more)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(docs).collect()}
    assert got == brute.deduplicated(more)
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(more)
    untouched = {r.doc_id for r in out.collect() if got[r.doc_id][1] == 0 and r.text == (dict(more)[r.doc_id] or "")}
    assert untouched >= {i for i, g in got.items() if g[1] == 0 and dict(more)[i] is not None}
    assert suffix_dedup.deduplicated(docs.limit(0)).collect() == []
    twice = suffix_dedup.deduplicated(docs.where("doc_id in (2000, 2002)").unionByName(docs.where("doc_id in (2000, 2002)"))).collect()
    assert len(twice) == 4 and all(r.n_removed == (150 if r.doc_id == 2002 else 0) for r in twice)


@pytest.mark.parametrize("batch", [2000, 3])
def test_suffix_dedup_with_hot_cores(spark, monkeypatch, batch):
    """Batches of three rows make some 20 splits, in seven groups."""
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if batch < 2000:
        monkeypatch.setattr(suffix_dedup, "SPLIT", 250)
    passage = " ".join(f"passage{k}" for k in range(30))
    rows = [(i, f"{'head' * (i % 7)}{i} {passage[: 150 + i]} tail{i}") for i in range(40)] + [(50 + i, passage) for i in range(20)]
    try:
        spark.conf.set(name, str(batch))
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(make_docs(spark, rows)).collect()}
        twice = suffix_dedup.deduplicated(make_docs(spark, [(7, passage)] * 9 + [(8, passage)] * 9)).collect()
    finally:
        spark.conf.set(name, before)
    assert got == brute.deduplicated(rows)
    assert len(twice) == 18 and all(r.n_removed == (len(passage) if r.doc_id == 8 else 0) for r in twice)


def test_earliest_of_equal_strings():
    """Strings that differ in a byte, in their offsets or in their core aren't equal; rows of one place don't displace each other."""
    text = np.frombuffer(b"".join([b"a" * 101, b"a" * 101, b"a" * 100 + b"b", b"a" * 101, b"a" * 101, b"a" * 101]), np.uint8)
    low, high, core = np.array([4, 4, 4, 3, 4, 4]), np.array([5, 5, 5, 4, 5, 5]), np.array([9, 9, 9, 9, 8, 9], np.uint64)
    gone = suffix_dedup.later(text, np.full(6, 101), low, high, core, np.array([3, 1, 4, 5, 6, 1]), np.array([0, 7, 0, 0, 0, 7]))
    assert gone.tolist() == [True, False, False, False, False, False]


def test_kneser_ney(spark, rows):
    train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    want = brute.kneser_ney([(i, t, train(i)) for i, t in rows])
    got = kneser_ney.score_texts(make_docs(spark, rows), F.expr("pmod(crc32(cast(doc_id as string)), 7) <> 2")).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3] and r.train == train(r.doc_id)
        assert (r.base_score, r.score) == pytest.approx(w[3:], rel=1e-12)
    none = kneser_ney.score_texts(make_docs(spark, rows[:5]), F.lit(None).cast("boolean")).collect()
    assert all(r.train_tokens == 0 and r.score == 0 and r.n_known == 0 for r in none)
    assert kneser_ney.score_texts(make_docs(spark, rows).limit(0), F.lit(True)).collect() == []


def test_kept_model_scores_other_texts(spark, rows, monkeypatch):
    """A kept model gives the scores of the run that counted it, also where shards are dealt into parts, and those of unseen texts."""
    monkeypatch.setattr(kneser_ney, "SHARDED", 3000)
    path = new_path(spark, "test-model")
    first = kneser_ney.score_texts(make_docs(spark, rows), F.expr("doc_id % 2 = 1"), path=path).drop("train").collect()
    monkeypatch.setattr(kneser_ney, "SHARDED", 200)
    assert {tuple(r) for r in kneser_ney.score_with(make_docs(spark, rows), path).collect()} == {tuple(r) for r in first}
    other = corpus(17, 20) + [(-1, "never seen words here"), (-2, None), (-3, "One two")]
    got = {r.doc_id: r for r in kneser_ney.score_with(make_docs(spark, other), path).collect()}
    p, tokens = brute.model([(i, t, i % 2 == 1) for i, t in rows])
    for i, t in other:
        stream = [*brute.words(t), "END"]
        want = sum(np.log10(p(u, v)) for u, v in zip(["START", *stream[:-1]], stream, strict=True))
        assert got[i].n_tokens == len(stream) and got[i].score == pytest.approx(want, rel=1e-9)
        assert got[i].n_known == sum(tokens[v] > 0 for v in stream)
    assert kneser_ney.score_with(make_docs(spark, rows).limit(0), path).collect() == []
    none = new_path(spark, "test-model")
    kneser_ney.score_texts(make_docs(spark, rows).limit(0), F.lit(True), path=none)
    assert all(r.score == 0 and r.n_known == 0 for r in kneser_ney.score_with(make_docs(spark, rows[:5]), none).collect())


def test_large_counts_keep_their_width():
    for values in ([0, 5, 2**32 - 1], [3, 2**40], []):
        assert kneser_ney._large(kneser_ney._small(np.array(values, np.int64))).tolist() == values


def test_probabilities_sum_to_one():
    p, tokens = brute.model([(i, t, True) for i, t in corpus(n=20)])
    for u in ["START", "never seen", *list(tokens)[:5]]:
        assert sum(p(u, v) for v in tokens) + p(u, "unknown") == pytest.approx(1.0)


def test_mixing(spark, rows):
    sources = [["b", "a", None, "c"][i % 4] for i in range(len(rows))]
    docs = make_docs(spark, rows, sources)
    got = mixing.mix_sources(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    size = {i: len(brute.words(t)) for i, t in rows}
    by = {}
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        s = by.setdefault((r.target, r.source_size), [0, 0])
        s[0] += r.taken
        s[1] += r["size"]
    for (target, whole), (taken, own) in by.items():
        assert own == whole and abs(taken - target) < 1 and target <= 2 * whole + 1e-9
    assert sum(t for t, _ in by) == pytest.approx(1.5 * sum(size.values()))
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(brute.words(r.text))
    assert words == {r.doc_id: r.taken for r in got if r.taken}
    assert mixing.mix_sources(docs.limit(0)).collect() == []
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix_sources(make_docs(spark, [(1, None), (2, " ")])).collect())
    twice = mixing.mix_sources(docs.unionByName(docs)).collect()
    assert len(twice) == 2 * len(got) and all(r.taken <= 2 * r["size"] for r in twice)


def test_mixing_prefers_quality(spark):
    rows = [(i, "w " * 10) for i in range(600)]
    docs = make_docs(spark, rows, ["s"] * 600)
    quality = spark.createDataFrame([(i, 20.0 if i % 2 else 0.05) for i in range(600)] + [(1, 0.01), (None, 9.0), (2, -1.0), (4, None)], "doc_id long, weight double")
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(docs, share=0.5, quality=quality).collect()}
    good, bad = (sum(t for i, t in taken.items() if i % 2 == k) for k in (1, 0))
    assert good + bad == 3000 and good > 0.9 * 3000
    plain = {r.doc_id: r.taken for r in mixing.mix_sources(docs, share=0.5).collect()}
    assert 0.4 < sum(t for i, t in plain.items() if i % 2) / 3000 < 0.6
    mixed = mixing.mixed_documents(docs, share=0.5, quality=quality).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(i for i, t in taken.items() if t)


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    docs = make_docs(spark, rows)
    pieces = packing.pack(docs, path, keep_ids=True).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32
        by_doc.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, t in rows:
        want = tok.encode(t or "", add_special_tokens=False).ids + [1]
        parts = sorted(by_doc[i], key=lambda x: x[0])
        assert np.concatenate([x[1] for x in parts]).tolist() == want and all(x[2] == len(want) for x in parts)
    sizes = []
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    assert sum(s < 2048 for s in sizes) <= 1 and max(sizes) <= 2048
    assert packing.pack(docs.limit(0), path).collect() == []
    assert packing.pack(docs.unionByName(docs), path).agg(F.sum("length")).first()[0] == 2 * sum(sizes)


def test_packing_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE", 2)
    rows = corpus(n=40) + [(900 + i, "the same text over and over") for i in range(30)] + ODD
    test_packing(spark, rows)


def test_hilbert_curve_visits_neighbours():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = np.argsort(packing.hilbert_key(cells, 3))
    assert sorted(packing.hilbert_key(cells, 3).tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_token_store(spark, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    docs = make_docs(spark, rows + [(-5, "first of all")])
    store = new_path(spark, "test-store")
    token_store.write_store(docs, path, store)
    digests = {r.doc_id: r for r in token_store.document_digests(spark, store).collect()}
    whole = {r.doc_id: r for r in token_store.read_documents(spark, store).collect()}
    at = 0
    for i, t in sorted(rows + [(-5, "first of all")]):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        d = digests[i]
        assert (d.start, d.n_tokens, d.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert whole[i].ids == ids and whole[i].start == at
        at += len(ids)
    stored = lambda at: [d for r in spark.read.parquet(f"{at}/chunks").collect() for d in token_store._each(bytes(r.digests))]
    chunks = stored(store)
    assert len(chunks) == len(set(chunks))
    empty = new_path(spark, "test-store")
    token_store.write_store(docs.limit(0), path, empty)
    assert token_store.document_digests(spark, empty).collect() == []
    again = new_path(spark, "test-store")
    token_store.write_store(docs.unionByName(docs), path, again)
    assert sorted(stored(again)) == sorted(chunks) and token_store.document_digests(spark, again).count() == 2 * len(digests)


def test_a_damaged_store_is_refused(spark, monkeypatch):
    monkeypatch.setattr(token_store, "ROW", 1)  # a chunk a row
    path = new_path(spark, "test-store")
    token_store.write_store(make_docs(spark, [(i, f"some words here {i} " * 40) for i in range(6)]), tokenizer_path("word_bpe_49k.json"), path)
    assert token_store.document_digests(spark, path).count() == 6
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in ("chunks", "recipes", "manifest")}
    whole = {t: (df.schema, [r.asDict() for r in df.collect()]) for t, df in tables.items()}

    def put(table, rows):
        spark.createDataFrame(rows, whole[table][0]).write.mode("overwrite").parquet(f"{path}/{table}")

    def refused(table, rows, message):
        put(table, rows)
        with pytest.raises(Exception, match=message):
            token_store.document_digests(spark, path).collect()
        put(table, whole[table][1])

    chunks, recipes, manifest = (whole[t][1] for t in ("chunks", "recipes", "manifest"))
    refused("chunks", chunks[1:], "is missing")
    refused("chunks", [r | {"ids": token_store._zip(b"\xff" + token_store._unzip(bytes(r["ids"]))[1:])} for r in chunks], "doesn't match its digest")
    refused("recipes", [r for r in recipes if r["doc_id"] != 3], "doesn't match its recipes")
    refused("recipes", [r | {"digests": bytes(r["digests"])[:-1] + b"\0"} for r in recipes], "doesn't match its Merkle root")
    for level, message in enumerate(["doesn't match its recipes", "doesn't match its recipes", "no row for the whole store"]):
        refused("manifest", [r for r in manifest if r["level"] != level], message)
    assert token_store.document_digests(spark, path).count() == 6


def test_a_store_of_many_ranges_and_blocks(spark, monkeypatch):
    for name, size in (("RANGE", 7), ("PART", 3), ("BLOCK", 900), ("ROW", 200), ("SHARD", 4000)):
        monkeypatch.setattr(token_store, name, size)
    test_token_store(spark, corpus(n=60) + ODD)


def test_a_store_with_ids_of_another_type(spark):
    docs = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, "none"), ("c", None)], "doc_id string, text string")
    path = new_path(spark, "test-store")
    token_store.write_store(docs, tokenizer_path("word_bpe_49k.json"), path)
    rows = token_store.document_digests(spark, path).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, "a", "b", "c"] and [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()


def vectors(spark, n=600, d=16, seed=2):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n - 40, d)), np.repeat(rng.normal(size=(1, d)), 40, 0)]).round(2)
    rows = [(i, v.tolist(), i % 7) for i, v in enumerate(x)]
    odd = [(n, None), (n + 1, []), (n + 2, [None] * d), (n + 3, [float("nan")] * d), (n + 4, [float("inf")] + [0.0] * (d - 1)), (n + 5, [1.0] * (d - 1)), (n + 50, [0.0] * d)]
    return x, spark.createDataFrame(rows + [(i, v, 0) for i, v in odd], "vec_id long, embedding array<float>, slot int").repartition(3)


def test_impact_search(spark):
    x, df = vectors(spark)
    rows = {i: np.floor(256 * v.astype(np.float32).astype(float)).astype(np.int64) for i, v in enumerate(x)}
    rows[650] = np.zeros(16, np.int64)
    # row 605 has another length and is compared with none
    got = {}
    for r in impact_search.top_k(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in [i for i in rows if i % 50 == 0]:
        want = sorted(((-int(v @ rows[q]), i) for i, v in rows.items() if i != q))[:5]
        assert [got[q][k + 1] for k in range(5)] == [(i, -s) for s, i in want]
    assert set(got) == {i for i in rows if i % 50 == 0}
    assert impact_search.top_k(df.limit(0), F.lit(True)).collect() == []
    few = impact_search.top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert sorted(r["rank"] for r in few) == [1, 2]


def test_impact_search_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(impact_search, "BLOCK", 90)
    monkeypatch.setattr(impact_search, "QUERIES", 3)
    test_impact_search(spark)


def test_impact_index_stops_on_proof():
    rng = np.random.default_rng(4)
    x = np.rint(rng.normal(size=(4000, 24)) * (rng.random((4000, 24)) < 0.1) * 200).astype(np.int64)
    x[7] = x[8] = x[9] = 900  # ties at the top
    index = impact_search.ImpactIndex.opened(impact_search.ImpactIndex(x).packed(), 24)
    reads = []
    for q in [x[7], x[100], -x[200], x[300], np.zeros(24, np.int64)]:
        member, score = index.search(q, 5, np.array([7]))
        true = x @ q
        assert (score == true[member]).all()
        order = np.lexsort((np.arange(len(x)), -np.where(np.arange(len(x)) == 7, -(2**60), true)))[:5]
        best = member[np.lexsort((member, -score))[:5]]
        assert (true[best] == true[order]).all() and set(np.flatnonzero(true > true[order[-1]])) - {7} <= set(member.tolist())
        reads.append(index.read)
    assert min(reads) < x.size / 3


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=3 + i % 3).round(2).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = {i: np.array(v) for i, v in rows}
    top, near = {}, {}
    for r in impact_search.top_k(df, F.col("vec_id") % 20 == 0).collect():
        top.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for r in vector_tree.nearest(df, F.col("vec_id") % 20 == 0).collect():
        near.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for q in range(0, 300, 20):
        own = [i for i in x if i != q and len(x[i]) == len(x[q])]
        scaled = {i: np.floor(256 * x[i]).astype(np.int64) for i in [*own, q]}
        want = sorted((-int(scaled[i] @ scaled[q]), i) for i in own)[:5]
        assert [top[q][k + 1] for k in range(5)] == [(i, -s) for s, i in want]
        assert {len(x[i]) for i in near[q].values()} == {len(x[q])} and sorted(near[q]) == list(range(1, 11))
        if len(x[q]) != 3:  # not the commonest length: exact
            assert [near[q][k + 1] for k in range(10)] == sorted(own, key=lambda i: (np.sqrt(((x[i] - x[q]) ** 2).sum()), i))[:10]


def test_tree_has_no_more_leaves_than_are_sent(monkeypatch):
    monkeypatch.setattr(vector_tree, "LEAVES", 50)
    x = np.random.default_rng(3).normal(size=(3000, 8))
    tree = vector_tree.Tree().grow(x, 8, np.random.default_rng(1))
    assert 39 <= tree.leaves <= 50 and set(tree.assign(x).tolist()) == set(range(tree.leaves))
    assert vector_tree.Tree().grow(np.ones((200, 4)), 8, np.random.default_rng(1)).leaves == 1


def test_vector_tree(spark):
    x, df = vectors(spark, 2000)
    x = x.astype(np.float32).astype(float)
    found, hit = {}, 0
    for r in vector_tree.nearest(df, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i in range(0, 2000, 100)}
    for q, rows in found.items():
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        far[q] = np.inf
        true = np.lexsort((np.arange(len(x)), far))[:10]
        rows.sort()
        assert [k for k, _, _ in rows] == list(range(1, 11))
        assert all(s == far[i] for _, i, s in rows) and [(s, i) for _, i, s in rows] == sorted((s, i) for _, i, s in rows)
        hit += len({i for _, i, _ in rows} & set(true.tolist()))
    assert hit / (10 * len(found)) >= 0.9
    assert vector_tree.nearest(df.limit(0), F.lit(True)).collect() == []
    assert vector_tree.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0).count() == 3


def test_vector_tree_of_two_levels(spark, monkeypatch):
    """Leaves above DEEP rows have trees of their own; one of them holds many copies, which are dealt into blocks."""
    for name, value in (("DEEP", 60), ("SUB_SAMPLE", 40), ("LEAVES", 30), ("BLOCK", 64)):
        monkeypatch.setattr(vector_tree, name, value)
    deep, second = [], vector_tree._second_level
    monkeypatch.setattr(vector_tree, "_second_level", lambda rows, asked, counts, *more: deep.append(counts) or second(rows, asked, counts, *more))
    x, df = vectors(spark, 2000)
    x = x.astype(np.float32).astype(float)
    copies = spark.range(5000, 5700).select(F.col("id").alias("vec_id")).crossJoin(df.where("vec_id = 100").select("embedding"))
    df = df.select("vec_id", "embedding").unionByName(copies)
    ids, x = np.concatenate((np.arange(2000), np.arange(5000, 5700))), np.concatenate((x, np.repeat(x[100:101], 700, 0)))
    found, hit = {}, 0
    for r in vector_tree.nearest(df, (F.col("vec_id") % 100 == 0) & (F.col("vec_id") < 2000)).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, 2000, 100))
    for q, rows in found.items():
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        far[q] = np.inf
        true = ids[np.lexsort((ids, far))[:10]]
        rows.sort()
        assert [k for k, _, _ in rows] == list(range(1, 11))
        hit += len({i for _, i, _ in rows} & set(true.tolist()))
    assert hit / (10 * len(found)) >= 0.9
    assert [i for _, i, _ in found[100]] == list(range(5000, 5010))
    assert len(deep) == 1 and len(deep[0]) > 5 and max(deep[0].values()) > 700


INSULTS = ["grubface", "dolthead", "snotling", "wretch"]


def toxic_corpus(seed, n=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ba", "lo", "mi", "ter", "san", "qu", "en", "dor"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    texts, toxic = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        texts.append(" ".join(w) + ".")
        toxic.append(int(i % 5 == 0))
    return texts, toxic


def test_toxicity_on_held_out_texts():
    model = toxicity.fit(*toxic_corpus(1))
    texts, toxic = toxic_corpus(2)
    scores = model.scores(model.margins(pa.array(texts)))
    assert np.mean((scores >= 0.5) == np.array(toxic)) > 0.98
    hard = ["you grub*face", "such a d.o.l.t.h.e.a.d", "s n o t l i n g indeed", "dollthead", "wre-tch"]
    assert (model.scores(model.margins(pa.array(hard))) >= 0.5).mean() >= 0.8
    assert (model.scores(model.margins(pa.array(["", None, "   ", "ba lomi"], pa.string()))) < 0.5).all()


def test_collapsed_weights_equal_the_kernel():
    words = [b"grubface", b"grubfac", b"dolt", b"a"]
    k = toxicity._Kernel(words)
    gram = np.array([[k.against(k.one(j))[i] for j in range(4)] for i in range(4)])
    assert np.allclose(gram, gram.T, atol=1e-5) and np.linalg.eigvalsh((gram + gram.T) / 2).min() > -1e-5
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    assert np.allclose(toxicity.word_margins(data, k.spread(k.one(0)))[2], gram[:, 0], atol=1e-5)


def test_kernel_against_all_subsequences():
    words = [b"grubface", b"grub*face", b"gr-u-bf-ace", b"Dolt", b"dolt", b"a", b"face", "\u00e9t\u00e9s".encode(), b"grubfacegrubface"]
    gram = np.array([[brute.subsequence_kernel(x, y, toxicity.SPAN, toxicity.DECAY) for y in words] for x in words])
    k = toxicity._Kernel(words)
    assert np.allclose(np.array([k.against(k.one(j)) for j in range(len(words))]), gram, atol=1e-5)
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    for j in range(len(words)):
        assert np.allclose(toxicity.word_margins(data, k.spread(k.one(j)))[2], gram[j], atol=1e-5)
    assert gram[3, 3] == gram[3, 4] and gram[0, 1] > 0.6 > 0.2 > gram[0, 3]  # an inserted character costs little


def test_toxicity_query_paths(spark):
    texts, toxic = toxic_corpus(3, 200)
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, "grubface " * 20_000)]
    docs = make_docs(spark, rows)
    labels = spark.createDataFrame([(i, t, 1) for i, t in enumerate(toxic)] + [(5, None, 0), (None, 1, 0)], "doc_id long, toxic int, margin int")
    out = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert len(out) == len(rows) and out[902] > 0.5 > max(out[900], out[901]) and all(0 <= s <= 1 for s in out.values())
    model = toxicity.fit(texts, toxic)
    clean = toxicity.clean_documents(docs, model)
    assert clean.columns == docs.columns and 900 in {r.doc_id for r in clean.collect()}
    assert toxicity.score_documents(docs.limit(0), model).collect() == []
    assert all(r.score < 0.5 for r in toxicity.toxicity(docs, labels.limit(0)).collect())


def test_rows_without_an_id(spark):
    path = tokenizer_path("word_bpe_49k.json")
    docs = make_docs(spark, [(None, "a few words here"), (None, None), (4, "some other words"), (None, "a few words here")])
    store = new_path(spark, "test-store")
    token_store.write_store(docs, path, store)
    assert sorted((r.doc_id is None, r.start) for r in token_store.document_digests(spark, store).collect())[-1][0]
    assert packing.pack(docs, path).select("doc_id").count() == 4
    mixed = mixing.mix_sources(docs).collect()
    assert len(mixed) == 4 and sum(r.taken for r in mixed) <= 1.5 * 11
    assert suffix_dedup.deduplicated(docs).count() == 4 and near_dup.near_duplicates(docs).count() == 4
    assert kneser_ney.score_texts(docs, F.lit(True)).count() == 4
    model = toxicity.fit(*toxic_corpus(1, 60))
    assert toxicity.score_documents(docs, model).count() == 4


def test_repeated_query_rows(spark):
    _, df = vectors(spark, 200)
    twice = df.unionByName(df)
    for found, k in ((impact_search.top_k(twice, F.col("vec_id") % 50 == 0), 5), (vector_tree.nearest(twice, F.col("vec_id") % 50 == 0), 10)):
        rows = found.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("rank").alias("ranks")).collect()
        assert rows and all(r.n == k == r.ranks for r in rows)


@pytest.mark.parametrize("name, kind, first", [("byte_bpe_50k.json", "lead", [64, 220, 50256, 275]), ("word_bpe_49k.json", "apart", [320, 49407, 321])])
def test_added_tokens_within_texts(spark, name, kind, first):
    from tokenizers import Tokenizer

    path = tokenizer_path(name)
    tok = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "plain words", None, "", "x<|startoftext|>y <|EndOfText|> z", "<|endoftext|><|endoftext|>", "  é <|endoftext|>\n日本", "last"]
    encoder = tokens.Encoder(path)
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert encoder.kind == kind and want[0] == first
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["", *texts]).slice(1)):
        ids, counts = encoder.encode(column)
        assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]
    rows = list(enumerate(texts))
    if kind == "lead":
        got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pack(make_docs(spark, rows), path, keep_ids=True).collect()}
        assert got == {i: [*w, 1] for i, w in enumerate(want)}
    else:
        store = new_path(spark, "test-store")
        token_store.write_store(make_docs(spark, rows), path, store)
        starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in want]))).tolist()
        assert {r.doc_id: (r.start, r.ids) for r in token_store.read_documents(spark, store).collect()} == {i: (starts[i], [*w, 1]) for i, w in enumerate(want)}


def test_a_text_that_does_not_fit_is_left_out_alone(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_BYTES", 100)
    docs = make_docs(spark, [(1, "é" * 60), (2, "bad words"), (3, "fine words"), (4, None)])
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, "doc_id", "text", "toxic") == (["bad words", "fine words", ""], [1, 0, 0])
    with pytest.raises(ValueError, match="no text with the label 1 fits"):
        toxicity.training_rows(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int"), "doc_id", "text", "toxic")
