"""The pipeline's stages, each against a brute-force version of what it keeps."""

from __future__ import annotations

import brute
import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F
from test_operators import INSULTS, make_docs, toxic_corpus

from siltstone.llm import near_dup, toxicity
from siltstone.llm.registry import crc_rest, toxicity_model


def test_stages(spark, tmp_path):
    texts, toxic = toxic_corpus(7, 150)
    clean = [t for t, y in zip(texts, toxic, strict=True) if not y]
    passage = max(clean, key=len)
    rows = [(i, t) for i, t in enumerate(texts)] + [(500 + i, texts[i + 1]) for i in range(4)] + [(600 + i, f"{clean[2 * i]} {passage} {clean[2 * i + 1]}") for i in range(4)] + [(700, None), (701, "")]
    docs = make_docs(spark, rows)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "suffix_dedup", "mixing", "packing"]

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity_model(docs, labels)
    one = stages["toxicity"](spark, docs, str(tmp_path)).cache()
    scores = dict(zip([i for i, _ in rows], model.scores(model.margins(pa.array([t for _, t in rows], pa.string()))), strict=True))
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {i for i, s in scores.items() if s < 0.5}
    assert not any(w in (r.text or "") for r in one.collect() for w in INSULTS)

    two = stages["near_dedup"](spark, one, str(tmp_path)).cache()
    components = brute.near_duplicates([(r.doc_id, r.text) for r in one.collect()])
    assert {r.doc_id for r in two.collect()} == {i for i, (_, c) in components.items() if i == c}

    three = stages["suffix_dedup"](spark, two, str(tmp_path)).cache()
    removed = brute.deduplicated([(r.doc_id, r.text) for r in two.collect()])
    assert {r.doc_id: len((r.text or "").encode()) for r in three.collect()} == {i: n - g for i, (n, g, _, _) in removed.items()}
    assert sum(passage in (r.text or "") for r in three.collect()) == 1

    four = stages["mixing"](spark, three, str(tmp_path)).cache()
    sizes = {r.doc_id: len(brute.words(r.text)) for r in three.collect()}
    assert four.columns == docs.columns and abs(sum(len(brute.words(r.text)) for r in four.collect()) - 1.5 * sum(sizes.values())) <= 3

    five = stages["packing"](spark, four, str(tmp_path))
    assert five.where("length > 2048").count() == 0 and {r.doc_id for r in five.select("doc_id").distinct().collect()} == {r.doc_id for r in four.collect()}
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert again.agg(F.sum("length")).first() == five.agg(F.sum("length")).first()
    assert crc_rest(5) is not None and toxicity.EMPTY < 0


def test_the_near_copies_stage_links_pairs_from_80_percent(spark, tmp_path):
    rows = []
    for i in range(12):
        w = [f"d{i}w{k}" for k in range(119)]  # 115 shingles; two changed words take 10, 105 / 125 = 0.84
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(["x" if k in (30, 70) else x for k, x in enumerate(w)]))]
    docs = make_docs(spark, rows)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i, (_, c) in brute.near_duplicates(rows, 80).items() if i == c} == set(range(0, 24, 2))
    assert all(c == i for i, (_, c) in brute.near_duplicates(rows, 85).items())


def test_bands_follow_from_the_threshold():
    assert near_dup.layout(85) == (20, 5) and near_dup.layout(80) == (32, 5)
    for percent in range(1, 101):
        bands, rows = near_dup.layout(percent)
        assert (1 - (percent / 100) ** rows) ** bands < 1e-5
