"""Driver steps, covers of families, routing and row numbers against plain versions."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import normal
from siltstone.operators import cohort, overlap, prefix, resample, serving
from siltstone.sources import catalog


def descriptor(**kw):
    return catalog.SourceDescriptor(**({"name": "assay", "urls": ("https://a.example/x", "https://a.example/y"), "required": ("id",)} | kw))


def test_descriptors_and_fetch_plans():
    for bad in ({"name": "Assay"}, {"urls": ("ftp://x",)}, {"optional": ("id",)}, {"headers": {"Authorization": "x"}}):
        with pytest.raises(ValueError):
            descriptor(**bad)
    plan = catalog.fetch_plan([descriptor(name="b"), descriptor()])
    assert [s["source"] for s in plan["steps"]] == ["assay", "assay", "b", "b"]
    assert plan["hash"] == catalog.fetch_plan([descriptor(), descriptor(name="b")])["hash"] != catalog.fetch_plan([descriptor()], "assay")["hash"]


def test_a_final_set_is_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    assert catalog.table_of(spark, descriptor(), path).count() == 3
    with pytest.raises(catalog.HeldOutError):
        catalog.table_of(spark, descriptor(role="final"), path)
    with pytest.raises(ValueError, match="lacks"):
        catalog.table_of(spark, descriptor(required=("other",)), path)
    df = spark.read.parquet(path)
    assert catalog.schema_hash(df) == catalog.schema_hash(df.repartition(2)) != catalog.schema_hash(df.limit(2))
    counts = [{"kind": "rows", "path": path}, {"kind": "groups", "path": path, "column": "id"}, {"kind": "value", "value": "7"}, {"kind": "files", "paths": [path, path + "x"]}]
    assert [catalog.inspected_count(spark, s) for s in counts] == [3, 3, 7, 1]
    with pytest.raises(ValueError, match="unknown kind"):
        catalog.inspected_count(spark, {"kind": "guess", "path": path})


def test_sniffing():
    assert catalog.resolve_file(["b.csv", "X/Data_2.CSV", "X/data_1.csv"], "DATA") == "X/Data_2.CSV"
    with pytest.raises(FileNotFoundError):
        catalog.resolve_file(["a.txt"], "a")
    assert catalog.normal_header("  Heavy Chain (VH) ") == "heavy_chain_vh"
    long, header = "ACDEFGHIKLMNPQRSTVWY", ["id", "heavy", "tm_score", "score"]
    rows = [[str(i), long + "AC", f"{i}.5" if i < 4 else "x", str(i)] for i in range(12)]
    assert catalog.sequence_columns(header, rows) == ["heavy"] and catalog.sequence_columns(header, [["1", "ACD"]]) == []
    assert catalog.score_column(header, rows, ["score", "tm"], skip=["heavy"]) == "score"
    assert catalog.score_column(["a"], [["nan"]] * 9, ["a"]) is None
    assert catalog.combinations_of(["b", "a", "c"])[:4] == [("a",), ("b",), ("c",), ("a", "b")] and len(catalog.combinations_of("abcd")) == 15
    assert len(catalog.names_hash(["a", "b"])) == 16 and catalog.names_hash(["a", "b"]) != catalog.names_hash(["ab"])
    assert catalog.search_space({"x": [1, 2], "y": "ab"}) == [{"x": 1, "y": "a"}, {"x": 1, "y": "b"}, {"x": 2, "y": "a"}, {"x": 2, "y": "b"}]
    with pytest.raises(ValueError, match="is not"):
        catalog.assert_same("dataset", "a", "b")


def test_paths_stay_within_their_root(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f").write_text("x")
    os.symlink(tmp_path / "in" / "f", tmp_path / "in" / "link")
    assert catalog.contained(str(tmp_path / "in"), str(tmp_path / "in" / "f")).endswith("in/f")
    for bad in (tmp_path / "in" / "link", tmp_path / "in" / ".." / "out", tmp_path / "other"):
        with pytest.raises(ValueError, match="plain path"):
            catalog.contained(str(tmp_path / "in"), str(bad))


def test_reference_cover(spark):
    rng = random.Random(3)
    rows = [(i, "f" if i % 2 else "g", "".join(rng.choice("AC") for _ in range(6))) for i in range(60)] + [(99, "f", None)]
    got = {}
    for r in cohort.reference_cover(spark.createDataFrame(rows, "id long, family string, text string"), "family", "id", "text", 0.7, most=4).collect():
        got.setdefault(r.family, []).append((r.place, r.record, r.similarity))
    for family in "fg":
        texts = {}
        for i, f, t in rows:
            if f == family and t is not None:
                texts.setdefault(t, i)
        ids = sorted((i, t) for t, i in texts.items())
        alike = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / 6
        chosen = [max(ids, key=lambda x: (sum(alike(x[1], y[1]) for y in ids), -x[0]))]
        while len(chosen) < 4:
            far = min((x for x in ids if x not in chosen), key=lambda x: (max(alike(x[1], c[1]) for c in chosen), x[0]))
            if max(alike(far[1], c[1]) for c in chosen) >= 0.7:
                break
            chosen.append(far)
        assert [r for _, r, _ in sorted(got[family])] == [i for i, _ in chosen]


def test_references_in_blocks(spark):
    rng = random.Random(5)
    rows = [(i, [rng.random() for _ in range(3)]) for i in range(50)]
    refs = [(f"r{j}", [rng.random() for _ in range(3)]) for j in range(23)]
    df, names = spark.createDataFrame(rows, "id long, v array<double>"), spark.createDataFrame(refs, "name string, c array<double>")
    far = lambda a, b: (sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) / 3) ** 0.5
    want = {i: min((far(v, c), n) for n, c in refs) for i, v in rows}
    for most in (5, 100):
        got = {r.id: (r.distance, r.nearest) for r in overlap.nearest_reference(df, names, "v", "name", "c", most).collect()}
        assert {i: n for i, (_, n) in got.items()} == {i: n for i, (_, n) in want.items()}
        assert all(abs(got[i][0] - want[i][0]) < 1e-12 for i in want)


def test_rows_are_numbered(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(20) if i % 7 else None, i % 3) for i in range(200)]
    got = prefix.numbered(spark.createDataFrame(rows, "id long, x int, w int").repartition(5), ["x", "id"], "at", "w", "sum_before").collect()
    total = 0
    for at, (i, _, w) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))):
        r = next(g for g in got if g.id == i)
        assert (r["at"], r.sum_before) == (at, total)
        total += w
    assert prefix.numbered(spark.createDataFrame([], "id long"), ["id"]).collect() == []


def test_normal_numbers(spark):
    row = spark.sql(f"select {normal.quantile_sql('0.975D')} as q, {normal.quantile_sql('0.01D')} as l, {normal.distribution_sql('1.0D')} as p, {normal.distribution_sql('-2.5D')} as t").first()
    assert row.q == pytest.approx(1.959963985, abs=1e-8) and row.l == pytest.approx(-2.326347874, abs=1e-8)
    assert row.p == pytest.approx(0.841344746, abs=2e-7) and row.t == pytest.approx(0.006209665, abs=2e-7)
    rows = spark.range(3000).withColumn("v", F.col("id") * 2.0)
    planted = normal.copula_labels(rows, "v", "id", 0.8, 1)
    rho = resample.weighted_spearman(planted.withColumns({"g": F.lit(1), "_k": F.lit(1)}), ["g"], "v", "planted").first().rho
    assert planted.count() == 3000 and rho == pytest.approx(0.8, abs=0.03)


def test_routes_and_ranges(spark):
    df = spark.createDataFrame([(1, "AAAA"), (2, "AAAT"), (3, "GGGG"), (4, "AA"), (5, None), (6, "")], "id int, t string")
    refs = spark.createDataFrame([("x", "AAAA"), ("w", "TTTT"), ("v", "AAAA")], "name string, r string")
    got = {r.id: (r.route, r.similarity) for r in serving.routed(df, refs, "t", "name", "r", 0.7).collect()}
    assert got == {1: ("v", 1.0), 2: ("v", 0.75), 3: (None, 0.0), 4: (None, 0.0), 5: (None, 0.0), 6: (None, 0.0)}
    with pytest.raises(ValueError, match="more than"):
        serving.routed(df, refs, "t", "name", "r", 0.7, most=2)
    runs = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end")), F.struct(F.lit(7).alias("start"), F.lit(7).alias("end")))
    assert spark.range(1).select(serving.residue_ranges(runs).alias("r")).first().r == "1-3,8-8"
