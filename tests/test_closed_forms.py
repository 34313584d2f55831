"""Operators on rows whose result is known, and invariants under reordering and repartitioning."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone import registry
from siltstone.functions import sequence as Q
from siltstone.functions import text as X
from siltstone.operators import contract, dedupe, evaluation, graph, learners, metrics, overlap, ranks, resample, splits


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize("pairs, rho", [([(1, 1), (2, 2), (3, 3)], 1.0), ([(1, 3), (2, 2), (3, 1)], -1.0), ([(1, 1), (2, 2), (3, 2), (4, 4)], 4.5 / math.sqrt(22.5)), ([(1, 1)], 0.0), ([(1, 2), (2, 2)], 0.0)])
def test_spearman(spark, pairs, rho):
    df = frame(spark, [("a", float(x), float(y)) for x, y in pairs], "g string, x double, y double")
    assert metrics.spearman(df, ["g"], "x", "y").first().spearman == pytest.approx(rho)


def test_mean_absolute_error(spark):
    df = frame(spark, [("a", 1.0, 1.5), ("a", 2.0, 2.0), ("a", 3.0, 1.0)], "g string, x double, y double")
    assert metrics.error_summary(df, ["g"], "x", "y").first().mae == pytest.approx(2.5 / 3)


def test_enrichment_of_a_perfect_ranking(spark):
    df = frame(spark, [("a", i, int(i >= 90), float(i)) for i in range(100)], "g string, i long, y int, s double")
    out = one(metrics.screening(df, ["g"], "y", "s", "i", 0.1))
    assert out["enrichment"] == pytest.approx(10.0) and out["catch"] == 1.0 and out["k"] == 10
    none = one(metrics.screening(df.withColumn("y", F.lit(0)), ["g"], "y", "s", "i", 0.1))
    assert none["enrichment"] == 0.0 and none["catch"] == 0.0


def test_classification_metrics(spark):
    df = frame(spark, [("a", 0, 0, 0.1), ("a", 1, 0, 0.2), ("a", 2, 1, 0.8), ("a", 3, 1, 0.9)], "g string, i long, y int, s double")
    assert metrics.rank_auc(df, ["g"], "y", "s").first().auc == 1.0
    assert metrics.average_precision(df, ["g"], "y", "s").first().average_precision == 1.0
    assert metrics.screening(df, ["g"], "y", "s", "i").first()["catch"] == 0.5
    assert metrics.calibration_error(df, ["g"], "y", "s").first().brier < 0.1
    tied = frame(spark, [("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("a", 0, 0.1)], "g string, y int, s double")
    assert metrics.rank_auc(tied, ["g"], "y", "s").first().auc == 0.875
    assert metrics.rank_auc(tied.where("y = 1"), ["g"], "y", "s").first().auc is None


def test_last_bin(spark):
    df = frame(spark, [("a", 1, 1.0), ("a", 0, 0.0)], "g string, y int, s double")
    assert metrics.reliability(df, ["g"], "y", "s").count() == 2
    assert metrics.reliability(df, ["g"], "y", "s", last_closed=False).count() == 1


def test_calibration_abstains(spark):
    df = frame(spark, [("a", 1, 0.9)] * 15 + [("a", 0, 0.1)] * 15 + [("b", 1, 0.9)] * 3, "g string, y int, s double")
    rows = {r.g: r for r in metrics.calibration_at(df, ["g"], "y", "s", 0.5).collect()}
    assert rows["b"].abstain and rows["b"].predicted_positive is None
    assert (rows["a"].predicted_positive, rows["a"].observed_positive) == (0.5, 1.0)


def test_exact_tail(spark):
    df = frame(spark, [("a", f"c{i:02d}", float(i)) for i in range(20)], "g string, r string, v double")
    assert {r.r for r in ranks.exact_tail(df, ["g"], "v", "r").where("target = 1").collect()} == {"c17", "c18", "c19"}
    two = frame(spark, [("a", "x", 1.0), ("a", "y", 5.0)], "g string, r string, v double")
    assert [r.rank_target for r in ranks.exact_tail(two, ["g"], "v", "r", higher_bad=False).orderBy("r").collect()] == [1.0, 0.0]
    binary = frame(spark, [("a", "x", 0.0), ("a", "y", 1.0)], "g string, r string, v double")
    assert [r.target for r in ranks.exact_tail(binary, ["g"], "v", "r").orderBy("r").collect()] == [0, 1]


def test_average_ranks(spark):
    df = frame(spark, [(10.0,), (20.0,), (20.0,), (30.0,)], "v double")
    assert sorted(r[0] for r in df.select(ranks.average_rank("v")).collect()) == [1.0, 2.5, 2.5, 4.0]
    assert sorted(r[0] for r in df.where("v < 30").select(ranks.percentile("v")).collect()) == [0.0, 0.75, 0.75]


def test_ranks_of_a_whole_table(spark):
    from siltstone.operators.prefix import running_sum, with_average_rank

    values = [(i * 7919 % 101) / 4 for i in range(500)] + [-3.5, 1e9]
    df = frame(spark, [(v,) for v in values], "v double").repartition(4)
    order = sorted(values)
    want = {v: (order.index(v) + 1 + order.index(v) + order.count(v)) / 2 for v in values}
    assert {r.v: r.average_rank for r in with_average_rank(df, "v").collect()} == want
    sums = running_sum(df.withColumn("one", F.lit(1)), "v", "one", "n", 8)
    assert {r.v: r.n for r in sums.collect()} == {v: sum(x <= v for x in values) for v in values}
    assert running_sum(df.limit(0).withColumn("one", F.lit(1)), "v", "one", "n").count() == 0


def test_conflicts_then_duplicates(spark):
    df = frame(spark, [(1, "k", 1.0), (2, "k", 2.0), (3, "m", 1.0), (4, "m", 1.0), (5, "m", None)], "i long, k string, v double")
    got = {r.i: r.status for r in dedupe.status(df, ["k"], "v", ["k", "v"], ["i"]).collect()}
    assert got == {1: "quarantined", 2: "quarantined", 3: "accepted", 4: "duplicate", 5: "accepted"}
    assert dedupe.conflict_keys(df, ["k"], "v").collect()[0].k == "k"


def test_status_survives_reordering(spark):
    rows = [(i, f"k{i % 7}", float(i % 3)) for i in range(60)]
    a = dedupe.status(frame(spark, rows, "i long, k string, v double"), ["k"], "v", ["k", "v"], ["i"])
    b = dedupe.status(frame(spark, rows[::-1], "i long, k string, v double").repartition(5), ["k"], "v", ["k", "v"], ["i"])
    assert sorted(map(str, a.select("i", "status").collect())) == sorted(map(str, b.select("i", "status").collect()))


def test_feedback(spark):
    known = frame(spark, [("A", 1)], "k string, y int")
    new = frame(spark, [(1, "A", 1), (2, "A", 0), (3, "B", 1), (4, "B", 1), (5, "B", 0)], "i long, k string, y int")
    got = {r.i: r.outcome for r in dedupe.merge_feedback(known, new, "k", "y", "i").collect()}
    assert got == {1: "duplicate", 2: "conflict", 3: "added", 4: "duplicate", 5: "conflict"}


def test_contract(spark):
    df = frame(spark, [(1, " ac DE ", "S1", "1.5", "yes"), (2, "A*C", "S1", "nan", "no"), (3, "", "zz", "x", "perhaps"), (4, "ACD", "s1", None, None)], "i long, s string, src string, v string, y string")
    rows = contract.normalized(df, id_col="i", sequence=F.col("s"), source=F.col("src"), value=F.col("v"), label=F.col("y"), roles={"s1": "supervised"}, well_formed=X.is_sequence(F.col("sequence")))
    got = {r.record_id: r for r in rows.collect()}
    assert got[1].sequence == "ACDE" and got[1].errors == [] and got[1].label == 1 and got[1].endpoint_value == 1.5
    assert set(got[2].errors) == {"sequence_illegal", "value_not_finite"}
    assert set(got[3].errors) == {"sequence_missing", "value_not_finite", "label_unknown", "source_unknown"}
    assert got[4].errors == [] and contract.accepted(rows).count() == 2


def test_overlap_strip(spark):
    train = frame(spark, [(1, "AAAA", "x"), (2, "BBBB", "L"), (3, "AAAT", "y"), (4, "CCCC", "z"), (5, "GGGG", None)], "i long, vh string, vl string")
    test = frame(spark, [(9, "AAAA", "L"), (8, "ZZZZ", "")], "i long, vh string, vl string")
    near = overlap.near_by_position(train, test, "i", "i", "vh", "vh", 1).select(F.col("a_id").alias("i"))
    got = {r.i: r.reason for r in overlap.strip_overlap(train, test, [("vh", "exact_vh"), ("vl", "exact_vl")], near, "i").collect()}
    assert got == {1: "exact_vh", 2: "exact_vl", 3: "near", 4: None, 5: None}
    assert {r.i for r in overlap.without_keys(train, test, ["vh", "vl"]).collect()} == {3, 4, 5}


def test_folds_keep_groups_whole(spark):
    rows = [(i, g) for i, g in enumerate("aaabbccccdeeff")]
    out = splits.grouped_folds(frame(spark, rows, "i long, g string"), "g", 3)
    assert out.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    assert splits.leaking_groups(out, "g", "fold").isEmpty() and out.select("fold").distinct().count() == 3


def test_caps_and_splits(spark):
    rows = [(i, f"s{i % 2}", i % 2 if i % 3 else 1 - i % 2) for i in range(64)]
    df = frame(spark, rows, "i long, s string, y int")
    a = splits.balanced_cap(df, ["s", "y"], "i", 3)
    assert a.count() == 12 and sorted(map(str, a.collect())) == sorted(map(str, splits.balanced_cap(df.repartition(4), ["s", "y"], "i", 3).collect()))
    assert splits.cumulative_split(df, "s", 1).where("part = 'test'").count() == 32
    w = splits.source_weights(df, "s", "y").agg(*[F.avg(c).alias(c) for c in ("class_weight", "source_weight", "hybrid_weight")]).first()
    assert [round(x, 9) for x in w] == [1.0, 1.0, 1.0]
    e = splits.eligible(frame(spark, [(1, "a", True, False), (2, "b", False, True), (3, "b", True, False)], "i long, s string, t boolean, h boolean"), "s", "b", F.col("t"), F.col("h"))
    assert {r.i: r.part for r in e.collect()} == {1: "train", 2: "test"}


def test_components(spark):
    nodes = frame(spark, [(i,) for i in range(1, 13)], "n long")
    edges = frame(spark, [(12, 11), (11, 10), (10, 9), (9, 8), (8, 1), (3, 4), (5, 5)], "a long, b long")
    got = {r.n: r.component for r in graph.components(nodes, "n", edges).collect()}
    assert got == {1: 1, 8: 1, 9: 1, 10: 1, 11: 1, 12: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7}


def test_alignment(spark):
    assert graph.aligned_identity("ACDEFGHIKLMNP", "ACDEFGHIKLMNP") == 1.0
    assert graph.aligned_identity("ACDEFGHIKLMNP", "ACDEFGHIKLMNW") == pytest.approx(12 / 13)
    assert graph.aligned_identity("ACDEFG", "ACDFG") == pytest.approx(5 / 6)
    df = frame(spark, [("ACDE", "ACDE"), ("ACDE", "A"), (None, "A")], "a string, b string")
    assert [r[0] for r in df.select(graph.alignment_identity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_kmer_pairs_equal_brute_force(spark):
    words = ["abcabcabd", "abcabcabe", "xyzxyzxyz", "abcabc", "abcab", "xyzxyzxyq"]
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    want = {(i, j) for i in range(6) for j in range(i + 1, 6) if len(grams(words[i]) & grams(words[j])) / len(grams(words[i]) | grams(words[j])) >= 0.6}
    assert {(r.a, r.b) for r in graph.kmer_pairs(frame(spark, list(enumerate(words)), "i long, s string"), "i", "s", 2, 0.6).collect()} == want


def test_pairs(spark):
    df = frame(spark, [("m", "vh", "H"), ("m", "vl", "L"), ("n", "vh", "H"), ("n", "vh", "G"), (None, "vh", "H"), (None, "vl", "L")], "m string, k string, s string")
    out = graph.pair_chains(df, "m", "k", "s", "vh", "vl")
    ids = {r.m: r.pair_id for r in out.collect()}
    import hashlib

    assert ids == {"m": hashlib.sha256(b"H|L").hexdigest()[:16], "n": None, None: None}
    assert [r.m for r in graph.pair_violations(out, "m", "k", "vh", "vl").collect()] == ["n"]


def test_sequences(spark):
    df = frame(spark, [("AAAA", "AAAT"), ("VILVIL", "VIL"), ("", "A")], "a string, b string")
    assert [r[0] for r in df.select(Q.positional_identity(F.col("a"), F.col("b"))).collect()] == [0.75, 0.0, 0.0]
    assert [r[0] for r in df.select(Q.longest_run(F.col("a"))).collect()] == [0.0, 6.0, 0.0]
    assert [r[0] for r in df.select(Q.scale_mean(F.col("a"), {"A": 1.8})).collect()] == [1.8, 0.0, 0.0]
    s = frame(spark, [("A1T;C3G", "ACC"), ("A2T", "ACC"), ("x", "ACC")], "m string, p string")
    assert [r[0] for r in s.select(Q.substituted(F.col("p"), Q.substitutions(F.col("m")))).collect()] == ["TCG", None, "ACC"]
    d = frame(spark, [("ACC", "TCG"), ("A", "AA")], "a string, b string").select(Q.differences(F.col("a"), F.col("b")).alias("d")).collect()
    assert [(x.pos, x.a, x.b) for x in d[0].d] == [(0, "A", "T"), (2, "C", "G")] and d[1].d is None
    runs = frame(spark, [([0.0, 1.0, 1.0, 0.0, 1.0],), ([],), ([0.0],)], "v array<double>").select(Q.segments(F.col("v"), 0.5).alias("r")).collect()
    assert [[(x.start, x.end) for x in r.r] for r in runs] == [[(1, 2), (4, 4)], [], []]
    ph = frame(spark, [("KKKK",), ("DDDD",), ("",)], "s string").select(Q.isoelectric_point(F.col("s")).alias("p"), Q.charge_at(F.col("s"), 7.0).alias("c")).collect()
    assert ph[0].p > 10 > 4 > ph[1].p and ph[0].c > 3 and ph[1].c < -3 and ph[2].c == 0.0
    kinds = frame(spark, [("Q" * 110 + "WGQGTLVTVSS",), ("Q" * 95 + "FGGGTKVEIK",), ("Q" * 20,), ("Q" * 120,)], "s string").select(Q.chain_kind(F.col("s")))
    assert [r[0] for r in kinds.collect()] == ["vh", "vl", "unknown", "vh"]


def test_text(spark):
    df = frame(spark, [(' {"b": 1e-05, "a": null, "created_at": 3, "c": "é"}',)], "j string")
    import hashlib

    assert df.select(X.canonical_hash(F.col("j"))).first()[0] == hashlib.sha256(b'{"a":null,"b":1e-05,"c":"\\u00e9"}').hexdigest()
    assert tuple(frame(spark, [("dir/alpha_2017_HIC.csv",)], "f string").select(*X.study_and_metric(F.col("f"))).first()) == ("alpha", "HIC")


def test_seed_consolidation(spark):
    rows = [("p", "r", s, v, d, q) for s, v, d, q in [(0, 0.2, 0.1, "in_domain"), (1, 0.4, 0.1, "out_of_domain"), (2, 0.6, 0.1, "borderline")]]
    out = one(evaluation.consolidated(frame(spark, rows, "p string, r string, seed int, s double, d double, q string").withColumn("src", F.lit("x")), ["p", "r"], "s", "d", "q", "src"))
    assert out["score"] == pytest.approx(0.4) and out["domain"] == "out_of_domain" and out["abstain"] and out["disagreement"] == pytest.approx(math.sqrt(0.08 / 3))


def test_blends_pick_the_strong_model(spark):
    rows = []
    for s in "xy":
        for i in range(10):
            rows += [(s, "strong", f"{s}{i}", int(i > 4), i / 10), (s, "weak", f"{s}{i}", int(i > 4), (i * 7 % 10) / 10)]
    rows += [("x", "rare", "x1", 0, 0.5)]
    df = frame(spark, rows, "s string, m string, r string, y int, p double")
    best = one(evaluation.best_blend(evaluation.blends(df, "s", "m", "r", "y", "p", ["strong", "weak", "rare"])))
    assert best["members"] == "strong" and best["macro_auc"] == 1.0 and best["sources"] == 2


def test_bootstrap_and_permutation(spark):
    df = frame(spark, [(f"g{i % 4}", float(i)) for i in range(12)], "g string, v double")
    a = one(resample.group_bootstrap(df, "g", F.col("v"), F.lit(1.0), 100))
    assert a["low"] <= a["point"] <= a["high"] and a == one(resample.group_bootstrap(df.repartition(3), "g", F.col("v"), F.lit(1.0), 100))
    p = one(resample.permutation_p(frame(spark, [(i, int(i >= 10), float(i)) for i in range(20)], "i long, y int, s double"), "y", "s", "i", 50))
    assert p["auc"] == 1.0 and p["p"] < 0.05 and abs(p["null_mean"] - 0.5) < 0.1


def test_radius_join_equals_brute_force(spark):
    rows = [(i, (i * 37 % 1800) / 10 - 90, (i * 113 % 3600) / 10 - 180) for i in range(300)] + [(900, 89.9, 0.0), (901, 89.9, 180.0), (902, 0.0, 179.99), (903, 0.0, -179.99)]

    def km(a, b):
        x = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * overlap.EARTH_KM * math.asin(min(1, math.sqrt(x)))

    df = frame(spark, rows, "i long, lat double, lon double")
    got = {r.a_id: (r.neighbours, round(r.nearest_km, 6)) for r in overlap.within_radius(df, df, "i", "lat", "lon", 500.0).collect()}
    want = {}
    for a in rows:
        near = [km(a, b) for b in rows if b[0] != a[0] and km(a, b) <= 500]
        if near:
            want[a[0]] = (len(near), round(min(near), 6))
    assert got == want


def test_radius_join_keeps_pairs_whose_circles_widen_towards_a_pole(spark):
    rows = [(0, 85.6, -0.5), (1, 86.5, 36.5), (2, -86.5, 10.0), (3, -88.9, 140.0)]

    def km(a, b):
        x = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * overlap.EARTH_KM * math.asin(math.sqrt(x))

    rows += [(100 + i, 76 + (i * 37 % 1400) / 100, (i * 113 % 3600) / 10 - 180) for i in range(400)]
    df = frame(spark, rows, "i long, lat double, lon double")
    got = {r.a_id: r.neighbours for r in overlap.within_radius(df, df, "i", "lat", "lon", 300.0).collect()}
    want = {a[0]: sum(b[0] != a[0] and km(a, b) <= 300 for b in rows) for a in rows}
    assert got == {k: n for k, n in want.items() if n}


def test_canonical_text_keeps_its_length(spark):
    texts = [" stra\u00dfe 1 ", "\u00df", "\ufb01n \u1f80\u03b1\u0390\u00df\u00dfx", "\u00e4\u00f6", " ", None]
    got = [r[0] for r in frame(spark, [(i, t) for i, t in enumerate(texts)], "i long, t string").orderBy("i").select(X.canonical_text(F.col("t"))).collect()]
    assert got == ["STRA\u1e9eE1", "\u1e9e", "\ufb01N\u1f88\u0391\u0390\u1e9e\u1e9eX", "\u00c4\u00d6", None, None]


def test_contract_rejections_count_a_sharp_s_once(spark, tmp_path):
    frame(spark, [(1, "\u00df" * 499, "src1", 499), (2, "\u00df" * 500, "src1", 500)], "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in registry.QUERIES["contract_rejections"](spark, str(tmp_path)).collect()] == [("src1", "sequence_short", 1)]


def test_learners(spark):
    rows = [(i, [float(i % 10), float(i % 3)], int(i % 10 > 4), i % 5) for i in range(100)]
    df = frame(spark, rows, "i long, v array<double>, y int, g int")
    out = learners.out_of_fold(df, "v", "y", "g", 2)
    assert out.count() == 100 and metrics.rank_auc(out, [], "y", "score").first().auc > 0.9
    slope, shift = learners.platt(out, "y", "score")
    assert slope > 0 and learners.platt(out.limit(5), "y", "score") == (1.0, 0.0)
    assert out.select(F.min(learners.calibrated(F.col("score"), slope, shift))).first()[0] >= 0


def test_queries_beyond_one_block_lose_nothing(spark):
    rng = random.Random(3)
    v = frame(spark, [(i, [rng.random() - 0.5 for _ in range(4)]) for i in range(60)], "i long, e array<double>")
    q = v.where("i % 2 = 0")
    assert sorted(map(tuple, overlap.knn(q, v, "i", "e", 3, most=7).collect())) == sorted(map(tuple, overlap.knn(q, v, "i", "e", 3).collect()))
    got, want = (overlap.near_by_cosine(v, q, "i", "e", 0.3, **most).collect() for most in ({"most_b": 7}, {}))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_cosine_and_neighbours_of_copies_equal_brute_force_without_a_pair_join(spark, monkeypatch):
    monkeypatch.setattr(overlap, "ROWS_A_BLOCK", 40)
    monkeypatch.setattr(overlap, "QUERIES_AT_ONCE", 5)
    rng = random.Random(7)
    vecs = [[rng.random() - 0.5 for _ in range(6)] for _ in range(40)]
    vecs = [list(rng.choice(vecs)) if i % 3 else [x * (1 + i % 2) for x in rng.choice(vecs)] for i in range(150)]
    vecs[20], vecs[31], vecs[40] = [0.0] * 6, None, [1.0, None, 0.0, 0.0, 0.0, 0.0]
    v = frame(spark, list(enumerate(vecs)), "i long, e array<double>")
    q = v.where("i % 10 = 0")
    whole = {i: x for i, x in enumerate(vecs) if x and None not in x}

    def dots(x, y):
        total = 0.0
        for s, t in zip(x, y, strict=True):
            total += s * t
        return total

    best, near = {}, {}
    for b in range(0, 150, 10):
        rows = sorted((math.sqrt(dots(d, d)), i) for i, x in whole.items() if b in whole and i != b for d in [[s - t for s, t in zip(x, whole[b], strict=True)]])
        near |= {(b, n + 1): (i, d) for n, (d, i) in enumerate(rows[:4])}
        for i, x in whole.items():
            if b in whole and i != b and (below := math.sqrt(dots(x, x)) * math.sqrt(dots(whole[b], whole[b]))):
                c = dots(x, whole[b]) / below
                if c >= 0.3 and (i not in best or (c, -b) > (best[i][1], -best[i][0])):
                    best[i] = (b, c)
    found = overlap.near_by_cosine(v, q, "i", "e", 0.3, most_b=6)
    assert {r.a_id: (r.b_id, r.cosine) for r in found.collect()} == best
    got = {(r.query_id, r["rank"]): (r.neighbour_id, r.distance) for r in overlap.knn(q, v, "i", "e", 4, most=6).collect()}
    assert {k: r for k, r in got.items() if k[0] != 40} == near and [got[40, n] for n in (1, 2)] == [(0, None), (1, None)]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_kmer_pairs_of_equal_texts_equal_brute_force(spark):
    words = ["abcdef", "abcdef", "abcdeg", "zz", "abcdef", "", None, "a", "zz", "abcdeg"]
    sets = [{w[k : k + 2] for k in range(len(w) - 1)} if w else set() for w in words]
    want = {(a, b, round(len(x & y) / len(x | y), 9)) for b, y in enumerate(sets) for a, x in enumerate(sets[:b]) if x and y and len(x & y) >= 0.6 * len(x | y)}
    got = graph.kmer_pairs(frame(spark, list(enumerate(words)), "i long, s string"), "i", "s", 2, 0.6).collect()
    assert {(r.a, r.b, round(r.jaccard, 9)) for r in got} == want and len(got) == len(want)


def test_copies_are_spread_in_parts_without_loss(spark):
    left = frame(spark, [(i, t) for i, t in enumerate("aabcz")], "x long, t string")
    rows = [(i, "ab"[i % 7 == 0]) for i in range(50)] + [(90, "c")]
    got = [tuple(r) for r in overlap.spread(left, frame(spark, rows, "y long, t string"), "t", "y", most=5).select("x", "y").collect()]
    assert sorted(got) == sorted((i, y) for i, t in enumerate("aabcz") for y, u in rows if t == u)


def test_kmer_similarities_are_rounded_once_a_link(spark):
    df = frame(spark, list(enumerate(["abcdef", "abcdef", "abcdeg", "abcdeg"])), "i long, s string")
    got = {(r.a, r.b): r.jaccard for r in graph.kmer_pairs(df, "i", "s", 2, 0.6, digits=2).collect()}
    assert got == {(0, 1): 1.0, (2, 3): 1.0, **{(a, b): 0.67 for a in (0, 1) for b in (2, 3)}}


def test_kmer_jaccard_pairs_of_all_parts(spark, tmp_path):
    frame(spark, [(1, "blue ring", 1), (2, "blue ring", 40), (3, "blue rings", 50)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert {(r.a, r.b) for r in registry.QUERIES["kmer_jaccard_pairs"](spark, str(tmp_path)).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_identity_components_of_all_customers(spark, tmp_path):
    frame(spark, [(i, c) for i, c in enumerate([1, 8, 15, 22, 7, 14, 21, 5, 5])], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.node: r.component for r in registry.QUERIES["identity_components"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 8: 1, 15: 15, 22: 15, 7: 7, 14: 7, 21: 21, 5: 5}


def test_blend_weights_of_all_lines(spark, tmp_path):
    rows = [(1, 10.0, 1.0, 0.0), (2, 20.0, 2.0, 0.0), (1, 30.0, 3.0, 0.0), (3, 40.0, 0.5, 0.0)]
    frame(spark, rows, "l_linenumber int, l_extendedprice double, l_quantity double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.w: (r.n, r.spearman) for r in registry.QUERIES["blend_weights"](spark, str(tmp_path)).collect()}
    assert len(got) == 11 and got[1.0] == (4, pytest.approx(-0.2)) and got[0.0] == (4, 0.0)


def test_identity_pairs_and_families_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "A", "A", "ACDEFGHI", "ACDEFGHK"]
    for _ in range(6):
        base = "".join(rng.choice("ACDE") for _ in range(rng.choice((9, 10, 18, 19, 40))))
        texts += [base, base]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 8))):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice(([], [rng.choice("ACDE")], [w[i], rng.choice("ACDE")]))
            texts.append("".join(w))
    first = {t: texts.index(t) for t in texts if t}
    want = {(a, b) for t, a in first.items() for u, b in first.items() if a < b and 0.85 <= len(t) / len(u) <= 1.15 and graph.aligned_identity(t, u) >= 0.9}
    df = frame(spark, list(enumerate(texts)), "i long, s string")
    assert {(r.a, r.b) for r in graph.identity_pairs(df, "i", "s").collect()} == want and any(b - a > 1 for a, b in want)
    family = list(range(len(texts)))
    for a, b in sorted(want) + [(first[t], i) for i, t in enumerate(texts) if t]:
        family = [min(family[a], family[b]) if f in (family[a], family[b]) else f for f in family]
    assert {r.i: r.component for r in graph.identity_families(df, "i", "s").collect()} == dict(enumerate(family))


def test_contract_rejections_of_odd_rows_equal_their_sql(spark, tmp_path):
    texts, sources = [None, "", "  ", "a" * 499, " " + "a" * 500], [None, "", "SRC1", "src1 ", "\u0391\u03a3", "\u0391\u03a3\u0130"]
    rows = [(i, t, s, None) for i, (t, s) in enumerate((t, s) for t in texts for s in sources)]
    frame(spark, rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.SQL["contract_rejections"]).fetchall()
    got = [tuple(r) for r in registry.QUERIES["contract_rejections"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and (None, "sequence_short", 3) in got


def test_knn_join_asks_for_every_row(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(3)]) for i in range(130)] + [(130, [1e200, 0.0, 0.0])]
    frame(spark, rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = [tuple(r) for r in registry.QUERIES["knn_join"](spark, str(tmp_path)).select("query_id", "neighbour_id", "distance", "rank").collect()]
    assert sorted(got) == sorted(con.execute(registry.SQL["knn_join"]).fetchall()) and len(got) == 131 * 5


def test_neighbours_of_plain_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(overlap, "ROWS_A_BLOCK", 500)
    rng = random.Random(12)
    vecs = [[float(rng.randint(-2, 2)) for _ in range(4)] for _ in range(1300)]
    v = frame(spark, list(enumerate(vecs)), "i long, e array<float>")
    got = {}
    for r in overlap.knn(v.where("i % 50 = 0"), v, "i", "e", 4, most=9).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.distance, r.neighbour_id)
    far = lambda a, b: math.sqrt(sum((s - t) ** 2 for s, t in zip(vecs[a], vecs[b], strict=True)))
    assert got == {a: dict(enumerate(sorted((far(a, b), b) for b in range(1300) if b != a)[:4], 1)) for a in range(0, 1300, 50)}


def test_near_positional_match_asks_for_every_part(spark, tmp_path):
    names = ["red rod", "red rod", "rad rod", "rad rad", "blue bolt", "b", "b", "", None, "red rods"]
    frame(spark, list(enumerate(names, 1)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = [tuple(r) for r in registry.QUERIES["near_positional_match"](spark, str(tmp_path)).select("a_id", "b_id", "mismatches").collect()]
    assert sorted(got) == sorted(con.execute(registry.SQL["near_positional_match"]).fetchall()) and len(got) == 8


def test_linked_ids_cross_in_arrays_without_loss(spark):
    sides = [[(i, "abc"[i % 7 % 3]) for i in range(40)], [(i, "bcd"[i % 5 % 3]) for i in range(100, 150)]]
    links = [("a", "b", 1), ("c", "d", 2), ("b", "b", 3), ("z", "c", 4)]
    left, right = frame(spark, sides[0], "x long, s string"), frame(spark, sides[1], "y long, t string")
    df = overlap.crossed(frame(spark, links, "s string, t string, v int"), left, right, ("s", "t"), ("x", "y"), most=8, a_task=10)
    got = sorted((r.x, r.y, r.v) for r in df.collect())
    assert got == sorted((x, y, v) for s, t, v in links for x, k in sides[0] for y, m in sides[1] if (k, m) == (s, t))
    assert "RoundRobin" in df._jdf.queryExecution().executedPlan().toString()


def test_kmer_pairs_of_frequent_texts_are_dealt_evenly(spark):
    words = ["abcdef"] * 30 + ["abcdeg"] * 20 + ["zz"]
    df = graph.kmer_pairs(frame(spark, list(enumerate(words)), "i long, s string"), "i", "s", 2, 0.6)
    assert {(r.a, r.b) for r in df.collect()} == {(a, b) for b in range(50) for a in range(b)} and df.count() == 1225
    assert "RoundRobin" in df._jdf.queryExecution().executedPlan().toString()


def test_radius_join_counts_copies_by_place(spark):
    rng = random.Random(4)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(90.0, 0.0), (-90.0, 5.0)]
    a = [(i, *rng.choice(spots)) for i in range(150)] + [(3, *spots[0]), (7, *spots[1]), (500, *spots[2]), (501, None, 0.0), (None, *spots[0])]
    b = [(i, *(x[1:] if i % 4 else rng.choice(spots))) for i, x in enumerate(a[:120])] + [(3, *spots[5]), (3, *spots[6]), (900, *spots[0]), (900, *spots[0]), (901, 1.0, None)]

    def km(p, q):
        x = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * overlap.EARTH_KM * math.asin(min(1, math.sqrt(x)))

    schema, want = "i long, lat double, lon double", {}
    for i, *p in a:
        for j, *q in b:
            if None not in (i, *p, *q) and i != j and (d := km(p, q)) <= 1500:
                want.setdefault(i, {}).setdefault(j, []).append(d)
    df = overlap.within_radius(frame(spark, a, schema), frame(spark, b, schema), "i", "lat", "lon", 1500.0)
    got = {r.a_id: (r.neighbours, round(r.nearest_km, 6)) for r in df.collect()}
    assert got == {i: (len(x), round(min(map(min, x.values())), 6)) for i, x in want.items()} and any(n > 10 for n, _ in got.values())
    same = frame(spark, [(i, 1.0, 2.0) for i in range(5000)], schema)
    df = overlap.within_radius(same, same, "i", "lat", "lon", 300.0)
    assert df.agg(F.count("*"), F.min("neighbours"), F.max("neighbours"), F.max("nearest_km")).first() == (5000, 4999, 4999, 0.0)
    assert "count(distinct" not in df._jdf.queryExecution().toString()  # rows are counted by class, not by pairs
