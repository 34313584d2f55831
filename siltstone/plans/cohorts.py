"""Queries of cohorts, reports, evidence, phases and resampled correlations, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import normal
from siltstone.functions import scales as S
from siltstone.functions import sequence as Q
from siltstone.operators import cohort, dedupe, evaluation, metrics, overlap, ranks, reporting, resample, serving, splits
from siltstone.operators.prefix import numbered
from siltstone.plans.core import LABELED, labeled, query, rounded, settled, settled_sql, spearman_sql, table
from siltstone.plans.structure import SEQ, poisson_sql, scale_sql, sequences

CANON = lambda c: f"coalesce(upper(replace(trim({c}), ' ', '')), '')"
SLUG = lambda c: f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"SELECT p_partkey, {CANON('p_name')} AS first, {CANON('p_type')} AS second, {SLUG('p_brand')} AS metric, lower(trim(p_type)) AS direction FROM part")
def aggregation_signatures(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", *cohort.signature(F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.col("p_type")))


@query("SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier")
def public_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"))
    return cohort.union_present([c, None, s])


@query("""WITH d AS (SELECT doc_id, source, lang, n_chars, sha256(text) AS k FROM documents), own AS (SELECT 'own' AS origin, * FROM d WHERE source IN ('src0', 'src1')),
u AS (SELECT * FROM own UNION ALL SELECT 'public', * FROM d WHERE source NOT IN ('src0', 'src1') AND k NOT IN (SELECT k FROM own))
SELECT doc_id, source, origin, CASE WHEN coalesce(lang, '') <> '' AND coalesce(k, '') <> '' THEN substr(sha256(lang || '|' || k), 1, 16) END AS pair_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY origin, doc_id) AS n FROM u) WHERE n = 1 AND n_chars >= 100""")
def antibody_cohort(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.sha2("text", 256).alias("k"))
    own = [d.where(F.col("source") == s) for s in ("src0", "src1")]
    rows = cohort.cohort(own, d.where(~F.col("source").isin("src0", "src1")), ["k"], ["doc_id"], ("lang", "k"), F.col("n_chars") >= 100)
    return rows.select("doc_id", "source", "origin", "pair_id")


@query("SELECT role, count(*) AS rows, count(DISTINCT source) AS sources FROM (SELECT source, CASE lower(trim(source)) WHEN 'src0' THEN 'supervised' WHEN 'src1' THEN 'supervised' WHEN 'src2' THEN 'auxiliary' ELSE 'unassigned' END AS role FROM documents) GROUP BY role")
def cohort_roles(spark, sf_dir):
    rows = cohort.by_role(table(spark, sf_dir, "documents"), "source", {"src0": "supervised", "src1": "supervised", "src2": "auxiliary"})
    return rows.groupBy("role").agg(F.count("*").alias("rows"), F.count_distinct("source").alias("sources"))


@query("WITH s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), a AS (SELECT unnest(['all', 'core', 'core+src3', 'all-src0']) AS arm) SELECT arm, source FROM s, a WHERE arm = 'all' OR (arm IN ('core', 'core+src3') AND source IN ('src0', 'src1')) OR (arm = 'core+src3' AND source = 'src3') OR (arm = 'all-src0' AND source <> 'src0')")
def arm_sources(spark, sf_dir):
    return cohort.arm_sources(table(spark, sf_dir, "documents"), "source", ["all", "core", "core+src3", "all-src0"], ["src0", "src1"])


@query("SELECT p_partkey, round(TRY_CAST(v AS DOUBLE), 6) AS y FROM (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS v, p_type || CASE WHEN p_partkey % 7 = 0 THEN '_std' ELSE '' END AS metric FROM part) WHERE TRY_CAST(v AS DOUBLE) IS NOT NULL AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND NOT regexp_matches(lower(metric), '(^|_)(std|sd|var|cv|sem)(_|$)')")
def pooled_rows(spark, sf_dir):
    i = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(i, "p_brand", F.when(i % 5 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("v"), F.concat("p_type", F.when(i % 7 == 0, "_std").otherwise("")).alias("metric"))
    return rounded(cohort.pooled(rows, "v", "p_brand", "metric", ["Brand#11", "Brand#12", "Brand#23"]).select("p_partkey", "y"))


@query("WITH g AS (SELECT c_custkey, c_nationkey, c_acctbal < 0 AS gone FROM customer), m AS (SELECT *, count(*) FILTER (gone) OVER (PARTITION BY c_nationkey) AS many, row_number() OVER (PARTITION BY c_nationkey, gone ORDER BY sha256('0|' || c_custkey), c_custkey) AS n FROM g) SELECT c_custkey, gone, NOT gone AND n <= many AS control FROM m")
def matched_control(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") < 0).alias("gone"))
    return cohort.matched_control(rows, "gone", ["c_nationkey"], "c_custkey").select("c_custkey", "gone", "control")


@query(LABELED + ", k AS (SELECT *, lang || ':' || (n_chars // 200) AS key FROM l), t AS (SELECT * FROM k WHERE doc_id % 4 = 0), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY doc_id DESC) AS n FROM k WHERE doc_id % 4 <> 0 AND key NOT IN (SELECT key FROM t)) WHERE n = 1), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS k FROM f) SELECT 1 AS one, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, round((sum(k) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0), 6) AS auc FROM r")
def transfer_auc(spark, sf_dir):
    rows = labeled(spark, sf_dir).withColumn("key", F.concat_ws(":", "lang", F.floor(F.col("n_chars") / 200).cast("string")))
    held = F.pmod("doc_id", F.lit(4)) == 0
    train = cohort.last_wins(overlap.without_keys(rows.where(~held), rows.where(held), ["key"]), ["source", "key"], "doc_id")
    return rounded(metrics.rank_auc(train.withColumn("one", F.lit(1)), ["one"], "label", "score"))


@query("""WITH b AS (SELECT d.doc_id, d.source AS origin, sha256(d.text) AS k, l.toxic AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id), n AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY sha256('0|' || doc_id), doc_id) AS n FROM b),
u AS (SELECT doc_id, k, label, 'broad' AS source FROM n WHERE origin = 'src0' AND n <= 40 UNION ALL SELECT doc_id, k, label, 'narrow' FROM n WHERE origin = 'src1') SELECT doc_id, source, label FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY label DESC NULLS LAST, doc_id) AS m FROM u) WHERE m = 1""")
def training_set(spark, sf_dir):
    b = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("origin"), F.sha2("text", 256).alias("k")).join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    sources = {"broad": b.where("origin = 'src0'"), "missing": None, "narrow": b.where("origin = 'src1'")}
    return cohort.assembled(sources, {"broad": 40}, "k", "label", "doc_id").select("doc_id", "source", "label")


@query("SELECT p_brand, count(*) FILTER (p_size > 5 AND v IS NOT NULL) AS active, round(avg(CASE WHEN p_size > 5 THEN v END), 6) AS score FROM (SELECT *, CASE WHEN p_partkey % 9 > 0 THEN p_retailprice END AS v FROM part) GROUP BY p_brand")
def report_score(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("v", F.when(F.col("p_partkey") % 9 > 0, F.col("p_retailprice")))
    return rounded(serving.report_score(rows, ["p_brand"], "v", F.col("p_size") > 5))


@query("SELECT p_partkey, unnest(['size', 'price']) AS assay, round(unnest([CAST(p_size AS DOUBLE), p_retailprice]), 6) AS value FROM part")
def report_assays(spark, sf_dir):
    reports = table(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), "p_retailprice").alias("assays"))
    return rounded(serving.assays_of(reports, "assays"))


@query("SELECT event_id, round(coalesce(a, b, 0.0), 6) AS risk, round(coalesce(c, 0.0), 6) AS uncertainty FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS a, CASE WHEN event_id % 2 = 0 THEN value / 2 END AS b, CASE WHEN event_id % 5 = 0 THEN value / 5 END AS c FROM events)")
def risk_precedence(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    risks = [F.when(i % 3 == 0, v), F.when(i % 2 == 0, v / 2)]
    return rounded(table(spark, sf_dir, "events").select("event_id", *serving.risk_and_uncertainty(risks, [F.when(i % 5 == 0, v / 5)])))


@query("SELECT l_orderkey, l_linenumber, round((l_discount + l_tax) / 2, 6) AS score, round(abs(l_discount - l_tax), 6) AS uncertainty FROM lineitem")
def two_model_gap(spark, sf_dir):
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *serving.two_model_gap(F.col("l_discount"), F.col("l_tax"))))


@query("SELECT event_type, user_id, round(avg(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END), 6) + 0.0::DOUBLE AS oriented FROM events GROUP BY ALL")
def oriented_means(spark, sf_dir):
    return rounded(serving.oriented_mean(table(spark, sf_dir, "events"), ["event_type", "user_id"], "value", F.col("event_id") % 2 == 0))


@query("WITH s AS (SELECT c_nationkey, c_mktsegment, max(c_acctbal) AS v FROM customer GROUP BY ALL) SELECT c_nationkey, max(v) FILTER (c_mktsegment = 'BUILDING') AS building, max(v) FILTER (c_mktsegment = 'MACHINERY') AS machinery, count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) = 2 AS complete FROM s GROUP BY c_nationkey")
def promotion_matrix(spark, sf_dir):
    out = serving.promotion_matrix(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", ["BUILDING", "MACHINERY"], "c_acctbal")
    return out.withColumnsRenamed({"BUILDING": "building", "MACHINERY": "machinery"})


@query(LABELED + f", b AS (SELECT lang, CAST(least(floor(score * 10), 9) AS INT) AS b, count(*) AS n, avg(score) AS m, avg(label) AS o FROM l GROUP BY ALL) SELECT lang, count(*) AS bins, sum(n)::BIGINT AS n, {settled_sql('sum(abs(o - m) * n) / sum(n)')} AS mean_error FROM b GROUP BY lang")
def calibration_check(spark, sf_dir):
    return settled(serving.weighted_calibration(labeled(spark, sf_dir), ["lang"], "label", "score"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN p < 0.001 THEN 'very strong' WHEN p < 0.01 THEN 'strong' WHEN p < 0.05 THEN 'moderate' WHEN p < 0.1 THEN 'weak' ELSE 'none' END AS band FROM (SELECT *, CASE WHEN l_linenumber < 7 THEN l_tax * l_discount * 10 END AS p FROM lineitem)")
def significance_bands(spark, sf_dir):
    p = F.when(F.col("l_linenumber") < 7, F.col("l_tax") * F.col("l_discount") * 10)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", serving.significance_band(p).alias("band"))


@query(LABELED + """, f AS (SELECT 'test' AS part, * FROM l WHERE doc_id % 5 = 0), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS k FROM f), s AS (SELECT score, count(*) AS n, sum(label) AS p FROM f GROUP BY score), c AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER (ORDER BY score DESC) AS cp FROM s)
SELECT 'test' AS part, count(*) AS n, count(DISTINCT source) AS groups, round((sum(k) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0), 6) AS auc, (SELECT round(sum(p * cp / cn) / sum(p), 6) FROM c) AS average_precision FROM r""")
def frozen_split_report(spark, sf_dir):
    rows = labeled(spark, sf_dir).where(F.pmod("doc_id", F.lit(5)) == 0).withColumn("part", F.lit("test"))
    auc = metrics.rank_auc(rows, ["part"], "label", "score").select("part", "auc")
    found = metrics.average_precision(rows, ["part"], "label", "score")
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("source").alias("groups"))
    return rounded(sizes.join(auc, "part").join(found, "part"))


@query("""WITH t AS (SELECT s_suppkey, s_acctbal, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey DESC) <= greatest(ceil(count(*) OVER () * 0.15::DOUBLE), 1) AS INT) AS target, (s_suppkey * 37 % 101) / 101.0::DOUBLE AS score FROM supplier),
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY target ORDER BY sha256('5|' || s_suppkey), s_suppkey) - 1) % 5 AS INT) AS fold FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, s_suppkey) AS n, greatest(ceil(count(*) OVER (PARTITION BY fold) * 0.15::DOUBLE), 1) AS k FROM f)
SELECT fold, count(*) AS n, sum(target)::BIGINT AS positives, round(coalesce(sum(CASE WHEN n <= k THEN target ELSE 0 END) / nullif(sum(target), 0)::DOUBLE, 0), 6) AS "catch" FROM r GROUP BY fold""")
def stratified_catch(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").withColumn("one", F.lit(1))
    rows = ranks.exact_tail(rows, ["one"], "s_acctbal", "s_suppkey").withColumn("score", F.col("s_suppkey") * 37 % 101 / 101.0)
    rows = serving.stratified_folds(rows, "target", "s_suppkey", 5, splits.hash_order(5, "s_suppkey"))
    return rounded(metrics.screening(rows, ["fold"], "target", "score", "s_suppkey").select("fold", "n", "positives", "catch"))


@query("SELECT event_type, count(DISTINCT user_id) AS records, round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events)::DOUBLE, 6) AS coverage, count(DISTINCT user_id) >= (SELECT count(DISTINCT user_id) FROM events) * 0.8 AS admitted FROM events WHERE NOT (event_type = 'click' AND user_id % 3 = 0) GROUP BY event_type")
def spec_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return rounded(serving.coverage(e.where("not (event_type = 'click' and user_id % 3 = 0)"), "event_type", "user_id", e))


@query(spearman_sql("SELECT l_suppkey, l_quantity AS x, l_extendedprice AS y FROM lineitem", "l_suppkey").replace("SELECT l_suppkey, count(*) AS n, round(", "SELECT l_suppkey, n, round(spearman, 6) AS spearman, CASE WHEN n < 600 THEN 'too_few' WHEN spearman < 0.0 THEN 'quarantine' ELSE 'serve' END AS decision FROM (SELECT l_suppkey, count(*) AS n, (").replace(", 6) AS spearman FROM r GROUP BY ALL", ") AS spearman FROM r GROUP BY ALL)"))
def head_quarantine(spark, sf_dir):
    heads = metrics.spearman(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return rounded(serving.quarantined(heads, "spearman", "n", 0.0, 600))


@query(LABELED + "SELECT failures, working, failure_groups, working_groups, failures >= 30 AND failure_groups >= 2 AND working_groups >= 2 AS fits FROM (SELECT count(*) FILTER (label = 1) AS failures, count(*) FILTER (label = 0) AS working, count(DISTINCT CASE WHEN label = 1 THEN source END) AS failure_groups, count(DISTINCT CASE WHEN label = 0 THEN source END) AS working_groups FROM l)")
def training_guards(spark, sf_dir):
    return cohort.training_guards(labeled(spark, sf_dir), "label", "source")


VARIANTS = f"""WITH p AS (SELECT p_partkey, regexp_replace(upper(p_name || p_type), '[^A-Z]', '', 'g') AS parent FROM part), v AS (SELECT p_partkey, pos, aa, substr(parent, 1, pos - 1) || aa || substr(parent, pos + 1) AS s FROM (SELECT p_partkey, parent, unnest([1, 2, 3]) AS pos, unnest(['W', 'D', 'K']) AS aa FROM p) WHERE length(parent) >= pos AND substr(parent, pos, 1) <> aa),
r AS (SELECT p_partkey, pos, aa, s, greatest(0.0::DOUBLE, least(1.0::DOUBLE, {scale_sql(S.HYDROPATHY)} / length(s) / 4 + 0.5::DOUBLE)) AS risk FROM v),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY risk DESC, pos) AS n FROM r) WHERE n = 1), t AS (SELECT p_partkey, pos, aa, s, risk FROM b ORDER BY risk DESC, p_partkey LIMIT 50) """


def phase_one(spark, sf_dir):
    """Anchors, their variants, a risk, the best of each anchor, and of these the first 50 (a report)."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.upper(F.concat("p_name", "p_type")), "[^A-Z]", "").alias("parent"))
    change = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(a).alias("aa")) for i, a in ((1, "W"), (2, "D"), (3, "K"))]))
    v = p.withColumn("c", change).select("p_partkey", "parent", "c.pos", "c.aa").where((F.length("parent") >= F.col("pos")) & (F.substring("parent", F.col("pos"), F.lit(1)) != F.col("aa")))
    v = v.withColumn("s", F.overlay("parent", "aa", F.col("pos"))).withColumn("risk", reporting.clamped(Q.scale_mean(F.col("s"), S.HYDROPATHY) / 4 + F.lit(0.5)))
    best = ranks.top_per_group(v, ["p_partkey"], [F.desc("risk"), "pos"], 1)
    return best.select("p_partkey", "pos", "aa", "s", "risk").orderBy(F.desc("risk"), "p_partkey").limit(50)


@query(VARIANTS + "SELECT p_partkey, pos, aa, s, round(risk, 6) AS risk FROM t")
def phase1_candidates(spark, sf_dir):
    return rounded(phase_one(spark, sf_dir))


@query(VARIANTS + f"SELECT p_partkey, round({scale_sql(S.CHARGE)}, 6) + 0.0::DOUBLE AS net_charge, coalesce(nullif(array_to_string(list_filter([CASE WHEN risk >= 0.6 THEN 'high risk' END, CASE WHEN {scale_sql(S.CHARGE)} < 0 THEN 'negative' END], lambda x: x IS NOT NULL), '; '), ''), 'no rule fits') AS explanation FROM t")
def phase2_report(spark, sf_dir):
    rows = phase_one(spark, sf_dir).withColumn("net_charge", Q.net_charge(F.col("s")).cast("double"))
    return rounded(rows.select("p_partkey", "net_charge", reporting.explanation([("high risk", F.col("risk") >= 0.6), ("negative", F.col("net_charge") < 0)]).alias("explanation")))


@query(VARIANTS + "SELECT p_partkey, level, round(least(1.0::DOUBLE, risk + CASE level WHEN 'high' THEN 0.3 WHEN 'medium' THEN 0.1 ELSE 0 END::DOUBLE), 6) AS boosted FROM (SELECT t.p_partkey, t.risk, CASE WHEN q.p_size > 30 THEN 'high' WHEN q.p_size > 10 THEN 'medium' ELSE 'low' END AS level FROM t JOIN part q ON t.p_partkey = q.p_partkey)")
def phase3_rerank(spark, sf_dir):
    level = F.when(F.col("p_size") > 30, "high").when(F.col("p_size") > 10, "medium").otherwise("low")
    rows = phase_one(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", level.alias("level")), "p_partkey")
    return rounded(ranks.boosted(rows, "risk", "level", {"high": 0.3, "medium": 0.1}).select("p_partkey", "level", "boosted"))


@query("SELECT doc_id, CAST(len(f) AS INT) AS found, coalesce(array_to_string(list_transform(f, lambda x: x.b || '-' || x.e), ','), '') AS ranges FROM (SELECT doc_id, list_slice(list_filter(list_transform(range(0, least(n_chars // 50, 12) + 1), lambda i: {'b': i * 7, 'e': i * 7 + i % 4}), lambda x: len(list_filter([0, n_chars % 40, n_chars % 90], lambda p: p + 1 >= x.b AND p + 1 <= x.e)) > 0), 1, 5) AS f FROM documents)")
def variants_at_positions(spark, sf_dir):
    n = F.col("n_chars")
    features = F.transform(F.sequence(F.lit(0).cast("long"), F.least(F.floor(n / 50), F.lit(12))), lambda i: F.struct((i * 7).alias("begin"), (i * 7 + i % 4).alias("end")))
    rows = table(spark, sf_dir, "documents").select("doc_id", serving.variants_at(features, F.array(F.lit(0).cast("long"), n % 40, n % 90)).alias("f"))
    return rows.select("doc_id", F.size("f").alias("found"), F.array_join(F.transform("f", lambda x: F.concat_ws("-", x["begin"].cast("string"), x["end"].cast("string"))), ",").alias("ranges"))


@query("SELECT doc_id, hits > 0 AS evidence, hits FROM (SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda t: regexp_matches(lower(t), 'license|copyright|permission'))) AS INT) AS hits FROM documents WHERE text IS NOT NULL)")
def keyword_evidence(spark, sf_dir):
    comments = F.array(F.split("text", "\n"), F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", *serving.keyword_evidence(comments, ["license", "copyright", "permission"]))


@query(SEQ + f""", m AS (SELECT p_partkey, i, avg(x) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM (SELECT p_partkey, unnest(list_transform(regexp_extract_all(s, '.'), lambda x: CASE x {" ".join(f"WHEN '{a}' THEN {v!r}::DOUBLE" for a, v in S.BETA_STRAND.items())} ELSE 0.0::DOUBLE END)) AS x, generate_subscripts(regexp_extract_all(s, '.'), 1) - 1 AS i FROM q)),
f AS (SELECT *, i - row_number() OVER (PARTITION BY p_partkey, m > 0.45 ORDER BY i) AS g FROM m), r AS (SELECT p_partkey, min(i) AS a, max(i) AS b FROM f WHERE m > 0.45 GROUP BY p_partkey, g)
SELECT q.p_partkey, coalesce(x.ranges, '') AS ranges FROM q LEFT JOIN (SELECT p_partkey, string_agg((a + 1) || '-' || (b + 1), ',' ORDER BY a) AS ranges FROM r GROUP BY p_partkey) x ON x.p_partkey = q.p_partkey""")
def hotspot_ranges(spark, sf_dir):
    runs = Q.segments(Q.centred_means(Q.scale_values(F.col("s"), S.BETA_STRAND)), 0.45, 6)
    return sequences(spark, sf_dir).select("p_partkey", serving.residue_ranges(runs).alias("ranges"))


@query("WITH h AS (SELECT vec_id, label, array_to_string(list_transform(list_filter(range(1, 12), lambda i: i % 4 <> 0), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN '1' ELSE '0' END), '') AS bits FROM embeddings) SELECT bits, count(*) AS rows, min(vec_id) AS first_record, count(DISTINCT label) > 1 AS conflict FROM h GROUP BY bits HAVING count(*) > 1")
def gradient_hash_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", serving.gradient_hash(F.slice("embedding", 1, 12), 4).alias("bits"))
    return serving.duplicate_groups(rows, "bits", "label", "vec_id")


_R = normal.correlation(0.6)


@query(f"""WITH n AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS i, count(*) OVER () AS n, CAST('0x' || substr(md5('3|' || c_custkey), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE + {1.0 / (1 << 53)!r}::DOUBLE AS u FROM customer),
p AS (SELECT *, (i + 0.5::DOUBLE) / n AS p FROM n), z AS (SELECT *, cast({_R!r} as double) * {normal.quantile_sql('p')} + cast({(1 - _R * _R) ** 0.5!r} as double) * {normal.quantile_sql('u')} AS z FROM p),
t AS (SELECT *, CAST(least(floor({normal.distribution_sql('z')} * n), n - 1) AS BIGINT) AS t FROM z) SELECT t.c_custkey, t.c_acctbal, b.c_acctbal AS planted FROM t JOIN n b ON b.i = t.t""")
def copula_labels(spark, sf_dir):
    return normal.copula_labels(table(spark, sf_dir, "customer"), "c_acctbal", "c_custkey", 0.6, 3)


@query("""WITH f AS (SELECT p_brand, min(p_name) AS t FROM part GROUP BY p_brand), s AS (SELECT a.p_partkey, f.p_brand, 1 - hamming(a.p_name, f.t) / length(a.p_name)::DOUBLE AS s FROM part a JOIN f ON length(a.p_name) = length(f.t) AND length(a.p_name) > 0), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY s DESC, p_brand) AS n FROM s) WHERE n = 1)
SELECT p.p_partkey, round(coalesce(b.s, 0), 6) AS similarity, CASE WHEN b.s >= 0.25 THEN b.p_brand END AS route FROM part p LEFT JOIN b ON b.p_partkey = p.p_partkey""")
def routed_specialist(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    refs = p.groupBy("p_brand").agg(F.min("p_name").alias("reference"))
    return rounded(serving.routed(p.select("p_partkey", "p_name"), refs, "p_name", "p_brand", "reference", 0.25).select("p_partkey", F.col("similarity").cast("double").alias("similarity"), "route"))


@query("WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, list_distance(a.e, b.e) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS n FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT CAST(floor(d / 0.05::DOUBLE) AS INT) AS bin, count(*) AS pairs, round(sqrt(avg(pow(la - lb, 2))), 6) AS rms FROM p WHERE n <= 5 GROUP BY 1")
def knn_label_rms(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    near = overlap.knn(v.where(F.pmod("vec_id", F.lit(20)) == 0), v, "vec_id", "embedding", 5)
    a, b = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("la")), v.select(F.col("vec_id").alias("neighbour_id"), F.col("label").alias("lb"))
    return rounded(serving.label_rms_by_distance(near.join(a, "query_id").join(b, "neighbour_id"), "distance", F.col("la") - F.col("lb"), 0.05))


@query(f"""WITH g AS (SELECT source AS g, avg(n_chars) AS a FROM documents GROUP BY 1), t AS (SELECT d, a, {poisson_sql("'1'", "d", "g")} AS k FROM g, (SELECT unnest(range(500)) AS d)), v AS (SELECT d, sum(a * k) / sum(k) AS v FROM t GROUP BY d HAVING sum(k) > 0), r AS (SELECT v, row_number() OVER (ORDER BY v) AS n FROM v)
SELECT round((SELECT avg(a) FROM g), 6) AS point, round(max(v) FILTER (n = 13), 6) AS low, round(max(v) FILTER (n = 488), 6) AS high, count(*) AS draws FROM r""")
def source_mean_ci(spark, sf_dir):
    return rounded(resample.source_bootstrap(table(spark, sf_dir, "documents"), "source", "n_chars", 500, 1))


def rho_sql(rows: str, x: str, y: str) -> str:
    """Weighted Spearman by d of rows (d, k, x, y)."""
    rank = lambda c: f"sum(k) OVER (PARTITION BY d ORDER BY {c}) - (sum(k) OVER (PARTITION BY d, {c}) - 1) / 2.0::DOUBLE"
    var = lambda c: f"(sum(k) * sum(k * {c} * {c}) - sum(k * {c}) * sum(k * {c}))"
    return f"SELECT d, CASE WHEN {var('a')} * {var('b')} > 0 THEN (sum(k) * sum(k * a * b) - sum(k * a) * sum(k * b)) / sqrt({var('a')} * {var('b')}) END AS rho FROM (SELECT d, k, {rank(x)} AS a, {rank(y)} AS b FROM ({rows})) GROUP BY d"


DRAWN = f"SELECT d, {poisson_sql(chr(39) + '2' + chr(39), 'd', 'doc_id')} AS k, doc_id, score, label, n_chars FROM l, (SELECT unnest(range(40)) AS d)"


@query(LABELED + f", t AS (SELECT * FROM ({DRAWN}) WHERE k > 0), v AS ({rho_sql('SELECT * FROM t', 'score', 'label')}), r AS (SELECT rho, row_number() OVER (ORDER BY rho) AS n FROM v WHERE rho IS NOT NULL), o AS ({rho_sql('SELECT -1 AS d, 1 AS k, score, label FROM l', 'score', 'label')}) SELECT round((SELECT rho FROM o), 6) AS point, round(max(rho) FILTER (n = 2), 6) AS low, round(max(rho) FILTER (n = 40), 6) AS high, count(*) AS draws FROM r")
def spearman_ci(spark, sf_dir):
    return rounded(resample.spearman_bootstrap(labeled(spark, sf_dir), "doc_id", "score", "label", 40, 2))


@query(LABELED + f""", t AS (SELECT *, CASE WHEN doc_id % 3 > 0 THEN n_chars END AS other FROM ({DRAWN}) WHERE k > 0), a AS ({rho_sql('SELECT * FROM t', 'label', 'score')}), b AS ({rho_sql('SELECT * FROM t WHERE other IS NOT NULL', 'label', 'other')}), v AS (SELECT a.rho - b.rho AS v FROM a JOIN b ON a.d = b.d), r AS (SELECT v, row_number() OVER (ORDER BY v) AS n FROM v WHERE v IS NOT NULL),
oa AS ({rho_sql('SELECT -1 AS d, 1 AS k, score, label FROM l', 'label', 'score')}), ob AS ({rho_sql('SELECT -1 AS d, 1 AS k, n_chars, label FROM l WHERE doc_id % 3 > 0', 'label', 'n_chars')})
SELECT round((SELECT oa.rho - ob.rho FROM oa, ob), 6) AS point, round(max(v) FILTER (n = 2), 6) AS low, round(max(v) FILTER (n = 40), 6) AS high, count(*) AS draws, round((SELECT avg(CAST(v <= 0 AS INT)) FROM v), 6) AS p_not_better FROM r""")
def paired_spearman(spark, sf_dir):
    rows = labeled(spark, sf_dir).withColumn("other", F.when(F.col("doc_id") % 3 > 0, F.col("n_chars")))
    return rounded(resample.paired_spearman_bootstrap(rows, "doc_id", "label", "score", "other", 40, 2))


@query(SEQ + f"SELECT p_partkey, round({scale_sql(S.CHARGE)}, 6) + 0.0::DOUBLE AS charge, round({scale_sql(S.HYDROPATHY)} / length(s), 6) + 0.0::DOUBLE AS hydropathy, round((" + " + ".join(f"(length(s) - length(replace(s, '{a}', '')))" for a in S.AROMATIC) + ") / length(s)::DOUBLE, 6) AS aromatic, CAST(length(s) AS INT) AS length FROM q WHERE length(s) > 0")
def physical_summary(spark, sf_dir):
    s = F.col("s")
    return rounded(sequences(spark, sf_dir).where(F.length(s) > 0).select("p_partkey", Q.net_charge(s).cast("double").alias("charge"), Q.scale_mean(s, S.HYDROPATHY).cast("double").alias("hydropathy"), Q.letter_share(s, S.AROMATIC).cast("double").alias("aromatic"), F.length(s).alias("length")))


AUDIT = "WITH p AS (SELECT source, doc_id, text, label, score FROM (SELECT d.source, d.doc_id, d.text, b.quality AS label, (d.n_chars % 1000) / 1000.0::DOUBLE AS score FROM documents d JOIN labels b ON d.doc_id = b.doc_id)) "


@query(AUDIT + """, c AS (SELECT sha256(text) AS k FROM p GROUP BY 1 HAVING count(DISTINCT label) > 1), q AS (SELECT * FROM p WHERE sha256(text) NOT IN (SELECT k FROM c)), r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY source ORDER BY label) + (count(*) OVER (PARTITION BY source, label) - 1) / 2.0::DOUBLE AS b FROM q),
s AS (SELECT source, count(*) AS n, coalesce(CASE WHEN count(*) > 1 AND (count(*) * sum(a * a) - sum(a) * sum(a)) * (count(*) * sum(b * b) - sum(b) * sum(b)) > 0 THEN (count(*) * sum(a * b) - sum(a) * sum(b)) / sqrt((count(*) * sum(a * a) - sum(a) * sum(a)) * (count(*) * sum(b * b) - sum(b) * sum(b))) END, 0.0) AS rho FROM r GROUP BY source)
SELECT (SELECT count(*) FROM c) AS conflicts, count(*) AS sources, sum(n)::BIGINT AS rows, round(avg(rho), 6) AS mean_spearman FROM s""")
def ensemble_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("k"))
    rows = labeled(spark, sf_dir).join(docs, "doc_id")
    bad = dedupe.conflict_keys(rows, ["k"], "label")
    per = metrics.spearman(rows.join(bad.select("k"), "k", "left_anti"), ["source"], "label", "score")
    out = per.agg(F.count("*").alias("sources"), F.sum("n").alias("rows"), F.avg("spearman").alias("mean_spearman"))
    return rounded(bad.agg(F.count("*").alias("conflicts")).crossJoin(F.broadcast(out)))  # one row each


SCORES = [("a", "n_chars % 1000"), ("b", "doc_id * 31 % 101"), ("c", "n_chars * 7 % 1009")]


@query("WITH r AS (SELECT doc_id, source, " + ", ".join(f"(row_number() OVER (PARTITION BY source ORDER BY {e}, doc_id) - 1) / greatest(count(*) OVER (PARTITION BY source) - 1, 1)::DOUBLE AS {n}" for n, e in SCORES) + " FROM documents) SELECT doc_id, round((a + b + c) / 3, 6) AS score FROM r")
def rank_ensemble(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", *[F.expr(e).alias(n) for n, e in SCORES])
    ranked = rows.select("doc_id", *[ranks.rank01(n, "doc_id", ["source"]).alias(n) for n, _ in SCORES])
    return rounded(ranked.select("doc_id", (reduce(lambda x, y: x + y, [F.col(n) for n, _ in SCORES]) / len(SCORES)).alias("score")))


ROUTED = "WITH l AS (SELECT d.doc_id, d.source, b.quality AS label, (d.n_chars % 1000) / 1000.0::DOUBLE AS p, (d.doc_id * 31 % 101) / 101.0::DOUBLE AS i FROM documents d JOIN labels b ON d.doc_id = b.doc_id), n AS (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM l), w AS (SELECT 'blend_' || w AS model, source, doc_id, label, w * p + (1 - w) * i AS score FROM n, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS w) UNION ALL SELECT 'routed', source, doc_id, label, CASE WHEN n < 50 THEN p ELSE i END FROM n) "


@query(ROUTED + ", r AS (SELECT *, rank() OVER (PARTITION BY model, source ORDER BY score) + (count(*) OVER (PARTITION BY model, source, score) - 1) / 2.0::DOUBLE AS k FROM w), a AS (SELECT model, source, (sum(k) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0) AS auc FROM r GROUP BY ALL) SELECT model, count(auc) AS sources, round(avg(auc), 6) AS mean_auc FROM a GROUP BY model")
def blend_routing(spark, sf_dir):
    """Weights of a pooled and an independent score, and the score of small sources routed to the pooled one."""
    rows = labeled(spark, sf_dir).select("doc_id", "source", "label", F.col("score").alias("p"), (F.col("doc_id") * 31 % 101 / 101.0).alias("i"))
    w = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    blends = rows.withColumn("w", w).select(F.concat(F.lit("blend_"), F.col("w").cast("string")).alias("model"), "source", "doc_id", "label", (F.col("w") * F.col("p") + (1 - F.col("w")) * F.col("i")).alias("score"))
    small = F.count("*").over(Window.partitionBy("source")) < 50
    routed = rows.select(F.lit("routed").alias("model"), "source", "doc_id", "label", F.when(small, F.col("p")).otherwise(F.col("i")).alias("score"))
    auc = metrics.rank_auc(blends.unionByName(routed), ["model", "source"], "label", "score")
    return rounded(auc.groupBy("model").agg(F.count("auc").alias("sources"), F.avg("auc").alias("mean_auc")))


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY sha256(text), doc_id) - 1 AS BIGINT) AS position FROM documents")
def deterministic_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("k"))
    return numbered(rows, ["k", "doc_id"]).select("doc_id", "position")


@query("SELECT c_custkey, array_to_string(list_transform(['BUILDING', 'MACHINERY', 'FURNITURE'], lambda n: CAST(coalesce(c_mktsegment = n, false) AS INT)), '') AS assay FROM customer")
def pooled_one_hot(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(cohort.one_hot("c_mktsegment", ["BUILDING", "MACHINERY", "FURNITURE"]).cast("array<string>"), "").alias("assay"))


@query(f"""WITH q AS (SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS s FROM part), w AS (SELECT p_partkey, flatten(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN regexp_matches(substr(s, CAST(i AS INT), 1), '[AEL]') THEN [i, i, i] ELSE [i] END)) AS w FROM q WHERE length(s) > 0),
u AS (SELECT p_partkey, w, [{", ".join(f"CAST('0x' || substr(md5('4|{k}|' || p_partkey), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE" for k in range(5))}] AS u FROM w)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(u, lambda x: w[CAST(floor(x * len(w)) + 1 AS INT)]))), ',') AS positions FROM u""")
def weighted_positions(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.upper("p_name"), "[^A-Z]", "").alias("s")).where(F.length("s") > 0)
    picked = serving.weighted_positions(F.col("s"), F.col("p_partkey"), 4, 5, "AEL", 3)
    return rows.select("p_partkey", F.array_join(picked.cast("array<string>"), ",").alias("positions"))


@query("WITH f AS (SELECT p_brand, p_name, min(p_partkey) AS id FROM part GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('0|' || p_name), id) AS n FROM f), p AS (SELECT * FROM n WHERE n <= 64), s AS (SELECT a.p_brand, a.id, sum(CASE WHEN length(a.p_name) = length(b.p_name) THEN 1 - hamming(a.p_name, b.p_name) / length(a.p_name)::DOUBLE ELSE 0 END) AS s FROM p a JOIN p b ON a.p_brand = b.p_brand GROUP BY ALL) SELECT p_brand AS family, id AS record FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(s, 9) DESC, id) AS m FROM s) WHERE m = 1")
def family_medoids(spark, sf_dir):
    rows = cohort.reference_cover(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_name", 0.5)
    return rows.where("place = 0").select("family", "record")


@query(None)
def family_references(spark, sf_dir):
    return rounded(cohort.reference_cover(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_name", 0.5))
