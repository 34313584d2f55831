"""Queries of keys, risk outputs, rankings, histograms, set operations and rechecks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import sequence as Q
from siltstone.functions import text as X
from siltstone.operators import contract, metrics, overlap, ranks, reporting
from siltstone.plans.core import LABELED, labeled, query, rounded, spearman_sql, table


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'molecule:' || doc_id WHEN doc_id % 3 = 1 THEN 'study:' || source ELSE sha256(text) END AS group_key, coalesce(source, '') || '|' || coalesce(lang, '') || '|' || n_chars AS composite FROM documents")
def group_keys(spark, sf_dir):
    d, r = table(spark, sf_dir, "documents"), F.pmod("doc_id", F.lit(3))
    key = reporting.group_key(("molecule", F.when(r == 0, F.col("doc_id"))), ("study", F.when(r == 1, F.col("source")).otherwise(" ")), ("", F.sha2("text", 256)))
    return d.select("doc_id", key.alias("group_key"), reporting.composite_key(F.col("source"), F.col("lang"), F.col("n_chars")).alias("composite"))


FLAGS = {"steel": "steel", "small": "small", "ends_copper": "copper$", "plated": "plat"}


@query("SELECT p_partkey, " + ", ".join(f"CAST(regexp_matches(lower(p_type || ' ' || p_name), '{p}') AS INT) AS {n}" for n, p in FLAGS.items()) + " FROM part")
def context_flags(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", *reporting.context_flags(F.concat_ws(" ", "p_type", "p_name"), FLAGS))


@query("SELECT event_id, round(s * value, 6) AS risk, CASE WHEN NOT stop THEN round(s * (value - 10), 6) END AS margin, CASE WHEN stop THEN 'abstain' WHEN s * (value - 10) >= 0 THEN 'fail' ELSE 'pass' END AS decision FROM (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 1.0 ELSE -1.0 END::DOUBLE AS s, event_id % 11 = 0 AS stop FROM events)")
def risk_output(spark, sf_dir):
    direction = F.when(F.col("event_type").isin("click", "view"), "higher_bad").otherwise("lower_bad")
    e = table(spark, sf_dir, "events")
    return rounded(e.select("event_id", *reporting.risk_output(F.col("value"), direction, F.lit(10.0), F.pmod("event_id", F.lit(11)) == 0)))


@query("SELECT l_orderkey, l_linenumber, round(risk, 6) AS risk, risk > 0.6 AS flagged FROM (SELECT *, 0.4::DOUBLE * least(1.0, greatest(0.0, l_quantity / 40)) + 0.3::DOUBLE * least(1.0, greatest(0.0, l_discount * 12 - 0.1::DOUBLE)) + 0.3::DOUBLE * least(1.0, greatest(0.0, l_tax * 10)) AS risk FROM lineitem)")
def blended_risk(spark, sf_dir):
    q, d, t = F.col("l_quantity") / 40, F.col("l_discount") * 12 - F.lit(0.1), F.col("l_tax") * 10
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *reporting.blended_risk([(0.4, q), (0.3, d), (0.3, t)])))


@query("WITH e AS (SELECT user_id, event_id, abs(value) AS d, value / 100.0::DOUBLE AS r, row_number() OVER (PARTITION BY user_id ORDER BY abs(value) DESC, event_id) AS n FROM events) SELECT user_id, round(avg(d), 6) AS disagreement, round(avg(r), 6) AS risk, round((avg(d) + avg(r)) / 2, 6) AS score, string_agg(CASE WHEN n <= 5 THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY n) AS top_items FROM e GROUP BY user_id")
def candidate_ranking(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.abs("value").alias("d"), (F.col("value") / 100.0).alias("r"))
    return rounded(reporting.candidate_ranking(e, "user_id", "event_id", "d", "r"))


@query("SELECT CAST(least(floor((n_chars - 0) / (3000.0::DOUBLE / 30)), 29) AS INT) AS bin, count(*) AS n FROM documents WHERE n_chars BETWEEN 0 AND 3000 GROUP BY 1")
def length_histogram(spark, sf_dir):
    return reporting.histogram(table(spark, sf_dir, "documents"), "n_chars", 0.0, 3000.0, 30)


@query("SELECT CASE WHEN l_quantity >= 25 THEN 'high' ELSE 'low' END || '_' || CASE WHEN l_discount >= 0.05 THEN 'high' ELSE 'low' END AS quadrant, count(*) AS n, round(avg(l_tax), 6) AS mean_tax FROM lineitem GROUP BY 1")
def quadrant_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("quadrant", reporting.quadrants(F.col("l_quantity"), F.col("l_discount"), 25.0, 0.05))
    return rounded(rows.groupBy("quadrant").agg(F.count("*").alias("n"), F.avg("l_tax").alias("mean_tax")))


@query("SELECT p_type, n FROM (SELECT p_type, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY p_type) ORDER BY n DESC, f LIMIT 15")
def most_common_types(spark, sf_dir):
    return reporting.most_common(table(spark, sf_dir, "part"), "p_type", "p_partkey", 15)


@query("""SELECT "column", n AS distinct_values FROM (SELECT unnest(['l_returnflag', 'l_linestatus', 'l_tax', 'one']) AS "column", unnest([count(DISTINCT l_returnflag), count(DISTINCT l_linestatus), count(DISTINCT l_tax), 1]) AS n FROM lineitem) WHERE n > 1""")
def varying_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1))
    return reporting.varying_columns(rows, ["l_returnflag", "l_linestatus", "l_tax", "one"])


@query("SELECT value, first_row FROM (SELECT value, min(k) AS k, min(c_custkey) AS first_row FROM (SELECT c_custkey, c_custkey * 2 AS k, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, c_custkey * 2 + 1, CAST(c_nationkey AS VARCHAR) FROM customer) GROUP BY value) ORDER BY k LIMIT 20")
def distinct_in_order(spark, sf_dir):
    return reporting.distinct_in_order(table(spark, sf_dir, "customer"), "c_custkey", ["c_mktsegment", "c_nationkey"], 20)


@query("SELECT round(avg(CAST(l.doc_id IS NOT NULL AS INT)), 6) AS quality, round(avg(CAST(d.text <> '' AS INT)), 6) AS text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def parse_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rounded(reporting.share_filled(rows, ["quality", "text"]))


@query("SELECT trim(lang) AS lang, count(*) AS n FROM documents WHERE trim(lang) <> '' GROUP BY 1")
def trimmed_group_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.trim("lang").alias("lang")).where("lang <> ''").groupBy("lang").agg(F.count("*").alias("n"))


@query("WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, round(avg(x), 6) AS mean, round(avg(x * x) - avg(x) * avg(x), 6) AS variance, round(avg(CAST(x < 0.05::DOUBLE AS INT)), 6) AS share_low FROM v GROUP BY vec_id")
def array_summaries(spark, sf_dir):
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", *reporting.array_summary(F.col("embedding"), 0.05)))


@query("WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT a.vec_id, a.label, b.label AS guess, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS n FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT label, count(*) AS n, round(avg(CAST(label = guess AS INT)), 6) AS accuracy FROM p WHERE n = 1 GROUP BY label")
def nearest_copy_accuracy(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    near = overlap.knn(v.where(F.pmod("vec_id", F.lit(20)) == 0), v, "vec_id", "embedding", 1)
    own, other = v.select(F.col("vec_id").alias("query_id"), "label"), v.select(F.col("vec_id").alias("neighbour_id"), F.col("label").alias("guess"))
    both = near.join(own, "query_id").join(other, "neighbour_id")
    return rounded(both.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("guess")).cast("int")).alias("accuracy")))


AUC = "(sum(k) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0)"


@query(LABELED + f", m AS (SELECT quantile_cont(n_chars, 0.5) AS m FROM l), b AS (SELECT l.*, n_chars > m AS long, lang = 'en' AS english FROM l, m), r AS (SELECT *, rank() OVER (PARTITION BY long, english ORDER BY score) + (count(*) OVER (PARTITION BY long, english, score) - 1) / 2.0::DOUBLE AS k FROM b) SELECT long, english, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, round({AUC}, 6) AS auc FROM r GROUP BY long, english")
def subgroup_auc(spark, sf_dir):
    rows = labeled(spark, sf_dir)
    middle = rows.agg(F.percentile("n_chars", F.lit(0.5)).alias("_m"))
    rows = rows.crossJoin(F.broadcast(middle)).withColumn("long", F.col("n_chars") > F.col("_m")).withColumn("english", F.col("lang") == "en")
    return rounded(metrics.rank_auc(rows, ["long", "english"], "label", "score"))


@query("SELECT lang, count(*) FILTER (n_chars < 500) AS short, count(*) FILTER (n_chars >= 500 AND n_chars < 2000) AS middle, count(*) FILTER (n_chars >= 2000) AS long FROM documents GROUP BY lang")
def size_bin_pivot(spark, sf_dir):
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "middle").otherwise("long")
    rows = table(spark, sf_dir, "documents").withColumn("size_bin", size)
    return rows.groupBy("lang").pivot("size_bin", ["short", "middle", "long"]).count().na.fill(0)


@query("SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal, NULL FROM supplier")
def union_of_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return contract.union_by_name([c, s])


@query("SELECT k, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, value FROM events) GROUP BY k")
def json_property_means(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").try_cast("int").alias("k"), "value")
    return rounded(e.groupBy("k").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")))


CHAIN = "SELECT p_partkey, 'QV' || 'C' || substr(s, 1, 12) || 'WV' || s || 'C' || s || 'WGQG' AS vh FROM (SELECT p_partkey, regexp_replace(upper(p_name || p_type), '[^A-Z]', '', 'g') AS s FROM part)"


@query(f"SELECT p_partkey, regexp_extract(substr(vh, 1, 80), 'C([A-Z]{{5,18}})W[IV]', 1) AS first_loop, regexp_extract(vh, 'C([A-Z]{{3,40}})WG.G', 1) AS third_loop, substr(sha256(substr(vh, 1, 3) || substr(vh, 20, 5)), 1, 16) AS framework FROM ({CHAIN})")
def heavy_loops(spark, sf_dir):
    s = F.regexp_replace(F.upper(F.concat("p_name", "p_type")), "[^A-Z]", "")
    rows = table(spark, sf_dir, "part").select("p_partkey", s.alias("s"))
    rows = rows.select("p_partkey", F.concat(F.lit("QVC"), F.substring("s", 1, 12), F.lit("WV"), "s", F.lit("C"), "s", F.lit("WGQG")).alias("vh"))
    first, third = Q.heavy_loops(F.col("vh"))
    return rows.select("p_partkey", first.alias("first_loop"), third.alias("third_loop"), F.substring(F.sha2(F.concat(F.substring("vh", 1, 3), F.substring("vh", 20, 5)), 256), 1, 16).alias("framework"))


@query("SELECT doc_id, coalesce(nullif(array_to_string(list_filter([CASE WHEN n_chars < 200 THEN 'short text' END, CASE WHEN n_chars > 5000 THEN 'long text' END, CASE WHEN lang <> 'en' THEN 'other language' END], lambda x: x IS NOT NULL), '; '), ''), 'no rule fits') AS explanation FROM documents")
def rule_explanations(spark, sf_dir):
    rules = [("short text", F.col("n_chars") < 200), ("long text", F.col("n_chars") > 5000), ("other language", F.col("lang") != "en")]
    return table(spark, sf_dir, "documents").select("doc_id", reporting.explanation(rules).alias("explanation"))


@query("WITH m AS (SELECT l_suppkey, quantile_cont(l_quantity, 0.5) AS m FROM lineitem GROUP BY l_suppkey) SELECT l.l_suppkey, count(*) AS n, sum(CAST(l_quantity > m AS INT))::BIGINT AS positives FROM lineitem l JOIN m ON l.l_suppkey = m.l_suppkey GROUP BY ALL")
def median_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    middle = rows.groupBy("l_suppkey").agg(F.percentile("l_quantity", F.lit(0.5)).alias("m"))
    return rows.join(middle, "l_suppkey").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum((F.col("l_quantity") > F.col("m")).cast("int")).alias("positives"))


WEIGHTS = [i / 10 for i in range(11)]


@query(spearman_sql("SELECT w, l_extendedprice AS x, w * l_quantity + (1 - w) * 50 * l_tax * 10 AS y FROM lineitem, (SELECT unnest([" + ", ".join(f"{w}::DOUBLE" for w in WEIGHTS) + "]) AS w)", "w"))
def blend_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("w", F.explode(F.array(*[F.lit(w) for w in WEIGHTS])))
    rows = rows.withColumn("y", F.col("w") * F.col("l_quantity") + (1 - F.col("w")) * 50 * F.col("l_tax") * 10)
    return rounded(metrics.spearman(rows, ["w"], "l_extendedprice", "y"))


@query("SELECT r.r_regionkey, r_name, r.r_regionkey % 2 = 0 OR EXISTS (SELECT 1 FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = r.r_regionkey AND c.c_acctbal > 9990) AS used FROM region r")
def policy_status(spark, sf_dir):
    policy = table(spark, sf_dir, "region").withColumn("prior", F.col("r_regionkey") % 2 == 0)
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9990").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return reporting.policy_status(policy, rich.select(F.col("n_regionkey").alias("r_regionkey")), ["r_regionkey"], "prior").select("r_regionkey", "r_name", "used")


@query("SELECT l_returnflag, count(*) > 0 AND l_returnflag <> 'R' AS exact FROM lineitem GROUP BY l_returnflag")
def recomputed_report(spark, sf_dir):
    fresh = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg("l_tax").alias("tax"), F.count("*").cast("double").alias("n"))
    report = fresh.withColumn("tax", F.when(F.col("l_returnflag") == "R", F.col("tax") + 0.1).otherwise(F.col("tax")))
    return reporting.recomputed(report, fresh, ["l_returnflag"], ["tax", "n"])


@query("SELECT c_custkey, substr(sha256(c_mktsegment || '|' || CAST(c_nationkey AS VARCHAR)), 1, 16) AS pair_id, substr(sha256(c_mktsegment || chr(0) || CAST(c_nationkey AS VARCHAR)), 1, 24) AS content FROM customer")
def content_keys(spark, sf_dir):
    n = F.col("c_nationkey").cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", X.paired_key(F.col("c_mktsegment"), n).alias("pair_id"), X.content_key(F.col("c_mktsegment"), n, length=24).alias("content"))


@query(spearman_sql("SELECT o_orderpriority, o_totalprice AS x, q AS y FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey", "o_orderpriority"))
def cross_source_agreement(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").join(q, "o_orderkey")
    return rounded(metrics.spearman(rows, ["o_orderpriority"], "o_totalprice", "q"))


@query("SELECT o_orderkey, rank FROM (SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders) WHERE rank <= 2")
def top_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ranks.top_per_group(rows, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2).select("o_orderkey", "rank")
