"""Queries of overlap, splits, sequences, graphs, evaluation and resampling, each with its SQL where SQL can express it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from siltstone.functions import scales as S
from siltstone.functions import sequence as Q
from siltstone.operators import evaluation, graph, learners, overlap, resample, splits
from siltstone.plans.core import LABELED, labeled, query, rounded, settled, settled_sql, spearman_sql, table
from siltstone.streaming.feedback import windowed_counts


def keyed(spark, sf_dir):
    """Documents with a key that the held-out part (ids divisible by 10) shares with some others."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.sha2("text", 256).alias("text_key"))
    return docs.withColumn("size_key", F.concat_ws(":", "lang", "n_chars")).withColumn("held", F.pmod("doc_id", F.lit(10)) == 0)


KEYED = "WITH k AS (SELECT doc_id, source, lang, n_chars, sha256(text) AS text_key, lang || ':' || n_chars AS size_key, doc_id % 10 = 0 AS held FROM documents) "


@query(KEYED + "SELECT doc_id, CASE WHEN text_key IN (SELECT text_key FROM k WHERE held) THEN 'exact_text' WHEN size_key IN (SELECT size_key FROM k WHERE held) THEN 'same_size' END AS reason FROM k WHERE NOT held")
def overlap_strip(spark, sf_dir):
    k = keyed(spark, sf_dir)
    return overlap.strip_overlap(k.where("not held"), k.where("held"), [("text_key", "exact_text"), ("size_key", "same_size")]).select("doc_id", "reason")


@query(KEYED + "SELECT source, coalesce(reason, 'kept') AS reason, count(*) AS rows FROM (SELECT source, CASE WHEN text_key IN (SELECT text_key FROM k WHERE held) THEN 'exact_text' WHEN size_key IN (SELECT size_key FROM k WHERE held) THEN 'same_size' END AS reason FROM k WHERE NOT held) GROUP BY ALL")
def overlap_strip_audit(spark, sf_dir):
    k = keyed(spark, sf_dir)
    rows = overlap.strip_overlap(k.where("not held"), k.where("held"), [("text_key", "exact_text"), ("size_key", "same_size")])
    return rows.groupBy("source", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("rows"))


@query(KEYED + "SELECT doc_id, source FROM k WHERE NOT held AND text_key NOT IN (SELECT text_key FROM k WHERE held) AND size_key NOT IN (SELECT size_key FROM k WHERE held)")
def holdout_anti_join(spark, sf_dir):
    k = keyed(spark, sf_dir)
    return overlap.without_keys(k.where("not held"), k.where("held"), ["text_key", "size_key"]).select("doc_id", "source")


@query(KEYED + "SELECT lang, seen, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM (SELECT *, text_key IN (SELECT text_key FROM k WHERE NOT held) AS seen FROM k WHERE held) GROUP BY ALL")
def seen_mask_eval(spark, sf_dir):
    k = keyed(spark, sf_dir)
    rows = overlap.with_seen(k.where("held"), k.where("not held"), ["text_key"])
    return rows.groupBy("lang", "seen").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("WITH k AS (SELECT DISTINCT source AS s, sha256(text) AS k FROM documents), n AS (SELECT s, count(*) AS n FROM k GROUP BY s) SELECT x.s AS a, y.s AS b, count(*) AS shared, round(count(*) / least(any_value(nx.n), any_value(ny.n))::DOUBLE, 6) AS share_of_smaller FROM k x JOIN k y ON x.k = y.k AND x.s < y.s JOIN n nx ON nx.s = x.s JOIN n ny ON ny.s = y.s GROUP BY ALL")
def dataset_overlap_matrix(spark, sf_dir):
    return rounded(overlap.dataset_overlap(keyed(spark, sf_dir), "source", "text_key"))


@query("WITH p AS (SELECT p_partkey, p_name FROM part) SELECT a.p_partkey AS a_id, b.p_partkey AS b_id, CAST(hamming(a.p_name, b.p_name) AS INT) AS mismatches FROM p a JOIN p b ON length(a.p_name) = length(b.p_name) AND length(a.p_name) > 1 AND a.p_partkey <> b.p_partkey AND hamming(a.p_name, b.p_name) <= 1")
def near_positional_match(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    pairs = overlap.near_by_position(parts, parts, "p_partkey", "p_partkey", "p_name", "p_name", 1)
    return pairs.where("a_id <> b_id")


COSINE = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"


@query(f"WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, {COSINE} AS c FROM v a JOIN v b ON b.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT a_id, b_id, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY c DESC, b_id) AS n FROM p WHERE c >= 0.3) WHERE n = 1")
def cosine_near_pairs(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return rounded(overlap.near_by_cosine(v, v.where(F.pmod("vec_id", F.lit(20)) == 0), "vec_id", "embedding", 0.3))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id) SELECT query_id, neighbour_id, round(d, 6) AS distance, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, neighbour_id) AS INT) AS rank FROM p) WHERE rank <= 5")
def knn_join(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return rounded(overlap.knn(v, v, "vec_id", "embedding", 5))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM x GROUP BY ALL),
d AS (SELECT x.vec_id, c.label AS nearest, sqrt(sum(pow(x.x - c.c, 2)) / count(*)) AS d FROM x JOIN c ON x.i = c.i GROUP BY ALL)
SELECT vec_id, nearest, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, nearest) AS n FROM d) WHERE n = 1""")
def nearest_centroid_domain(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    long = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    centres = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("centre"))
    return rounded(overlap.nearest_reference(v.select("vec_id", "embedding"), centres, "embedding", "label", "centre").select("vec_id", "nearest", "distance"))


PLACES = "SELECT c_custkey, (c_custkey * 7919 % 18000) / 100.0::DOUBLE - 90 AS lat, (c_custkey * 104729 % 36000) / 100.0::DOUBLE - 180 AS lon FROM customer"


def places(spark, sf_dir):
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", (F.pmod(c * 7919, F.lit(18000)) / F.lit(100.0) - 90).alias("lat"), (F.pmod(c * 104729, F.lit(36000)) / F.lit(100.0) - 180).alias("lon"))


HAVERSINE = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"WITH p AS ({PLACES}), d AS (SELECT a.c_custkey AS a_id, b.c_custkey AS b_id, {HAVERSINE} AS km FROM p a JOIN p b ON a.c_custkey <> b.c_custkey) SELECT a_id, round(min(km), 4) AS nearest_km, count(DISTINCT b_id) AS neighbours FROM d WHERE km <= 300 GROUP BY a_id")
def haversine_radius_join(spark, sf_dir):
    p = places(spark, sf_dir)
    out = overlap.within_radius(p, p, "c_custkey", "lat", "lon", 300.0)
    return out.select("a_id", F.round("nearest_km", 4).alias("nearest_km"), "neighbours")


@query(f"WITH p AS ({PLACES}), b AS (SELECT CAST(floor(lat / 15) * 1000 + floor(lon / 15) AS BIGINT) AS block FROM p), s AS (SELECT block, count(*) AS n FROM b GROUP BY block), f AS (SELECT block, n, (row_number() OVER (ORDER BY n DESC, sha1('0:' || block), block) - 1) % 5 AS fold FROM s) SELECT CAST(fold AS INT) AS fold, count(*) AS blocks, sum(n)::BIGINT AS rows FROM f GROUP BY fold")
def spatial_block_folds(spark, sf_dir):
    p = places(spark, sf_dir).withColumn("block", splits.block_key(F.col("lat"), F.col("lon"), 15.0))
    return splits.grouped_folds(p, "block", 5).groupBy("fold").agg(F.count_distinct("block").alias("blocks"), F.count("*").alias("rows"))


@query(LABELED + "SELECT doc_id, source, label FROM (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY sha256('7|' || source || '|' || label || '|' || doc_id), doc_id) AS n FROM l) WHERE n <= 5")
def balanced_cap(spark, sf_dir):
    return splits.balanced_cap(labeled(spark, sf_dir), ["source", "label"], "doc_id", 5, 7).select("doc_id", "source", "label")


@query(LABELED + ", a AS (SELECT *, row_number() OVER (PARTITION BY source, lang, label ORDER BY sha256('7|' || source || '|' || lang || '|' || label || '|' || doc_id), doc_id) AS n FROM l), b AS (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY sha256('7|' || source || '|' || label || '|' || doc_id), doc_id) AS m FROM a WHERE n <= 2) SELECT doc_id, source, lang, label FROM b WHERE m <= 3")
def two_level_cap(spark, sf_dir):
    return splits.two_level_cap(labeled(spark, sf_dir), ["source", "lang", "label"], ["source", "label"], "doc_id", 2, 3, 7).select("doc_id", "source", "lang", "label")


@query(LABELED + "SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS n FROM l) WHERE n <= (SELECT least(min(c), 60) FROM (SELECT count(*) AS c FROM l GROUP BY label))")
def balanced_truncate(spark, sf_dir):
    return splits.class_balanced(labeled(spark, sf_dir), "label", "doc_id", 60).select("doc_id", "label")


@query(LABELED + "SELECT doc_id, CASE WHEN c >= 5 AND n <= CASE WHEN (c % 5) * 2 = 5 THEN NULL ELSE round(c * 0.2::DOUBLE) END THEN 'calibration' ELSE 'fit' END AS part FROM (SELECT *, count(*) OVER (PARTITION BY source, label) AS c, row_number() OVER (PARTITION BY source, label ORDER BY sha256('0|' || source || '|' || label || '|' || doc_id), doc_id) AS n FROM l)")
def calibration_split(spark, sf_dir):
    return splits.calibration_split(labeled(spark, sf_dir), ["source", "label"], "doc_id").select("doc_id", "part")


@query("WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), f AS (SELECT source, CAST((row_number() OVER (ORDER BY n DESC, sha1('0:' || source), source) - 1) % 4 AS INT) AS fold FROM s) SELECT d.doc_id, f.fold FROM documents d JOIN f ON d.source = f.source")
def grouped_folds(spark, sf_dir):
    return splits.grouped_folds(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 4).select("doc_id", "fold")


@query("WITH s AS (SELECT user_id AS u, count(*) AS n FROM events GROUP BY user_id), c AS (SELECT u, coalesce(sum(n) OVER (ORDER BY n, sha256('0|' || u), u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT e.event_id, CASE WHEN c.before < 2000 THEN 'test' ELSE 'train' END AS part FROM events e JOIN c ON e.user_id = c.u")
def cumulative_group_split(spark, sf_dir):
    return splits.cumulative_split(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", 2000).select("event_id", "part")


@query("SELECT part, count(*) AS n FROM (SELECT CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END AS part FROM (SELECT CAST('0x' || substr(sha256('0|' || doc_id), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM documents)) GROUP BY part")
def hashed_split(spark, sf_dir):
    return splits.fraction_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT text_key, count(DISTINCT part) AS parts FROM (SELECT sha256(text) AS text_key, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM documents) GROUP BY text_key HAVING count(DISTINCT part) > 1")
def group_leakage_check(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_key"), F.when(F.pmod("doc_id", F.lit(5)) == 0, "test").otherwise("train").alias("part"))
    return splits.leaking_groups(rows, "text_key", "part")


@query("SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS only_in FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def key_set_difference(spark, sf_dir):
    return splits.set_difference(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), table(spark, sf_dir, "orders"), "o_custkey")


@query(LABELED + "SELECT doc_id, source, part FROM (SELECT doc_id, source, CASE WHEN source <> 'src0' AND n_chars >= 300 THEN 'train' WHEN source = 'src0' AND n_chars >= 1000 THEN 'test' END AS part FROM l) WHERE part IS NOT NULL")
def eligible_split(spark, sf_dir):
    return splits.eligible(labeled(spark, sf_dir), "source", "src0", F.col("n_chars") >= 300, F.col("n_chars") >= 1000).select("doc_id", "source", "part")


@query(LABELED + """, s AS (SELECT source, label, count(*) AS c FROM l GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY source) AS s, sum(c) OVER () AS n, count(*) OVER () AS k, (SELECT count(DISTINCT source) FROM s) AS m FROM s),
w AS (SELECT source, label, c, n / (c * k)::DOUBLE AS cw, n / (s * m)::DOUBLE AS sw FROM t), h AS (SELECT *, sqrt(cw * sw) AS h FROM w)
SELECT l.doc_id, round(h.cw, 6) AS class_weight, round(h.sw, 6) AS source_weight, round(h.h / (SELECT sum(h * c) / sum(c) FROM h), 6) AS hybrid_weight FROM l JOIN h ON l.source = h.source AND l.label = h.label""")
def source_weights(spark, sf_dir):
    rows = splits.source_weights(labeled(spark, sf_dir), "source", "label").select("doc_id", "class_weight", "source_weight", "hybrid_weight")
    return rounded(rows.select("doc_id", *[F.col(c).cast("double") for c in ("class_weight", "source_weight", "hybrid_weight")]))


def sequences(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.upper(F.concat("p_name", "p_type")), "[^A-Z]", "").alias("s"))


SEQ = "WITH q AS (SELECT p_partkey, regexp_replace(upper(p_name || p_type), '[^A-Z]', '', 'g') AS s FROM part) "


def scale_sql(scale: dict[str, float], default: float = 0.0) -> str:
    total = " + ".join(f"(length(s) - length(replace(s, '{a}', ''))) * {v - default!r}::DOUBLE" for a, v in scale.items())
    return f"({total} + length(s) * {default!r}::DOUBLE)"


def share_sql(letters: str) -> str:
    return "(" + " + ".join(f"(length(s) - length(replace(s, '{a}', '')))" for a in letters) + ") / nullif(length(s), 0)::DOUBLE"


def values_sql(scale: dict[str, float], default: float = 0.0) -> str:
    return "list_transform(regexp_extract_all(s, '.'), lambda x: CASE x " + " ".join(f"WHEN '{a}' THEN {v!r}::DOUBLE" for a, v in scale.items()) + f" ELSE {default!r}::DOUBLE END)"


def windows_sql(values: str) -> str:
    return f"CASE WHEN len({values}) = 0 THEN 0 WHEN len({values}) < 5 THEN list_avg({values}) ELSE list_max(list_transform(range(1, len({values}) - 3), lambda i: list_avg(list_slice({values}, i, i + 4)))) END"


@query(SEQ + f"""SELECT p_partkey, round({scale_sql(S.HYDROPATHY)} / length(s), 6) + 0.0::DOUBLE AS hydropathy_mean, round({scale_sql(S.CHARGE)}, 6) + 0.0::DOUBLE AS net_charge, round({scale_sql(S.CHARGE)} / length(s), 6) + 0.0::DOUBLE AS charge_density,
round({windows_sql('v')}, 6) AS hydrophobic_patch, round({share_sql(S.AROMATIC)}, 6) AS aromatic_share, round({scale_sql(S.BETA_SHEET, 1.0)} / length(s), 6) AS beta_sheet_mean,
CAST(list_max(list_transform(string_split(regexp_replace(s, '[^{S.STRONG_HYDROPHOBIC}]', ' ', 'g'), ' '), lambda x: length(x))) AS DOUBLE) AS longest_hydrophobic_run, round({share_sql(S.GATEKEEPERS)}, 6) AS gatekeeper_share, round({windows_sql('b')}, 6) AS beta_aromatic_patch, CAST(length(s) AS INT) AS length
FROM (SELECT *, {values_sql(S.HYDROPATHY)} AS v, {values_sql({a: S.BETA_SHEET.get(a, 1.0) + (a in S.AROMATIC) for a in S.ALPHABET}, 1.0)} AS b FROM q)""")
def sequence_descriptors(spark, sf_dir):
    return rounded(sequences(spark, sf_dir).select("p_partkey", *Q.descriptors(F.col("s"))))


def charge_sql(ph: str) -> str:
    plus = f"1 / (1 + pow(10::DOUBLE, {ph} - {S.N_TERMINUS}))" + "".join(f" + (length(s) - length(replace(s, '{a}', ''))) / (1 + pow(10::DOUBLE, {ph} - {k}))" for a, k in S.POSITIVE_PKA.items())
    minus = f"1 / (1 + pow(10::DOUBLE, {S.C_TERMINUS} - {ph}))" + "".join(f" + (length(s) - length(replace(s, '{a}', ''))) / (1 + pow(10::DOUBLE, {k} - {ph}))" for a, k in S.NEGATIVE_PKA.items())
    return f"(({plus}) - ({minus}))"


@query(SEQ + f" SELECT p_partkey, round({charge_sql('6.0')}, 6) AS charge_6, round({charge_sql('7.4')}, 6) AS charge_74, round({charge_sql('6.0')} - {charge_sql('7.4')}, 6) AS shift FROM q")
def charge_ph(spark, sf_dir):
    c = F.col("s")
    return rounded(sequences(spark, sf_dir).select("p_partkey", Q.charge_at(c, 6.0).alias("charge_6"), Q.charge_at(c, 7.4).alias("charge_74"), (Q.charge_at(c, 6.0) - Q.charge_at(c, 7.4)).alias("shift")))


@query(f"""WITH RECURSIVE q AS (SELECT p_partkey, regexp_replace(upper(p_name || p_type), '[^A-Z]', '', 'g') AS s FROM part),
b(p_partkey, s, lo, hi, n) AS (SELECT p_partkey, s, 2.0::DOUBLE, 12.0::DOUBLE, 0 FROM q UNION ALL SELECT p_partkey, s, CASE WHEN {charge_sql('((lo + hi) / 2)')} > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {charge_sql('((lo + hi) / 2)')} > 0 THEN hi ELSE (lo + hi) / 2 END, n + 1 FROM b WHERE n < 40)
SELECT p_partkey, round((lo + hi) / 2, 6) AS pi FROM b WHERE n = 40""")
def isoelectric_points(spark, sf_dir):
    return rounded(sequences(spark, sf_dir).select("p_partkey", Q.isoelectric_point(F.col("s")).alias("pi")))


def centred_sql(scale: dict[str, float]) -> str:
    return f"""SELECT p_partkey, i, avg(x) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM (SELECT p_partkey, unnest({values_sql(scale)}) AS x, generate_subscripts({values_sql(scale)}, 1) - 1 AS i FROM q)"""


@query(SEQ + f""", m AS ({centred_sql(S.BETA_STRAND)}), f AS (SELECT *, m > 0.45 AS on_, i - row_number() OVER (PARTITION BY p_partkey, m > 0.45 ORDER BY i) AS g FROM m)
SELECT p_partkey, CAST(min(i) AS INT) AS "start", CAST(max(i) AS INT) AS "end", round(avg(m), 6) AS score FROM f WHERE on_ GROUP BY p_partkey, g""")
def hotspot_segments(spark, sf_dir):
    runs = Q.segments(Q.centred_means(Q.scale_values(F.col("s"), S.BETA_STRAND)), 0.45, 6)
    rows = sequences(spark, sf_dir).select("p_partkey", F.explode(runs).alias("r"))
    return rows.select("p_partkey", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.col("r.score").alias("score"))


@query(SEQ + f""", a AS ({centred_sql(S.BETA_STRAND)}), b AS ({centred_sql(S.AGGREGATION)}), c AS ({centred_sql(S.combined_scale())}),
v AS (SELECT a.p_partkey, a.i, CAST(a.m > 0.45 AS INT) + CAST(b.m > 0.0 AS INT) + CAST(c.m > 0.4 AS INT) AS v FROM a JOIN b ON a.p_partkey = b.p_partkey AND a.i = b.i JOIN c ON a.p_partkey = c.p_partkey AND a.i = c.i),
f AS (SELECT *, i - row_number() OVER (PARTITION BY p_partkey, v >= 2 ORDER BY i) AS g FROM v) SELECT p_partkey, CAST(min(i) AS INT) AS "start", CAST(max(i) AS INT) AS "end", CAST(max(v) AS DOUBLE) AS score FROM f WHERE v >= 2 GROUP BY p_partkey, g""")
def consensus_segments(spark, sf_dir):
    rows = sequences(spark, sf_dir).select("p_partkey", F.explode(Q.consensus_segments(F.col("s"))).alias("r"))
    return rows.select("p_partkey", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.col("r.score").alias("score"))


@query(SEQ + "SELECT gram, sum(c)::BIGINT AS n, count(*) AS sequences FROM (SELECT p_partkey, substr(s, CAST(i AS INT), 2) AS gram, count(*) AS c FROM (SELECT p_partkey, s, unnest(range(1, length(s))) AS i FROM q) GROUP BY ALL) GROUP BY gram")
def dipeptide_counts(spark, sf_dir):
    rows = sequences(spark, sf_dir).select("p_partkey", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2)))).alias("gram"))
    return rows.groupBy("gram").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("sequences"))


@query("SELECT a.p_partkey, round(CASE WHEN length(a.p_name) = length(b.p_name) AND length(a.p_name) > 0 THEN 1 - hamming(a.p_name, b.p_name) / length(a.p_name)::DOUBLE ELSE 0 END, 6) AS identity, CASE WHEN length(a.p_name) = length(b.p_name) THEN CAST(hamming(a.p_name, b.p_name) AS INT) END AS differences FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def sequence_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    both = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")
    d = Q.differences(F.col("p_name"), F.col("other"))
    return rounded(both.select("p_partkey", Q.positional_identity(F.col("p_name"), F.col("other")).cast("double").alias("identity"), F.when(d.isNotNull(), F.size(d)).alias("differences")))


@query("""WITH q AS (SELECT s_suppkey, s_name AS s FROM supplier) SELECT s_suppkey, CAST(i AS INT) AS pos, a AS new, overlay_ AS variant FROM (SELECT s_suppkey, i, a, substr(s, 1, CAST(i AS INT) - 1) || a || substr(s, CAST(i AS INT) + 1) AS overlay_, substr(s, CAST(i AS INT), 1) AS old FROM (SELECT s_suppkey, s, unnest(range(1, length(s) + 1)) AS i FROM q), (SELECT unnest(string_split('A C D E F G H I K L M N P Q R S T V W Y', ' ')) AS a)) WHERE a <> old""")
def single_substitutions(spark, sf_dir):
    q = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("s"), F.explode(F.sequence(F.lit(1), F.length("s_name"))).alias("pos"))
    q = q.withColumn("new", F.explode(F.array(*[F.lit(a) for a in S.ALPHABET]))).where(F.substring("s", F.col("pos"), F.lit(1)) != F.col("new"))
    return q.select("s_suppkey", "pos", "new", F.overlay("s", "new", F.col("pos")).alias("variant"))


MUTANT = "SELECT p_partkey, upper(p_name) AS parent, upper(substr(p_name, 2, 1)) || '2' || 'W;' || upper(substr(p_name, 1, 1)) || '1Y;x' AS m FROM part"


@query(f"WITH q AS ({MUTANT}) SELECT p_partkey, CASE WHEN m SIMILAR TO '[A-Z]2W;[A-Z]1Y;x' THEN 'YW' || substr(parent, 3) ELSE NULL END AS variant FROM q WHERE m SIMILAR TO '[A-Z]2W;[A-Z]1Y;x'")
def apply_substitutions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("parent"))
    m = p.withColumn("m", F.concat(F.substring("parent", 2, 1), F.lit("2W;"), F.substring("parent", 1, 1), F.lit("1Y;x"))).where(F.col("m").rlike("^[A-Z]2W;[A-Z]1Y;x$"))
    return m.select("p_partkey", Q.substituted(F.col("parent"), Q.substitutions(F.col("m"))).alias("variant"))


@query("""WITH k AS (SELECT p_partkey AS id, list_distinct(list_transform(range(1, length(p_name) - 2), lambda i: substr(p_name, CAST(i AS INT), 4))) AS g FROM part WHERE length(p_name) >= 4)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::DOUBLE, 6) AS jaccard FROM k a JOIN k b ON a.id < b.id WHERE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::DOUBLE >= 0.6""")
def kmer_jaccard_pairs(spark, sf_dir):
    return graph.kmer_pairs(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", 4, 0.6, digits=6)


@query("""WITH RECURSIVE k AS (SELECT DISTINCT o_custkey AS c FROM orders),
e AS (SELECT c AS a, CASE WHEN c % 3 = 0 THEN c ELSE c - 7 END AS b FROM k), b AS (SELECT a, b FROM e WHERE b IN (SELECT c FROM k) UNION SELECT b, a FROM e WHERE b IN (SELECT c FROM k)),
r(x, y) AS (SELECT c, c FROM k UNION SELECT r.x, b.b FROM r JOIN b ON r.y = b.a) SELECT x AS node, min(y) AS component FROM r GROUP BY x""")
def identity_components(spark, sf_dir):
    k = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node")).distinct()
    edges = k.select(F.col("node").alias("a"), F.when(F.col("node") % 3 == 0, F.col("node")).otherwise(F.col("node") - 7).alias("b"))
    edges = edges.join(k.select(F.col("node").alias("b")), "b", "left_semi")
    return graph.components(k, "node", edges)


@query(None)
def alignment_identity(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    both = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")
    return rounded(both.select("p_partkey", graph.alignment_identity(F.col("p_name"), F.col("other")).alias("identity")))


@query(None)
def alignment_identity_families(spark, sf_dir):
    return graph.identity_families(sequences(spark, sf_dir), "p_partkey", "s")


PAIRS = "WITH c AS (SELECT conv_id, turn, role, text, count(*) FILTER (role = 'user') OVER w AS u, count(*) FILTER (role = 'assistant') OVER w AS a, max(CASE WHEN role = 'user' THEN text END) OVER w AS tu, max(CASE WHEN role = 'assistant' THEN text END) OVER w AS ta FROM conversations WINDOW w AS (PARTITION BY conv_id)) "


@query(PAIRS + "SELECT conv_id, turn, role, CASE WHEN u = 1 AND a = 1 AND conv_id IS NOT NULL THEN substr(sha256(tu || '|' || ta), 1, 16) END AS pair_id FROM c")
def pair_chains(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return graph.pair_chains(rows, "conv_id", "role", "text", "user", "assistant").select("conv_id", "turn", "role", "pair_id")


@query(PAIRS + "SELECT conv_id, count(*) FILTER (role = 'user') AS n_first, count(*) FILTER (role = 'assistant') AS n_second, count(*) FILTER (u = 1 AND a = 1) AS paired FROM c GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 1 OR count(*) FILTER (role = 'assistant') > 1")
def pair_invariants(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return graph.pair_violations(graph.pair_chains(rows, "conv_id", "role", "text", "user", "assistant"), "conv_id", "role", "user", "assistant")


SEEDS = "WITH p AS (SELECT event_type, user_id, value / 100.0::DOUBLE AS score, abs(value) AS far, CASE WHEN event_id % 50 = 0 THEN 'out_of_domain' WHEN event_id % 9 = 0 THEN 'borderline' ELSE 'in_domain' END AS domain, 's' || (event_id % 3) AS source FROM events) "
CONSOLIDATED = SEEDS + ", c AS (SELECT event_type, user_id, count(*) AS seeds, avg(score) AS score, stddev_pop(score) AS disagreement, avg(far) AS distance, list_extract(['in_domain', 'borderline', 'out_of_domain'], max(CASE domain WHEN 'in_domain' THEN 1 WHEN 'borderline' THEN 2 ELSE 3 END)) AS domain, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM p GROUP BY ALL) "


def seeds(spark, sf_dir):
    i = F.col("event_id")
    domain = F.when(i % 50 == 0, "out_of_domain").when(i % 9 == 0, "borderline").otherwise("in_domain")
    return table(spark, sf_dir, "events").select("event_type", "user_id", (F.col("value") / 100.0).alias("score"), F.abs("value").alias("far"), domain.alias("domain"), F.concat(F.lit("s"), (i % 3).cast("string")).alias("source"), i.alias("event_id"))


@query(CONSOLIDATED + "SELECT event_type, user_id, seeds, " + ", ".join(f"{settled_sql(c)} AS {c}" for c in ("score", "disagreement", "distance")) + ", sources, domain, domain = 'out_of_domain' AS abstain FROM c")
def seed_consolidation(spark, sf_dir):
    return settled(evaluation.consolidated(seeds(spark, sf_dir), ["event_type", "user_id"], "score", "far", "domain", "source"))


@query(CONSOLIDATED + ", r AS (SELECT *, row_number() OVER (ORDER BY disagreement) AS n, count(*) OVER () AS c FROM c) SELECT count(*) AS records, count(*) FILTER (domain = 'in_domain') AS in_domain, count(*) FILTER (domain = 'borderline') AS borderline, count(*) FILTER (domain = 'out_of_domain') AS out_of_domain, round(avg(disagreement), 6) AS mean_disagreement, round(max(CASE WHEN n = least(floor(c * 0.95::DOUBLE), c - 1) + 1 THEN disagreement END), 6) AS high_disagreement FROM r")
def uncertainty_summary(spark, sf_dir):
    return rounded(evaluation.uncertainty_summary(evaluation.consolidated(seeds(spark, sf_dir), ["event_type", "user_id"], "score", "far", "domain", "source")))


@query(SEEDS + ", a AS (SELECT event_type, domain, source, avg(score) AS v FROM p GROUP BY ALL), b AS (SELECT event_type, source AS seed, avg(v) AS m, count(*) AS s FROM a GROUP BY ALL) SELECT event_type, count(*) AS seeds, max(s) AS sources, round(avg(m), 6) AS macro_mean, round(stddev_pop(m), 6) AS macro_deviation FROM b GROUP BY event_type")
def macro_source_summary(spark, sf_dir):
    return rounded(evaluation.macro_summary(seeds(spark, sf_dir), ["event_type"], "source", "domain", "score"))


REPORT = "WITH r AS (SELECT p_partkey, p_brand AS assay, p_type || CASE WHEN p_partkey % 11 = 0 THEN '_std' ELSE '' END AS metric, p_size AS n, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_retailprice % 200) / 100.0::DOUBLE - 0.5 END AS rho, p_partkey % 29 = 0 AS stop FROM part), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY assay, metric ORDER BY n DESC NULLS LAST, p_partkey) AS i FROM r) WHERE i = 1) "


@query(REPORT + "SELECT p_partkey, assay, metric, CASE WHEN stop THEN 'abstain_too_few_samples' WHEN lower(assay) = 'brand#13' THEN 'exclude_family' WHEN ends_with(metric, '_std') THEN 'exclude_scatter' WHEN n < 20 OR rho IS NULL THEN 'abstain_too_few_samples' WHEN rho < 0 THEN 'quarantine_negative' ELSE 'serve' END AS decision FROM t")
def serving_policy(spark, sf_dir):
    i = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(i, F.col("p_brand").alias("assay"), F.concat("p_type", F.when(i % 11 == 0, "_std").otherwise("")).alias("metric"), F.col("p_size").alias("n"), F.when(i % 13 != 0, (F.col("p_retailprice") % 200) / 100.0 - 0.5).alias("rho"), (i % 29 == 0).alias("stop"))
    best = evaluation.largest_report(rows, ["assay", "metric"], "n", "p_partkey")
    return best.select("p_partkey", "assay", "metric", evaluation.serving_decision(F.col("assay"), F.col("metric"), F.col("n"), F.col("rho"), F.col("stop"), ["brand#13"], 20).alias("decision"))


@query("WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_discount) AS d, avg(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT l_returnflag, n >= 1000 AS enough, d > 0.05 AS discount, q < 25 AS quantity, n >= 1000 AND d > 0.05 AND q < 25 AS promoted FROM s")
def promotion_gate(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_discount").alias("d"), F.avg("l_quantity").alias("q"))
    return evaluation.gate(s, {"enough": F.col("n") >= 1000, "discount": F.col("d") > 0.05, "quantity": F.col("q") < 25}).select("l_returnflag", "enough", "discount", "quantity", "promoted")


@query("WITH b AS (SELECT l_linestatus AS g, avg(l_discount) AS v FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL), t AS (SELECT l_linestatus AS g, avg(l_discount) AS v FROM lineitem WHERE l_linenumber > 3 GROUP BY ALL) SELECT coalesce(b.g, t.g) AS l_linestatus, round(b.v, 6) AS baseline, round(t.v, 6) AS trial, round(t.v - b.v, 6) AS gain, coalesce(t.v - b.v >= 0.0001, false) AS admitted FROM b FULL JOIN t ON b.g = t.g")
def relative_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    part = lambda cond: rows.where(cond).groupBy("l_linestatus").agg(F.avg("l_discount").alias("v"))
    return rounded(evaluation.relative_gate(part("l_linenumber <= 3"), part("l_linenumber > 3"), ["l_linestatus"], "v", 0.0001))


PREDICTIONS = "WITH p AS (SELECT l.source, m.model, l.doc_id, l.label, CASE m.model WHEN 'a' THEN (l.n_chars % 1000) / 1000.0::DOUBLE WHEN 'b' THEN (l.n_chars * 7 % 1009) / 1009.0::DOUBLE ELSE (l.doc_id * 31 % 101) / 101.0::DOUBLE END AS score FROM (SELECT d.doc_id, d.lang AS source, d.n_chars, b.quality AS label FROM documents d JOIN labels b ON d.doc_id = b.doc_id) l, (VALUES ('a'), ('b'), ('c')) m(model) WHERE NOT (m.model = 'c' AND l.doc_id % 2 = 0)) "


def predictions(spark, sf_dir):
    l = labeled(spark, sf_dir).select(F.col("lang").alias("source"), "doc_id", "n_chars", "label").withColumn("model", F.explode(F.array(*[F.lit(m) for m in "abc"])))
    score = F.when(F.col("model") == "a", F.col("n_chars") % 1000 / 1000.0).when(F.col("model") == "b", F.col("n_chars") * 7 % 1009 / 1009.0).otherwise(F.col("doc_id") * 31 % 101 / 101.0)
    return l.withColumn("score", score).where(~((F.col("model") == "c") & (F.col("doc_id") % 2 == 0)))


@query(PREDICTIONS + "SELECT doc_id, round(avg(score), 6) AS score FROM p WHERE model IN ('a', 'c') GROUP BY doc_id HAVING count(DISTINCT model) = 2")
def common_record_mean(spark, sf_dir):
    return rounded(evaluation.common_records(predictions(spark, sf_dir), "model", "doc_id", "score", ["a", "c"]))


@query(PREDICTIONS + """, s(members, size, model) AS (VALUES ('a', 1, 'a'), ('b', 1, 'b'), ('a+b', 2, 'a'), ('a+b', 2, 'b')), m AS (SELECT members, size, source, doc_id, any_value(label) AS y, avg(score) AS x FROM p JOIN s ON p.model = s.model GROUP BY ALL HAVING count(*) = size),
r AS (SELECT *, rank() OVER (PARTITION BY members, source ORDER BY x) + (count(*) OVER (PARTITION BY members, source, x) - 1) / 2.0::DOUBLE AS k FROM m),
a AS (SELECT members, size, source, (sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS auc FROM r GROUP BY ALL)
SELECT members, size, count(auc) AS sources, round(avg(auc), 6) AS macro_auc FROM a GROUP BY ALL""")
def blend_selection(spark, sf_dir):
    return rounded(evaluation.blends(predictions(spark, sf_dir), "source", "model", "doc_id", "label", "score", ["a", "b", "c"]))


@query("""WITH x AS (SELECT vec_id, label AS source, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-8 THEN 1 ELSE stddev_pop(x) END AS d FROM x GROUP BY i),
z AS (SELECT vec_id, source, x.i, (x - m) / d AS z FROM x JOIN s ON x.i = s.i), c AS (SELECT source, i, avg(z) AS c FROM z GROUP BY ALL), f AS (SELECT z.source, vec_id, sqrt(avg(pow(z - c, 2))) AS f FROM z JOIN c ON z.source = c.source AND z.i = c.i GROUP BY ALL)
SELECT source, count(*) AS rows, round(avg(f), 6) AS mean_distance, round(quantile_cont(f, 0.95), 6) AS p95, round(quantile_cont(f, 0.99), 6) AS p99 FROM f GROUP BY source""")
def applicability_index(spark, sf_dir):
    return rounded(evaluation.applicability(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label"))


@query("WITH q AS (SELECT quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS q FROM documents) SELECT band, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM (SELECT n_chars, CAST(len(list_filter(q, lambda v: v < n_chars)) AS INT) AS band FROM documents, q) GROUP BY band")
def quantile_bands(spark, sf_dir):
    rows = evaluation.subgroup_bands(table(spark, sf_dir, "documents").select("n_chars"), "n_chars")
    return rows.groupBy("band").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


def poisson_sql(*key: str) -> str:
    """How often a draw takes a row: resample.times of resample.uniform."""
    cuts, total, term = [], 0.0, math.exp(-1)
    for k in range(12):
        total += term
        cuts.append(f"{total!r}::DOUBLE")
        term /= k + 1
    return f"len(list_filter([{', '.join(cuts)}], lambda c: c <= CAST('0x' || substr(md5({" || '|' || ".join(key)}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE))"


@query(f"""WITH g AS (SELECT o_custkey AS g, sum(o_totalprice) AS a, count(*)::DOUBLE AS b FROM orders GROUP BY 1), t AS (SELECT d, a, b, {poisson_sql("'0'", "d", "g")} AS k FROM g, (SELECT unnest(range(200)) AS d)),
v AS (SELECT d, sum(a * k) / sum(b * k) AS v FROM t GROUP BY d), r AS (SELECT v, row_number() OVER (ORDER BY v) AS n FROM v)
SELECT round((SELECT sum(a) / sum(b) FROM g), 4) AS point, round(max(v) FILTER (n = 6), 4) AS low, round(max(v) FILTER (n = 196), 4) AS high, count(*) AS draws FROM r""")
def group_bootstrap_ci(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rounded(resample.group_bootstrap(rows, "o_custkey", F.col("o_totalprice"), F.lit(1.0)), 4)


@query(LABELED + """, r AS (SELECT doc_id, label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM l), s AS (SELECT sum(label) AS p, count(*) AS n, sum(label * r) AS s FROM r),
d AS (SELECT d, r, row_number() OVER (PARTITION BY d ORDER BY md5('0|' || d || '|' || doc_id), doc_id) AS k FROM r, (SELECT unnest(range(1, 101)) AS d)), z AS (SELECT d, sum(r) AS v FROM d, s WHERE k <= s.p GROUP BY d)
SELECT round(any_value((s.s - s.p * (s.p + 1) / 2) / (s.p * (s.n - s.p))), 6) AS auc, round(avg((v - s.p * (s.p + 1) / 2) / (s.p * (s.n - s.p))), 6) AS null_mean, round((count(*) FILTER (v >= s.s) + 1) / 101.0::DOUBLE, 6) AS p FROM z, s""")
def permutation_test(spark, sf_dir):
    return rounded(resample.permutation_p(labeled(spark, sf_dir), "label", "score", "doc_id"))


@query("SELECT count(*) FILTER (l_linenumber <= 2) AS near, count(*) FILTER (NOT l_linenumber <= 2) AS far, round(0.25::DOUBLE * (avg(CASE WHEN l_linenumber <= 2 THEN l_tax - l_discount END) - avg(CASE WHEN NOT l_linenumber <= 2 THEN l_tax - l_discount END)), 6) AS effect FROM lineitem")
def did_effect(spark, sf_dir):
    return rounded(resample.difference_in_differences(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax", F.col("l_linenumber") <= 2, F.lit(0.25)))


@query("SELECT l_returnflag, count(*) AS n, round((count(*) * sum(l_quantity * l_extendedprice) - sum(l_quantity) * sum(l_extendedprice)) / (count(*) * sum(l_quantity * l_quantity) - sum(l_quantity) * sum(l_quantity)), 4) AS slope FROM lineitem GROUP BY ALL")
def leak_slope(spark, sf_dir):
    out = resample.slope(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return out.select("l_returnflag", "n", F.round("slope", 4).alias("slope"))


@query(spearman_sql("SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y FROM lineitem", "l_returnflag"))
def cross_measure_spearman(spark, sf_dir):
    from siltstone.operators import metrics

    return rounded(metrics.spearman(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


@query(LABELED + ", b AS (SELECT ntile(10) OVER (ORDER BY score, label) AS bin, score, label::DOUBLE AS y FROM l), p AS (SELECT CAST(bin AS INT) AS bin, count(*) AS n, avg(score) AS x, avg(y) AS y FROM b GROUP BY 1) SELECT bin, n, round(x, 6) AS x, round(y, 6) AS y, round(max(y) OVER (ORDER BY bin), 6) AS monotone_y FROM p")
def monotone_calibration(spark, sf_dir):
    return rounded(resample.monotone_curve(labeled(spark, sf_dir).withColumn("y", F.col("label").cast("double")), "score", "y"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def windowed_event_counts(spark, sf_dir):
    return rounded(windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "value"))


@query(None)
def out_of_fold_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).alias("y"), (F.col("vec_id") % 17).alias("g"))
    return rounded(learners.out_of_fold(rows, "embedding", "y", "g").select("vec_id", "fold", "score"), 4)
