"""The query that shows most operators at work: contract, conflicts, overlap, exact labels and screening metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import dedupe, metrics, overlap, ranks
from siltstone.plans.core import query, rounded, table

FLAGSHIP = "screened_sources"


@query("""
WITH r AS (SELECT d.doc_id, d.source, d.n_chars, sha256(d.text) AS k, b.quality FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id),
f AS (SELECT *, coalesce(min(quality) OVER w <> max(quality) OVER w, false) AS bad FROM r WINDOW w AS (PARTITION BY k)),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bad, k ORDER BY doc_id) AS n FROM f) WHERE NOT bad AND n = 1 AND k NOT IN (SELECT sha256(text) FROM benchmark)),
l AS (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) <= greatest(ceil(count(*) OVER (PARTITION BY source) * 0.15::DOUBLE), 1) AS INT) AS target, (doc_id * 37 % 1009) / 1009.0::DOUBLE AS score FROM s),
i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS n, greatest(ceil(count(*) OVER (PARTITION BY source) * 0.15::DOUBLE), 1) AS k, rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1) / 2.0::DOUBLE AS r FROM l)
SELECT source, count(*) AS n, sum(target)::BIGINT AS positives, round((sum(r) FILTER (target = 1) - sum(target) * (sum(target) + 1) / 2) / nullif(sum(target) * (count(*) - sum(target)), 0), 6) AS auc, round(coalesce(sum(CASE WHEN n <= k THEN target ELSE 0 END) / nullif(sum(target), 0)::DOUBLE, 0), 6) AS "catch" FROM i GROUP BY source
""")
def screened_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("k"))
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = dedupe.status(rows, ["k"], "quality", ["k"], ["doc_id"]).where("status = 'accepted'")
    held = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("k"))
    rows = overlap.without_keys(rows, held, ["k"])
    rows = ranks.exact_tail(rows, ["source"], "n_chars", "doc_id").withColumn("score", F.col("doc_id") * 37 % 1009 / 1009.0)
    auc = metrics.rank_auc(rows, ["source"], "target", "score").select("source", "auc")
    found = metrics.screening(rows, ["source"], "target", "score", "doc_id").select("source", "n", "positives", "catch")
    return rounded(found.join(auc, "source").select("source", "n", "positives", "auc", "catch"))
