"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame expressions only.

Every document gets the exponential key ``-ln(u) / weight`` (u from a digest of its id, so that reruns agree; the weight is
that of the document's quality, from a table of weights by id, and 1 where that has none).  Within a source, documents sorted by their keys are a weighted sample without
replacement of any length.  A source's target is first met by complete epochs; what remains is taken from the front of the
sorted documents until the prefix sum of sizes reaches it, cutting the last document.

No source is ever sorted in one task: keys fall into ranges, at least ``BUCKETS`` and one for each ``BUCKET_ROWS`` rows, the
sizes of (source, range) are pre-aggregated and written, and only the range that holds a source's cut is sorted.  What all rows are joined with is one row a source.

Defined results: a null text has size 0 and no words are taken from a document of size 0; a null source is a source of its
own, last in the order; repeated rows of one id share one key and, at the cut, share what is taken; an empty table gives
an empty result; other columns are ignored, whatever their names; a weight that is null, not finite or not positive counts as
1, and of several weights of one id the largest counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import written

BUCKETS, MAX_BUCKETS, BUCKET_ROWS = 1024, 1 << 20, 50_000
#: One row a source is broadcast up to so many sources; beyond it the join is an ordinary one.
MAX_BROADCAST = 100_000
#: The same for the weights by id, of some 16 bytes each.
MAX_WEIGHTS = 200_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")), F.lit(0)).cast("long")


def uniform(id_: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from the md5 of ``id:seed``."""
    digest = F.substring(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digest, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sums: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Add ``target`` to one row a source (source, source_size).

    Sources take the weights in turn, by code point, null last.  The level L of ``target = min(cap * size, weight * L)``
    that spends ``share`` of all words is the largest of the levels met when sources fill up in the order of cap * size / weight.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sums.withColumn("_w", F.element_at(cycle, F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1))
    full = F.col("source_size").cast("double") * F.lit(float(cap))
    order = Window.orderBy(full / F.col("_w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    left = F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = Window.partitionBy()
    level = ranked.withColumn("_level", (F.sum("source_size").over(whole).cast("double") * F.lit(float(share)) - before * F.lit(float(cap))) / left)
    return level.withColumn("_level", F.max("_level").over(whole)).withColumn("target", F.least(full, F.col("_w") * F.col("_level"))).drop("_w", "_level")


def weighed(rows: DataFrame, quality: DataFrame | None, id_col: str) -> DataFrame:
    """Add ``_q``, the weight of each row's id in the table ``quality`` (id, weight), else 1."""
    if quality is None:
        return rows.withColumn("_q", F.lit(1.0))
    id_, weight = (F.col(f"`{c}`") for c in quality.columns)
    weight = weight.cast("double")
    fine = quality.select(id_.alias("_qi"), weight.alias("_q")).where(id_.isNotNull() & (weight > 0) & (weight < float("inf")))
    fine = written(fine.groupBy("_qi").agg(F.max("_q").alias("_q")), "mixing-weights")
    fine = F.broadcast(fine) if fine.count() <= MAX_WEIGHTS else fine
    return rows.join(fine, F.col(id_col) == F.col("_qi"), "left").withColumn("_q", F.coalesce("_q", F.lit(1.0))).drop("_qi")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, quality: DataFrame | None) -> DataFrame:
    """doc_id, source, size and key of every row."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    return weighed(base, quality, "doc_id").select("doc_id", "source", "size", (-F.log(uniform(F.col("doc_id"), seed)) / F.col("_q")).alias("key"))


def mixing_plan(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row a source: its size, target, complete epochs, and where its sorted documents are cut (key, id, words, size there)."""
    scale, n = rows.agg(F.avg("key"), F.count("*")).first()
    scale, buckets = scale or 1.0, min(MAX_BUCKETS, max(BUCKETS, n // BUCKET_ROWS))  # the scale only spreads the keys over the ranges
    bucket = F.least(F.floor((1 - F.exp(-F.col("key") / F.lit(float(scale)))) * buckets), F.lit(buckets - 1)).cast("int")
    rows = rows.withColumn("_b", bucket)
    hist = written(rows.groupBy("source", "_b").agg(F.sum("size").alias("_n")), "mixing-sizes")
    sums = hist.groupBy("source").agg(F.sum("_n").alias("source_size"))
    budget = F.floor(F.col("target")).cast("long")
    plan = source_targets(sums, weights, share, cap).withColumn("_epochs", F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("_rest", budget - F.col("_epochs") * F.col("source_size")).withColumnRenamed("source", "_s")
    upto = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = hist.withColumn("_upto", F.sum("_n").over(upto)).join(plan, F.col("source").eqNullSafe(F.col("_s"))).where((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_n") < F.col("_rest")))
    cut = cut.select(F.col("source").alias("_cs"), F.col("_b").alias("_cb"), (F.col("_rest") - F.col("_upto") + F.col("_n")).alias("_want"))
    near = rows.join(F.broadcast(cut) if _few(sums) else cut, F.col("source").eqNullSafe(F.col("_cs")) & (F.col("_b") == F.col("_cb")))
    same = near.groupBy("_cs", "key", "doc_id").agg(F.sum("size").alias("_n"), F.first("_want").alias("_want"))
    run = F.sum("_n").over(Window.partitionBy("_cs").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = same.withColumn("_run", run).where((F.col("_run") >= F.col("_want")) & (F.col("_run") - F.col("_n") < F.col("_want")))
    at = at.select("_cs", F.col("key").alias("_key"), F.col("doc_id").alias("_id"), (F.col("_want") - F.col("_run") + F.col("_n")).alias("_part"), F.col("_n").alias("_all"))
    return plan.drop("_rest").join(at, F.col("_s").eqNullSafe(F.col("_cs")), "left").drop("_cs")


def _few(sums: DataFrame) -> bool:
    return sums.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST


def with_taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target and taken to rows of (source, doc_id, size, key, ...)."""
    plan = F.broadcast(plan) if _few(plan) else plan
    both = rows.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    first = F.struct(F.col("key"), F.col("doc_id"))
    cut = F.struct(F.col("_key").alias("key"), F.col("_id").alias("doc_id"))
    part = F.when(F.col("_key").isNull(), F.lit(0)).when(first < cut, F.col("size")).when(first == cut, F.expr("(_part * size) div _all")).otherwise(F.lit(0))
    taken = F.when(F.col("size") > 0, F.col("_epochs") * F.col("size") + part).otherwise(F.lit(0)).cast("long")
    return both.withColumn("taken", taken).drop("_s", "_epochs", "_key", "_id", "_part", "_all")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, quality: DataFrame | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken (words of the document in the mix, repeats counted) of every row."""
    rows = written(sized(docs, id_col, text_col, source_col, seed, quality), "mixing")
    return with_taken(rows, mixing_plan(rows, weights, share, cap)).select(F.col("doc_id").alias(id_col), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, quality: DataFrame | None = None) -> DataFrame:
    """The mix itself: a row for each complete copy, and one cut after its last word taken where a source's target ends."""
    rows = written(sized(docs, id_col, text_col, source_col, seed, quality), "mixing")
    plan = mixing_plan(rows, weights, share, cap)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"))
    keyed = weighed(keyed, quality, "doc_id").withColumn("_text", F.col("_row").getField(text_col)).withColumn("size", word_count(F.col("_text"))).withColumn("key", -F.log(uniform(F.col("doc_id"), seed)) / F.col("_q"))
    copies = F.expr("transform(sequence(1L, (taken + size - 1) div size), i -> least(size, taken - (i - 1) * size))")
    out = with_taken(keyed, plan).where("taken > 0").withColumn("_words", F.explode(copies))
    words = F.expr("array_join(slice(array_remove(split(_text, '[\\\\x20\\\\x09-\\\\x0D]+'), ''), 1, cast(_words as int)), ' ')")
    text = F.when(F.col("_words") == F.col("size"), F.col("_text")).otherwise(words)
    return out.select(*[text.alias(c) if c == text_col else (F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("_row").getField(c).alias(c)) for c in docs.columns])


#: DuckDB SQL for the rows of :func:`mix_sources` with its defaults, and the weights 2 and 0.5 of labelled documents of quality 1 and 0.
SQL = """
WITH q AS (SELECT doc_id, max(CASE WHEN quality > 0 THEN 2.0 ELSE 0.5 END :: DOUBLE) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
k AS (
  SELECT *, -ln((CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':17'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / coalesce(q.q, 1.0::DOUBLE) AS key FROM d LEFT JOIN q USING (doc_id)),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END :: DOUBLE AS w FROM d GROUP BY source),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
             - CAST(coalesce(sum(source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) * 2.0::DOUBLE)
            / sum(w) OVER (ORDER BY CAST(source_size AS DOUBLE) * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (
  SELECT source, source_size, least(CAST(source_size AS DOUBLE) * 2.0::DOUBLE, w * max(level) OVER ()) AS target FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, CAST(floor(e.target) AS BIGINT) - e.epochs * e.source_size AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM r
"""
