"""Consolidating repeated predictions, macro summaries, serving policy, blends and gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.metrics import rank_auc
from siltstone.operators.prefix import numbered

#: Domains from best to worst.
DOMAINS = ("in_domain", "borderline", "out_of_domain")


def consolidated(df: DataFrame, keys: Sequence[str], score: str, distance: str, domain: str, source: str) -> DataFrame:
    """One row a key over its seeds: means, disagreement (population deviation), worst domain, sources, and whether to abstain."""
    level = F.array_position(F.array(*[F.lit(d) for d in DOMAINS]), F.col(domain))
    out = df.groupBy(*keys).agg(F.count("*").alias("seeds"), F.avg(score).alias("score"), F.stddev_pop(score).alias("disagreement"), F.avg(distance).alias("distance"), F.max(level).alias("_level"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"))
    out = out.withColumn("domain", F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), F.col("_level").cast("int")))
    return out.withColumn("abstain", F.col("domain") == DOMAINS[-1]).drop("_level")


def uncertainty_summary(rows: DataFrame, share: float = 0.95) -> DataFrame:
    """Records by domain, mean disagreement and its value at place ``floor(share * n)`` of the sorted ones."""
    ranked = numbered(rows, ["disagreement"], "_r")
    n = rows.agg(F.count("*").alias("_n"))
    ranked = ranked.crossJoin(F.broadcast(n))  # one row
    at = F.least(F.floor(F.col("_n") * share), F.col("_n") - 1)
    counts = [F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS]
    return ranked.agg(F.count("*").alias("records"), *counts, F.avg("disagreement").alias("mean_disagreement"), F.max(F.when(F.col("_r") == at, F.col("disagreement"))).alias("high_disagreement"))


def macro_summary(df: DataFrame, experiment: Sequence[str], seed: str, source: str, value: str) -> DataFrame:
    """Mean over a seed's sources, then mean and population deviation over seeds."""
    per = df.groupBy(*experiment, seed, source).agg(F.avg(value).alias("_v")).groupBy(*experiment, seed).agg(F.avg("_v").alias("_m"), F.count("*").alias("_s"))
    return per.groupBy(*experiment).agg(F.count("*").alias("seeds"), F.max("_s").alias("sources"), F.avg("_m").alias("macro_mean"), F.stddev_pop("_m").alias("macro_deviation"))


def serving_decision(family: Column, metric: Column, n: Column, rho: Column, abstained: Column, excluded: Sequence[str] = (), least: int = 30) -> Column:
    """The first rule that fits an assay, from a fixed list."""
    scatter = metric.rlike(r"(?i)(^|[^a-z])(std|stddev|sd|cv|var|variance|sem)([^a-z]|$)")
    return (
        F.when(F.coalesce(abstained, F.lit(False)), "abstain_too_few_samples").when(F.lower(family).isin(*excluded) if excluded else F.lit(False), "exclude_family").when(F.coalesce(scatter, F.lit(False)), "exclude_scatter")
        .when(n < least, "abstain_too_few_samples").when(rho.isNull(), "abstain_too_few_samples").when(rho < 0, "quarantine_negative").otherwise("serve")
    )


def largest_report(df: DataFrame, keys: Sequence[str], n: str, tie: str) -> DataFrame:
    """Of several reports of one assay the one with most rows (the first of equals)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(n).desc_nulls_last(), tie))).where("_r = 1").drop("_r")


def gate(summary: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """A boolean for each check, and ``promoted`` if all hold (a null check fails)."""
    held = [F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()]
    out = summary.select("*", *held)
    both = F.lit(True)
    for n in checks:
        both = both & F.col(n)
    return out.withColumn("promoted", both)


def relative_gate(baseline: DataFrame, trial: DataFrame, keys: Sequence[str], value: str, least_gain: float) -> DataFrame:
    """Baseline, trial, gain, and whether the gain reaches the least one."""
    b = baseline.select(*keys, F.col(value).alias("baseline"))
    t = trial.select(*keys, F.col(value).alias("trial"))
    return b.join(t, list(keys), "full").withColumn("gain", F.col("trial") - F.col("baseline")).withColumn("admitted", F.coalesce(F.col("gain") >= least_gain, F.lit(False)))


def common_records(df: DataFrame, model: str, record: str, score: str, models: Sequence[str]) -> DataFrame:
    """Records that every named model predicts, with the mean of the scores."""
    rows = df.where(F.col(model).isin(*models)).groupBy(record).agg(F.count_distinct(model).alias("_k"), F.avg(score).alias("score"))
    return rows.where(F.col("_k") == len(set(models))).drop("_k")


def blends(df: DataFrame, source: str, model: str, record: str, label: str, score: str, models: Sequence[str], least_coverage: float = 0.8) -> DataFrame:
    """For each set of models with enough coverage: mean AUC over sources of the mean score, best first.

    A model whose share of all records is below ``least_coverage`` takes no part.  Ties go to fewer models, then by name.
    """
    total = df.agg(F.count_distinct(record).alias("_all"))
    cover = df.groupBy(F.col(model).alias("_m")).agg(F.count_distinct(record).alias("_c")).crossJoin(F.broadcast(total)).where(F.col("_c") >= F.col("_all") * least_coverage).select("_m")
    rows = df.join(cover, F.col(model) == F.col("_m"), "left_semi")
    names = sorted(set(models))
    sets = [list(c) for k in range(1, len(names) + 1) for c in combinations(names, k)]
    member = F.explode(F.filter(F.array(*[F.array(*[F.lit(x) for x in s]) for s in sets]), lambda s: F.array_contains(s, F.col(model))))
    mixed = rows.withColumn("_set", member).groupBy("_set", source, record).agg(F.first(label).alias("_label"), F.avg(score).alias("_score"), F.count("*").alias("_k")).where(F.col("_k") == F.size("_set"))
    auc = rank_auc(mixed.withColumn("members", F.array_join("_set", "+")).withColumn("size", F.size("_set")), ["members", "size", source], "_label", "_score")
    return auc.groupBy("members", "size").agg(F.count("auc").alias("sources"), F.avg("auc").alias("macro_auc"))


def best_blend(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(F.desc_nulls_last("macro_auc"), "size", "members").limit(1)


def applicability(df: DataFrame, record: str, vec: str, source: str) -> DataFrame:
    """One row a source: centroid of standardized vectors, and the 95th and 99th percentile of its rows' distance to it.

    The deviation of a component is floored to 1 where it is below 1e-8.
    """
    long = df.select(F.col(record).alias("_row"), F.col(source).alias("source"), F.posexplode(vec).alias("_i", "_x")).withColumn("_x", F.col("_x").cast("double"))
    scale = long.groupBy("_i").agg(F.avg("_x").alias("_mean"), F.stddev_pop("_x").alias("_sd")).withColumn("_sd", F.when(F.col("_sd") < 1e-8, 1.0).otherwise(F.col("_sd")))
    long = long.join(F.broadcast(scale), "_i").withColumn("_z", (F.col("_x") - F.col("_mean")) / F.col("_sd"))  # a row a component
    centre = long.groupBy("source", "_i").agg(F.avg("_z").alias("_c"))
    far = long.join(centre, ["source", "_i"]).groupBy("source", "_row").agg(F.sqrt(F.avg(F.pow(F.col("_z") - F.col("_c"), 2))).alias("_d"))
    return far.groupBy("source").agg(F.count("*").alias("rows"), F.avg("_d").alias("mean_distance"), F.percentile("_d", F.lit(0.95)).alias("p95"), F.percentile("_d", F.lit(0.99)).alias("p99"))


def subgroup_bands(df: DataFrame, value: str, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``band`` of each row, by linear quantiles of the whole table (one row, broadcast)."""
    marks = df.agg(F.percentile(value, F.array(*[F.lit(q) for q in quantiles])).alias("_q"))
    return df.crossJoin(F.broadcast(marks)).withColumn("band", F.size(F.filter("_q", lambda q: q < F.col(value)))).drop("_q")
