"""Ranking, screening and calibration metrics, by group.

All metrics aggregate once over (group, score) or ranked rows; none collects a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.prefix import running_sum
from siltstone.operators.ranks import average_rank, top_count

Groups = Sequence[str]


def pearson(x: str, y: str) -> Column:
    """From sums; 0 for fewer than two rows or without variance (the built-in fails there)."""
    n, sx, sy = F.count(F.lit(1)), F.sum(x), F.sum(y)
    sxy, sxx, syy = F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x)), F.sum(F.col(y) * F.col(y))
    var = (n * sxx - sx * sx) * (n * syy - sy * sy)
    return F.coalesce(F.when((n > 1) & (var > 0), (n * sxy - sx * sy) / F.sqrt(F.when(var > 0, var))), F.lit(0.0))


def spearman(df: DataFrame, groups: Groups, truth: str, pred: str) -> DataFrame:
    rows = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    rows = rows.select(*groups, average_rank(truth, groups).alias("_x"), average_rank(pred, groups).alias("_y"))
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), pearson("_x", "_y").alias("spearman"))


def error_summary(df: DataFrame, groups: Groups, truth: str, pred: str) -> DataFrame:
    """Mean absolute error, that of predicting 0, and the skill 1 - MAE / MAE0."""
    err, own = F.sum(F.abs(F.col(truth) - F.col(pred))), F.sum(F.abs(F.col(truth)))
    return df.groupBy(*groups).agg(F.count("*").alias("n"), (err / F.count("*")).alias("mae"), (own / F.count("*")).alias("mae0"), (1 - F.try_divide(err, own)).alias("skill"))


def rank_auc(df: DataFrame, groups: Groups, label: str, score: str) -> DataFrame:
    """Mann-Whitney AUC, ties counted half; null for one class only."""
    rows = df.withColumn("_r", average_rank(score, groups))
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    total = F.sum(F.when(F.col(label) == 1, F.col("_r")))
    return rows.groupBy(*groups).agg(pos.alias("positives"), neg.alias("negatives"), F.try_divide(total - pos * (pos + 1) / 2, pos * neg).alias("auc"))


def average_precision(df: DataFrame, groups: Groups, label: str, score: str) -> DataFrame:
    """Sum of precision over the steps of recall at distinct scores."""
    steps = df.groupBy(*groups, score).agg(F.count("*").alias("_n"), F.sum(label).alias("_p"))
    w = Window.partitionBy(*groups).orderBy(F.col(score).desc())
    steps = steps.withColumn("_cn", F.sum("_n").over(w)).withColumn("_cp", F.sum("_p").over(w))
    return steps.groupBy(*groups).agg(F.try_divide(F.sum(F.col("_p") * F.col("_cp") / F.col("_cn")), F.sum("_p")).alias("average_precision"))


def screening(df: DataFrame, groups: Groups, label: str, score: str, tie: str, share: float = 0.15, rule: str = "ceil") -> DataFrame:
    """Among the top share: catch (recall), precision, and enrichment by precision and by recall over the base rate."""
    w = Window.partitionBy(*groups)
    rows = df.withColumn("_k", top_count(F.count("*").over(w), share, rule)).withColumn("_n", F.row_number().over(w.orderBy(F.col(score).desc(), F.col(tie))))
    n, pos = F.count("*"), F.sum(label)
    hit, k = F.sum(F.when(F.col("_n") <= F.col("_k"), F.col(label)).otherwise(0)), F.first("_k")
    base = pos / n
    return rows.groupBy(*groups).agg(n.alias("n"), pos.alias("positives"), k.alias("k"), F.coalesce(F.try_divide(hit, pos), F.lit(0.0)).alias("catch"), (hit / k).alias("precision"), F.coalesce(F.try_divide(hit / k, base), F.lit(0.0)).alias("enrichment"), F.coalesce(F.try_divide(F.try_divide(hit, pos), base), F.lit(0.0)).alias("recall_enrichment"))


def bin_of(score: Column, bins: int = 10, last_closed: bool = True) -> Column:
    """The equal-width bin of a score from 0 to 1; without a closed last bin a score of 1 has none."""
    edges = F.array(*[F.lit(i / bins) for i in range(bins)])
    place = F.size(F.filter(edges, lambda e: e <= score)) - 1
    return F.when((score >= 0) & (score < 1), place).when((score == 1) & F.lit(last_closed), F.lit(bins - 1))


def reliability(df: DataFrame, groups: Groups, label: str, score: str, bins: int = 10, last_closed: bool = True) -> DataFrame:
    rows = df.withColumn("bin", bin_of(F.col(score), bins, last_closed)).where("bin is not null")
    return rows.groupBy(*groups, "bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("observed"))


def calibration_error(df: DataFrame, groups: Groups, label: str, score: str, bins: int = 10, last_closed: bool = True) -> DataFrame:
    """Brier score and expected calibration error.  Sums are decimal, so that they don't depend on the order of the rows."""
    exact = lambda c: F.sum(c.cast("decimal(38,18)")).cast("double")
    parts = df.withColumn("_b", bin_of(F.col(score), bins, last_closed)).groupBy(*groups, "_b").agg(F.count("*").alias("_n"), exact(F.col(score)).alias("_s"), F.sum(label).alias("_l"), F.sum(F.pow(F.col(score) - F.col(label), 2).cast("decimal(38,18)")).alias("_q"))
    gap = F.when(F.col("_b").isNotNull(), F.abs(F.col("_s") - F.col("_l"))).otherwise(0.0)
    return parts.groupBy(*groups).agg(F.sum("_n").alias("n"), (F.sum("_q").cast("double") / F.sum("_n")).alias("brier"), (F.sum(gap) / F.sum("_n")).alias("ece"))


def calibration_at(df: DataFrame, groups: Groups, label: str, score: str, threshold: float, least: int = 20) -> DataFrame:
    """Share predicted positive, and what is observed among those; abstains below so many rows."""
    n, above = F.count("*"), F.col(score) >= threshold
    return df.groupBy(*groups).agg(n.alias("n"), (n < least).alias("abstain"), F.when(n >= least, F.avg(above.cast("int"))).alias("predicted_positive"), F.when(n >= least, F.avg(F.when(above, F.col(label)))).alias("observed_positive"))


def ecdf(df: DataFrame, baseline: DataFrame, value: str, base: str) -> DataFrame:
    """``percentile``: share of the baseline at or below the value (0.5 for an empty baseline).

    Both sides are merged into one row a value, whose running counts need no task that holds them all.
    """
    both = df.select(F.col(value).alias("_v"), F.lit(1).alias("_row"), F.lit(0).alias("_base")).unionByName(baseline.select(F.col(base).alias("_v"), F.lit(0).alias("_row"), F.lit(1).alias("_base")))
    per = both.groupBy("_v").agg(F.sum("_row").alias("_rows"), F.sum("_base").alias("_n"))
    per = running_sum(per, "_v", "_n", "_upto").withColumn("_all", F.lit(baseline.count()))
    return per.where("_rows > 0").select(F.col("_v").alias(value), F.col("_rows").alias("rows"), F.coalesce(F.try_divide("_upto", "_all"), F.lit(0.5)).alias("percentile"))
