"""Bootstrap, permutation and difference-in-differences estimates.

Replicates weigh groups, not rows: a group's statistics are summed once, and a replicate draws groups by a digest, so that the
cost is replicates x groups and results rerun to the same digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.prefix import numbered, with_average_rank


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a digest of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def times(u: Column) -> Column:
    """A Poisson number of mean 1 from a uniform one."""
    cuts, total, term = [], 0.0, math.exp(-1)
    for k in range(12):
        total += term
        cuts.append(total)
        term /= k + 1
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= u))


def drawn(df: DataFrame, record: str, draws: int, seed: int, out: str = "_k") -> DataFrame:
    """Each row once for each draw ``_d`` that takes it, and how often it does."""
    return df.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn(out, times(uniform(F.lit(seed), F.col("_d"), F.col(record)))).where(f"{out} > 0")


def interval(values: DataFrame, value: str, draws: int, alpha: float = 0.05) -> DataFrame:
    """``low`` and ``high``: the values at the index percentiles of one row a draw, and the number of draws with a value."""
    ranked = values.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(Window.orderBy(value)))  # a row a draw
    low, high = int(alpha / 2 * draws) + 1, min(draws, int((1 - alpha / 2) * draws) + 1)
    return ranked.agg(F.max(F.when(F.col("_r") == low, F.col(value))).alias("low"), F.max(F.when(F.col("_r") == high, F.col(value))).alias("high"), F.count("*").alias("draws"))


def bootstrap_metric(df: DataFrame, group: str, sums: dict[str, Column], metric: Callable[[dict[str, Column]], Column], draws: int = 200, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """A metric of sums, with the interval between index percentiles over draws of groups with replacement.

    How often a draw takes a group is Poisson with mean 1, the limit of sampling with replacement, so that groups need no numbers.
    """
    per = df.groupBy(group).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    point = per.agg(metric({n: F.sum(f"_{n}") for n in sums}).alias("point"))
    values = drawn(per, group, draws, seed).groupBy("_d").agg(metric({n: F.sum(F.col(f"_{n}") * F.col("_k")) for n in sums}).alias("_v"))
    return point.crossJoin(F.broadcast(interval(values, "_v", draws, alpha)))  # one row each


def group_bootstrap(df: DataFrame, group: str, numerator: Column, denominator: Column, draws: int = 200, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """:func:`bootstrap_metric` of the ratio of two sums."""
    return bootstrap_metric(df, group, {"a": numerator, "b": denominator}, lambda s: s["a"] / s["b"], draws, seed, alpha)


def source_bootstrap(df: DataFrame, source: str, value: str, draws: int = 2000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """The mean of sources' means, with the interval over draws of sources."""
    means = df.groupBy(source).agg(F.avg(value).alias("_m"))
    return group_bootstrap(means, source, F.col("_m"), F.lit(1.0), draws, seed, alpha)


def weighted_spearman(rows: DataFrame, groups: list[str], x: str, y: str, times_: str = "_k") -> DataFrame:
    """``rho`` by group of rows that count several times each; null without variance.

    Ranks are worked out on one row for each distinct value of a group.
    """
    for value, rank in ((x, "_rx"), (y, "_ry")):
        counts = rows.groupBy(*groups, F.col(value).alias("_v")).agg(F.sum(times_).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_v"))
        counts = counts.select(*groups, F.col("_v"), (upto - (F.col("_n") - 1) / F.lit(2.0)).alias(rank)).withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(groups)})
        rows = rows.join(counts, [F.col(g) == F.col(f"_g{i}") for i, g in enumerate(groups)] + [F.col(value) == F.col("_v")]).drop("_v", *[f"_g{i}" for i in range(len(groups))])
    w = F.col(times_)
    n, sx, sy = F.sum(w), F.sum(w * F.col("_rx")), F.sum(w * F.col("_ry"))
    sxy, sxx, syy = F.sum(w * F.col("_rx") * F.col("_ry")), F.sum(w * F.col("_rx") * F.col("_rx")), F.sum(w * F.col("_ry") * F.col("_ry"))
    var = (n * sxx - sx * sx) * (n * syy - sy * sy)
    return rows.groupBy(*groups).agg(F.when(var > 0, (n * sxy - sx * sy) / F.sqrt(F.when(var > 0, var))).alias("rho"))


def spearman_bootstrap(df: DataFrame, record: str, x: str, y: str, draws: int = 50, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Spearman's correlation, with the interval over draws of rows."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(record, x, y)
    point = weighted_spearman(rows.withColumns({"_d": F.lit(-1), "_k": F.lit(1)}), ["_d"], x, y).select(F.col("rho").alias("point"))
    return point.crossJoin(F.broadcast(interval(weighted_spearman(drawn(rows, record, draws, seed), ["_d"], x, y), "rho", draws, alpha)))


def paired_spearman_bootstrap(df: DataFrame, record: str, truth: str, a: str, b: str, draws: int = 50, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """The difference of two predictions' correlations with the truth, each where it is there, over the same draws; and P(difference <= 0)."""

    def differences(rows: DataFrame) -> DataFrame:
        one, two = (weighted_spearman(rows.where(F.col(c).isNotNull()).select("_d", "_k", truth, c), ["_d"], truth, c).select("_d", F.col("rho").alias(n)) for c, n in ((a, "_a"), (b, "_b")))
        return one.join(two, "_d").select("_d", (F.col("_a") - F.col("_b")).alias("_diff"))

    rows = df.where(F.col(truth).isNotNull()).select(record, truth, a, b)
    point = differences(rows.withColumns({"_d": F.lit(-1), "_k": F.lit(1)})).select(F.col("_diff").alias("point"))
    values = differences(drawn(rows, record, draws, seed))
    share = values.agg(F.avg((F.col("_diff") <= 0).cast("int")).alias("p_not_better"))
    return point.crossJoin(F.broadcast(interval(values, "_diff", draws, alpha))).crossJoin(F.broadcast(share))  # one row each


def permutation_p(df: DataFrame, label: str, score: str, record: str, draws: int = 100, seed: int = 0, buckets: int = 4096) -> DataFrame:
    """AUC, and the share of label permutations that reach it, ``(b + 1) / (draws + 1)``.

    A draw gives the positive labels to the rows of least digest.  Digests fall into buckets, whose sums are pre-aggregated; rows are
    sorted only in the bucket that holds a draw's cut.
    """
    rows = with_average_rank(df.select(F.col(record).alias("_id"), F.col(label).alias("_y"), F.col(score).alias("_s0")), "_s0", "_r").drop("_s0")
    pos = rows.agg(F.sum("_y").alias("_p"), F.count("*").alias("_n"), F.sum(F.col("_y") * F.col("_r")).alias("_s"))
    spread = rows.withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_u", F.md5(F.concat_ws("|", F.lit(str(seed)), "_d", "_id")))
    spread = spread.withColumn("_b", F.pmod(F.conv(F.substring("_u", 1, 3), 16, 10).cast("int"), F.lit(4096)) * buckets / 4096).withColumn("_b", F.floor("_b").cast("int"))
    sums = spread.groupBy("_d", "_b").agg(F.count("*").alias("_c"), F.sum("_r").alias("_v"))
    upto = Window.partitionBy("_d").orderBy("_b")
    sums = sums.withColumn("_upto", F.sum("_c").over(upto)).crossJoin(F.broadcast(pos))
    whole = sums.where("_upto <= _p").select("_d", F.col("_v").alias("_null"))
    cut = sums.where("_upto > _p and _upto - _c < _p").select(F.col("_d").alias("_cd"), F.col("_b").alias("_cb"), (F.col("_p") - F.col("_upto") + F.col("_c")).alias("_want"))
    near = spread.join(F.broadcast(cut), (F.col("_d") == F.col("_cd")) & (F.col("_b") == F.col("_cb")))  # at most a row a draw
    near = near.withColumn("_k", F.row_number().over(Window.partitionBy("_d").orderBy("_u", "_id"))).where("_k <= _want").select("_d", F.col("_r").alias("_null"))
    null = whole.unionByName(near).groupBy("_d").agg(F.sum("_null").alias("_null")).crossJoin(F.broadcast(pos))
    auc = lambda s: (s - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * (F.col("_n") - F.col("_p")))
    return null.agg(F.first(auc(F.col("_s"))).alias("auc"), F.avg(auc(F.col("_null"))).alias("null_mean"), ((F.count_if(F.col("_null") >= F.col("_s")) + 1) / F.lit(draws + 1)).alias("p"))


def difference_in_differences(df: DataFrame, loss_a: str, loss_b: str, near: Column, share: Column) -> DataFrame:
    """``share * (mean change of near rows - mean change of far rows)`` of the loss from a to b."""
    change = F.col(loss_b) - F.col(loss_a)
    return df.agg(F.count_if(near).alias("near"), F.count_if(~near).alias("far"), (share * (F.avg(F.when(near, change)) - F.avg(F.when(~near, change)))).alias("effect"))


def slope(df: DataFrame, groups: list[str], y: str, x: str) -> DataFrame:
    """Least-squares slope by group (null without variance of x)."""
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    sxy, sxx = F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))
    return df.groupBy(*groups).agg(n.alias("n"), F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx).alias("slope"))


def monotone_curve(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Mean x and y in bins of equally many rows, y made monotone by its running maximum."""
    rows = numbered(df.select(x, y), [x, y], "_at").crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))  # one row
    small, more = F.floor(F.col("_n") / bins), F.col("_n") % bins  # the first bins have one row more
    place = F.when(F.col("_at") < more * (small + 1), F.floor(F.col("_at") / (small + 1))).otherwise(more + F.floor(F.try_divide(F.col("_at") - more * (small + 1), small)))
    rows = rows.withColumn("bin", (place + 1).cast("int"))
    per = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"))
    return per.withColumn("monotone_y", F.max("y").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def planted_leak(train: DataFrame, test: DataFrame, record: str, share: float, seed: int = 0) -> DataFrame:
    """The training rows, and a share of the test rows (by a digest) put among them, marked ``leaked``."""
    some = test.where(uniform(F.lit(seed), F.col(record)) < share)
    return train.withColumn("leaked", F.lit(False)).unionByName(some.withColumn("leaked", F.lit(True)), allowMissingColumns=True)
