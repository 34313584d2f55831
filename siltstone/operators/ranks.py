"""Ranks, and labels from ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, groups: Sequence[str] = ()) -> Column:
    """1-based rank in the group; ties get their mean."""
    by = Window.partitionBy(*groups)
    return F.rank().over(by.orderBy(value)) + (F.count("*").over(Window.partitionBy(*groups, value)) - 1) / F.lit(2.0)


def percentile(value: str, groups: Sequence[str] = ()) -> Column:
    """Average rank from 0 to 1."""
    n = F.count("*").over(Window.partitionBy(*groups))
    return (average_rank(value, groups) - 1) / F.greatest(n - 1, F.lit(1))


def rank01(value: str, tie: str, groups: Sequence[str] = ()) -> Column:
    """Rank from 0 to 1, ties in the order of a second column."""
    w = Window.partitionBy(*groups)
    return (F.row_number().over(w.orderBy(value, tie)) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))


def top_count(n: Column, share: float, rule: str = "ceil") -> Column:
    """How many rows a share of n is: ceil, half_even or floor; 1 at least."""
    x = n * F.lit(share)
    k = {"ceil": F.ceil(x), "half_even": F.bround(x, 0), "floor": F.floor(x)}[rule]
    return F.greatest(k.cast("long"), F.lit(1))


def exact_tail(df: DataFrame, groups: Sequence[str], value: str, tie: str, share: float = 0.15, rule: str = "ceil", higher_bad: bool = True) -> DataFrame:
    """``target``: 1 for exactly the worst share of each group; ``rank_target``: the percentile, larger meaning worse.

    A group whose values are all 0 or 1 keeps them.
    """
    w = Window.partitionBy(*groups)
    order = [F.col(value).desc(), F.col(tie).desc()] if higher_bad else [F.col(value), F.col(tie)]
    worst = F.row_number().over(w.orderBy(*order)) <= top_count(F.count("*").over(w), share, rule)
    binary = F.bool_and(F.col(value).isin(0, 1)).over(w)
    p = percentile(value, groups)
    return df.withColumn("target", F.when(binary, F.col(value).cast("int")).otherwise(worst.cast("int"))).withColumn("rank_target", F.when(binary, F.col(value).cast("double")).otherwise(p if higher_bad else 1 - p))


def tail_labels(df: DataFrame, groups: Sequence[str], value: str, low: float = 0.15, high: float = 0.85, higher_bad: bool = True) -> DataFrame:
    """``label``: failure at or beyond the bad tail's index quantile, working at or beyond the other, else ambiguous.

    Failure is tested first, so that a value that meets both is a failure.
    """
    w = Window.partitionBy(*groups)
    rows = df.withColumn("_nth", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    at = lambda share: F.least(F.floor(F.col("_n") * F.lit(share)).cast("long"), F.col("_n") - 1) + 1
    pick = lambda share: F.max(F.when(F.col("_nth") == at(share), F.col(value))).over(w)
    rows = rows.withColumn("_low", pick(low)).withColumn("_high", pick(high))
    up, down = F.col(value) >= F.col("_high"), F.col(value) <= F.col("_low")
    bad, good = (up, down) if higher_bad else (down, up)
    return rows.withColumn("label", F.when(bad, "failure").when(good, "working").otherwise("ambiguous")).withColumnsRenamed({"_low": "low_threshold", "_high": "high_threshold"}).drop("_nth", "_n")


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= k)


def diversified_top(df: DataFrame, anchor: str, score: str, tie: str, k: int) -> DataFrame:
    """The best row of each anchor, and of these the k best."""
    best = top_per_group(df, [anchor], [F.col(score).desc(), F.col(tie)], 1).drop("rank")
    return best.orderBy(F.col(score).desc(), F.col(tie)).limit(k)


def boosted(df: DataFrame, score: str, level: str, boosts: dict[str, float]) -> DataFrame:
    """The score, raised by its level's boost, 1 at most."""
    table = F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv])
    return df.withColumn("boosted", F.least(F.lit(1.0), F.col(score) + F.coalesce(F.try_element_at(table, F.col(level)), F.lit(0.0))))
