"""Risk orientation, group keys, rankings of candidates, histograms and recomputed checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_key(*parts: tuple[str, Column]) -> Column:
    """The first part that isn't blank, with its prefix."""
    return F.coalesce(*[F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")) != "", F.concat(F.lit(f"{p}:" if p else ""), c.cast("string"))) for p, c in parts])


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def context_flags(text: Column, patterns: dict[str, str]) -> list[Column]:
    """1 where the text has the pattern (any case), else 0."""
    return [F.coalesce(text.rlike(f"(?i){p}"), F.lit(False)).cast("int").alias(n) for n, p in patterns.items()]


def risk_output(value: Column, direction: Column, threshold: Column, abstain: Column) -> list[Column]:
    """Oriented risk, its margin to the oriented threshold, and the decision."""
    sign = F.when(direction == "higher_bad", 1.0).otherwise(-1.0)
    margin = sign * (value - threshold)
    decision = F.when(abstain, "abstain").when(margin >= 0, "fail").otherwise("pass")
    return [(sign * value).alias("risk"), F.when(~abstain, margin).alias("margin"), decision.alias("decision")]


def clamped(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def blended_risk(parts: Sequence[tuple[float, Column]], flag_above: float = 0.6) -> list[Column]:
    """Weighted sum of parts clamped to [0, 1], and whether it is above the threshold."""
    total = sum((F.lit(w) * clamped(c) for w, c in parts[1:]), F.lit(parts[0][0]) * clamped(parts[0][1]))
    return [total.alias("risk"), (total > flag_above).alias("flagged")]


def candidate_ranking(df: DataFrame, candidate: str, item: str, disagreement: str, risk: str, top: int = 5) -> DataFrame:
    """Mean disagreement and risk of each candidate, their mean as score, and its items of largest disagreement.

    The list holds ``top`` items only; it is cut by rank before it is gathered.
    """
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(candidate).orderBy(F.col(disagreement).desc(), F.col(item))))
    keep = F.when(F.col("_r") <= top, F.struct(F.col("_r").alias("r"), F.col(item).cast("string").alias("i")))
    out = ranked.groupBy(candidate).agg(F.avg(disagreement).alias("disagreement"), F.avg(risk).alias("risk"), F.array_sort(F.collect_list(keep)).alias("_top"))
    return out.select(candidate, "disagreement", "risk", ((F.col("disagreement") + F.col("risk")) / 2).alias("score"), F.array_join(F.transform("_top", lambda x: x["i"]), ",").alias("top_items"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows in equal bins from low to high; the last holds its upper edge."""
    place = F.least(F.floor((F.col(value) - low) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def quadrants(x: Column, y: Column, x_cut: float, y_cut: float) -> Column:
    return F.concat(F.when(x >= x_cut, "high").otherwise("low"), F.lit("_"), F.when(y >= y_cut, "high").otherwise("low"))


def most_common(df: DataFrame, item: str, order: str, k: int) -> DataFrame:
    """The k most frequent items; of equals the one that comes first."""
    return df.groupBy(item).agg(F.count("*").alias("n"), F.min(order).alias("_first")).orderBy(F.desc("n"), "_first").limit(k).drop("_first")


def varying_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that hold more than one value, with their number, from one pass."""
    one = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "distinct_values").where("distinct_values > 1")


def distinct_in_order(df: DataFrame, id_col: str, columns: Sequence[str], most: int) -> DataFrame:
    """Values of several columns, row by row and column by column, each once, up to a limit."""
    long = df.select(F.col(id_col).alias("_i"), F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("_k", "value")).where("value is not null and value <> ''")
    first = long.groupBy("value").agg(F.min(F.struct("_i", "_k")).alias("_at"))
    return first.orderBy("_at").limit(most).select("value", F.col("_at._i").alias("first_row"))


def share_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg((F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("int")).alias(c) for c in columns])


def array_summary(values: Column, low: float) -> list[Column]:
    """Mean, population variance and share below a value of an array of numbers."""
    v = F.transform(values, lambda x: x.cast("double"))
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    second = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) / n
    return [mean.alias("mean"), (second - mean * mean).alias("variance"), (F.size(F.filter(v, lambda x: x < low)) / n).alias("share_low")]


def recomputed(report: DataFrame, fresh: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """For each key whether a report's figures are what is worked out afresh (a missing row or figure isn't)."""
    a = report.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    both = a.join(fresh.select(*keys, *columns), list(keys), "full")
    same = [F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance, F.lit(False)) for c in columns]
    exact = same[0]
    for s in same[1:]:
        exact = exact & s
    return both.select(*keys, exact.alias("exact"))


def policy_status(policy: DataFrame, ledger: DataFrame, keys: Sequence[str], prior: str) -> DataFrame:
    """``used``: said so by the policy, or found in the ledger in whatever state."""
    seen = ledger.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return policy.join(seen, list(keys), "left").withColumn("used", F.col(prior) | F.coalesce("_seen", F.lit(False))).drop("_seen")


def explanation(rules: Sequence[tuple[str, Column]], none: str = "no rule fits") -> Column:
    """The texts of the rules that hold, in their order."""
    found = F.array_compact(F.array(*[F.when(c, t) for t, c in rules]))
    return F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise(none)
