"""Reports read, scored, oriented and re-ranked for serving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.metrics import reliability


def assays_of(reports: DataFrame, assays: str) -> DataFrame:
    """A row for each entry of the map of assays."""
    return reports.select("*", F.explode(F.map_entries(assays)).alias("_e")).select(*[c for c in reports.columns if c != assays], F.col("_e.key").alias("assay"), F.col("_e.value").alias("value"))


def report_score(rows: DataFrame, groups: Sequence[str], value: str, active: Column) -> DataFrame:
    """Mean and number of the active assays that have a value."""
    fine = active & F.col(value).isNotNull()
    return rows.groupBy(*groups).agg(F.count_if(fine).alias("active"), F.avg(F.when(fine, F.col(value))).alias("score"))


def risk_and_uncertainty(risks: Sequence[Column], uncertainties: Sequence[Column]) -> list[Column]:
    """The first risk and the first uncertainty that is there, 0 if none."""
    return [F.coalesce(*risks, F.lit(0.0)).alias("risk"), F.coalesce(*uncertainties, F.lit(0.0)).alias("uncertainty")]


def two_model_gap(a: Column, b: Column) -> list[Column]:
    return [((a + b) / 2).alias("score"), F.abs(a - b).alias("uncertainty")]


def oriented_mean(rows: DataFrame, groups: Sequence[str], value: str, higher_bad: Column) -> DataFrame:
    """Mean of values turned so that more is worse."""
    return rows.groupBy(*groups).agg(F.avg(F.when(higher_bad, F.col(value)).otherwise(-F.col(value))).alias("oriented"))


def promotion_matrix(summary: DataFrame, row: str, column: str, columns: Sequence[str], value: str) -> DataFrame:
    """One row an experiment, one column a measure (null where it is missing), and whether none is missing."""
    out = summary.groupBy(row).pivot(column, list(columns)).agg(F.max(value))
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(f"`{c}`").isNotNull()
    return out.withColumn("complete", complete)


def weighted_calibration(df: DataFrame, groups: Sequence[str], label: str, score: str, bins: int = 10) -> DataFrame:
    """Bins that have rows, and the mean gap of their score and rate, weighted by their sizes."""
    gap = F.abs(F.col("observed") - F.col("mean_score"))
    return reliability(df, groups, label, score, bins).groupBy(*groups).agg(F.count("*").alias("bins"), F.sum("n").alias("n"), (F.sum(gap * F.col("n")) / F.sum("n")).alias("mean_error"))


def significance_band(p: Column) -> Column:
    return F.when(p.isNull(), "none").when(p < 0.001, "very strong").when(p < 0.01, "strong").when(p < 0.05, "moderate").when(p < 0.1, "weak").otherwise("none")


def stratified_folds(df: DataFrame, label: str, record: str, folds: int, digest: Column) -> DataFrame:
    """``fold``: the rows of each label dealt in turn, in the order of a digest."""
    return df.withColumn("fold", ((F.row_number().over(Window.partitionBy(label).orderBy(digest, record)) - 1) % folds).cast("int"))


def coverage(df: DataFrame, model: str, record: str, records: DataFrame, least: float = 0.8) -> DataFrame:
    """Share of all records that each model predicts, and whether it is enough."""
    total = records.agg(F.count_distinct(record).alias("_all"))
    per = df.groupBy(model).agg(F.count_distinct(record).alias("records")).crossJoin(F.broadcast(total))  # one row
    return per.select(model, "records", (F.col("records") / F.col("_all")).alias("coverage"), (F.col("records") >= F.col("_all") * least).alias("admitted"))


def quarantined(heads: DataFrame, rho: str, n: str, least_rho: float = 0.2, least_rows: int = 20) -> DataFrame:
    """``decision`` of each head: too few rows, quarantine below the least correlation, else serve."""
    return heads.withColumn("decision", F.when(F.col(n) < least_rows, "too_few").when(F.coalesce(F.col(rho) < least_rho, F.lit(True)), "quarantine").otherwise("serve"))


def routed(df: DataFrame, references: DataFrame, text: str, name: str, reference: str, threshold: float, most: int = 10_000) -> DataFrame:
    """``route``: the reference of the largest share of equal places (ties by name) if it reaches the threshold, else null.

    References are grouped by length, so that a row meets those of its own length only; their number is checked.
    """
    if references.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} references; route by a coarser reference set")
    refs = references.groupBy(F.length(reference).alias("_n")).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(reference).alias("t")))).alias("_refs"))
    place = F.sequence(F.lit(1), F.length(text))
    equal = lambda r: F.size(F.filter(place, lambda i: F.substring(text, i, F.lit(1)) == F.substring(r["t"], i, F.lit(1)))) / F.length(text)
    best = F.array_min(F.transform("_refs", lambda r: F.struct((-equal(r)).alias("s"), r["n"].alias("n"))))
    out = df.join(F.broadcast(refs), F.length(text) == F.col("_n"), "left").withColumn("_best", F.when(F.length(text) > 0, best))
    similarity = F.coalesce(-F.col("_best.s"), F.lit(0.0))
    return out.withColumn("similarity", similarity).withColumn("route", F.when(F.col("similarity") >= threshold, F.col("_best.n"))).drop("_n", "_refs", "_best")


def label_rms_by_distance(neighbours: DataFrame, distance: str, difference: Column, width: float) -> DataFrame:
    """Pairs in bins of distance, with the root mean square of their labels' difference."""
    return neighbours.groupBy(F.floor(F.col(distance) / F.lit(width)).cast("int").alias("bin")).agg(F.count("*").alias("pairs"), F.sqrt(F.avg(F.pow(difference, 2))).alias("rms"))


def variants_at(features: Column, positions: Column, shift: int = 1, most: int = 5) -> Column:
    """The first features (structs with ``begin`` and ``end``) that hold any of the 0-based positions."""
    hit = lambda f: F.exists(positions, lambda p: (p + shift >= f["begin"]) & (p + shift <= f["end"]))
    return F.slice(F.filter(features, hit), 1, most)


def keyword_evidence(comments: Column, keywords: Sequence[str]) -> list[Column]:
    """Whether any text of the nested comments (arrays of arrays) holds a keyword (any case), and how many do."""
    pattern = "(?i)" + "|".join(keywords)
    texts = F.flatten(comments)
    return [F.exists(texts, lambda t: t.rlike(pattern)).alias("evidence"), F.size(F.filter(texts, lambda t: t.rlike(pattern))).alias("hits")]


def residue_ranges(runs: Column) -> Column:
    """Runs (structs with 0-based ``start`` and ``end``) as 1-based ranges, joined by commas."""
    one = lambda r: F.concat_ws("-", (r["start"] + 1).cast("string"), (r["end"] + 1).cast("string"))
    return F.array_join(F.transform(runs, one), ",")


def gradient_hash(values: Column, width: int) -> Column:
    """Bits of a picture (its values by rows): whether each value is above its left neighbour in the row."""
    places = F.filter(F.sequence(F.lit(1), F.size(values) - 1), lambda i: i % width != 0)
    return F.array_join(F.transform(places, lambda i: F.when(F.get(values, i) > F.get(values, i - 1), "1").otherwise("0")), "")


def duplicate_groups(df: DataFrame, key: str, label: str, record: str) -> DataFrame:
    """Keys that several rows share: their number, the first row, and whether labels differ."""
    rows = df.groupBy(key).agg(F.count("*").alias("rows"), F.min(record).alias("first_record"), (F.count_distinct(label) > 1).alias("conflict"))
    return rows.where("rows > 1")


def weighted_positions(text: Column, key: Column, seed: int, picks: int, heavy: str, weight: int) -> Column:
    """Distinct 1-based positions of ``picks`` draws with replacement; letters of ``heavy`` count ``weight`` times."""
    from siltstone.operators.resample import uniform

    slots = F.flatten(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.array_repeat(i, F.when(F.substring(text, i, F.lit(1)).rlike(f"[{heavy}]"), weight).otherwise(1))))
    draws = F.array(*[uniform(F.lit(seed), F.lit(k), key) for k in range(picks)])
    return F.when(F.length(text) > 0, F.array_sort(F.array_distinct(F.transform(draws, lambda u: F.element_at(slots, (F.floor(u * F.size(slots)) + 1).cast("int"))))))
