"""Duplicates and conflicts: which rows to keep, which to quarantine, and why."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Key = Sequence[str]


def first_wins(df: DataFrame, keys: Key, order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; ``order`` should end in a unique column."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def conflict_keys(df: DataFrame, keys: Key, value: str) -> DataFrame:
    """Keys whose rows hold different values (nulls don't count)."""
    return df.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("rows")).where("least <> most")


def status(df: DataFrame, conflict_on: Key, value: str, duplicate_on: Key, order: Sequence[Column | str]) -> DataFrame:
    """``status``: every row of a conflicting key is quarantined; of the others' duplicates the first is accepted."""
    w = Window.partitionBy(*conflict_on)
    rows = df.withColumn("_bad", F.coalesce(F.min(value).over(w) != F.max(value).over(w), F.lit(False)))
    nth = F.row_number().over(Window.partitionBy("_bad", *duplicate_on).orderBy(*order))
    return rows.withColumn("status", F.when(F.col("_bad"), "quarantined").when(nth == 1, "accepted").otherwise("duplicate")).drop("_bad")


def status_counts(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Rows by each dimension alone and by status (one pass over grouping sets)."""
    sets = ", ".join(f"({d}, status)" for d in dimensions)
    cols = ", ".join(f"cast({d} as string) as {d}" for d in dimensions)
    view = "_siltstone_status"
    df.createOrReplaceTempView(view)
    picked = ", ".join(dimensions)
    return df.sparkSession.sql(f"SELECT {cols}, status, count(*) AS rows FROM {view} GROUP BY GROUPING SETS ({sets}, (status))") if picked else df.groupBy("status").count()


def failure_first(df: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """One row a key; a failing one if there is any."""
    return first_wins(df, [key], [F.col(label).desc_nulls_last(), order])


def quality_gate(df: DataFrame, group: str, sequence: str, label: str, order: str, valid: Column) -> DataFrame:
    """``verdict``: invalid, no_label, conflict (differs from the key's first label), duplicate or kept, in this order of tests."""
    fine = F.coalesce(valid, F.lit(False)) & F.col(label).isNotNull()
    w = Window.partitionBy("_fine", group, sequence).orderBy(order)
    rows = df.withColumn("_fine", fine)
    first, nth = F.first(label).over(w), F.row_number().over(w)
    verdict = F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(F.col(label).isNull(), "no_label").when(first != F.col(label), "conflict").when(nth > 1, "duplicate").otherwise("kept")
    return rows.withColumn("verdict", verdict).drop("_fine")


def conflict_ledger(df: DataFrame, record: str, key: str, label: str, source: str) -> DataFrame:
    """One row for each key with more than one label: its labels, sources and records, sorted."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("labels"), F.array_sort(F.collect_set(source)).alias("sources"), F.count(record).alias("records"), F.min(record).alias("first_record"))
    text = lambda c: F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",")
    return rows.where(F.size("labels") > 1).select(key, text("labels").alias("labels"), text("sources").alias("sources"), "records", "first_record")


def exclusion_ledger(df: DataFrame, record: str, key: str, label: str, valid: Column) -> DataFrame:
    """record and the reasons to leave it out (label_flip, duplicate_record, invalid), of those that have one."""
    by_key, by_record = Window.partitionBy(key), Window.partitionBy(record)
    flip = F.min(label).over(by_key) != F.max(label).over(by_key)
    reasons = F.array_compact(F.array(F.when(flip, "label_flip"), F.when(F.count("*").over(by_record) > 1, "duplicate_record"), F.when(~F.coalesce(valid, F.lit(False)), "invalid")))
    return df.withColumn("_r", reasons).where(F.size("_r") > 0).select(record, F.array_join("_r", "|").alias("reasons"))


def merge_feedback(existing: DataFrame, new: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """``outcome`` of each new row: added, duplicate (same label as known or as first in the batch) or conflict."""
    known = existing.groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_known"))
    w = Window.partitionBy(key).orderBy(order)
    rows = new.join(known, F.col(key) == F.col("_k"), "left").withColumn("_first", F.first(label).over(w)).withColumn("_nth", F.row_number().over(w))
    reference = F.coalesce("_known", "_first")
    outcome = F.when(reference != F.col(label), "conflict").when(F.col("_known").isNotNull() | (F.col("_nth") > 1), "duplicate").otherwise("added")
    return rows.withColumn("outcome", outcome).drop("_k", "_known", "_first", "_nth")


def label_conflicts(df: DataFrame, group: str, keys: Key, value: Column) -> DataFrame:
    """By group: keys, and keys with more than one value."""
    per = df.groupBy(group, *keys).agg(F.count_distinct(value).alias("_d"))
    return per.groupBy(group).agg(F.count("*").alias("keys"), F.count_if(F.col("_d") > 1).alias("conflicting"))


def without_conflicts(df: DataFrame, keys: Key, target: str, order: str) -> DataFrame:
    """The first row of each key whose rows agree on the target."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_d", F.coalesce(F.min(target).over(w) != F.max(target).over(w), F.lit(False)))
    return first_wins(rows.where(~F.col("_d")), keys, [order]).drop("_d")
