"""Samples, splits and folds that rerun to the same rows and keep groups whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.prefix import numbered


def hash_order(seed: object, *cols: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]), 256)


def balanced_cap(df: DataFrame, strata: Sequence[str], record: str, most: int, seed: int = 0) -> DataFrame:
    """At most so many rows of each stratum, chosen by a digest."""
    w = Window.partitionBy(*strata).orderBy(hash_order(seed, *strata, record), record)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def two_level_cap(df: DataFrame, inner: Sequence[str], outer: Sequence[str], record: str, most_inner: int, most_outer: int, seed: int = 0) -> DataFrame:
    return balanced_cap(balanced_cap(df, inner, record, most_inner, seed), outer, record, most_outer, seed)


def class_balanced(df: DataFrame, label: str, order: str, most: int) -> DataFrame:
    """Equally many rows of each class: the least class's number, or ``most`` if that is less."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_c")).agg(F.least(F.min("_c"), F.lit(most)).alias("_k"))
    rows = df.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(order)))
    return rows.join(F.broadcast(sizes)).where(F.col("_n") <= F.col("_k")).drop("_n", "_k")  # one row is broadcast


def calibration_split(df: DataFrame, strata: Sequence[str], record: str, share: float = 0.2, least: int = 5, seed: int = 0) -> DataFrame:
    """``part``: calibration for a share of each stratum of at least so many rows, else fit."""
    w = Window.partitionBy(*strata)
    n = F.count("*").over(w)
    nth = F.row_number().over(w.orderBy(hash_order(seed, *strata, record), record))
    return df.withColumn("part", F.when((n >= least) & (nth <= F.bround(n * F.lit(share), 0)), "calibration").otherwise("fit"))


def grouped_folds(df: DataFrame, group: str, folds: int, seed: int = 0) -> DataFrame:
    """``fold`` of every row: whole groups, the largest first, dealt in turn."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_size"))
    order = [F.col("_size").desc(), F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"))), F.col(group)]
    return df.join(numbered(sizes, order, "_at").withColumn("fold", (F.col("_at") % folds).cast("int")).drop("_size", "_at"), group)


def cumulative_split(df: DataFrame, group: str, test_rows: int, seed: int = 0) -> DataFrame:
    """``part``: test for whole groups, the smallest first, until they hold the rows asked for (the group that crosses is in)."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_size"))
    placed = numbered(sizes, [F.col("_size"), hash_order(seed, group), F.col(group)], "_at", "_size", "_before")
    return df.join(placed.withColumn("part", F.when(F.col("_before") < test_rows, "test").otherwise("train")).drop("_size", "_at", "_before"), group)


def fraction_split(df: DataFrame, record: str, train: float = 0.7, validation: float = 0.15, seed: int = 0) -> DataFrame:
    """``part`` by a digest of the record alone, so that it doesn't change when rows are added."""
    u = F.conv(F.substring(hash_order(seed, record), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return df.withColumn("part", F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test"))


def block_key(lat: Column, lon: Column, degrees: float) -> Column:
    return (F.floor(lat / degrees) * 1000 + F.floor(lon / degrees)).cast("long")


def eligible(df: DataFrame, source: str, held: str, training: Column, holdout: Column) -> DataFrame:
    """``part``: train (another source, eligible for training) or test (the held source, eligible); others go."""
    part = F.when((F.col(source) != held) & training, "train").when((F.col(source) == held) & holdout, "test")
    return df.withColumn("part", part).where("part is not null")


def leaking_groups(df: DataFrame, group: str, part: str) -> DataFrame:
    """Groups that stand in more than one part."""
    return df.groupBy(group).agg(F.count_distinct(part).alias("parts")).where("parts > 1")


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of only one side, and which."""
    left = a.select(key).distinct().exceptAll(b.select(key).distinct()).withColumn("only_in", F.lit("left"))
    return left.unionByName(b.select(key).distinct().exceptAll(a.select(key).distinct()).withColumn("only_in", F.lit("right")))


def source_weights(df: DataFrame, source: str, label: str) -> DataFrame:
    """Weights of mean 1: by (source, class), by source, and their geometric mean.

    They are worked out on one row a stratum: rows are never gathered.
    """
    strata = df.groupBy(source, label).agg(F.count("*").alias("_c"))
    strata = strata.withColumn("_s", F.sum("_c").over(Window.partitionBy(source)))
    one = strata.agg(F.sum("_c").alias("_n"), F.count("*").alias("_classes"), F.count_distinct(source).alias("_sources"))
    strata = strata.crossJoin(F.broadcast(one))  # one row
    strata = strata.withColumn("class_weight", F.col("_n") / (F.col("_c") * F.col("_classes"))).withColumn("source_weight", F.col("_n") / (F.col("_s") * F.col("_sources")))
    strata = strata.withColumn("_h", F.sqrt(F.col("class_weight") * F.col("source_weight")))
    mean = strata.agg((F.sum(F.col("_h") * F.col("_c")) / F.sum("_c")).alias("_m"))
    strata = strata.crossJoin(F.broadcast(mean)).select(F.col(source).alias("_1"), F.col(label).alias("_2"), "class_weight", "source_weight", (F.col("_h") / F.col("_m")).alias("hybrid_weight"))
    return df.join(strata, F.col(source).eqNullSafe(F.col("_1")) & F.col(label).eqNullSafe(F.col("_2"))).drop("_1", "_2")
