"""Sinks: ledgers, content-addressed bundles, append-only logs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.splits import set_difference


def write_tsv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Sorted, tab-separated, with a header."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def row_hashes(df: DataFrame) -> DataFrame:
    """A hash of each row: all columns by name, with null told from empty."""
    parts = [F.concat(F.lit(c), F.when(F.col(f"`{c}`").isNull(), F.lit("\1")).otherwise(F.concat(F.lit("\2"), F.col(f"`{c}`").cast("string")))) for c in sorted(df.columns)]
    return df.select(F.sha2(F.concat_ws("\0", *parts), 256).alias("row_hash"))


def dataset_hash(df: DataFrame) -> str:
    """A hash that depends neither on the rows' order nor on their partitions."""
    n, low, high = row_hashes(df).agg(F.count("*"), F.sum(F.conv(F.substring("row_hash", 1, 15), 16, 10).cast("decimal(38,0)")), F.sum(F.conv(F.substring("row_hash", 16, 15), 16, 10).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{sorted(df.columns)}|{n}|{low}|{high}".encode()).hexdigest()


def write_bundle(df: DataFrame, root: str, source: str) -> str:
    """Write a table under its own hash, with a manifest beside it; the path."""
    digest = dataset_hash(df)
    path = f"{root}/{source}/{digest}"
    df.write.mode("overwrite").parquet(f"{path}/rows")
    manifest = {"source": source, "dataset_sha256": digest, "columns": sorted(df.columns), "rows": df.count()}
    df.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return path


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """The rows, if they are what the manifest and the folder's name say."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    rows = spark.read.parquet(f"{path}/rows")
    if not manifest["dataset_sha256"] == dataset_hash(rows) == path.rstrip("/").rsplit("/", 1)[-1] or rows.count() != manifest["rows"]:
        raise ValueError(f"{path} isn't what its manifest says")
    return rows


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return set_difference(row_hashes(a), row_hashes(b), "row_hash").isEmpty()


def append_log(spark: SparkSession, path: str, entry: dict) -> None:
    spark.createDataFrame([(json.dumps(entry, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str) -> list[dict]:
    """All entries; one that isn't JSON is an error."""
    return [json.loads(r[0]) for r in spark.read.text(path).collect()]


class SingleShot:
    """Leave to use a held-out set once: an attempt is written down before the data are touched, and any attempt counts as a use."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entries(self) -> list[dict]:
        from pyspark.errors import AnalysisException

        try:
            return read_log(self.spark, self.path)
        except AnalysisException:
            return []

    def begin(self, name: str, data_hash: str) -> None:
        if any(e["name"] == name for e in self.entries()):
            raise PermissionError(f"{name} has been used")
        append_log(self.spark, self.path, {"name": name, "state": "started", "data_hash": data_hash})

    def finish(self, name: str, result: dict) -> None:
        append_log(self.spark, self.path, {"name": name, "state": "completed", "result": result})
