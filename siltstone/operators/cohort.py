"""Cohorts: unions of sources, signatures, arms, pools, matched controls and assembled training sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import canonical_text, paired_key, slug
from siltstone.operators.contract import union_by_name
from siltstone.operators.dedupe import failure_first, first_wins
from siltstone.operators.splits import hash_order


def signature(first: Column, second: Column, metric: Column, direction: Column) -> list[Column]:
    """What one measurement is told apart by: both texts, the metric's slug and its direction."""
    return [F.coalesce(canonical_text(first), F.lit("")).alias("first"), F.coalesce(canonical_text(second), F.lit("")).alias("second"), slug(metric).alias("metric"), F.lower(F.trim(direction)).alias("direction")]


def union_present(tables: Sequence[DataFrame | None]) -> DataFrame:
    """The union of the tables that are there, by column name."""
    found = [t for t in tables if t is not None]
    if not found:
        raise ValueError("none of the tables is there")
    return union_by_name(found)


def cohort(own: Sequence[DataFrame], public: DataFrame, keys: Sequence[str], order: Sequence[Column | str], pair: tuple[str, str], wanted: Column) -> DataFrame:
    """Own sources and the public rows whose keys they don't hold, one row a key, with ``pair_id``; only wanted rows."""
    base = union_present(own)
    fresh = public.join(base.select(*keys).distinct(), list(keys), "left_anti")
    rows = first_wins(union_by_name([base.withColumn("origin", F.lit("own")), fresh.withColumn("origin", F.lit("public"))]), keys, [F.col("origin"), *order])
    return rows.withColumn("pair_id", paired_key(F.col(pair[0]), F.col(pair[1]))).where(wanted)


def by_role(rows: DataFrame, source: str, roles: dict[str, str], default: str = "unassigned") -> DataFrame:
    """``role`` of each row by its source."""
    table = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    return rows.withColumn("role", F.coalesce(F.try_element_at(table, F.lower(F.trim(F.col(source)))), F.lit(default)))


def arm_sources(sources: DataFrame, source: str, arms: Sequence[str], core: Sequence[str]) -> DataFrame:
    """(arm, source): "all", "core", "core+x" (the core and x) and "all-x" (all but x)."""
    arm = F.explode(F.array(*[F.lit(a) for a in arms]))
    rows = sources.select(F.col(source).alias("source")).where("source is not null").distinct().withColumn("arm", arm)
    is_core, name = F.col("source").isin(*core), F.col("arm")
    member = F.when(name == "all", F.lit(True)).when(name == "core", is_core).when(name.startswith("core+"), is_core | (F.col("source") == F.substring(name, 6, 1000))).when(name.startswith("all-"), F.col("source") != F.substring(name, 5, 1000))
    return rows.where(F.coalesce(member, F.lit(False))).select("arm", "source")


def pooled(rows: DataFrame, value: str, family: str, metric: str, families: Sequence[str], scatter: str = r"(?i)(^|_)(std|sd|var|cv|sem)(_|$)") -> DataFrame:
    """Rows with a finite number, of an allowed family, whose metric isn't a measure of scatter; ``y`` is the number."""
    y = F.col(value).try_cast("double")
    rows = rows.withColumn("y", F.when(~F.isnan(y) & (F.abs(y) < float("inf")), y))
    return rows.where(F.col("y").isNotNull() & F.col(family).isin(*families) & ~F.coalesce(F.col(metric).rlike(scatter), F.lit(False)))


def matched_control(rows: DataFrame, gone: str, pattern: Sequence[str], record: str, seed: int = 0) -> DataFrame:
    """``control``: as many other rows of each pattern as have gone from it (all, where fewer are left), by a digest."""
    many = F.count_if(F.col(gone)).over(Window.partitionBy(*pattern))
    nth = F.row_number().over(Window.partitionBy(*pattern, gone).orderBy(hash_order(seed, record), record))
    return rows.withColumn("_many", many).withColumn("control", ~F.col(gone) & (nth <= F.col("_many"))).drop("_many")


def one_hot(value: str, names: Sequence[str]) -> Column:
    """1 at the value's place among the names, else 0; all 0 for another value."""
    return F.array(*[F.coalesce(F.col(value) == n, F.lit(False)).cast("int") for n in names])


def assembled(sources: dict[str, DataFrame | None], caps: dict[str, int], key: str, label: str, record: str, seed: int = 0) -> DataFrame:
    """Optional sources, each capped by a digest, united with their names as ``source``; one row a key, a failing one if there is any."""
    capped = []
    for name, rows in sources.items():
        if rows is not None:
            rows = rows.withColumn("source", F.lit(name))
            if name in caps:
                rows = rows.orderBy(hash_order(seed, record), record).limit(caps[name])
            capped.append(rows)
    return failure_first(union_present(capped), key, label, record)


def training_guards(rows: DataFrame, label: str, group: str, least_failures: int = 30, least_groups: int = 2) -> DataFrame:
    """Counts of both classes and of their groups, and whether they allow a fit (one row)."""
    bad, good = F.col(label) == 1, F.col(label) == 0
    counts = rows.agg(F.count_if(bad).alias("failures"), F.count_if(good).alias("working"), F.count_distinct(F.when(bad, F.col(group))).alias("failure_groups"), F.count_distinct(F.when(good, F.col(group))).alias("working_groups"))
    return counts.withColumn("fits", (F.col("failures") >= least_failures) & (F.col("failure_groups") >= least_groups) & (F.col("working_groups") >= least_groups))


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key."""
    return first_wins(df, keys, [F.col(order).desc()])


def reference_cover(df: DataFrame, family: str, record: str, text: str, threshold: float, most: int = 8, probes: int = 64) -> DataFrame:
    """References of each family: its medoid, then greedily the text farthest from all chosen, until all are near enough or ``most`` are chosen.

    At most ``probes`` distinct texts of a family (by digest) are compared, by the share of equal places of equally long texts.
    Columns: family, place, record, similarity (to the nearest chosen before; 1 for the medoid).
    """
    import pandas as pd

    some = df.where(F.col(text).isNotNull()).groupBy(family, text).agg(F.min(record).alias("_id"))
    some = some.withColumn("_n", F.row_number().over(Window.partitionBy(family).orderBy(hash_order(0, text), "_id"))).where(F.col("_n") <= probes)

    def alike(a: str, b: str) -> float:
        return sum(x == y for x, y in zip(a, b, strict=True)) / len(a) if a and len(a) == len(b) else float(a == b)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_id").reset_index(drop=True)
        texts = rows[text].tolist()
        near = [[alike(a, b) for b in texts] for a in texts]
        chosen, out = [max(range(len(texts)), key=lambda i: (sum(near[i]), -i))], [1.0]
        while len(chosen) < min(most, len(texts)):
            best = [max(near[i][j] for j in chosen) for i in range(len(texts))]
            far = min((i for i in range(len(texts)) if i not in chosen), key=lambda i: (best[i], i))
            if best[far] >= threshold:
                break
            chosen.append(far)
            out.append(best[far])
        return pd.DataFrame({"family": rows[family].iloc[0], "place": range(len(chosen)), "record": [rows["_id"][i] for i in chosen], "similarity": out})

    kind = {c: df.schema[c].dataType.simpleString() for c in (family, record)}
    return some.groupBy(family).applyInPandas(choose, f"family {kind[family]}, place int, record {kind[record]}, similarity double")
