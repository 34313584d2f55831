"""The normal distribution in expressions that Spark and other SQL engines share, and labels tied to a value by a Gaussian copula."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published coefficients of Acklam's rational approximation of the normal quantile (relative error 1.15e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
# Those of a published Chebyshev fit of the complementary error function (error below 1.2e-7).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _number(v: float) -> str:
    return f"cast({v!r} as double)"


def _polynomial(coefficients, x: str) -> str:
    """Highest power first."""
    out = _number(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {_number(c)})"
    return out


def quantile_sql(p: str) -> str:
    """SQL for the normal quantile of p, strictly between 0 and 1."""
    low = f"sqrt(-2 * ln({p}))"
    high = f"sqrt(-2 * ln(1 - {p}))"
    middle = f"({p} - {_number(0.5)})"
    square = f"({middle} * {middle})"
    return (
        f"(case when {p} < {_number(0.02425)} then {_polynomial(_C, low)} / {_polynomial(_D, low)} when {p} > {_number(0.97575)} then -({_polynomial(_C, high)} / {_polynomial(_D, high)})"
        f" else {middle} * {_polynomial(_A, square)} / {_polynomial(_B, square)} end)"
    )


def distribution_sql(x: str) -> str:
    """SQL for the probability that a standard normal number is at most x."""
    z = f"(abs({x}) / {_number(math.sqrt(2))})"
    t = f"(1 / (1 + {z} / 2))"
    tail = f"(0.5 * {t} * exp(-{z} * {z} + {_polynomial(_ERFC[::-1], t)}))"
    return f"(case when {x} >= 0 then 1 - {tail} else {tail} end)"


def correlation(rho: float) -> float:
    """Pearson's correlation of normal scores whose rank correlation is rho."""
    return 2 * math.sin(math.pi * rho / 6)


def copula_labels(df: DataFrame, value: str, record: str, rho: float, seed: int = 0) -> DataFrame:
    """record, value and ``planted``: values of the same distribution, whose ranks correlate with the row's by about rho."""
    from siltstone.operators.prefix import numbered
    from siltstone.operators.resample import uniform

    r = correlation(rho)
    rows = numbered(df.where(F.col(value).isNotNull()).select(F.col(record), F.col(value)), [F.col(value), F.col(record)], "_at")
    n = rows.agg(F.count("*").alias("_n"))
    rows = rows.crossJoin(F.broadcast(n)).withColumn("_u", uniform(F.lit(seed), F.col(record)) + F.lit(1.0 / (1 << 53)))  # one row
    rows = rows.withColumn("_p", (F.col("_at") + F.lit(0.5)) / F.col("_n"))
    rows = rows.withColumn("_z", F.expr(f"{_number(r)} * {quantile_sql('_p')} + {_number(math.sqrt(1 - r * r))} * {quantile_sql('_u')}"))
    rows = rows.withColumn("_to", F.least(F.floor(F.expr(distribution_sql("_z")) * F.col("_n")), F.col("_n") - 1).cast("long"))
    back = rows.select(F.col("_at").cast("long").alias("_to"), F.col(value).alias("planted"))
    return rows.select(record, value, "_to").join(back, "_to").select(record, value, "planted")
