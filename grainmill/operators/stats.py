"""Statistics around training, as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def norm(x: Column, p: float = 2) -> Column:
    return F.max(F.abs(x)) if p == float("inf") else F.pow(F.sum(F.pow(F.abs(x), F.lit(float(p)))), F.lit(1.0 / p))


def excess_kurtosis(x: Column) -> Column:
    """Mean of fourth powers over the sample deviation's, less 3; 0 without spread."""
    n = F.count(x)
    k = (F.kurtosis(x) + 3) * F.pow((n - 1) / n, 2) - 3
    return F.when(F.stddev_samp(x) > 0, k).otherwise(0.0)


def tensor_stats(x: Column) -> dict[str, Column]:
    """Empty input has zeros, and a zero fraction of 1."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return {
        "mean": zero(F.avg(x)), "std": zero(F.stddev_samp(x)), "min": zero(F.min(x)), "max": zero(F.max(x)), "l1": zero(F.sum(F.abs(x))), "l2": zero(norm(x)),
        "zero_fraction": F.coalesce(F.avg((F.abs(x) < 1e-10).cast("double")), F.lit(1.0)), "kurtosis": excess_kurtosis(x),
    }


def rounded(columns: dict[str, Column], digits: int = 5) -> list[Column]:
    return [F.round(c, digits).alias(name) for name, c in columns.items()]


def clip_coefficient(total: Column, most: float) -> Column:
    return F.least(F.lit(1.0), F.lit(most) / (total + 1e-6))


def zero_filled(counts: DataFrame, key: str, n: int, column: str = "n") -> DataFrame:
    """Counts of 0 .. n - 1, those missing as 0."""
    return counts.sparkSession.range(n).select(F.col("id").alias(key)).join(counts, key, "left").select(key, F.coalesce(column, F.lit(0)).alias(column))
