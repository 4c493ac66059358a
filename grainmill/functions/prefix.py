"""Global running sums without a single-partition sort of all rows.

Keys are dealt in blocks of about equally many rows: their quantiles are a one-row
subquery over the key column alone, and each row finds its block by bisection. A window
runs inside each block, and only the blocks' totals (one row a block) are summed in one
place. Both the window and the totals stand on one exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of all keys, a power of two: more than a large cluster's cores, few for one window.
BLOCKS = 1024


def same(names: dict[str, str]) -> Column:
    """Columns equal one another, nulls too."""
    return reduce(lambda a, b: a & b, (F.col(a).eqNullSafe(F.col(b)) for a, b in names.items()))


def with_block(df: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """df with _block, the number from 0 on of an integer key's block: how many of the
    keys' quantiles are less; -1 for nulls. An outlier or a cluster of keys leaves the
    blocks even, but for keys that are equal."""
    shares = F.array(*(F.lit((i + 1) / blocks) for i in range(blocks - 1)))
    bounds = df.select(F.col(key).cast("long").alias("k")).agg(F.percentile_approx("k", shares).alias("b")).scalar()
    steps = F.array(*(F.lit(1 << i) for i in reversed(range((blocks - 1).bit_length()))))
    found = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get("_bounds", at + step - 1) < F.col(key), step).otherwise(0))
    return df.withColumn("_bounds", bounds).withColumn("_block", F.when(F.col(key).isNull(), -1).otherwise(found).cast("long")).drop("_bounds")


def running_sum(df: DataFrame, key: str, value: Column, out: str, within: list[str] | None = None, blocks: int = BLOCKS, total: str | None = None, dense: Column | int | None = None) -> DataFrame:
    """df with the sum of value over all rows of smaller key (ties in no order; keys
    should be unique) as a bigint column. key is an integer column, whose nulls come
    first; a null value counts as 0; within: columns whose groups, also those of
    nulls, are summed each on their own. total: a column for the sum over the whole
    group. dense: keys are known to be 0 to this number, so no quantiles are asked for.
    Carry no wide columns through it: sum over keys and sizes and join the result."""
    groups = within or []
    valued = df.withColumn("_value", F.coalesce(value.cast("long"), F.lit(0)))
    dealt = with_block(valued, key, blocks) if dense is None else valued.withColumn("_block", F.floor(F.col(key) * F.lit(blocks) / (F.lit(dense) + 1)).cast("long"))
    staged = dealt.repartition(*groups, "_block")
    before = Window.partitionBy(*groups, "_block").orderBy(F.col(key).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    local = staged.withColumn("_local", F.coalesce(F.sum("_value").over(before), F.lit(0)))
    totals = staged.groupBy(*groups, "_block").agg(F.sum("_value").alias("_total"))
    of_group = Window.partitionBy(*(groups or [F.lit(0)]))
    all_blocks = of_group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(all_blocks), F.lit(0)))
    offsets = offsets.withColumn("_total", F.sum("_total").over(of_group)) if total else offsets.drop("_total")
    names = {c: f"_of_{i}" for i, c in enumerate([*groups, "_block"])}
    summed = local.join(offsets.withColumnsRenamed(names), same(names)).withColumn(out, (F.col("_local") + F.col("_offset")).cast("long"))
    summed = summed.drop("_value", "_local", "_offset", "_block", *names.values())
    return summed.withColumnRenamed("_total", total) if total else summed


def position(df: DataFrame, key: str, out: str = "pos", within: list[str] | None = None, blocks: int = BLOCKS) -> DataFrame:
    """df with the 0-based position of each row by key."""
    return running_sum(df, key, F.lit(1), out, within, blocks)
