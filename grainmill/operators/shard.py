"""Sharding, batching and resuming by arithmetic on positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _div(a: Column, b) -> Column:
    return F.floor(a / b).cast("long")


def strided(df: DataFrame, pos: str, ranks: int, n: int, drop_last: bool = True, fill_last: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rank r gets positions r, r + ranks, ...; the tail is dropped, or filled by
    starting over so that all ranks get as many, or left as it is. keep: other columns."""
    even = df.where(F.col(pos) < n - n % ranks) if drop_last else df
    out = even.select(F.pmod(F.col(pos), F.lit(ranks)).cast("long").alias("rank"), _div(F.col(pos), ranks).alias("ordinal"), F.col(pos).alias("pos"), *keep)
    fill = -n % ranks
    if drop_last or not fill_last or not fill:
        return out
    again = df.where(F.col(pos) < fill).select(((F.col(pos) + n) % ranks).alias("rank"), _div(F.col(pos) + n, ranks).alias("ordinal"), F.col(pos).alias("pos"), *keep)
    return out.unionByName(again)


def megabatch(df: DataFrame, pos: str, micro: int, ranks: int, consumed: int = 0, n: int | None = None) -> DataFrame:
    """df from position consumed on, with step, rank and slot: groups of micro * ranks
    in order, each rank a slice of micro; with n, an incomplete last group is dropped."""
    group = micro * ranks
    o = F.col(pos) - consumed
    left = df.where(o >= 0)
    if n is not None:
        left = left.where(o < (n - consumed) // group * group)
    return left.withColumns({"step": _div(o, group), "rank": _div(o % group, micro), "slot": (o % micro).cast("long")})


def bucket(n: int, micro: int, ranks: int) -> int:
    """Samples of a rank's bucket in the random and cyclic orders."""
    return n // (micro * ranks) * micro


def rank_grid(df: DataFrame, rank: str, sizes: dict[str, int]) -> DataFrame:
    """Coordinates of each rank in a grid, the last axis fastest."""
    stride, columns = 1, {}
    for axis, size in reversed(sizes.items()):
        columns[axis] = _div(F.col(rank), stride) % size
        stride *= size
    return df.withColumns({axis: columns[axis] for axis in sizes})


def zero_partition(params: DataFrame, ranks: int, name: str = "name", size: str = "n") -> DataFrame:
    """(name, rank, start, stop): each flat parameter in near-equal slices, the last
    ones shorter by one; empty slices are left out."""
    each = params.withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranks - 1).cast("long"))))
    part = _div(F.col(size) - 1, ranks) + 1
    short = part * ranks - F.col(size)
    full = F.lit(ranks) - short
    start = F.col("rank") * part - F.greatest(F.col("rank") - full, F.lit(0))
    stop = start + part - (F.col("rank") >= full).cast("long")
    return each.select(name, "rank", start.cast("long").alias("start"), stop.cast("long").alias("stop")).where("start < stop")


def stage_at(steps: DataFrame, stages: list[tuple[str, int]], step: str = "step") -> DataFrame:
    """steps with the last stage that has started (stages: name and first step)."""
    if sorted(s for _, s in stages)[:1] != [1] or len({s for _, s in stages}) < len(stages) or len({n for n, _ in stages}) < len(stages):
        raise ValueError("stages start at 1, with distinct names and steps")
    active = F.lit(None).cast("string")
    for name, start in sorted(stages, key=lambda x: x[1]):
        active = F.when(F.col(step) >= start, F.lit(name)).otherwise(active)
    return steps.withColumn("stage", active)
