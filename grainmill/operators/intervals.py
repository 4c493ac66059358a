"""Joins of half-open intervals of integers, without comparing all with all.

An interval belongs to a level, the power of two its length needs, and at any level at
least its own it meets at most two buckets of that width. Two intervals that overlap
meet in a bucket at the higher of their levels, so one of them is always at its own
level there: that side is matched with the other's buckets by equality. Of the buckets
a pair shares, the one that holds the later start counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(length: Column) -> Column:
    """The smallest k with length <= 2**k."""
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1))).cast("int")


def _buckets(df: DataFrame, levels: Column) -> DataFrame:
    """df (_lo, _hi) once for each bucket that it meets at these levels."""
    each = df.withColumn("_level", F.explode(levels))
    first, last = F.expr("shiftright(_lo, _level)"), F.expr("shiftright(_hi - 1, _level)")
    return each.withColumn("_bucket", F.explode(F.sequence(first, last)))


def interval_join(left: DataFrame, right: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(left, right, lo, hi): each pair of rows, as structs, whose intervals [lo, hi)
    overlap, with the overlap. Both sides may be large and of any lengths: a row is
    copied at most twice a level that the other side has above its own, of which there
    are 64 at most, and rows meet in buckets no wider than twice the longer interval.
    Empty intervals and those with a null end overlap nothing. Buckets are join keys, so
    Spark splits crowded ones."""
    sides = []
    for name, df in (("left", left), ("right", right)):
        start, stop = F.col(f"`{lo}`").cast("long"), F.col(f"`{hi}`").cast("long")
        own = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name), start.alias("_lo"), stop.alias("_hi")).where("_lo < _hi")
        sides.append(own.withColumn("_own", _level(F.col("_hi") - F.col("_lo"))))

    def matched(short: DataFrame, long: DataFrame, above: bool) -> DataFrame:
        """Pairs at the level of the long side's intervals."""
        present = long.agg(F.collect_set("_own").alias("l")).scalar()  # 64 at most
        levels = F.filter("_present", lambda x: x > F.col("_own") if above else x >= F.col("_own"))
        a = _buckets(short.withColumn("_present", present), levels).drop("_present").withColumnsRenamed({"_lo": "_lo_a", "_hi": "_hi_a"}).drop("_own")
        b = _buckets(long, F.array("_own")).withColumnsRenamed({"_lo": "_lo_b", "_hi": "_hi_b"}).drop("_own")
        start, stop = F.greatest("_lo_a", "_lo_b"), F.least("_hi_a", "_hi_b")
        met = a.join(b, ["_level", "_bucket"]).where((start < stop) & (F.expr("shiftright(greatest(_lo_a, _lo_b), _level)") == F.col("_bucket")))
        return met.select("left", "right", start.alias("lo"), stop.alias("hi"))

    return matched(sides[0], sides[1], False).unionByName(matched(sides[1], sides[0], True))
