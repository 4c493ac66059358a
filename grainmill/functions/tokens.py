"""Deterministic tokenizers and text arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Tokens between runs of white space, empty ones at the ends included."""
    return F.split(text, r"\s+")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def char_ids(text: Column) -> Column:
    """Code points as token ids."""
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long")))


def char_count(text: Column) -> Column:
    return F.length(text).cast("long")


def with_eos(ids: Column, eos: int) -> Column:
    return F.concat(ids, F.array(F.lit(eos).cast("long")))


def ceil_div(a: Column, b: int) -> Column:
    """Ceiling of a / b for a of either sign, in integers."""
    return F.floor((a + (b - 1)) / b).cast("long")


def floor_div(a: Column, b) -> Column:
    return F.floor(a / b).cast("long")


def fraction_of(key: Column, seed: str) -> Column:
    """A pseudo-random integer below 2**28 from the md5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "-"), key.cast("string"))), 1, 7), 16, 10).cast("long")


def shuffle_key(key: Column, seed: str) -> Column:
    """Sorting by this is a deterministic shuffle that any engine can repeat."""
    return F.md5(F.concat(F.lit(seed + "-"), key.cast("string")))
