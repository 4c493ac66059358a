"""Choosing among logits: ranks, top-k, nucleus, routing. Logits stay in their row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _held(value, use, **columns) -> Column:
    """use(struct of columns) where each column is evaluated once a row: inside a
    lambda a column would be evaluated anew for every element."""
    return F.element_at(F.transform(F.array(F.struct(value.alias("x"), *(c.alias(k) for k, c in columns.items()))), use), 1)


def exps(logits: Column, temperature: float = 1.0) -> Column:
    scaled = logits if temperature == 1.0 else F.transform(logits, lambda x: x / temperature)
    return _held(scaled, lambda s: F.transform(s["x"], lambda x: F.exp(x - s["top"])), top=F.array_max(scaled))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities in time linear in the vocabulary."""
    return _held(exps(logits, temperature), lambda s: _held(s["x"], lambda t: F.transform(t["x"], lambda e: e / t["sum"]), sum=total(s["x"])))


def target_rank(logits: Column, target: Column) -> Column:
    """1 + the number of greater logits; ties don't raise it."""
    own = F.element_at(logits, target + 1)
    return (F.size(F.filter(logits, lambda x: x > own)) + 1).cast("long")


def cross_entropy(logits: Column, target: Column, z: float = 0.0) -> Column:
    """Log-sum-exp of shifted logits less the shifted target, plus z times its
    square (clamped to 20 either way)."""
    log_z = F.log(total(exps(logits)))
    loss = log_z - (F.element_at(logits, target + 1) - F.array_max(logits))
    bounded = F.greatest(F.least(log_z, F.lit(20.0)), F.lit(-20.0))
    return loss + z * bounded * bounded if z else loss


def ranked(values: Column, k: int | None = None) -> Column:
    """Structs (value, idx) from the largest value on, the first index on ties."""
    pairs = F.transform(values, lambda x, i: F.struct((-x).alias("n"), i.alias("idx"), x.alias("value")))
    order = F.array_sort(pairs)
    return F.slice(order, 1, k) if k else order


def argmax(values: Column) -> Column:
    return F.element_at(ranked(values, 1), 1)["idx"].cast("long")


def nucleus(probs: Column, p: float, at_least: int = 1) -> Column:
    """Structs (value, idx) of the likeliest tokens: in rising order those whose
    running sum stays within 1 - p go, but the last at_least never."""
    order = F.array_sort(F.transform(probs, lambda x, i: F.struct(x.alias("value"), i.alias("idx"))))
    step = lambda a, y: F.struct((a["sum"] + y["value"]).alias("sum"), (a["n"] + (F.round(a["sum"] + y["value"], 9) <= round(1 - p, 9)).cast("int")).alias("n"))
    below = lambda s: F.aggregate(s["x"], F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), step)["n"]
    return _held(order, lambda s: F.slice(s["x"], F.greatest(F.least(below(s), F.size(s["x"]) - at_least), F.lit(0)) + 1, F.size(s["x"])))


def chosen(candidates: Column, u: Column) -> Column:
    """The idx at which the running sum of the candidates' values, taken to a sum of
    1, reaches u; candidates are structs (value, idx)."""
    values = F.transform(candidates, lambda s: s["value"])
    at = _held(values, lambda s: draw(s["x"], u * s["sum"]), sum=total(values))
    return F.element_at(candidates, (at + 1).cast("int"))["idx"].cast("long")


def tempered(candidates: Column, temperature: float) -> Column:
    """Candidates (value, idx) with softmax probabilities of their values."""
    probs = softmax(F.transform(candidates, lambda s: s["value"]), temperature)
    return F.zip_with(candidates, probs, lambda s, p: F.struct(p.alias("value"), s["idx"].alias("idx")))


def sharded_top(shards: DataFrame, key: str, width: int, k: int) -> DataFrame:
    """(key, top): the k best of all shards (key, shard, part: array of logits) as structs
    (value, idx) from the best on, out of the k best of each; idx counts over all shards."""
    local = F.transform(ranked(F.col("part"), k), lambda s: F.struct((-s["value"]).alias("n"), (s["idx"] + F.col("shard") * width).cast("long").alias("idx"), s["value"].alias("value")))
    best = F.slice(F.array_sort(F.flatten(F.collect_list("local"))), 1, k)
    return shards.select(key, local.alias("local")).groupBy(key).agg(F.transform(best, lambda s: F.struct(s["value"].alias("value"), s["idx"].alias("idx"))).alias("top"))


def draw(probs: Column, u: Column) -> Column:
    """The first index at which the running sum of probabilities reaches u."""
    state = F.aggregate(probs, F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("i")), lambda a, x: F.struct((a["c"] + x).alias("c"), (a["i"] + (F.round(a["c"] + x, 9) < u).cast("int")).alias("i")))
    return F.least(state["i"], F.size(probs) - 1).cast("long")
