"""Training, validation and test samples of several weighted prefixes, in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import position, running_sum, same
from ..functions.tokens import floor_div, shuffle_key
from ..sources.cache import written
from .blend import blend, integer_weights, shuffled_position
from .samples import LAST_EPOCH

#: Fixed value: so much more is prepared of each prefix than its weight asks for.
MARGIN = 1.005
SPLITS = ("train", "valid", "test")


def split_documents(docs: DataFrame, shares: list[float]) -> DataFrame:
    """docs (prefix, doc_id, ...) with split: of each prefix, in the order of its
    documents, rounded shares go to train, valid and test; the overshoot of rounding is
    taken from all bounds."""
    sizes = docs.groupBy("prefix").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("prefix", "_p")
    counts = [F.bround(F.lit(s / sum(shares)) * F.col("_n")).cast("long") for s in shares]
    over = sum(counts[1:], counts[0]) - F.col("_n")
    numbered = position(docs, "doc_id", "_rn", within=["prefix"]).join(sizes, same({"prefix": "_p"}))
    split = F.when(F.col("_rn") < counts[0] - over, SPLITS[0]).when(F.col("_rn") < counts[0] + counts[1] - over, SPLITS[1]).otherwise(SPLITS[2])
    return numbered.withColumn("split", split).drop("_rn", "_n", "_p")


def built_splits(docs: DataFrame, weights: dict[str, object], shares: list[float], wanted: dict[str, int], length: int, seed: str) -> DataFrame:
    """(split, pos, prefix, index, sample_id, doc_id, doc_offset): for each split as many
    positions as wanted, blended by the prefixes' weights; each takes its prefix's next
    sample in shuffled order, which starts in a document at an offset.

    docs: prefix, doc_id, n_tokens. Every (prefix, split) reads its documents for as many
    epochs as MARGIN times its part of the wanted samples needs, in a shuffled order, the
    last epoch apart where less than LAST_EPOCH of it is needed. All prefixes, splits
    and epochs go through the same grouped steps. Prefixes without a weight are left
    out. Positions of a prefix without tokens in a split have null samples. The splits,
    the order of documents and the samples' starts are written to the shared folder on
    the way, so each is made once.
    """
    group = ["prefix", "split"]
    names = sorted(weights)
    whole = integer_weights([weights[p] for p in names])
    rows = [(p, s, -(-wanted[s] * w * 1005 // (1000 * sum(whole)))) for p, w in zip(names, whole, strict=True) for s in SPLITS if wanted.get(s)]
    spark = docs.sparkSession
    needs = spark.createDataFrame(rows, "_p string, _s string, need long")  # three rows a prefix
    held = written(split_documents(docs.where(F.col("prefix").isin(names)), shares), "splits")
    per = held.groupBy(*group).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    plan = per.join(needs, (F.col("prefix") == F.col("_p")) & (F.col("split") == F.col("_s"))).drop("_p", "_s")
    plan = plan.withColumn("epochs", F.greatest(F.ceil((F.col("need") * length + 1) / F.col("tokens")), F.lit(1)).cast("long"))
    early = floor_div((F.col("epochs") - 1) * F.col("tokens") - 1, length)
    few = F.col("need") - early < F.floor(LAST_EPOCH * floor_div(F.col("tokens") - 1, length))
    plan = plan.withColumn("apart", (F.col("epochs") > 1) & few).withColumn("count", floor_div(F.col("epochs") * F.col("tokens") - 1, length)).withColumn("early", F.when(F.col("apart"), early).otherwise(F.col("count")))

    each = held.join(plan, group).withColumn("epoch", F.explode(F.expr("sequence(0L, epochs - 1)"))).withColumn("last", (F.col("epoch") == F.col("epochs") - 1) & F.col("apart"))
    key = shuffle_key(F.concat_ws("/", "prefix", "split", "epoch", "doc_id"), f"{seed}-docs")
    order = shuffled_position(each, key, "p", [*group, "last"])
    ordered = order.withColumn("pos", (F.col("p") + F.when(F.col("last"), (F.col("epochs") - 1) * F.col("n_docs")).otherwise(0)).cast("long"))
    ordered = written(ordered.select(*group, "pos", "doc_id", "n_tokens", "count", "early", (F.col("epochs") * F.col("n_docs")).alias("n")), "documents")
    ranged = running_sum(ordered, "pos", F.col("n_tokens"), "start", within=group, dense=F.col("n"))
    first = F.floor((F.col("start") + length - 1) / length).cast("long")
    last = F.least(floor_div(F.col("start") + F.col("n_tokens") - 1, length), F.col("count") - 1)
    starts = ranged.where("n_tokens > 0").withColumns({"first": first, "stop": last}).where("first <= stop").withColumn("sample_id", F.explode(F.sequence("first", "stop")))
    starts = starts.withColumn("late", F.col("sample_id") >= F.col("early")).withColumn("doc_offset", F.col("sample_id") * length - F.col("start"))
    starts = written(starts.select(*group, "sample_id", "late", "early", "doc_id", "doc_offset"), "samples")
    mixed = shuffled_position(starts, shuffle_key(F.concat_ws("/", "prefix", "split", "sample_id"), f"{seed}-samples"), "p", [*group, "late"])
    index = mixed.select("prefix", "split", (F.col("p") + F.when(F.col("late"), F.col("early")).otherwise(0)).cast("long").alias("index"), "sample_id", "doc_id", "doc_offset")

    label = F.element_at(F.array(*(F.lit(p) for p in names)), F.col("dataset_id") + 1)
    blends = [blend(spark, whole, n).select(F.lit(s).alias("split"), "pos", label.alias("prefix"), F.col("ordinal").alias("index")) for s in SPLITS if (n := wanted.get(s))]
    return reduce(lambda a, b: a.unionByName(b), blends).join(index, [*group, "index"], "left").select("split", "pos", "prefix", "index", "sample_id", "doc_id", "doc_offset")
