"""Whole sample pipelines: epochs of shuffled documents cut into samples, weighted
sets of samples tiled over epochs, mixtures of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prefix import position, running_sum, same
from ..functions.tokens import char_count, floor_div, shuffle_key
from .blend import blend, shuffled_position
from .packing import joined, pieces


def epochs_for(tokens: int, n_samples: int, length: int, extra: int = 1) -> int:
    """The fewest passes over that many tokens that give n_samples."""
    return max(1, -(-(n_samples * length + extra) // tokens))


#: Fixed value: of the last epoch at least this share is needed for it to go with the others.
LAST_EPOCH = 0.80


def last_epoch_apart(tokens: int, epochs: int, n_samples: int, length: int, extra: int = 1) -> bool:
    """Whether the last epoch is shuffled on its own: less than LAST_EPOCH of it is needed."""
    before = ((epochs - 1) * tokens - extra) // length
    return epochs > 1 and n_samples - before < int(LAST_EPOCH * ((tokens - extra) // length))


def document_order(docs: DataFrame, epochs: int, apart: bool, seed: str) -> DataFrame:
    """(doc_id, epoch, pos): every document once an epoch in a shuffled order, with the
    last epoch behind all others if it is apart."""
    each = docs.select("doc_id").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
    each = each.withColumn("last", (F.col("epoch") == epochs - 1) & apart)
    n = docs.agg(F.count(F.lit(1))).scalar()
    order = shuffled_position(each, shuffle_key(F.concat_ws("/", "epoch", "doc_id"), seed), "p", ["last"])
    return order.select("doc_id", "epoch", (F.col("p") + F.when(F.col("last"), (epochs - 1) * n).otherwise(0)).cast("long").alias("pos"))


def shuffled_samples(docs: DataFrame, n_samples: int, length: int, seed: str, drop_last: bool = True, extra: int = 1) -> DataFrame:
    """(pos, sample_id, tokens, n_pad): as many epochs of shuffled documents as
    n_samples need, cut into samples of length + extra tokens (those of the last epoch
    too), in a shuffled order; the last sample may be short by n_pad tokens unless it is
    dropped. docs: doc_id (unique; one may be null) and text, whose characters are the
    tokens; a null text has none. Without any token there is no sample."""
    sizes = docs.select("doc_id", F.coalesce(char_count(F.col("text")), F.lit(0)).alias("n_tokens"))
    n, tokens = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    if not tokens:
        return docs.limit(0).select(F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("sample_id"), F.lit("").alias("tokens"), F.lit(0).cast("long").alias("n_pad"))
    epochs = epochs_for(tokens, n_samples, length, extra)
    apart = last_epoch_apart(tokens, epochs, n_samples, length, extra)
    total = epochs * tokens - extra
    count = total // length if drop_last else -(-total // length)
    before = ((epochs - 1) * tokens - extra) // length if apart else count
    ordered = document_order(docs, epochs, apart, f"{seed}-docs").withColumnRenamed("doc_id", "_d").join(sizes, same({"_d": "doc_id"})).drop("_d")
    ranged = running_sum(ordered, "pos", F.col("n_tokens"), "start", dense=n * epochs).withColumn("limit", F.lit(count).cast("long"))
    texts = docs.select(F.col("doc_id").alias("_d"), "text")
    cut = joined(pieces(texts.join(ranged, same({"_d": "doc_id"})).drop("_d"), length, extra, "limit", []), ["chunk_id"])
    part = cut.withColumnRenamed("chunk_id", "sample_id").withColumn("late", F.col("sample_id") >= before)
    order = shuffled_position(part.select("sample_id", "late"), shuffle_key(F.col("sample_id"), f"{seed}-samples"), "p", ["late"])
    order = order.select("sample_id", (F.col("p") + F.when(F.col("late"), before).otherwise(0)).cast("long").alias("pos"))
    return cut.withColumnRenamed("chunk_id", "sample_id").join(order, "sample_id").select("pos", "sample_id", "tokens", (length + extra - F.length("tokens")).cast("long").alias("n_pad"))


def weighted_epochs(spark: SparkSession, sizes: list[int], weights: list[int], n_samples: int, seed: str) -> DataFrame:
    """(pos, dataset_id, sample_id): one epoch (as many samples as there are) blended
    by weight, each dataset read in a circle, shuffled once and repeated to n_samples."""
    epoch = sum(sizes)
    size = F.element_at(F.array(*(F.lit(s).cast("long") for s in sizes)), F.col("dataset_id") + 1)
    one = blend(spark, weights, epoch).select("pos", "dataset_id", (F.col("ordinal") % size).alias("sample_id"))
    shuffled = shuffled_position(one, shuffle_key(F.col("pos"), seed), "slot").where(F.col("slot") < n_samples)
    tiled = F.sequence(F.col("slot"), F.lit(n_samples - 1).cast("long"), F.lit(epoch).cast("long"))
    return shuffled.select(F.explode(tiled).alias("pos"), "dataset_id", "sample_id")


def mixture(docs: DataFrame, fractions: dict[str, float], splits: list[str], seed: str) -> DataFrame:
    """(split, doc_id, source, pos): of each source its first share of the train split,
    and all of the test split, each split in a shuffled order. docs: doc_id, source,
    split. A negative share or an unknown split is an error."""
    if any(f < 0 for f in fractions.values()):
        raise ValueError("negative fraction")
    if unknown := set(splits) - {"train", "test"}:
        raise ValueError(f"unknown splits {sorted(unknown)}")
    own = docs.where(F.col("source").isin(list(fractions)) & F.col("split").isin(splits)).select("split", "source", "doc_id")
    share = F.create_map(*(F.lit(x) for pair in fractions.items() for x in pair))[F.col("source")]
    ranked = position(own, "doc_id", "k", within=["split", "source"]).join(own.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n")), ["split", "source"])
    kept = ranked.where((F.col("split") == "test") | (F.col("k") < F.floor(share * F.col("n"))))
    return shuffled_position(kept, shuffle_key(F.col("doc_id"), seed), "pos", ["split"]).select("split", "doc_id", "source", "pos")


def concatenated(docs: DataFrame, part: str, key: str = "doc_id") -> DataFrame:
    """docs with global_id: the parts, in the order of their names, in a row; rows
    without a part come first, of each part those without a key."""
    earlier = Window.partitionBy(F.lit(0)).orderBy(F.col(part).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    sizes = docs.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(F.col(part).alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    numbered = position(docs, key, "_k", within=[part]).join(offsets, same({part: "_p"}))
    return numbered.withColumn("global_id", F.col("_k") + F.col("_offset")).drop("_k", "_offset", "_p")


def looked_up(dataset: DataFrame, lists: DataFrame, value: str) -> DataFrame:
    """lists (list_id, ids: array of global_id) with the values at those ids, in order: as
    many as there are ids, null at one that isn't there. Lists without ids have none;
    lists of one list_id are taken as one."""
    each = lists.select("list_id", F.posexplode_outer("ids").alias("_i", "global_id"))
    found = each.join(dataset.select("global_id", value), "global_id", "left")
    pairs = F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", value))))
    return found.groupBy("list_id").agg(F.transform(pairs, lambda s: s[value]).alias(f"{value}s"))


def split_samples(docs: DataFrame, length: int, extra: int = 1) -> DataFrame:
    """(split, sample_id, doc_id, doc_offset): where each sample of each split starts,
    each split's documents in a row of their own. docs: split, doc_id, n_tokens."""
    ranged = running_sum(docs.where("n_tokens > 0"), "doc_id", F.col("n_tokens"), "start", within=["split"])
    totals = docs.groupBy("split").agg(F.sum("n_tokens").alias("total"))
    stop = F.col("start") + F.col("n_tokens") - 1
    first, last = F.floor((F.col("start") + length - 1) / length).cast("long"), F.least(floor_div(stop, length), floor_div(F.col("total") - extra, length))
    ids = ranged.join(totals, "split").withColumns({"first": first, "last": last}).where("first <= last").withColumn("sample_id", F.explode(F.sequence("first", "last")))
    return ids.select("split", "sample_id", "doc_id", (F.col("sample_id") * length - F.col("start")).alias("doc_offset"))
