"""Blending weighted sources and the order in which samples are drawn."""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prefix import position, same


def greedy_pattern(weights: list[int], n: int) -> list[int]:
    """At each step the source that is furthest behind its share, the first on
    ties, in exact arithmetic: argmax of w_j * max(i, 1) - c_j."""
    total = sum(weights)
    counts, out = [0] * len(weights), []
    for i in range(n):
        behind = [w * max(i, 1) - total * c for w, c in zip(weights, counts, strict=True)]
        best = behind.index(max(behind))
        counts[best] += 1
        out.append(best)
    return out


def integer_weights(weights: list) -> list[int]:
    """Smallest integers in the same proportion as integers, fractions or decimals; a
    float is the decimal that it prints as."""
    exact = [w if isinstance(w, Fraction) else Fraction(str(w)) for w in weights]
    if any(w < 0 for w in exact) or not any(exact):
        raise ValueError("weights are at least 0, and not all 0")
    scale = lcm(*(x.denominator for x in exact))
    whole = [int(x * scale) for x in exact]
    return [w // gcd(*whole) for w in whole]


#: Periods up to this are walked on the driver and extended by arithmetic.
PERIOD = 4096
#: Positions of a block of a longer walk, and those walked before it to find its start.
WALK, WARM_UP = 8192, 1024
#: Blocks walked side by side.
TOGETHER = 64


def blend(spark: SparkSession, weights: list, n: int) -> DataFrame:
    """(pos, dataset_id, ordinal): the greedy blend of n positions, in which each goes to
    the source furthest behind its share; ordinal counts within the source.

    weights are any non-negative integers, fractions or decimals, taken exactly. If
    their smallest integers have a sum P of at most PERIOD, the choice repeats with that
    period from position P on, and 2P choices are extended by arithmetic. Else tasks
    walk blocks of the positions, see `block_starts`."""
    whole = integer_weights(weights)
    return _periodic(spark, whole, n) if sum(whole) <= PERIOD else _walked(spark, whole, n)


def _periodic(spark: SparkSession, weights: list[int], n: int) -> DataFrame:
    p = sum(weights)
    pattern = greedy_pattern(weights, 3 * p)
    if pattern[p : 2 * p] != pattern[2 * p :]:
        raise ValueError("the blend is not periodic")
    rows, counts = [], [0] * len(weights)
    for i, ds in enumerate(pattern[: 2 * p]):
        rows.append((i, ds, counts[ds]))
        counts[ds] += 1
    table = F.broadcast(spark.createDataFrame(rows, "slot long, dataset_id int, before long"))  # 2 * PERIOD rows at most
    pos = spark.range(n).withColumnRenamed("id", "pos")
    slot = F.when(F.col("pos") < p, F.col("pos")).otherwise(F.col("pos") % p + p)
    per_period = F.array(*(F.lit(w) for w in weights))
    joined = pos.withColumn("slot", slot).join(table, "slot")
    rounds = F.when(F.col("pos") < 2 * p, F.lit(0)).otherwise(F.floor(F.col("pos") / p) - 1)
    ordinal = F.col("before") + rounds * F.element_at(per_period, F.col("dataset_id") + 1)
    return joined.select("pos", "dataset_id", ordinal.cast("long").alias("ordinal"))


def fair_counts(weights: list[int], pos: int) -> list[int]:
    """Counts that sum to pos, each next to its share: floors, and one more for the
    largest remainders."""
    total = sum(weights)
    counts = [w * pos // total for w in weights]
    behind = sorted(range(len(weights)), key=lambda j: (total * counts[j] - weights[j] * pos, j))
    for j in behind[: pos - sum(counts)]:
        counts[j] += 1
    return counts


def walk_blocks(weights: list[int], starts: list[int], counts: list[list[int]], steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greedy walk of several blocks side by side, each from its position and its
    counts so far: choices and ordinals (block, step), and the counts after. What each
    source is behind by is kept in exact integers."""
    total, k = sum(weights), len(starts)
    small = total.bit_length() + len(weights).bit_length() + 2 < 63
    kind = np.int64 if small else object
    share, held = np.array(weights, kind), np.array(counts, np.int64)
    behind = np.array([[w * s - total * c for w, c in zip(weights, own, strict=True)] for s, own in zip(starts, counts, strict=True)], kind)
    chosen, ordinal, each = np.zeros((k, steps), np.int32), np.zeros((k, steps), np.int64), np.arange(k)
    first = [i for i, s in enumerate(starts) if s == 0]  # position 0 is judged as position 1
    behind[first] += share
    for i in range(steps):
        best = behind.argmax(axis=1)  # the first on ties
        chosen[:, i], ordinal[:, i] = best, held[each, best]
        held[each, best] += 1
        behind[each, best] -= total
        if i:
            behind += share
        else:
            behind[[j for j in range(k) if starts[j]]] += share
    return chosen, ordinal, held


def block_starts(spark: SparkSession, weights: list[int], n: int, block: int = WALK, warm_up: int = WARM_UP) -> DataFrame:
    """(block, counts): how often each source was chosen before every block, exactly.

    Walks from different counts at one position soon become the same walk. So every
    block is walked on its own, from fair counts a little before it, and what it comes
    to at its end is compared with where the next began. Where all agree, the first
    block's start being known, all are the true walk; blocks that began elsewhere are
    walked again from their predecessor's end, until all agree. The states are a table
    of a row a block; the driver sees how many disagree."""
    from ..sources import ship
    from ..sources.cache import scratch

    ship(spark)
    blocks = -(-n // block)

    def run(batches):
        for batch in batches:
            ids, known = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), TOGETHER):
                own, given = ids[at : at + TOGETHER], known[at : at + TOGETHER]
                fresh = [i for i, c in enumerate(given) if c is None]
                begin = {i: max(0, own[i] * block - warm_up) for i in fresh}
                for skip in {own[i] * block - begin[i] for i in fresh}:
                    of = [i for i in fresh if own[i] * block - begin[i] == skip]
                    after = walk_blocks(weights, [begin[i] for i in of], [fair_counts(weights, begin[i]) for i in of], skip)[2]
                    for i, c in zip(of, after.tolist(), strict=True):
                        given[i] = c
                ends = walk_blocks(weights, [b * block for b in own], given, block)[2].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(given, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["block", "counts", "after"])

    schema = "block long, counts array<long>, after array<long>"
    states = spark.range(blocks).select(F.col("id").alias("block"), F.lit(None).cast("array<long>").alias("counts")).mapInArrow(run, schema)
    while True:
        path = scratch(spark, "blend")
        states.write.parquet(path)
        states = spark.read.schema(schema).parquet(path)
        before = states.select((F.col("block") + 1).alias("block"), F.col("after").alias("told"))
        wrong = states.join(before, "block").where("counts != told").select("block", F.col("told").alias("counts"))
        if wrong.isEmpty():
            return states.select("block", "counts")
        again = wrong.mapInArrow(run, schema)
        states = states.join(wrong.select("block"), "block", "left_anti").union(again)


def _walked(spark: SparkSession, weights: list[int], n: int) -> DataFrame:
    states = block_starts(spark, weights, n)

    def run(batches):
        for batch in batches:
            ids, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), TOGETHER):
                own = np.array(ids[at : at + TOGETHER])
                chosen, ordinal, _ = walk_blocks(weights, (own * WALK).tolist(), counts[at : at + TOGETHER], WALK)
                pos = own[:, None] * WALK + np.arange(WALK)
                keep = pos < n
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (pos, chosen, ordinal)], ["pos", "dataset_id", "ordinal"])

    return states.repartition("block").mapInArrow(run, "pos long, dataset_id int, ordinal long")


def blended_lookup(order: DataFrame, datasets: DataFrame, consumed: DataFrame) -> DataFrame:
    """order (pos, folder, ordinal) with sample: each dataset is read in a circle, from
    where earlier stages left it. datasets: folder, size; consumed: folder, n, the
    samples that earlier stages took; a folder that they didn't read starts at 0."""
    heads = datasets.join(consumed.select("folder", F.col("n").alias("_used")), "folder", "left")
    return order.join(heads, "folder").select("pos", "folder", "ordinal", ((F.col("ordinal") + F.coalesce("_used", F.lit(0))) % F.col("size")).cast("long").alias("sample"))


def bins(weights: list[float], n_bins: int) -> list[tuple[int, int, int, int]]:
    """(bin, dataset, bias, width) of closed-form blending. Bins left over by
    rounding down go to the last dataset, the first of them repeating its bias."""
    shares = np.asarray(weights) / np.sum(weights)
    own = [(ds, bias) for ds, w in enumerate(shares) for bias in range(int(w * n_bins))]
    last, spare = len(weights) - 1, n_bins - len(own)
    own += [(last, own[-1][1] + k) for k in range(spare)]
    width = [sum(ds == k for ds, _ in own) for k in range(len(weights))]
    return [(i, ds, bias, width[ds]) for i, (ds, bias) in enumerate(own)]


def blend_bins(spark: SparkSession, weights: list[float], sizes: list[int], n: int, n_bins: int = 100) -> DataFrame:
    """(pos, dataset_id, sample_id): pos mod bins picks the dataset, arithmetic the sample."""
    n_bins = min(n_bins, n)
    rows = [(b, ds, bias, width, sizes[ds]) for b, ds, bias, width in bins(weights, n_bins)]
    table = F.broadcast(spark.createDataFrame(rows, "bin long, dataset_id int, bias long, width long, size long"))
    pos = spark.range(n).select(F.col("id").alias("pos"), (F.col("id") % n_bins).alias("bin"))
    sample = (F.col("bias") + F.floor(F.col("pos") / n_bins) * F.col("width")) % F.col("size")
    return pos.join(table, "bin").select("pos", "dataset_id", sample.cast("long").alias("sample_id"))


def largest_remainder(weights: DataFrame, n: int, weight: str = "weight", key: str = "key") -> DataFrame:
    """weights with a count each: floors of n * share, the rest to the largest
    fractional parts (ties by key)."""
    total = weights.agg(F.sum(weight).alias("_total"))
    quota = weights.join(F.broadcast(total)).withColumn("_quota", F.lit(n) * F.col(weight) / F.col("_total"))
    floors = quota.withColumn("_floor", F.floor(F.round("_quota", 9)).cast("long"))
    spare = F.lit(n) - F.sum("_floor").over(Window.partitionBy(F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round(F.col("_quota") - F.col("_floor"), 9).desc(), key))
    return floors.withColumn("n_samples", F.col("_floor") + (rank <= spare).cast("long")).drop("_total", "_quota", "_floor")


def shuffled_position(df: DataFrame, key: Column, out: str, group: list[str] | None = None) -> DataFrame:
    """df with each row's position in the order of a hash key. Keys' leading digits
    part them in blocks, so no partition holds all rows. Groups of nulls are groups like
    others; a null key is replaced by a hash of the whole row, so its rows are spread."""
    group = group or []
    own = F.coalesce(key, F.md5(F.concat_ws("/", F.lit("null"), F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)))))
    staged = df.withColumn("_k", own).withColumn("_b", F.substring("_k", 1, 3))
    sizes = staged.groupBy(*group, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    own = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_k"))
    names = {c: f"_of_{i}" for i, c in enumerate([*group, "_b"])}
    placed = staged.withColumn("_r", own).join(offsets.withColumnsRenamed(names), same(names))
    return placed.withColumn(out, (F.col("_r") - 1 + F.col("_o")).cast("long")).drop("_k", "_b", "_r", "_o", *names.values())


def domain_slots(counts: DataFrame, total: int, key: str = "key", weight: str = "weight") -> DataFrame:
    """counts with n_samples: each domain's part of a batch of `total`, by largest
    remainders, at least one; what that takes too much comes off the largest, down to
    one, then off the next. The domains are few, a row each; a batch has room for all."""
    own = largest_remainder(counts, total, weight, key).withColumn("n_samples", F.greatest("n_samples", F.lit(1)))
    over = F.sum("n_samples").over(Window.partitionBy(F.lit(0))) - total
    larger = Window.partitionBy(F.lit(0)).orderBy(F.col("n_samples").desc(), key).rowsBetween(Window.unboundedPreceding, -1)
    spare = F.col("n_samples") - 1
    taken = F.greatest(F.least(over - F.coalesce(F.sum(spare).over(larger), F.lit(0)), spare), F.lit(0))
    return own.withColumn("n_samples", (F.col("n_samples") - taken).cast("long"))


def domain_batches(docs: DataFrame, slots: DataFrame, domain: str, micro: int, ranks: int, n_micro: int) -> DataFrame:
    """(doc_id, domain, step, rank, micro_batch, slot): every step takes each domain's
    next documents, the domains in a row, cut by rank and then by micro-batch; all stop
    when the first domain has run out. slots: domain, n_samples (a row per domain, that
    of nulls the first if there is one)."""
    in_order = Window.partitionBy(F.lit(0)).orderBy(F.col(domain).asc_nulls_first())  # a row per domain
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = slots.select(F.col(domain).alias("_d"), "n_samples", F.coalesce(F.sum("n_samples").over(earlier), F.lit(0)).alias("_offset"), (F.row_number().over(in_order) - 1).cast("long").alias("domain_idx"))
    sizes = offsets.join(docs.groupBy(domain).agg(F.count(F.lit(1)).alias("_n")), same({domain: "_d"})).drop(domain)
    steps = sizes.agg(F.min(F.floor(F.col("_n") / F.col("n_samples")))).scalar()
    numbered = position(docs.select("doc_id", domain), "doc_id", "_k", within=[domain]).join(sizes, same({domain: "_d"}))
    at = F.col("_offset") + F.col("_k") % F.col("n_samples")
    own = numbered.withColumns({"step": F.floor(F.col("_k") / F.col("n_samples")).cast("long"), "_at": at}).where(F.col("step") < steps)
    per_rank = micro * n_micro
    return own.select("doc_id", domain, "domain_idx", "step", F.floor(F.col("_at") / per_rank).cast("long").alias("rank"), F.floor(F.col("_at") % per_rank / micro).cast("long").alias("micro_batch"), (F.col("_at") % micro).cast("long").alias("slot")).where(F.col("rank") < ranks)


def legacy_permutation(n: int, seed: int) -> np.ndarray:
    """numpy's frozen legacy shuffle, for runs that must repeat such an order."""
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    return order
