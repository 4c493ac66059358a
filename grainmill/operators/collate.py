"""Batches of samples: shifted inputs and labels, positions, masks, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shifted(ids: str, length: int) -> dict[str, Column]:
    """Inputs without the last token, labels without the first."""
    return {"input_ids": F.slice(ids, 1, length), "label_ids": F.slice(ids, 2, length)}


def line_positions(text: Column, n: Column) -> Column:
    """Positions 0, 1, ... that restart after every line end."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.sequence(F.lit(0), F.length(x)))
    return F.slice(F.flatten(lines), F.lit(1), n)


def line_runs(text: Column, n: int) -> Column:
    """Of the positions of the first n tokens, the lengths of the runs 0, 1, ... they
    consist of: one a line. Text has n characters at least."""
    lines = F.split(F.substring(text, F.lit(1), F.lit(n)), "\n")
    return F.transform(lines, lambda x, i: F.length(x) + F.when(i < F.size(lines) - 1, 1).otherwise(0))


def boundary_mask(positions: str, length: int) -> Column:
    """False where the label is a document's first token."""
    return F.transform(F.slice(positions, 2, length), lambda p: p != 0)


def context_slice(ids: Column, rank: Column, ranks: int, length: int) -> Column:
    """Rank r's part [r * length // ranks, (r + 1) * length // ranks)."""
    start = F.floor(rank * length / ranks)
    return F.slice(ids, (start + 1).cast("int"), (F.floor((rank + 1) * length / ranks) - start).cast("int"))


def left_pad_positions(ids: str, pad: int) -> Column:
    """0 over the padding on the left, then 0, 1, ... after its last token."""
    n = F.size(ids)
    last = F.array_position(F.reverse(F.col(ids)), F.lit(pad).cast("long"))
    pads = F.when(last > 0, n - last + 1).otherwise(0).cast("int")
    zero = F.lit(0).cast("long")
    after = F.when(pads < n, F.sequence(zero, (n - pads - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(F.array_repeat(zero, pads), after)  # no pass over the ids for each of them


#: Functions from samples to batches' columns, by name.
COLLATORS: dict = {}


def collator(name: str):
    """Register a function (samples, **settings) -> DataFrame as a collator."""
    def keep(f):
        if name in COLLATORS:
            raise ValueError(f"there is a collator {name}")
        COLLATORS[name] = f
        return f

    return keep


def collate(samples: DataFrame, name: str, **settings) -> DataFrame:
    """samples through the collator of that name; an unknown one is an error."""
    if name not in COLLATORS:
        raise ValueError(f"unknown collator {name}; there are {sorted(COLLATORS)}")
    return COLLATORS[name](samples, **settings)


@collator("causal")
def causal(samples: DataFrame, length: int) -> DataFrame:
    """samples (ids of length + 1, ...) with input_ids, label_ids and label_mask, all true."""
    return samples.withColumns(shifted("ids", length) | {"label_mask": F.array_repeat(F.lit(True), length)})


@collator("documents")
def documents(samples: DataFrame, length: int) -> DataFrame:
    """As causal, with positions (pos, one a token) that restart with each document, and
    a mask without each document's first label."""
    return causal(samples, length).withColumns({"position_ids": F.slice("pos", 1, length), "label_mask": boundary_mask("pos", length)})


@collator("domains")
def domains(samples: DataFrame, length: int, names: DataFrame) -> DataFrame:
    """As causal, with the number of each sample's domain (names: domain, domain_idx; a
    row a domain); an unknown or null domain has -1."""
    known = names.select(F.col("domain").alias("_d"), "domain_idx")
    return causal(samples, length).join(known, F.col("domain") == F.col("_d"), "left").drop("_d").withColumn("domain_idx", F.coalesce("domain_idx", F.lit(-1)))


def sft(pairs: DataFrame, length: int, eos: int = 0, batch: str = "batch_id") -> DataFrame:
    """pairs (prompt, completion as id arrays) to input_ids, position_ids, label_mask
    of prompt + completion + end, cut to length + 1 and padded on the right to the
    longest of the batch; masked in are the completion's tokens."""
    whole = F.slice(F.concat("prompt", "completion", F.array(F.lit(eos).cast("long"))), 1, length + 1)
    cut = pairs.withColumn("ids", whole).withColumn("valid", F.size("ids")).withColumn("prompt_len", F.size("prompt"))
    cut = cut.withColumn("longest", F.max("valid").over(Window.partitionBy(batch)))
    at = F.sequence(F.lit(0), F.col("longest") - 1)
    return cut.withColumns({
        "input_ids": F.concat("ids", F.array_repeat(F.lit(eos).cast("long"), F.col("longest") - F.col("valid"))),
        "position_ids": F.transform(at, lambda i: F.when(i < F.col("valid"), i).otherwise(-1)),
        "label_mask": F.transform(at, lambda i: (i >= F.col("prompt_len")) & (i < F.col("valid"))),
    })


def sft_valid() -> Column:
    return F.exists("position_ids", lambda p: p >= 0) & F.exists("label_mask", lambda m: m)


def attention_pairs(positions: str, window: int | None = None) -> Column:
    """Structs (q, kv): each query with the keys of its document up to it, at most
    `window` back. Each query's keys are one range, so no self-join is made."""
    def of(p, q):
        back = p if window is None else F.least(p, F.lit(window))
        return F.transform(F.sequence(q - back, q), lambda kv: F.struct(q.alias("q"), kv.alias("kv")))

    return F.flatten(F.transform(positions, of))


def pair_sums(runs: str, window: int | None = None) -> Column:
    """Struct (start, n_pairs, kv_sum): how many pairs attention_pairs has, and the sum of
    their keys, of positions given as lengths of runs 0, 1, ...; start is the sum of these.
    A step for each run: its first w + 1 queries have all keys, later ones the last w + 1."""
    def more(a, run):
        n, s = run.cast("long"), a["start"]
        full = n if window is None else F.least(n, F.lit(window + 1).cast("long"))
        half = lambda x: F.shiftright(x, 1)
        pairs = half(full * (full + 1))
        # keys of query s + i, i below full: s .. s + i
        third = (full - 1) * pairs
        keys = s * pairs + F.call_function("div", third, F.lit(3).cast("long"))
        if window is not None:
            k = F.lit(window + 1).cast("long")
            rest = n - full
            pairs = pairs + rest * k
            keys = keys + k * (rest * s + half((full + n - 1) * rest)) - half(rest * window * k)
        return F.struct((s + n).alias("start"), (a["n_pairs"] + pairs).alias("n_pairs"), (a["kv_sum"] + keys).alias("kv_sum"))

    zero = F.lit(0).cast("long")
    return F.aggregate(runs, F.struct(zero.alias("start"), zero.alias("n_pairs"), zero.alias("kv_sum")), more)


def topk_loss_mask(rows: DataFrame, k: int, percent: float, group: str, index: str, rank: str = "rank", mask: str = "mask") -> DataFrame:
    """rows with the mask of each group cut to its likelier tokens.

    Active (non-zero) tokens of a rank above k are dropped, at most the share
    percent of the active ones: the highest ranks, then the lowest index. A group
    that would keep nothing keeps its mask."""
    active = F.col(mask) > 0
    per = Window.partitionBy(group)
    cap = F.floor(F.lit(percent) / 100 * F.sum(active.cast("long")).over(per))
    order = Window.partitionBy(group).orderBy(F.col("_out").desc(), F.col(rank).desc(), index)
    staged = rows.withColumn("_out", active & (F.col(rank) > k)).withColumns({"_cap": cap, "_place": F.row_number().over(order)})
    staged = staged.withColumn("_drop", F.col("_out") & (F.col("_place") <= F.col("_cap")))
    kept = F.sum((active & ~F.col("_drop")).cast("long")).over(per)
    dropped = F.col("_drop") & (kept > 0)
    return staged.withColumn("dropped", dropped).withColumn("new_mask", F.when(F.col("dropped"), F.lit(0.0)).otherwise(F.col(mask).cast("double"))).drop("_out", "_cap", "_place", "_drop")
