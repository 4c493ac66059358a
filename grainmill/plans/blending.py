"""Queries of blending, sharding and batching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.prefix import position, running_sum
from ..functions.tokens import fraction_of, shuffle_key
from ..operators import blend as B
from ..operators import shard as H
from ..sources import ship
from .base import Registry, table

R = Registry()


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")


@R.add("SELECT source, round(n / sum(n) OVER (), 9)::DOUBLE AS weight FROM (SELECT source, sum(n_chars)::DOUBLE AS n FROM documents GROUP BY source)")
def normalize_weights(spark, d):
    sums = _docs(spark, d).groupBy("source").agg(F.sum("n_chars").cast("double").alias("n"))
    return sums.join(F.broadcast(sums.agg(F.sum("n").alias("total")))).select("source", F.round(F.col("n") / F.col("total"), 9).alias("weight"))


def _greedy_sql(weights, n, tail):
    w, p = ", ".join(map(str, weights)), sum(weights)
    return f"""WITH RECURSIVE g(i, c, ds) AS (SELECT 0::BIGINT, list_transform([{w}], lambda x: 0::BIGINT), -1
UNION ALL SELECT i + 1, list_transform(range(1, {len(weights) + 1}), lambda j: c[j] + (j = best)::BIGINT), (best - 1)::INT
FROM (SELECT i, c, list_position(e, list_max(e)) AS best FROM (SELECT i, c, list_transform(range(1, {len(weights) + 1}), lambda j: [{w}][j] * greatest(i, 1) - {p} * c[j]) AS e FROM g WHERE i < {n}))),
o AS (SELECT i - 1 AS pos, ds AS dataset_id, (c[ds + 1] - 1)::BIGINT AS ordinal FROM g WHERE i > 0) {tail}"""


@R.add(_greedy_sql([1, 5, 3, 1], 400, "SELECT pos, dataset_id, (ordinal % [8, 2, 5, 5][dataset_id + 1])::BIGINT AS sample_id FROM o"))
def blend_greedy(spark, d):
    """Greedy blend of datasets of 8, 2, 5 and 5 samples, each read in a circle."""
    sizes = F.array(*(F.lit(x) for x in (8, 2, 5, 5)))
    return B.blend(spark, B.integer_weights([0.1, 0.5, 0.3, 0.1]), 400).select("pos", "dataset_id", (F.col("ordinal") % F.element_at(sizes, F.col("dataset_id") + 1)).alias("sample_id"))


@R.add(_greedy_sql([8, 2], 1000, "SELECT dataset_id, count(*) AS n, max(ordinal) AS last_ordinal FROM o GROUP BY dataset_id"))
def blend_greedy_counts(spark, d):
    return B.blend(spark, [8, 2], 1000).groupBy("dataset_id").agg(F.count("*").alias("n"), F.max("ordinal").alias("last_ordinal"))


@R.add("""WITH RECURSIVE g(i, c, ds) AS (SELECT 0::BIGINT, [0::BIGINT, 0, 0], -1
UNION ALL SELECT i + 1, list_transform([1, 2, 3], lambda j: c[j] + (j = best)::BIGINT), (best - 1)::INT
FROM (SELECT i, c, list_position(e, list_max(e)) AS best FROM (SELECT i, c, list_transform([1, 2, 3], lambda j: [5, 3, 2][j] * greatest(i, 1) - 10 * c[j]) AS e FROM g WHERE i < 10))),
p AS (SELECT i - 1 AS slot, ds, c[ds + 1] - 1 AS before FROM g WHERE i > 0)
SELECT ds AS dataset_id, count(*) AS n, sum(before + (pos // 10) * [5, 3, 2][ds + 1])::BIGINT AS ordinal_sum FROM (SELECT unnest(range(0, 1000000)) AS pos) JOIN p ON pos % 10 = slot GROUP BY ds""")
def blend_periodic(spark, d):
    """A long blend from its period alone."""
    return B.blend(spark, [5, 3, 2], 1_000_000).groupBy("dataset_id").agg(F.count("*").alias("n"), F.sum("ordinal").alias("ordinal_sum"))


@R.add("""WITH b AS (SELECT unnest([0,0,0,0,0,1,1,1,2,2]) AS ds, unnest([0,1,2,3,4,0,1,2,0,1]) AS bias, unnest(range(0, 10)) AS bin)
SELECT pos, ds::INT AS dataset_id, ((bias + (pos // 10) * [5, 3, 2][ds + 1]) % [1000, 400, 30][ds + 1])::BIGINT AS sample_id FROM (SELECT unnest(range(0, 50000)) AS pos) JOIN b ON pos % 10 = bin""")
def blend_bins(spark, d):
    return B.blend_bins(spark, [0.5, 0.3, 0.2], [1000, 400, 30], 50_000, 10)


@R.add("""WITH w AS (SELECT source, count(*) AS c FROM documents GROUP BY source), q AS (SELECT source, 1237 * c / sum(c) OVER () AS q FROM w), f AS (SELECT source, q, floor(round(q, 9)) AS f FROM q)
SELECT source, (f + (row_number() OVER (ORDER BY round(q - f, 9) DESC, source) <= 1237 - sum(f) OVER ())::INT)::BIGINT AS n_samples FROM f""")
def blend_largest_remainder(spark, d):
    counts = _docs(spark, d).groupBy("source").agg(F.count("*").alias("c"))
    return B.largest_remainder(counts, 1237, "c", "source").select("source", "n_samples")


@R.add("SELECT lang, ceil(round(5000 * c / sum(c) OVER () * 1.005, 6))::BIGINT AS quota FROM (SELECT lang, count(*) AS c FROM documents GROUP BY lang)")
def blend_quota(spark, d):
    """Samples to prepare of each source, with a margin of half a percent."""
    counts = _docs(spark, d).groupBy("lang").agg(F.count("*").alias("c"))
    return counts.join(F.broadcast(counts.agg(F.sum("c").alias("t")))).select("lang", F.ceil(F.round(F.lit(5000) * F.col("c") / F.col("t") * 1.005, 6)).cast("long").alias("quota"))


_SHUF = "(SELECT doc_id, row_number() OVER (ORDER BY md5('epoch-' || doc_id)) - 1 AS pos FROM documents)"


@R.add(f"SELECT p AS pos, doc_id FROM (SELECT unnest(range(0, 2500)) AS p) JOIN {_SHUF} s ON p % (SELECT count(*) FROM documents) = s.pos")
def epoch_tiling(spark, d):
    """One shuffled order repeated epoch after epoch and cut to length."""
    docs = _docs(spark, d).select("doc_id")
    n = docs.count()
    order = B.shuffled_position(docs, shuffle_key(F.col("doc_id"), "epoch"), "slot")
    return order.withColumn("pos", F.explode(F.sequence(F.col("slot"), F.lit(2499).cast("long") + n, F.lit(n).cast("long")))).where("pos < 2500").select("pos", "doc_id")


@R.add("""SELECT epoch, doc_id, row_number() OVER (PARTITION BY epoch = 2 ORDER BY md5('docs-' || epoch || '/' || doc_id)) - 1 + CASE WHEN epoch = 2 THEN 2 * (SELECT count(*) FROM documents) ELSE 0 END AS pos
FROM documents, (SELECT unnest(range(0, 3)) AS epoch)""")
def doc_idx(spark, d):
    """Documents of three epochs in shuffled order, the last, part-used epoch apart."""
    docs = _docs(spark, d).select("doc_id")
    n = docs.count()
    each = docs.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("is_last", F.col("epoch") == 2)
    key = shuffle_key(F.concat_ws("/", "epoch", "doc_id"), "docs")
    return B.shuffled_position(each, key, "p", ["is_last"]).select("epoch", "doc_id", (F.col("p") + F.when(F.col("is_last"), 2 * n).otherwise(0)).alias("pos"))


@R.add("SELECT i, row_number() OVER (PARTITION BY i < 7000 ORDER BY md5('shuffle-' || i)) - 1 + CASE WHEN i < 7000 THEN 0 ELSE 7000 END AS pos FROM (SELECT unnest(range(0, 10000)) AS i)")
def shuffle_idx(spark, d):
    """Two parts of the samples permuted each on its own."""
    ids = spark.range(10_000).select(F.col("id").alias("i"), (F.col("id") < 7000).alias("part"))
    return B.shuffled_position(ids, shuffle_key(F.col("i"), "shuffle"), "p", ["part"]).select("i", (F.col("p") + F.when(F.col("part"), 0).otherwise(7000)).alias("pos"))


@R.add()
def numpy_shuffle(spark, d):
    """All documents in the order of numpy's legacy shuffle with seed 1234. That
    generator is sequential, so one task draws the order, at 8 bytes a document."""
    import pandas as pd

    docs = position(_docs(spark, d).select("doc_id"), "doc_id", "rank")

    def drawn(batches):
        for batch in batches:
            for n in batch["n"]:
                order = B.legacy_permutation(int(n), 1234)
                for at in range(0, len(order), 100_000):
                    part = order[at : at + 100_000]
                    yield pd.DataFrame({"pos": range(at, at + len(part)), "rank": part})

    ship(spark)
    order = docs.agg(F.count(F.lit(1)).alias("n")).mapInPandas(drawn, "pos long, rank long")
    return order.join(docs, "rank").select("pos", "doc_id")


@R.add("SELECT source, row_number() OVER (ORDER BY md5('files-' || source)) - 1 AS pos FROM (SELECT DISTINCT source FROM documents)")
def file_order_shuffle(spark, d):
    return B.shuffled_position(_docs(spark, d).select("source").distinct(), shuffle_key(F.col("source"), "files"), "pos")


@R.add("""WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS size FROM documents),
b AS (SELECT pos, 'src' || (pos % 4) AS source, pos // 4 + 3 AS sample FROM (SELECT unnest(range(0, 2000)) AS pos))
SELECT b.pos, b.source, s.doc_id FROM b JOIN s ON b.source = s.source AND (b.sample % s.size) = s.k""")
def join_blend_lookup(spark, d):
    """Blended positions to documents: an equi-join on source and sample mod size."""
    docs = _docs(spark, d).select("doc_id", "source")
    numbered = position(docs, "doc_id", "k", within=["source"])
    sizes = docs.groupBy("source").agg(F.count("*").alias("size"))
    pos = spark.range(2000).select(F.col("id").alias("pos"), F.concat(F.lit("src"), F.col("id") % 4).alias("source"), (F.floor(F.col("id") / 4) + 3).alias("sample"))
    return pos.join(sizes, "source").withColumn("k", F.col("sample") % F.col("size")).join(numbered, ["source", "k"]).select("pos", "source", "doc_id")


R.queries["blend_join_samples"], R.sql["blend_join_samples"] = join_blend_lookup, R.sql["join_blend_lookup"]


@R.add("""WITH p AS (SELECT doc_id // 64 AS step, source, count(*) * 128 AS t FROM documents GROUP BY ALL)
SELECT step::BIGINT AS step, source, sum(t) OVER (PARTITION BY source ORDER BY step)::BIGINT AS consumed FROM p""")
def consumption_cumulative(spark, d):
    """Tokens of each source used up to every step."""
    per = _docs(spark, d).groupBy(F.floor(F.col("doc_id") / 64).cast("long").alias("step"), "source").agg((F.count("*") * 128).alias("t"))
    return running_sum(per, "step", F.col("t"), "before", within=["source"]).select("step", "source", (F.col("before") + F.col("t")).alias("consumed"))


@R.add("SELECT source, sum(len(string_split_regex(text, '\\s+')))::BIGINT AS tokens FROM documents GROUP BY source")
def consumption_by_source(spark, d):
    from ..functions.tokens import word_count

    return table(spark, d, "documents").groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("tokens"))


@R.add("SELECT k AS dataset_id, count(doc_id) AS n FROM (SELECT unnest(range(0, 6)) AS k) LEFT JOIN documents ON k = doc_id % 4 GROUP BY k")
def count_dataset_indexes(spark, d):
    """Uses of each dataset, zeros kept."""
    used = _docs(spark, d).groupBy((F.col("doc_id") % 4).alias("dataset_id")).agg(F.count("*").alias("n"))
    return spark.range(6).select(F.col("id").alias("dataset_id")).join(used, "dataset_id", "left").select("dataset_id", F.coalesce("n", F.lit(0)).alias("n"))


@R.add("SELECT source, count(*) AS available, floor(100 * 16 * 0.02)::BIGINT AS needed, floor(100 * 16 * 0.02) <= count(*) AS enough FROM documents GROUP BY source")
def enough_data_check(spark, d):
    needed = int(100 * 16 * 0.02)
    return _docs(spark, d).groupBy("source").agg(F.count("*").alias("available")).select("source", "available", F.lit(needed).cast("long").alias("needed"), (F.lit(needed) <= F.col("available")).alias("enough"))


_POS = "(SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, (SELECT count(*) FROM documents) AS n FROM documents)"


def _positioned(spark, d):
    docs = _docs(spark, d).select("doc_id")
    return position(docs, "doc_id", "pos"), docs.count()


@R.add(f"SELECT pos % 7 AS rank, pos // 7 AS ordinal, pos FROM {_POS} WHERE pos < n - n % 7")
def shard_strided(spark, d):
    return H.strided(*_order(spark, d, 7))


def _order(spark, d, ranks):
    rows, n = _positioned(spark, d)
    return rows, "pos", ranks, n


@R.add(f"SELECT p % 7 AS rank, p // 7 AS ordinal, p % n AS pos FROM (SELECT pos AS p, n FROM {_POS} UNION ALL SELECT pos + n, n FROM {_POS} WHERE pos < (7 - n % 7) % 7)")
def shard_strided_filled(spark, d):
    """The tail filled by starting over."""
    return H.strided(*_order(spark, d, 7), drop_last=False)


@R.add(f"SELECT rank, ordinal, pos FROM (SELECT pos % 4 AS rank, pos // 4 AS ordinal, pos FROM {_POS} WHERE pos < n - n % 4) WHERE ordinal >= 100 // 4")
def resume_skip(spark, d):
    """Each rank leaves out its part of 100 samples already seen."""
    return H.strided(*_order(spark, d, 4)).where(f"ordinal >= {100 // 4}")


_MEGA = "(pos - 37) // 24 AS step, ((pos - 37) % 24) // 4 AS rank, (pos - 37) % 4 AS slot"


@R.add(f"SELECT doc_id, {_MEGA} FROM {_POS} WHERE pos >= 37 AND pos - 37 < (n - 37) // 24 * 24")
def batch_assign(spark, d):
    rows, n = _positioned(spark, d)
    return H.megabatch(rows, "pos", 4, 6, 37, n).select("doc_id", "step", "rank", "slot")


@R.add(f"""WITH a AS (SELECT doc_id, {_MEGA} FROM {_POS} WHERE pos >= 37), n AS (SELECT count(*) AS n FROM documents)
SELECT doc_id, step, rank, slot FROM a UNION ALL SELECT -1, (p - 37) // 24, ((p - 37) % 24) // 4, (p - 37) % 4 FROM n, (SELECT unnest(range(0, 24)) AS k), LATERAL (SELECT n + k AS p) WHERE k < (24 - (n - 37) % 24) % 24""")
def batch_assign_padded(spark, d):
    """An incomplete last batch is filled with -1."""
    rows, n = _positioned(spark, d)
    fill = -(n - 37) % 24
    padded = rows.select("doc_id", "pos").union(spark.range(n, n + fill).select(F.lit(-1).cast("long"), "id"))
    return H.megabatch(padded, "pos", 4, 6, 37).select("doc_id", "step", "rank", "slot")


@R.add(f"""WITH b AS (SELECT doc_id, pos, n // 24 * 4 AS size FROM {_POS} WHERE pos < n // 24 * 24)
SELECT doc_id, rank, row_number() OVER (PARTITION BY rank ORDER BY md5('bucket-3-' || rank || '/' || doc_id)) - 1 AS ordinal FROM (SELECT doc_id, pos // size AS rank FROM b)""")
def batch_random_bucket(spark, d):
    """Epoch 3: each rank's bucket of samples in a shuffled order of its own."""
    rows, n = _positioned(spark, d)
    size = H.bucket(n, 4, 6)
    own = rows.where(F.col("pos") < size * 6).select("doc_id", F.floor(F.col("pos") / size).cast("long").alias("rank"))
    return B.shuffled_position(own, shuffle_key(F.concat_ws("/", "rank", "doc_id"), "bucket-3"), "ordinal", ["rank"])


@R.add(f"""WITH b AS (SELECT doc_id, pos, n // 24 * 4 AS size FROM {_POS} WHERE pos < n // 24 * 24)
SELECT doc_id, pos // size AS rank, (pos % size - 5 + size) % size AS ordinal FROM b""")
def batch_cyclic(spark, d):
    """As the random order without shuffling, resumed 5 samples into each bucket."""
    rows, n = _positioned(spark, d)
    size = H.bucket(n, 4, 6)
    own = rows.where(F.col("pos") < size * 6)
    return own.select("doc_id", F.floor(F.col("pos") / size).cast("long").alias("rank"), F.pmod(F.col("pos") % size - 5, F.lit(size)).alias("ordinal"))


_DOM = "w AS (SELECT lang, count(*) AS c FROM documents GROUP BY lang), q AS (SELECT lang, 64 * c / sum(c) OVER () AS q FROM w), f AS (SELECT lang, q, floor(round(q, 9)) AS f FROM q), z AS (SELECT lang, (f + (row_number() OVER (ORDER BY round(q - f, 9) DESC, lang) <= 64 - sum(f) OVER ())::INT)::BIGINT AS size FROM f)"


@R.add(f"WITH {_DOM} SELECT lang, greatest(size, 1)::BIGINT AS size FROM z")
def domain_batch_sizes(spark, d):
    """Slots of each domain in a batch of 64, by largest remainders, at least one."""
    counts = _docs(spark, d).groupBy("lang").agg(F.count("*").alias("c"))
    return B.domain_slots(counts, 64, "lang", "c").select("lang", F.col("n_samples").alias("size"))


@R.add(f"""WITH {_DOM}, s AS (SELECT doc_id, d.lang, greatest(size, 1) AS size, row_number() OVER (PARTITION BY d.lang ORDER BY doc_id) - 1 AS k FROM documents d JOIN z USING (lang)),
e AS (SELECT min(n // size) AS steps FROM (SELECT lang, size, count(*) AS n FROM s GROUP BY ALL))
SELECT doc_id, lang, (k // size)::BIGINT AS step FROM s, e WHERE k // size < steps""")
def domain_steps(spark, d):
    """Which step uses each document; all stop when the first domain has run out."""
    numbered = position(_docs(spark, d).select("doc_id", "lang"), "doc_id", "k", within=["lang"])
    sizes = domain_batch_sizes(spark, d).join(_docs(spark, d).groupBy("lang").agg(F.count("*").alias("n")), "lang")
    steps = sizes.agg(F.min(F.floor(F.col("n") / F.col("size"))).alias("steps"))
    return numbered.join(sizes, "lang").withColumn("step", F.floor(F.col("k") / F.col("size")).cast("long")).join(F.broadcast(steps)).where("step < steps").select("doc_id", "lang", "step")


@R.add(f"SELECT doc_id, pos // 5 AS chunk, (pos // 5) % 3 AS rank FROM {_POS}")
def micro_batcher(spark, d):
    rows, _ = _positioned(spark, d)
    chunk = F.floor(F.col("pos") / 5).cast("long")
    return rows.select("doc_id", chunk.alias("chunk"), (chunk % 3).alias("rank"))


@R.add(f"SELECT (pos // 16) AS part, count(*) AS n, min(doc_id) AS first_doc FROM {_POS} GROUP BY 1")
def micro_splitter(spark, d):
    rows, _ = _positioned(spark, d)
    return rows.groupBy(F.floor(F.col("pos") / 16).cast("long").alias("part")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@R.add("SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) - 1 AS shard FROM documents")
def even_split_ntile(spark, d):
    """Seven near-equal shards in order, the first ones with one more."""
    rows, n = _positioned(spark, d)
    small, more = divmod(n, 7)
    big = more * (small + 1)
    shard = F.when(F.col("pos") < big, F.floor(F.col("pos") / (small + 1))).otherwise(more + F.floor((F.col("pos") - big) / max(small, 1)))
    return rows.select("doc_id", shard.cast("long").alias("shard"))


@R.add("""WITH p AS (SELECT doc_id, n_chars AS n, (n_chars - 1) // 8 + 1 AS part, r FROM documents, (SELECT unnest(range(0, 8)) AS r)),
q AS (SELECT *, 8 - (part * 8 - n) AS f FROM p), z AS (SELECT doc_id, r, r * part - greatest(r - f, 0) AS start, r * part - greatest(r - f, 0) + part - (r >= f)::INT AS stop FROM q)
SELECT doc_id, r AS rank, start::BIGINT AS start, stop::BIGINT AS stop FROM z WHERE start < stop""")
def zero_partition(spark, d):
    """Flat parameters (here the texts' lengths) in eight near-equal slices."""
    return H.zero_partition(_docs(spark, d), 8, "doc_id", "n_chars")


@R.add("SELECT r AS rank, r // 48 % 2 AS ep, r // 12 % 4 AS pp, r // 4 % 3 AS dp, r // 2 % 2 AS cp, r % 2 AS tp FROM (SELECT unnest(range(0, 96)) AS r)")
def rank_grid(spark, d):
    return H.rank_grid(spark.range(96).withColumnRenamed("id", "rank"), "rank", {"ep": 2, "pp": 4, "dp": 3, "cp": 2, "tp": 2})


@R.add("SELECT w AS worker, r AS rank, ((2 ** (1 + w) * 3 ** (1 + r))::BIGINT % 4294967296)::BIGINT AS seed FROM (SELECT unnest(range(0, 4)) AS w), (SELECT unnest(range(0, 16)) AS r)")
def worker_seed(spark, d):
    grid = spark.range(64).select(F.floor(F.col("id") / 16).cast("long").alias("worker"), (F.col("id") % 16).alias("rank"))
    three = F.aggregate(F.array_repeat(F.lit(3).cast("long"), (F.col("rank") + 1).cast("int")), F.lit(1).cast("long"), lambda a, x: a * x % 2**32)
    two = F.pow(F.lit(2), F.col("worker") + 1).cast("long")
    return grid.select("worker", "rank", (three * two % 2**32).alias("seed"))


@R.add("SELECT a, b FROM (SELECT unnest(range(0, 16)) AS a), (SELECT unnest(range(0, 16)) AS b) WHERE a < b")
def all_pairs(spark, d):
    """Every pair of 16 ranks."""
    ranks = spark.range(16)
    return ranks.select(F.col("id").alias("a"), F.explode(F.when(F.col("id") < 15, F.sequence(F.col("id") + 1, F.lit(15).cast("long")))).alias("b"))


_STAGES = [("base", 1), ("middle", 40), ("anneal", 90)]


@R.add("SELECT step, CASE WHEN step >= 90 THEN 'anneal' WHEN step >= 40 THEN 'middle' ELSE 'base' END AS stage FROM (SELECT unnest(range(1, 121)) AS step)")
def stage_asof(spark, d):
    return H.stage_at(spark.range(1, 121).withColumnRenamed("id", "step"), _STAGES)


@R.add("""WITH s AS (SELECT unnest(['base', 'middle', 'anneal']) AS stage, unnest([1, 40, 90]) AS start), n AS (SELECT *, coalesce(lead(start) OVER (ORDER BY start), 121) AS next FROM s)
SELECT stage, step, CASE WHEN step >= next THEN 0 ELSE next - greatest(step, start) END::BIGINT AS remaining FROM n, (SELECT unnest([1, 39, 40, 89, 100, 120]) AS step)""")
def stage_remaining_steps(spark, d):
    """Steps of each stage still to do when training is at a step (of 120)."""
    stages = spark.createDataFrame(_STAGES, "stage string, start long")
    ranged = stages.withColumn("next", F.coalesce(F.lead("start").over(Window.partitionBy(F.lit(0)).orderBy("start")), F.lit(121)))
    at = ranged.withColumn("step", F.explode(F.array(*(F.lit(x) for x in (1, 39, 40, 89, 100, 120)))))
    left = F.when(F.col("step") >= F.col("next"), 0).otherwise(F.col("next") - F.greatest(F.col("step"), F.col("start")))
    return at.select("stage", "step", left.cast("long").alias("remaining"))


@R.add("SELECT source, sum(n_chars)::BIGINT AS tokens FROM documents GROUP BY source")
def consumed_tokens_total(spark, d):
    """Tokens of each source over all stages, from one map per stage."""
    per = _docs(spark, d).groupBy((F.col("doc_id") % 3).alias("stage"), "source").agg(F.sum("n_chars").alias("t"))
    maps = per.groupBy("stage").agg(F.map_from_entries(F.collect_list(F.struct("source", "t"))).alias("consumed"))
    return maps.select(F.explode("consumed").alias("source", "t")).groupBy("source").agg(F.sum("t").alias("tokens"))


@R.add("SELECT (SELECT count(*) FROM documents) AS samples, (SELECT count(*) * 128 FROM documents)::BIGINT AS tokens, true AS samples_agree, true AS tokens_agree")
def metadata_invariants(spark, d):
    """Stage samples add up to the total, and samples times length to the tokens."""
    stages = _docs(spark, d).groupBy((F.col("doc_id") % 3).alias("stage")).agg(F.count("*").alias("samples"), F.sum(F.lit(128)).alias("tokens"))
    total = _docs(spark, d).agg(F.count("*").alias("total"))
    sums = stages.agg(F.sum("samples").alias("samples"), F.sum("tokens").alias("tokens")).join(F.broadcast(total))
    return sums.select("samples", "tokens", (F.col("samples") == F.col("total")).alias("samples_agree"), (F.col("tokens") == F.col("total") * 128).alias("tokens_agree"))


@R.add("SELECT lang, round(c / sum(c) OVER (), 9)::DOUBLE AS weight FROM (SELECT lang, count(*) AS c FROM documents GROUP BY lang)")
def domain_weights(spark, d):
    counts = _docs(spark, d).groupBy("lang").agg(F.count("*").alias("c"))
    return counts.join(F.broadcast(counts.agg(F.sum("c").alias("t")))).select("lang", F.round(F.col("c") / F.col("t"), 9).alias("weight"))


@R.add("WITH a AS (SELECT doc_id, 0 AS part, row_number() OVER (ORDER BY doc_id) - 1 AS g FROM documents WHERE lang = 'en'), n AS (SELECT count(*) AS n FROM a), b AS (SELECT doc_id, 1 AS part, row_number() OVER (ORDER BY doc_id) - 1 + n AS g FROM documents, n WHERE lang = 'fr') SELECT g AS global_id, part, doc_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def combined_lookup(spark, d):
    """Two datasets in a row under one index."""
    docs = _docs(spark, d)
    first, second = (docs.where(F.col("lang") == x).select("doc_id") for x in ("en", "fr"))
    n = first.count()
    both = position(first, "doc_id", "g").withColumn("part", F.lit(0)).unionByName(position(second, "doc_id", "g").withColumns({"g": F.col("g") + n, "part": F.lit(1)}))
    return both.select(F.col("g").alias("global_id"), "part", "doc_id")


@R.add("SELECT count(*) AS n FROM documents")
def zero_column_count(spark, d):
    """Rows without columns keep their number."""
    return _docs(spark, d).select().agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT doc_id, 'train' AS part FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'test' FROM documents WHERE doc_id % 5 = 0")
def union_mix(spark, d):
    docs = _docs(spark, d).select("doc_id")
    return docs.where("doc_id % 5 != 0").withColumn("part", F.lit("train")).unionByName(docs.where("doc_id % 5 = 0").withColumn("part", F.lit("test")))


@R.add("SELECT DISTINCT source FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT source FROM documents WHERE lang = 'fr' AND n_chars > 4000")
def except_keys(spark, d):
    docs = _docs(spark, d)
    return docs.where("doc_id % 2 = 0").select("source").subtract(docs.where("lang = 'fr' AND n_chars > 4000").select("source"))


@R.add(f"SELECT count(*) AS shared FROM (SELECT doc_id FROM {_POS} WHERE pos % 4 = 1 INTERSECT SELECT doc_id FROM {_POS} WHERE pos % 4 = 2)")
def intersect_ranks(spark, d):
    """Two ranks share no sample; a tail that doesn't fill all ranks stays as it is."""
    rows = H.strided(*_order(spark, d, 4), drop_last=False, fill_last=False, keep=("doc_id",))
    return rows.where("rank = 1").select("doc_id").intersect(rows.where("rank = 2").select("doc_id")).agg(F.count("*").alias("shared"))


@R.add("SELECT d.doc_id, d.lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def semi_prior(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return _docs(spark, d).join(good, "doc_id", "left_semi").select("doc_id", "lang")


def _drawn_sql(seed, n, most):
    return f"list_transform(range(0, {n}), lambda j: ('0x' || substr(md5('{seed}-' || i || '/' || j), 1, 7))::BIGINT % {most})"


def _drawn(seed, n, most):
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: fraction_of(F.concat_ws("/", F.col("id"), j), seed) % most)


@R.add(f"""WITH r AS (SELECT unnest(range(0, 64)) AS i) SELECT i AS sample_id, {_drawn_sql('dummy', 32, 1000)} AS input_ids, {_drawn_sql('label', 32, 1000)} AS label_ids, list_transform(range(0, 32), lambda j: true) AS label_mask,
CASE WHEN i % 4 = 0 THEN list_transform(range(0, 32), lambda j: j - CASE WHEN j < 4 THEN 0 WHEN j < 10 THEN 4 ELSE 10 END) ELSE range(0, 32) END AS position_ids FROM r""")
def dummy_batches(spark, d):
    """Made-up micro-batches of four: drawn ids and labels, nothing masked; the first of
    each holds documents of 4, 6 and S - 10 tokens, the others one."""
    s = 32
    at = F.sequence(F.lit(0).cast("long"), F.lit(s - 1).cast("long"))
    packed = F.transform(at, lambda j: j - F.when(j < 4, 0).when(j < 10, 4).otherwise(10))
    ids = spark.range(64).withColumns({"input_ids": _drawn("dummy", s, 1000), "label_ids": _drawn("label", s, 1000), "label_mask": F.array_repeat(F.lit(True), s)})
    return ids.select(F.col("id").alias("sample_id"), "input_ids", "label_ids", "label_mask", F.when(F.col("id") % 4 == 0, packed).otherwise(at).alias("position_ids"))


@R.add("SELECT i AS sample_id, ('0x' || substr(md5('noise-' || i), 1, 7))::BIGINT % 1000 AS token FROM (SELECT unnest(range(0, 5000)) AS i)")
def random_tokens(spark, d):
    """Hash-drawn token ids in place of a random generator."""
    return spark.range(5000).select(F.col("id").alias("sample_id"), (fraction_of(F.col("id"), "noise") % 1000).alias("token"))


@R.add(f"WITH r AS (SELECT unnest(range(0, 320)) AS i) SELECT i AS sample_id, {_drawn_sql('noise', 33, 1000)} AS ids FROM r")
def random_samples(spark, d):
    """Samples of S + 1 drawn ids for 10 steps of a batch of 32."""
    return spark.range(320).select(F.col("id").alias("sample_id"), _drawn("noise", 33, 1000).alias("ids"))
