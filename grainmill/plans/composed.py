"""Queries that put operators together: sample pipelines, loaders, formats, samplers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import cache_key
from ..functions import schedule as Q
from ..functions.tokens import char_count, char_ids, fraction_of
from ..operators import blend as B
from ..operators import evals as E
from ..operators import packing as P
from ..operators import samples as M
from ..operators import select as S
from ..operators import shard as H
from ..sources import register
from ..sources.cache import kept
from .base import Registry, scratch, table
from .blending import _greedy_sql
from .text import _SPANS
from .training import _L, _logits

R = Registry()
N = 128


@R.add(f"""WITH o AS (SELECT epoch, text, length(text) AS n, md5('gpt-docs-' || epoch || '/' || doc_id) AS k FROM documents, (SELECT unnest([0, 1]) AS epoch)),
s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY epoch, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM o),
t AS (SELECT sum(n)::BIGINT AS total, (sum(n)::BIGINT // 2 - 1) // {N} AS early FROM s), i AS (SELECT early, unnest(range(0, (total - 1 + {N - 1}) // {N})) AS sample_id FROM t),
p AS (SELECT sample_id, early, start, substr(text, (greatest(sample_id * {N} - start, 0) + 1)::INT, (least(start + n, sample_id * {N} + {N + 1}) - greatest(start, sample_id * {N}))::INT) AS piece FROM i JOIN s ON start < sample_id * {N} + {N + 1} AND start + n > sample_id * {N}),
g AS (SELECT sample_id, early, string_agg(piece, '' ORDER BY start) AS tokens FROM p GROUP BY ALL)
SELECT row_number() OVER (PARTITION BY sample_id < early ORDER BY md5('gpt-samples-' || sample_id)) - 1 + CASE WHEN sample_id < early THEN 0 ELSE early END AS pos, sample_id, tokens, {N + 1} - length(tokens) AS n_pad FROM g""")
def gpt_samples(spark, d):
    """One and a half epochs of shuffled documents as shuffled samples: the second epoch,
    of which less than 80 % is needed, is apart, and the last sample is short."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    per_epoch = (docs.agg(F.sum(char_count(F.col("text")))).first()[0] - 1) // N
    return M.shuffled_samples(docs, per_epoch * 3 // 2, N, "gpt", drop_last=False)


_TWO = "d AS (SELECT doc_id, (lang <> 'en')::INT AS dataset_id, row_number() OVER (PARTITION BY lang = 'en' ORDER BY doc_id) - 1 AS sample_id, count(*) OVER (PARTITION BY lang = 'en') AS size FROM documents), n AS (SELECT count(*) AS n, count(*) * 3 // 2 AS most FROM documents)"
_NANO = _greedy_sql([8, 2], "(SELECT count(*) FROM documents)", "") + f""", {_TWO}, e AS (SELECT dataset_id, ordinal, row_number() OVER (ORDER BY md5('nano-' || pos)) - 1 AS slot FROM o),
a AS (SELECT p AS pos, dataset_id, ordinal FROM (SELECT n, unnest(range(0, most)) AS p FROM n) JOIN e ON p % n = slot),
b AS (SELECT pos, doc_id, a.dataset_id, pos % 2 AS rank, pos // 2 // 4 AS step, pos // 2 % 4 AS slot FROM a JOIN d ON a.dataset_id = d.dataset_id AND ordinal % size = sample_id, n WHERE pos < most // 8 * 8)"""


def _nanoset(spark, d):
    """English documents and all others at 8 to 2, for one and a half epochs."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("lang") != "en").cast("int").alias("dataset_id"))
    counted = {r.dataset_id: r["count"] for r in docs.groupBy("dataset_id").count().collect()}  # two rows
    sizes = [counted.get(0, 0), counted.get(1, 0)]
    most = sum(sizes) * 3 // 2
    order = M.weighted_epochs(spark, sizes, B.integer_weights([8, 2]), most, "nano")
    numbered = M.position(docs, "doc_id", "sample_id", within=["dataset_id"])
    return order.where(F.col("pos") < most // 8 * 8).join(numbered, ["dataset_id", "sample_id"]), most // 8 * 8


def _batched(spark, d, consumed):
    rows, n = _nanoset(spark, d)
    order = H.strided(rows.select("pos"), "pos", 2, n).where(F.col("ordinal") >= consumed // 2)
    at = F.col("ordinal") - consumed // 2
    return rows.join(order, "pos").select("rank", F.floor(at / 4).cast("long").alias("step"), (at % 4).alias("slot"), "dataset_id", "doc_id")


@R.add(_NANO + " SELECT rank, step, slot, dataset_id, doc_id FROM b")
def nanoset_batches(spark, d):
    """Weighted samples of two datasets dealt to two ranks in batches of four."""
    return _batched(spark, d, 0)


@R.add(_NANO + " SELECT rank, step - 12 AS step, slot, dataset_id, doc_id FROM b WHERE step >= 12")
def nanoset_resume(spark, d):
    """The same resumed after 96 samples: its first batch is the thirteenth."""
    return _batched(spark, d, 96)


@R.add("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), q AS (SELECT lang, n, 64 * n / sum(n) OVER () AS q FROM c),
z AS (SELECT lang, n, (floor(round(q, 9)) + (row_number() OVER (ORDER BY round(q - floor(round(q, 9)), 9) DESC, lang) <= 64 - sum(floor(round(q, 9))) OVER ())::INT)::BIGINT AS size FROM q),
o AS (SELECT *, sum(size) OVER (ORDER BY lang) - size AS before, row_number() OVER (ORDER BY lang) - 1 AS domain_idx, min(n // size) OVER () AS steps FROM z),
s AS (SELECT doc_id, d.lang, domain_idx, steps, k // size AS step, (before + k % size)::BIGINT AS p FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents) d JOIN o USING (lang))
SELECT doc_id, lang, domain_idx, step, p // 32 AS rank, p % 32 // 4 AS micro_batch, p % 4 AS slot FROM s WHERE step < steps""")
def domain_batches(spark, d):
    """Batches of 64 by domain share for two ranks with eight micro-batches of four."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    slots = B.domain_slots(docs.groupBy("lang").agg(F.count("*").alias("c")), 64, "lang", "c").select("lang", "n_samples")
    return B.domain_batches(docs, slots, "lang", 4, 2, 8)


@R.add(f"WITH {_SPANS}, i AS (SELECT unnest(range(0, (SELECT (sum(n) - 1) // {N} FROM s)::BIGINT)) AS sample_id), l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS domain_idx FROM documents GROUP BY lang) SELECT sample_id, domain_idx FROM i JOIN s ON start <= sample_id * {N} AND sample_id * {N} < start + n JOIN documents USING (doc_id) JOIN l USING (lang)")
def domain_collate(spark, d):
    """The domain of the document in which each sample starts, as a number."""
    docs = table(spark, d, "documents")
    numbered = docs.select("lang").distinct().withColumn("domain_idx", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("lang")) - 1).cast("long"))  # a row per domain
    last = (docs.agg(F.sum(char_count(F.col("text")))).scalar() - 1) / N
    starts = P.sample_index(docs, N).where(F.col("sample_id") < F.floor(last))
    return starts.join(docs.select("doc_id", "lang"), "doc_id").join(numbered, "lang").select("sample_id", "domain_idx")


@R.add("""WITH s AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY split, source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY split, source) AS n FROM s),
f AS (SELECT * FROM r WHERE split = 'test' OR k < floor((substr(source, 4)::INT + 1) / 20.0::DOUBLE * n)) SELECT split, doc_id, source, row_number() OVER (PARTITION BY split ORDER BY md5('mixture-' || doc_id)) - 1 AS pos FROM f""")
def mixture_splits(spark, d):
    """A share of each of the twenty sources for training, and all of them for tests."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"))
    return M.mixture(docs, {f"src{k}": (k + 1) / 20 for k in range(20)}, ["train", "test"], "mixture")


_CONCAT = "c AS (SELECT doc_id, row_number() OVER (ORDER BY lang, doc_id) - 1 AS global_id FROM documents)"


@R.add(f"WITH {_CONCAT}, l AS (SELECT unnest(range(0, 50)) AS list_id), n AS (SELECT count(*) AS n FROM c), i AS (SELECT list_id, p, list_id * (p * 17 + 1) % n AS global_id FROM l, n, (SELECT unnest(range(0, 5)) AS p)) SELECT list_id, list(doc_id ORDER BY p) AS doc_ids FROM i JOIN c USING (global_id) GROUP BY list_id")
def combined_lists(spark, d):
    """Lists of ids looked up in all languages' documents in a row."""
    docs = M.concatenated(table(spark, d, "documents").select("doc_id", "lang"), "lang")
    n = docs.agg(F.count(F.lit(1))).scalar()
    ids = spark.range(50).select(F.col("id").alias("list_id"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda p: F.col("id") * (p * 17 + 1)).alias("raw"))
    return M.looked_up(docs, ids.withColumn("n", n).select("list_id", F.transform("raw", lambda r: r % F.col("n")).alias("ids")), "doc_id")


_SPLIT = "b AS (SELECT n, round_even(0.949 * n, 0)::BIGINT AS x, round_even(0.05 * n, 0)::BIGINT AS y, round_even(0.001 * n, 0)::BIGINT AS z FROM (SELECT count(*) AS n FROM documents)), t AS (SELECT doc_id, length(text) AS len, CASE WHEN rn < x - (x + y + z - n) THEN 'train' WHEN rn < x + y - (x + y + z - n) THEN 'valid' ELSE 'test' END AS split FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents), b)"


@R.add(f"""WITH {_SPLIT}, s AS (SELECT doc_id, split, len, coalesce(sum(len) OVER (PARTITION BY split ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, sum(len) OVER (PARTITION BY split)::BIGINT AS total FROM t),
i AS (SELECT split, unnest(range(0, (max(total) - 1) // {N} + 1)) AS sample_id FROM s GROUP BY split) SELECT split, sample_id, doc_id, sample_id * {N} - start AS doc_offset FROM i JOIN s USING (split) WHERE start <= sample_id * {N} AND sample_id * {N} < start + len""")
def tvt_samples(spark, d):
    """Sample starts of the training, validation and test documents, each on its own."""
    docs = table(spark, d, "documents").select("doc_id", char_count(F.col("text")).alias("n_tokens"))
    _, x, y, _ = P.split_bounds([949, 50, 1], docs.count())
    split = F.when(F.col("rn") < x, "train").when(F.col("rn") < y, "valid").otherwise("test")
    return M.split_samples(M.position(docs, "doc_id", "rn").withColumn("split", split).drop("rn"), N)


@R.add("WITH c AS (SELECT source, sum(n_chars)::BIGINT AS consumed FROM documents WHERE lang = 'fr' GROUP BY source) SELECT 's3://data/src' || k AS folder, coalesce(consumed, 0) AS consumed FROM (SELECT unnest(range(0, 24)) AS k) LEFT JOIN c ON source = 'src' || k")
def consumption_match(spark, d):
    """Tokens consumed so far matched to datasets by folder; none is 0."""
    consumed = table(spark, d, "documents").where("lang = 'fr'").groupBy(F.concat(F.lit("s3://data/"), "source").alias("folder")).agg(F.sum("n_chars").alias("consumed"))
    folders = spark.range(24).select(F.concat(F.lit("s3://data/src"), "id").alias("folder"))
    return folders.join(consumed, "folder", "left").select("folder", F.coalesce("consumed", F.lit(0)).alias("consumed"))


@R.add("SELECT vec_id % 4 AS rank, sum(len(embedding))::BIGINT AS local_params, sum(len(embedding) * CASE WHEN label % 2 = 0 THEN 2 ELSE 4 END)::BIGINT AS local_bytes, (SELECT sum(len(embedding)) FROM embeddings)::BIGINT AS total_params FROM embeddings GROUP BY 1")
def param_counts(spark, d):
    """Parameters and their bytes on each rank, and the total over ranks."""
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 4).alias("rank"), F.size("embedding").cast("long").alias("n"), F.when(F.col("label") % 2 == 0, 2).otherwise(4).alias("width"))
    local = e.groupBy("rank").agg(F.sum("n").alias("local_params"), F.sum(F.col("n") * F.col("width")).alias("local_bytes"))
    return local.withColumn("total_params", F.sum("local_params").over(Window.partitionBy(F.lit(0))))  # a row per rank


@R.add("SELECT o_orderkey AS test, round(o_totalprice::DOUBLE * 1048576 / (o_orderkey % 7 + 1) * 8 / 1e9, 6)::DOUBLE AS gbps FROM orders")
def link_gbps(spark, d):
    """Gigabits per second from bytes and seconds."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("test"), F.round(Q.gbps(F.col("o_totalprice").cast("double") * 1048576, F.col("o_orderkey") % 7 + 1), 6).alias("gbps"))


@R.add("SELECT o_orderkey AS step, round(o_totalprice::DOUBLE * 64 / 2.5, 4)::DOUBLE AS tokens_per_s, round(o_totalprice::DOUBLE * 64 / 2.5 / 8, 4)::DOUBLE AS per_gpu, round((60000 - o_orderkey) * 2.5, 4)::DOUBLE AS eta_s FROM orders")
def throughput_eta(spark, d):
    """Tokens a second, the same a device, and the seconds left."""
    sequences, step = F.col("o_totalprice").cast("double"), F.col("o_orderkey")
    return table(spark, d, "orders").select(step.alias("step"), *(F.round(c, 4).alias(k) for k, c in Q.throughput(sequences, 64, F.lit(2.5), 8, F.lit(60000) - step).items()))


@R.add("SELECT o_orderkey AS step, tag, round(CASE tag WHEN 'loss' THEN o_totalprice::DOUBLE / 1e5 WHEN 'lr' THEN (o_orderkey % 100) / 1000.0::DOUBLE ELSE o_totalprice::DOUBLE * 2 END, 9)::DOUBLE AS value FROM orders, (SELECT unnest(['loss', 'lr', 'tokens_per_s']) AS tag)")
def metrics_long(spark, d):
    """Metrics of each step as (step, tag, value) rows appended to a table, and back."""
    path = scratch(spark, "metrics")
    wide = table(spark, d, "orders").select(F.col("o_orderkey").alias("step"), (F.col("o_totalprice").cast("double") / 1e5).alias("loss"), (F.col("o_orderkey") % 100 / F.lit(1000.0)).alias("lr"), (F.col("o_totalprice").cast("double") * 2).alias("tokens_per_s"))
    for part in (wide.where("step % 2 = 0"), wide.where("step % 2 = 1")):
        E.long_metrics(part, "step").write.mode("append").parquet(path)
    return spark.read.schema("step long, tag string, value double").parquet(path).select("step", "tag", F.round("value", 9).alias("value"))


@R.add("SELECT event_id, user_id AS a, (props::JSON ->> '$.k')::BIGINT AS b, NULL::BIGINT AS c FROM events")
def nested_path(spark, d):
    """Dotted paths into nested values; one that isn't there is null."""
    e = table(spark, d, "events").select("event_id", F.struct("user_id", F.from_json("props", "k long").alias("props")).alias("event"))
    return e.select("event_id", *(E.by_path(e, path, "long").alias(k) for k, path in (("a", "event.user_id"), ("b", "event.props.k"), ("c", "event.props.none.k"))))


@R.add("SELECT doc_id, regexp_matches('model.' || source || '.' || lang, '^(?:model\\.src1|.*norm)') OR (doc_id % 6 = 0 AND regexp_matches('tied.' || lang, '^(?:model\\.src1|.*norm|tied\\.de)')) OR regexp_matches('model.' || source || '.' || lang, '^(?:tied\\.de)') AS excluded FROM documents")
def weight_decay_tied(spark, d):
    """Names, or the names they are tied to, that a list of patterns matches at the start."""
    name, tied = F.concat_ws(".", F.lit("model"), "source", "lang"), F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("tied."), "lang"))
    return table(spark, d, "documents").select("doc_id", E.matches_any([r"model\.src1", r".*norm", r"tied\.de"], name, tied).alias("excluded"))


@R.add("""WITH w AS (SELECT item_id, string_split_regex(text, '\\s+') AS w FROM benchmark), c AS (SELECT item_id, w, list_transform(range(0, 4), lambda k: w[9 + k]) AS choices, item_id % 4 AS gold FROM w)
SELECT item_id, 'mcf' AS form, 'Question: ' || array_to_string(w[1:8], ' ') || chr(10) || ' A. ' || choices[1] || chr(10) || ' B. ' || choices[2] || chr(10) || ' C. ' || choices[3] || chr(10) || ' D. ' || choices[4] || chr(10) || 'Answer:' AS prompt, [' A', ' B', ' C', ' D'] AS choices, gold FROM c
UNION ALL SELECT item_id, 'cf', 'Question: ' || array_to_string(w[1:8], ' ') || chr(10) || 'Answer:', list_transform(choices, lambda x: ' ' || x), gold FROM c""")
def eval_prompts(spark, d):
    """Prompts, choices and gold index of multiple-choice lines in two formulations."""
    w = F.split("text", r"\s+")
    key = F.when(F.col("item_id") % 2 == 0, (F.col("item_id") % 4 + 1).cast("string")).otherwise(F.char(F.col("item_id") % 4 + 65))
    lines = table(spark, d, "benchmark").select("item_id", F.struct(F.array_join(F.slice(w, 1, 8), " ").alias("question"), F.transform(F.sequence(F.lit(9), F.lit(12)), lambda k: F.get(w, k - 1)).alias("choices"), key.alias("answerKey")).alias("line"))
    each = [lines.select("item_id", F.lit(form).alias("form"), E.prompt("arc", form, F.col("line")).alias("p")) for form in ("mcf", "cf")]
    return reduce(lambda a, b: a.unionByName(b), each).select("item_id", "form", "p.prompt", "p.choices", "p.gold")


@R.add(f"""WITH {_L}, u AS (SELECT vec_id, unnest(range(0, len(l))) AS idx, unnest(l) AS x FROM s), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, idx) AS place FROM u) WHERE place <= 5),
p AS (SELECT vec_id, idx, place, exp(x / 0.7 - max(x / 0.7) OVER (PARTITION BY vec_id)) AS e FROM k), r AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p, ('0x' || substr(md5('topk-' || vec_id), 1, 7))::BIGINT / 268435456.0 AS u FROM p),
c AS (SELECT *, round(sum(p) OVER (PARTITION BY vec_id ORDER BY place ROWS UNBOUNDED PRECEDING), 9) AS cum FROM r) SELECT vec_id, min(idx) FILTER (place = least(1 + (SELECT count(*) FROM c b WHERE b.vec_id = c.vec_id AND b.cum < b.u), 5))::BIGINT AS token FROM c GROUP BY vec_id""")
def topk_two_phase(spark, d):
    """The best five of each of four vocabulary shards, the best five of those, and a
    draw among them at a temperature of 0.7."""
    rows = _logits(spark, d)
    shards = rows.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.slice("l", s * 16 + 1, 16))).alias("shard", "part"))
    u = fraction_of(F.col("vec_id"), "topk") / F.lit(268435456.0)
    return S.sharded_top(shards, "vec_id", 16, 5).select("vec_id", S.chosen(S.tempered(F.col("top"), 0.7), u).alias("token"))


@R.add(f"""WITH {_L}, t AS (SELECT vec_id, unnest(range(0, len(l))) AS idx, unnest(list_transform(l, lambda x: exp(x / 0.8 - list_max(l) / 0.8))) AS e FROM s), q AS (SELECT vec_id, idx, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM t),
r AS (SELECT *, round(sum(p) OVER (PARTITION BY vec_id ORDER BY p, idx ROWS UNBOUNDED PRECEDING), 9) AS cum, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, idx DESC) AS place FROM q), k AS (SELECT vec_id, idx, p, ('0x' || substr(md5('topp-' || vec_id), 1, 7))::BIGINT / 268435456.0 AS u FROM r WHERE cum > 0.1 OR place <= 2),
c AS (SELECT *, round(sum(p) OVER (PARTITION BY vec_id ORDER BY p, idx ROWS UNBOUNDED PRECEDING), 9) AS cum, sum(p) OVER (PARTITION BY vec_id) * u AS top, row_number() OVER (PARTITION BY vec_id ORDER BY p, idx) AS place, count(*) OVER (PARTITION BY vec_id) AS n FROM k)
SELECT vec_id, min(idx) FILTER (place = least(1 + below, n))::BIGINT AS token FROM (SELECT *, count(*) FILTER (cum < top) OVER (PARTITION BY vec_id) AS below FROM c) GROUP BY vec_id""")
def topp_draw(spark, d):
    """A draw from the nucleus of 90 % at a temperature of 0.8."""
    u = fraction_of(F.col("vec_id"), "topp") / F.lit(268435456.0)
    return _logits(spark, d).select("vec_id", S.chosen(S.nucleus(S.softmax(F.col("l"), 0.8), 0.9, 2), u).alias("token"))


@R.add(f"""WITH f AS (SELECT doc_id % 4 AS file, string_agg(text, '' ORDER BY doc_id) AS t FROM documents GROUP BY 1), r AS (SELECT file, t, length(t) AS n, coalesce(sum(length(t)) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM f),
k AS (SELECT *, least(greatest(1000 - start, 0), n) AS skipped FROM r), b AS (SELECT *, greatest(least(n - skipped, 1000000 - greatest(start - 1000, 0)), 0) AS taken FROM k), i AS (SELECT file, t, skipped, unnest(range(0, (taken // {N + 1})::BIGINT)) AS sample_idx FROM b)
SELECT file, sample_idx, md5(array_to_string(list_transform(string_split(substr(t, (skipped + sample_idx * {N + 1} + 1)::INT, {N + 1}), ''), lambda c: unicode(c)), ',')) AS ids_md5 FROM i""")
def ds_folder_budget(spark, d):
    """Samples from a folder of folders of token files under a skip and a budget of tokens;
    each is written by many tasks in ranges of documents, and read as one file."""
    register(spark)
    path = scratch(spark, "ds")
    for k in range(4):
        part = table(spark, d, "documents").where(F.col("doc_id") % 4 == k).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        part.select(char_ids(F.col("text")).alias("input_ids")).write.format("ds").option("token_size", 4).mode("append").save(f"{path}/{k}")
    read = spark.read.format("ds").option("sequence_length", N).option("skip_tokens", 1000).option("max_tokens", 1_000_000).option("with_folder", True).option("join_folders", True).load(path)
    return read.select(F.col("file").cast("long"), "sample_idx", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


@R.add("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT len(l)::BIGINT AS n_sequences, count(*) AS n_documents, sum(list_sum(list_transform(l, lambda x: length(x))))::BIGINT AS n_tokens FROM l GROUP BY 1")
def mmidx_documents(spark, d):
    """Lines as sequences of indexed documents, and how many documents have how many."""
    register(spark)
    path = scratch(spark, "mmidx")
    lines = table(spark, d, "documents").select(F.transform(F.split("text", "\n"), lambda x: char_ids(x)).alias("sequences"))
    lines.write.format("mmidx").mode("append").save(path)
    per = spark.read.format("mmidx").load(path).groupBy("file", "doc_id").agg(F.count("*").alias("n_sequences"), F.sum("size").alias("n"))
    return per.groupBy("n_sequences").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_tokens"))


@R.add("SELECT md5(CASE WHEN length(text) <= 3 THEN '' ELSE array_to_string(list_transform(string_split(substr(text, 4, 7), ''), lambda c: unicode(c)), ',') END) AS part, count(*) AS n FROM documents GROUP BY 1")
def mmidx_slices(spark, d):
    """Tokens 3 to 9 of every sequence, read as such a slice."""
    register(spark)
    path = scratch(spark, "mmidx")
    table(spark, d, "documents").select(char_ids(F.col("text")).alias("tokens")).write.format("mmidx").mode("append").save(path)
    read = spark.read.format("mmidx").option("offset", 3).option("length", 7).load(path)
    return read.groupBy(F.md5(F.array_join("tokens", ",")).alias("part")).agg(F.count("*").alias("n"))


@R.add("SELECT doc_id, lang AS domain, n_chars FROM documents")
def domains_from_disk(spark, d):
    """A folder per domain, each loaded with its name as a column."""
    path = scratch(spark, "domains")
    table(spark, d, "documents").select("doc_id", "n_chars", "lang").write.partitionBy("lang").parquet(path)
    domains = sorted(r.lang for r in table(spark, d, "documents").select("lang").distinct().collect())  # a row per domain
    return E.domain_folders(spark, {x: f"{path}/lang={x}" for x in domains}).select("doc_id", "domain", "n_chars")


@R.add(f"WITH {_SPANS}, i AS (SELECT unnest(range(0, (SELECT (sum(n) - 1) // 64 + 1 FROM s)::BIGINT)) AS sample_id) SELECT sample_id, doc_id, (sample_id * 64 - start)::BIGINT AS doc_offset FROM i JOIN s ON start <= sample_id * 64 AND sample_id * 64 < start + n")
def sample_index_cached(spark, d):
    """A sample index kept under the hash of its parameters, and read from there."""
    root = scratch(spark, "index")
    key = cache_key(table=d, sequence_length=64, seed=0)
    build = lambda: P.sample_index(table(spark, d, "documents"), 64)
    kept(spark, root, key, build)
    return kept(spark, root, key, None)


@R.add()
def tokenize_bpe(spark, d):
    """Subword ids of every text: how many, and their sum."""
    from ..functions.subwords import with_bpe_ids

    docs = with_bpe_ids(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


@R.add("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly_events(spark, d):
    """Hourly counts from a replayed event stream under a watermark that covers it."""
    from ..streaming import consumption as C

    schema = table(spark, d, "events").schema
    stream = C.table_stream(spark, d, "events", schema)
    return C.drained(C.hourly_events(stream, "3650 days"), scratch(spark, "stream"))
