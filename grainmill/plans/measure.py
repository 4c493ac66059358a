"""Queries of statistics, formulas, strings, grids and shard algebra."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import schedule as Q
from ..functions.prefix import running_sum
from ..functions.tokens import shuffle_key
from ..operators import stats as A
from .base import Registry, table

R = Registry()

_V = "v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS pos FROM embeddings)"


def _values(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


_KURT = "CASE WHEN stddev_samp(x) > 0 THEN (kurtosis_pop(x) + 3) * pow((count(*) - 1) / count(*), 2) - 3 ELSE 0 END"
_STATS = f"round(avg(x), 5)::DOUBLE AS mean, round(stddev_samp(x), 5)::DOUBLE AS std, round(min(x), 5)::DOUBLE AS min, round(max(x), 5)::DOUBLE AS max, round(sum(abs(x)), 5)::DOUBLE AS l1, round(sqrt(sum(x * x)), 5)::DOUBLE AS l2, round(avg((abs(x) < 1e-10)::INT), 5)::DOUBLE AS zero_fraction, round({_KURT}, 5)::DOUBLE AS kurtosis"


@R.add(f"WITH {_V} SELECT label, {_STATS} FROM v GROUP BY label")
def tensor_stats(spark, d):
    return _values(spark, d).groupBy("label").agg(*A.rounded(A.tensor_stats(F.col("x"))))


@R.add(f"WITH {_V} SELECT vec_id, round({_KURT}, 5)::DOUBLE AS kurtosis FROM v GROUP BY vec_id")
def excess_kurtosis(spark, d):
    return _values(spark, d).groupBy("vec_id").agg(F.round(A.excess_kurtosis(F.col("x")), 5).alias("kurtosis"))


@R.add(f"WITH {_V} SELECT label, pos // 8 AS head, round(avg(x), 5)::DOUBLE AS mean, round(stddev_samp(x), 5)::DOUBLE AS std, round(max(x), 5)::DOUBLE AS max, round(min(x), 5)::DOUBLE AS min FROM v GROUP BY ALL")
def per_head_stats(spark, d):
    x = F.col("x")
    return _values(spark, d).groupBy("label", F.floor(F.col("pos") / 8).cast("long").alias("head")).agg(*A.rounded({"mean": F.avg(x), "std": F.stddev_samp(x), "max": F.max(x), "min": F.min(x)}))


@R.add("""SELECT l_linenumber::BIGINT AS layer, l_returnflag AS component, count(*) AS n, round(avg(l_quantity), 5)::DOUBLE AS mean, round(stddev_samp(l_quantity), 5)::DOUBLE AS std, round(max(l_extendedprice), 2)::DOUBLE AS highest
FROM lineitem GROUP BY GROUPING SETS ((l_linenumber, l_returnflag), (l_returnflag), ())""")
def stats_grouping_sets(spark, d):
    """Per layer and component, per component, and over all, in one pass."""
    t = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("layer"), F.col("l_returnflag").alias("component"), F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p"))
    g = t.groupingSets([["layer", "component"], ["component"], []], "layer", "component")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("q"), 5).alias("mean"), F.round(F.stddev_samp("q"), 5).alias("std"), F.round(F.max("p"), 2).alias("highest"))


@R.add("""WITH n AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS s, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS m FROM embeddings WHERE vec_id % 10 <> 1)
SELECT round(sqrt(sum(s)), 5)::DOUBLE AS norm, round(max(m), 5)::DOUBLE AS largest, round(least(1.0, 1.0 / (sqrt(sum(s)) + 1e-6)), 6)::DOUBLE AS coefficient FROM n""")
def grad_norm_clip(spark, d):
    """Norm over all parameters, tied ones (every tenth to its neighbour) once."""
    e = table(spark, d, "embeddings").withColumn("tie", F.when(F.col("vec_id") % 10 == 1, F.col("vec_id") - 1).otherwise(F.col("vec_id")))
    once = e.where("tie = vec_id").select(F.explode("embedding").alias("x")).select(F.col("x").cast("double").alias("x"))
    total = A.norm(F.col("x"))
    return once.agg(F.round(total, 5).alias("norm"), F.round(A.norm(F.col("x"), float("inf")), 5).alias("largest"), F.round(A.clip_coefficient(total, 1.0), 6).alias("coefficient"))


@R.add("SELECT k AS label, count(label) AS n FROM (SELECT unnest(range(0, 14)) AS k) LEFT JOIN embeddings ON k = label GROUP BY k")
def bincount(spark, d):
    counts = table(spark, d, "embeddings").groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"))
    return A.zero_filled(counts, "label", 14)


@R.add("SELECT o_orderkey AS step, round(o_totalprice * 128 / 7.5, 4)::DOUBLE AS tokens_per_s, round(o_totalprice * 128 / 7.5 / 16, 4)::DOUBLE AS per_gpu FROM orders")
def throughput(spark, d):
    rate = F.col("o_totalprice").cast("double") * 128 / 7.5
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("step"), F.round(rate, 4).alias("tokens_per_s"), F.round(rate / 16, 4).alias("per_gpu"))


@R.add("""WITH t AS (SELECT 'suite' || (l_suppkey % 5) || ':task' || (l_partkey % 40) AS task, l_discount::DOUBLE AS acc FROM lineitem), p AS (SELECT 'suite' || unnest(range(0, 6)) AS prefix)
SELECT prefix, round(coalesce(avg(acc), 0), 6)::DOUBLE AS acc FROM p LEFT JOIN t ON contains(task, prefix || ':') GROUP BY prefix""")
def eval_average(spark, d):
    """Mean accuracy of the tasks whose name holds a prefix, 0 without any."""
    t = table(spark, d, "lineitem").select(F.concat(F.lit("suite"), F.col("l_suppkey") % 5, F.lit(":task"), F.col("l_partkey") % 40).alias("task"), F.col("l_discount").cast("double").alias("acc"))
    per = t.groupBy("task").agg(F.sum("acc").alias("s"), F.count("*").alias("n"))  # before the prefixes multiply rows
    prefixes = F.broadcast(spark.range(6).select(F.concat(F.lit("suite"), "id").alias("prefix")))
    hits = prefixes.join(per, F.contains("task", F.concat("prefix", F.lit(":"))), "left")
    return hits.groupBy("prefix").agg(F.round(F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.0)), 6).alias("acc"))


@R.add("SELECT l_linestatus AS folder, CASE WHEN sum(l_quantity) > 0 THEN round(100.0 * sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 2) ELSE 0 END::DOUBLE AS percent FROM lineitem GROUP BY 1")
def ratio_percent(spark, d):
    q = F.col("l_quantity").cast("double")
    share = F.round(100.0 * F.sum(F.when(F.col("l_returnflag") == "R", q).otherwise(0.0)) / F.nullif(F.sum(q), F.lit(0.0)), 2)
    return table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("folder")).agg(F.coalesce(share, F.lit(0.0)).alias("percent"))


@R.add("SELECT event_type AS timer, count(*) AS n, round(sum(value), 4)::DOUBLE AS total, round(avg(value), 6)::DOUBLE AS mean FROM events GROUP BY 1")
def timer_summary(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("timer")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


_LR = "SELECT step, style, round(CASE WHEN step <= 100 THEN 3e-4 * step / 100 WHEN step < 400 THEN 3e-4 WHEN step < 900 THEN 3e-5 + (3e-4 - 3e-5) * CASE style WHEN 'cosine' THEN (1 + cos(pi() * (step - 400) / 500)) / 2 WHEN 'linear' THEN 1 - (step - 400) / 500 ELSE 1 - sqrt((step - 400) / 500) END ELSE 3e-5 END, 12)::DOUBLE AS lr FROM (SELECT unnest(range(0, 1000)) AS step), (SELECT unnest(['cosine', 'linear', '1-sqrt']) AS style)"


@R.add(_LR)
def lr_schedule(spark, d):
    """Warm-up, plateau, three kinds of decay, floor."""
    steps = spark.range(1000).withColumnRenamed("id", "step")
    each = [steps.select("step", F.lit(s).alias("style"), F.round(Q.learning_rate(F.col("step"), 3e-4, 3e-5, 100, 400, 500, s), 12).alias("lr")) for s in ("cosine", "linear", "1-sqrt")]
    return each[0].unionByName(each[1]).unionByName(each[2])


_MODELS = [(24, 2048, 16, 16, 49152, 4096, 8192), (32, 4096, 32, 8, 131072, 8192, 14336), (80, 8192, 64, 8, 128256, 8192, 28672)]
_MODELS_SQL = "m AS (SELECT * FROM (VALUES " + ", ".join(map(str, _MODELS)) + ") AS t(layers, hidden, heads, kv_heads, vocab, len, ffn))"


def _models(spark):
    return spark.createDataFrame(_MODELS, "layers long, hidden long, heads long, kv_heads long, vocab long, len long, ffn long")


@R.add(f"""WITH {_MODELS_SQL}, f AS (SELECT layers, hidden, 3.0::DOUBLE * 4 * len * (layers * (2.0::DOUBLE * hidden * heads * (hidden // heads) + 2.0::DOUBLE * hidden * 2 * kv_heads * (hidden // heads) + 2.0::DOUBLE * heads * len * (hidden // heads) * 2 + 2.0::DOUBLE * heads * (hidden // heads) * hidden + 6.0::DOUBLE * hidden * ffn) + 2.0::DOUBLE * hidden * vocab) AS flops FROM m)
SELECT layers::BIGINT AS layers, hidden::BIGINT AS hidden, round(flops / 1e9, 3)::DOUBLE AS gflops, round(flops / (2.5 * 64 * 1e12), 6)::DOUBLE AS tflops_per_gpu FROM f""")
def flops(spark, d):
    """Model FLOPs of a step of four sequences, and the rate of 64 devices in 2.5 s."""
    m = _models(spark)
    f = Q.model_flops(*(F.col(c).cast("double") for c in ("layers", "hidden", "heads", "kv_heads", "vocab", "len", "ffn")), F.lit(4.0))
    return m.select("layers", "hidden", F.round(f / 1e9, 3).alias("gflops"), F.round(f / (2.5 * 64 * 1e12), 6).alias("tflops_per_gpu"))


@R.add(f"""WITH {_MODELS_SQL} SELECT layers::BIGINT AS layers, tied, (vocab::BIGINT * hidden * CASE WHEN tied THEN 1 ELSE 2 END + layers * (3 * hidden::BIGINT * ffn + (2 + 2 * kv_heads / heads) * hidden * hidden))::BIGINT AS params,
(4 * heads * (hidden // heads) * hidden::BIGINT + 3 * ffn::BIGINT * hidden)::BIGINT AS block_cost, (ceil(vocab / 1024) * 1024)::BIGINT AS padded_vocab FROM m, (SELECT unnest([true, false]) AS tied)""")
def estimate_params(spark, d):
    m = _models(spark).withColumn("tied", F.explode(F.array(F.lit(True), F.lit(False))))
    p = Q.parameters(*(F.col(c) for c in ("layers", "hidden", "heads", "kv_heads", "vocab", "ffn", "tied")))
    cost = Q.block_cost(F.col("heads"), F.floor(F.col("hidden") / F.col("heads")), F.col("hidden"), F.col("ffn"))
    return m.select("layers", "tied", p.cast("long").alias("params"), cost.cast("long").alias("block_cost"), Q.padded_vocab(F.col("vocab"), 128, 8).alias("padded_vocab"))


@R.add("""WITH x AS (SELECT unnest([5, 999, 1000, 1234, 56789, 999499, 1500000, 2500000000, 7100000000000]) AS x), k AS (SELECT x, round(x * pow(10.0, 2 - floor(log10(x)))) / pow(10.0, 2 - floor(log10(x))) AS k FROM x),
p AS (SELECT x, k, CASE WHEN k >= 1e12 THEN 4 WHEN k >= 1e9 THEN 3 WHEN k >= 1e6 THEN 2 WHEN k >= 1e3 THEN 1 ELSE 0 END AS p FROM k)
SELECT x, regexp_replace(regexp_replace(printf('%.6f', round(k / pow(1000.0, p), 6)), '0+$', ''), '\\.$', '') || ['', 'K', 'M', 'B', 'T'][p + 1] AS text FROM p""")
def human_format(spark, d):
    x = spark.createDataFrame([(v,) for v in (5, 999, 1000, 1234, 56789, 999499, 1500000, 2500000000, 7100000000000)], "x long")
    return x.select("x", Q.human_format(F.col("x")).alias("text"))


@R.add("SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.2fB', n::DOUBLE) WHEN n < 1048576 THEN printf('%.2fKB', round(n / 1024.0::DOUBLE, 2)) ELSE printf('%.2fMB', round(n / 1048576.0::DOUBLE, 2)) END AS text FROM (SELECT doc_id, n_chars * 50 AS n FROM documents)")
def size_format(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.size_format(F.col("n_chars") * 50).alias("text"))


@R.add("""WITH f AS (SELECT l_orderkey, l_linenumber, l_linestatus, l_suppkey + 1 AS fan_in, l_partkey + 1 AS fan_out FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(CASE l_linestatus WHEN 'O' THEN 0.001 * fan_out * 4 / fan_in ELSE 0.001 * fan_out / (fan_in * 4) END, 13)::DOUBLE AS lr,
round(0.02 / sqrt(fan_in) * least(1.0, sqrt(fan_out / fan_in)), 13)::DOUBLE AS std FROM f""")
def mup_lr(spark, d):
    """Spectral rates and deviations of layers with such fan-ins and fan-outs."""
    kind = F.when(F.col("l_linestatus") == "O", "column").otherwise("row")
    fan_in, fan_out = F.col("l_suppkey") + 1, F.col("l_partkey") + 1
    rate, std = Q.mup_rate(0.001, kind, fan_in, fan_out, 4), Q.spectral_std(0.02, fan_in, fan_out)
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round(rate, 13).alias("lr"), F.round(std, 13).alias("std"))


@R.add("SELECT method, layers, round(CASE method WHEN 'NUM_LAYERS' THEN sqrt(2.0 * layers) ELSE 1.0 END, 9)::DOUBLE AS scale FROM (SELECT unnest(['NONE', 'NUM_LAYERS']) AS method), (SELECT unnest(range(1, 100)) AS layers)")
def init_scale(spark, d):
    m = spark.range(1, 100).select(F.col("id").alias("layers"), F.explode(F.array(F.lit("NONE"), F.lit("NUM_LAYERS"))).alias("method"))
    return m.select("method", "layers", F.round(Q.init_scale(F.col("method"), F.col("layers")), 9).alias("scale"))


@R.add("""WITH a AS (SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) * pow(10.0, vec_id % 7 - 1) * CASE WHEN vec_id % 11 = 0 THEN 0 ELSE 1 END AS amax FROM embeddings), e AS (SELECT *, CASE WHEN amax > 0 THEN floor(log2(448.0 / amax)) END AS e FROM a)
SELECT vec_id, CASE WHEN amax <= 0 THEN 3.0 WHEN e < 0 THEN 1 / pow(2.0, abs(e)) ELSE pow(2.0, e) END::DOUBLE AS scale FROM e""")
def fp8_scale(spark, d):
    amax = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))) * F.pow(F.lit(10.0), F.col("vec_id") % 7 - 1) * F.when(F.col("vec_id") % 11 == 0, 0).otherwise(1)
    return table(spark, d, "embeddings").select("vec_id", Q.fp8_scale(amax, F.lit(3.0), 448.0).alias("scale"))


_ACT = "0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x)))"


def _erf_sql(x):
    return f"(sign({x}) * (1 - (1 / (1 + 0.3275911 * abs({x}))) * (0.254829592 + (1 / (1 + 0.3275911 * abs({x}))) * (-0.284496736 + (1 / (1 + 0.3275911 * abs({x}))) * (1.421413741 + (1 / (1 + 0.3275911 * abs({x}))) * (-1.453152027 + (1 / (1 + 0.3275911 * abs({x}))) * 1.061405429)))) * exp(-({x}) * ({x}))))"


_ACTS = {"gelu_tanh": _ACT, "gelu_fast": "0.5 * x * (1 + tanh(x * 0.7978845608 * (1 + 0.044715 * x * x)))", "quick_gelu": "x / (1 + exp(-1.702 * x))", "clipped_gelu": f"greatest(least({_ACT}, 1.0), -0.1)", "silu": "x / (1 + exp(-x))",
         "mish": "x * tanh(ln(1 + exp(x)))", "linear": "x", "relu_squared": "pow(greatest(x, 0), 2)", "gelu": f"0.5 * x * (1 + {_erf_sql('(x / sqrt(2))')})", "laplace": f"0.5 * (1 + {_erf_sql('((x - 0.707107) / (0.282095 * sqrt(2)))')})"}


@R.add(f"WITH {_V} SELECT label, " + ", ".join(f"round(sum({e}), 5)::DOUBLE AS {n}" for n, e in _ACTS.items()) + " FROM v GROUP BY label")
def activations(spark, d):
    """Sums of each activation over the values of a label."""
    return _values(spark, d).groupBy("label").agg(*(F.round(F.sum(c), 5).alias(n) for n, c in Q.activations(F.col("x")).items()))


@R.add("WITH l AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS l FROM embeddings) SELECT vec_id, round(list_sum(list_transform(l, lambda x: x / sqrt(list_sum(list_transform(l, lambda y: y * y)) / len(l) + 1e-5))), 5)::DOUBLE AS normed_sum FROM l")
def rms_norm(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("l"))
    mean = F.aggregate("l", F.lit(0.0), lambda a, x: a + x * x) / F.size("l")
    return e.select("vec_id", F.round(F.aggregate("l", F.lit(0.0), lambda a, x: a + x) / F.sqrt(mean + 1e-5), 5).alias("normed_sum"))


@R.add("SELECT page_id, regexp_extract(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/+', '/', 'g'), '^([^/]*)', 1) AS bucket, regexp_extract(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/+', '/', 'g'), '^[^/]*/(.*)$', 1) AS prefix FROM pages")
def path_components(spark, d):
    """Bucket and prefix of a path, double slashes as one."""
    flat = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "/+", "/")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(flat, "^([^/]*)", 1).alias("bucket"), F.regexp_extract(flat, "^[^/]*/(.*)$", 1).alias("prefix"))


@R.add("SELECT page_id, url FROM pages WHERE regexp_full_match(regexp_replace(url, '^https?://', ''), '[^/]+/en/[0-9]+\\.html')")
def file_listing(spark, d):
    """Paths that a pattern matches in full."""
    return table(spark, d, "pages").where(F.regexp_replace("url", "^https?://", "").rlike(r"^[^/]+/en/[0-9]+\.html$")).select("page_id", "url")


@R.add("SELECT doc_id, regexp_matches('model.' || source || '.' || lang, '^(?:model\\.src1|.*norm)') AND lang <> 'de' AS excluded FROM documents")
def weight_decay_exclude(spark, d):
    """Names that a list of patterns matches at their start."""
    name = F.concat_ws(".", F.lit("model"), "source", "lang")
    patterns = [r"model\.src1", r".*norm"]
    return table(spark, d, "documents").select("doc_id", (name.rlike("^(?:" + "|".join(patterns) + ")") & (F.col("lang") != "de")).alias("excluded"))


@R.add("SELECT item_id, 'ds' || item_id % 3 AS dataset, 'sub' || item_id % 5 AS subset FROM benchmark")
def string_ops_eval_key(spark, d):
    """Dataset and subset from a task key |dataset:subset|."""
    key = F.concat(F.lit("|ds"), F.col("item_id") % 3, F.lit(":sub"), F.col("item_id") % 5, F.lit("|0"))
    return table(spark, d, "benchmark").select("item_id", F.regexp_extract(key, r"\|([^:|]*):([^|]*)\|", 1).alias("dataset"), F.regexp_extract(key, r"\|([^:|]*):([^|]*)\|", 2).alias("subset"))


@R.add("SELECT doc_id, doc_id % 4 AS pp, doc_id % 3 AS dp, doc_id % 2 AS tp FROM documents")
def regex_shard_ranks(spark, d):
    """Ranks from a shard's file name."""
    path = F.format_string("optimizer_pp-%d-of-4_dp-%d-of-3_tp-%d-of-2.pt", F.col("doc_id") % 4, F.col("doc_id") % 3, F.col("doc_id") % 2)
    return table(spark, d, "documents").select("doc_id", *(F.regexp_extract(path, rf"{k}-(\d+)-of", 1).cast("long").alias(k) for k in ("pp", "dp", "tp")))


@R.add("SELECT doc_id, printf('model/layers/%d/weight_pp-rank-%d-of-4_tp-rank-%d-of-2.safetensors', doc_id % 12, doc_id % 4, doc_id % 2) AS path, doc_id % 12 AS layer, doc_id % 2 AS tp FROM documents")
def shard_path_parse(spark, d):
    path = F.format_string("model/layers/%d/weight_pp-rank-%d-of-4_tp-rank-%d-of-2.safetensors", F.col("doc_id") % 12, F.col("doc_id") % 4, F.col("doc_id") % 2)
    return table(spark, d, "documents").select("doc_id", path.alias("path"), F.regexp_extract(path, r"layers/(\d+)/", 1).cast("long").alias("layer"), F.regexp_extract(path, r"tp-rank-(\d+)-of", 1).cast("long").alias("tp"))


@R.add("SELECT doc_id, md5('{\"doc\":' || doc_id || ',\"seed\":42}') AS cache_key, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 100000000)::BIGINT AS fixture_hash FROM documents")
def hash_md5(spark, d):
    key = F.to_json(F.struct(F.col("doc_id").alias("doc"), F.lit(42).alias("seed")))
    return table(spark, d, "documents").select("doc_id", F.md5(key).alias("cache_key"), (F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("long") % 100_000_000).alias("fixture_hash"))


@R.add("SELECT lang, source, (count(*) FILTER (doc_id % 2 = 0) + count(*) FILTER (doc_id % 2 = 1))::BIGINT AS n FROM documents GROUP BY ALL")
def map_merge_sum(spark, d):
    """Two maps of counts merged with 0 for a missing key."""
    counts = table(spark, d, "documents").groupBy("lang", "source", (F.col("doc_id") % 2).alias("half")).agg(F.count("*").alias("n"))
    side = lambda h: F.map_from_entries(F.collect_list(F.when(F.col("half") == h, F.struct("source", "n"))))
    maps = counts.groupBy("lang").agg(side(0).alias("a"), side(1).alias("b"))
    merged = F.map_zip_with("a", "b", lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return maps.select("lang", F.explode(merged).alias("source", "n"))


@R.add("SELECT source AS task, 'acc' AS metric, round(avg(n_chars), 4)::DOUBLE AS value FROM documents GROUP BY source UNION ALL SELECT source, 'best', max(n_chars)::DOUBLE FROM documents GROUP BY source")
def eval_metrics_flatten(spark, d):
    """Nested results by task and metric, errors of metrics left out."""
    m = table(spark, d, "documents").groupBy("source").agg(F.create_map(F.lit("acc"), F.round(F.avg("n_chars"), 4), F.lit("best"), F.max("n_chars").cast("double"), F.lit("acc_stderr"), F.lit(0.0)).alias("m"))
    return m.select(F.col("source").alias("task"), F.explode("m").alias("metric", "value")).where(~F.col("metric").endswith("_stderr"))


@R.add("SELECT o_orderkey, CASE WHEN s >= 86400 THEN (s // 86400) || CASE WHEN s // 86400 = 1 THEN ' day, ' ELSE ' days, ' END ELSE '' END || (s % 86400 // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS eta FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS s FROM orders)")
def eta_format(spark, d):
    s = F.floor(F.col("o_totalprice").cast("double")).cast("long")
    days = F.floor(s / 86400)
    clock = F.format_string("%d:%02d:%02d", F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60)
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.when(days == 1, "1 day, ").when(days > 1, F.concat(days.cast("string"), F.lit(" days, "))).otherwise(""), clock).alias("eta"))


@R.add("SELECT doc_id, doc_id * 3 AS a, doc_id * 3 + 5 AS b, doc_id * 7 AS c, doc_id * 7 + 2 AS d FROM documents")
def slice_pairs(spark, d):
    """Local and global slices to text and back."""
    text = F.format_string("slice(%d,%d,None)|slice(%d,%d,None)", F.col("doc_id") * 3, F.col("doc_id") * 3 + 5, F.col("doc_id") * 7, F.col("doc_id") * 7 + 2)
    n = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", *(F.element_at(n, i + 1).cast("long").alias(k) for i, k in enumerate("abcd")))


@R.add("SELECT doc_id, 'model_' || source || '.weight' AS name, 'run_2024_' || doc_id || '.log' AS log FROM documents")
def regex_fix_names(spark, d):
    """A doubled part of a name once, and a filled-in template."""
    broken = F.concat(F.lit("model_model_"), "source", F.lit(".weight.weight"))
    fixed = F.regexp_replace(F.regexp_replace(broken, "^(model_)+", "model_"), r"(\.weight)+$", ".weight")
    log = F.replace(F.replace(F.lit("run_%date_%jobid.log"), F.lit("%date"), F.lit("2024")), F.lit("%jobid"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", fixed.alias("name"), log.alias("log"))


@R.add("SELECT doc_id, source, n_chars FROM documents")
def metadata_to_json(spark, d):
    """Metadata to JSON and back through its paths."""
    j = F.to_json(F.struct(F.struct("doc_id", "n_chars").alias("meta"), "source"))
    return table(spark, d, "documents").withColumn("j", j).select(F.get_json_object("j", "$.meta.doc_id").cast("long").alias("doc_id"), F.get_json_object("j", "$.source").alias("source"), F.get_json_object("j", "$.meta.n_chars").cast("long").alias("n_chars"))


@R.add("SELECT doc_id, '| ' || rpad(source, 8, ' ') || ' | ' || rpad(lang, 4, ' ') || ' | ' || rpad(n_chars::VARCHAR, 8, ' ') || ' |' AS line FROM documents")
def format_table_row(spark, d):
    cells = [F.rpad(F.col("source"), 8, " "), F.rpad(F.col("lang"), 4, " "), F.rpad(F.col("n_chars").cast("string"), 8, " ")]
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


@R.add("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN item_id % 4 ELSE item_id % 26 END AS gold FROM benchmark")
def gold_index(spark, d):
    """The answer's index from a digit (from 1) or a letter."""
    key = F.when(F.col("item_id") % 2 == 0, (F.col("item_id") % 4 + 1).cast("string")).otherwise(F.char(F.col("item_id") % 26 + 65))
    b = table(spark, d, "benchmark").withColumn("key", key)
    gold = F.when(F.col("key").rlike("^[0-9]+$"), F.expr("try_cast(key as bigint)") - 1).otherwise((F.ascii("key") - 65).cast("long"))
    return b.select("item_id", gold.alias("gold"))


_TASKS = {"arc": 2, "mmlu": 57, "hellaswag": 1, "piqa": 1, "winogrande": 1, "openbookqa": 1, "commonsenseqa": 1, "boolq": 1}


@R.add("SELECT family || ':' || subset || '|' || form AS task FROM (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _TASKS.items()) + ") AS t(family, n)), LATERAL (SELECT unnest(range(0, n)) AS subset), (SELECT unnest(['mcf', 'cf', 'hybrid']) AS form)")
def eval_task_grid(spark, d):
    """Families and their subsets in three formulations."""
    f = spark.createDataFrame(list(_TASKS.items()), "family string, n int")
    each = f.withColumn("subset", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("form", F.explode(F.array(*(F.lit(x) for x in ("mcf", "cf", "hybrid")))))
    return each.select(F.concat("family", F.lit(":"), "subset", F.lit("|"), "form").alias("task"))


@R.add("SELECT name, row_number() OVER (ORDER BY regexp_extract(name, '([0-9]+)$', 1)::BIGINT) AS place FROM (SELECT DISTINCT source AS name FROM documents)")
def sort_numeric_names(spark, d):
    """Folders in the order of the number they end in."""
    names = table(spark, d, "documents").select(F.col("source").alias("name")).distinct().withColumn("k", F.regexp_extract("name", "([0-9]+)$", 1).cast("long"))
    return running_sum(names, "k", F.lit(1), "before").select("name", (F.col("before") + 1).alias("place"))


_GRID = """g AS (SELECT dp, tp, pp, mbs, zero FROM (SELECT unnest([1, 2, 4, 8, 16]) AS dp), (SELECT unnest([1, 2, 4, 8]) AS tp), (SELECT unnest([1, 2, 4]) AS pp), (SELECT unnest([1, 2, 4]) AS mbs), (SELECT unnest([0, 1]) AS zero)
WHERE dp * tp * pp BETWEEN 8 AND 64 AND NOT (dp = 1 AND zero = 1) AND mbs >= pp - 1)"""


def _grid(spark):
    one = lambda name, values: F.explode(F.array(*(F.lit(v) for v in values))).alias(name)
    g = spark.range(1).select(one("dp", (1, 2, 4, 8, 16)))
    for name, values in (("tp", (1, 2, 4, 8)), ("pp", (1, 2, 4)), ("mbs", (1, 2, 4)), ("zero", (0, 1))):
        g = g.select("*", one(name, values))
    return g.where("dp * tp * pp between 8 and 64 and not (dp = 1 and zero = 1) and mbs >= pp - 1").distinct()


@R.add(f"WITH {_GRID} SELECT DISTINCT dp, tp, pp, mbs, zero, (dp * tp * pp)::INT AS gpus FROM g")
def grid_cross_filter(spark, d):
    """Configurations of a sweep that pass its filters."""
    return _grid(spark).withColumn("gpus", F.col("dp") * F.col("tp") * F.col("pp"))


@R.add(f"WITH {_GRID} SELECT dp, tp, pp, mbs, zero FROM g WHERE dp IN (2, 8) AND mbs IN (1, 4)")
def bench_grid(spark, d):
    return _grid(spark).where(F.col("dp").isin(2, 8) & F.col("mbs").isin(1, 4))


@R.add(f"""WITH {_GRID}, n AS (SELECT *, 'run-' || dp || '-' || tp || '-' || pp || '-' || mbs || '-' || zero AS name FROM g), o AS (SELECT name, 14097000 + row_number() OVER (ORDER BY md5('old-' || name)) AS job_id FROM n WHERE substr(md5('done-' || name), 1, 1) < '8')
SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.name = n.name AND (n.pp = 1 OR o.job_id >= 14097150))""")
def grid_anti_prior(spark, d):
    """Configurations without an earlier result that counts."""
    from ..operators.blend import shuffled_position

    named = _grid(spark).withColumn("name", F.concat_ws("-", F.lit("run"), "dp", "tp", "pp", "mbs", "zero"))
    done = named.where(F.substring(shuffle_key(F.col("name"), "done"), 1, 1) < "8").select("name")
    old = shuffled_position(done, shuffle_key(F.col("name"), "old"), "p").select(F.col("name").alias("old_name"), (F.col("p") + 14097001).alias("job_id"))
    return named.join(old, (F.col("name") == F.col("old_name")) & ((F.col("pp") == 1) | (F.col("job_id") >= 14097150)), "left_anti")


@R.add("SELECT d.doc_id, d.n_chars AS weight_decay, l.quality AS lr FROM documents d JOIN labels l USING (doc_id)")
def param_groups_merge(spark, d):
    """Settings of two lists of parameters, zipped by name."""
    return table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("weight_decay")).join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("lr")), "doc_id")


@R.add("SELECT md5(text) AS tied, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def tied_groups(spark, d):
    """Parameters of the same content, tied to the first."""
    return table(spark, d, "documents").groupBy(F.md5("text").alias("tied")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@R.add("SELECT source, count(DISTINCT lang) = 1 AS synced FROM documents GROUP BY source")
def assert_synced(spark, d):
    return table(spark, d, "documents").groupBy("source").agg((F.countDistinct("lang") == 1).alias("synced"))


@R.add("SELECT vec_id, s AS shard, md5(array_to_string(list_transform(embedding[s * 16 + 1 : s * 16 + 16], lambda x: round(x::DOUBLE, 4)::DECIMAL(10, 4)), ',')) AS values_md5 FROM embeddings, (SELECT unnest(range(0, 4)) AS s)")
def reshard_1d(spark, d):
    """Rows cut in 8 shards of a first topology, merged and cut again in 4."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("flat", "x"))
    old = e.select("vec_id", F.floor(F.col("flat") / 8).alias("old_shard"), (F.col("flat") % 8).alias("local"), "x")
    flat = F.col("old_shard") * 8 + F.col("local")
    new = old.select("vec_id", F.floor(flat / 16).cast("long").alias("shard"), flat.alias("flat"), "x")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("flat", "x"))), lambda s: F.round(s["x"].cast("double"), 4).cast("decimal(10,4)").cast("string"))
    return new.groupBy("vec_id", "shard").agg(F.md5(F.array_join(parts, ",")).alias("values_md5"))


@R.add("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text <> ''")
def zero_merge_roundtrip(spark, d):
    """Flat values cut in five slices by offset and put together again."""
    from ..operators.shard import zero_partition

    docs = table(spark, d, "documents").where("text != ''").select("doc_id", "text", F.length("text").alias("n"))
    cuts = zero_partition(docs, 5, "doc_id", "n").join(docs, "doc_id")
    slices = cuts.select("doc_id", "start", F.substring(F.col("text"), (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")).alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda s: s["part"]), "")
    return slices.groupBy("doc_id").agg(F.md5(whole).alias("text_md5"))


@R.add("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY ALL")
def ext_tumbling(spark, d):
    """Hourly windows."""
    w = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@R.add("""WITH e AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE AS gap FROM events), s AS (SELECT *, sum(coalesce(gap, true)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_session(spark, d):
    """Sessions of a user that end after half an hour of silence."""
    s = table(spark, d, "events").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), "n")
