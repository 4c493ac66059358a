"""Sample pipelines, loaders, sources and samplers against plain walks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.functions import prefix, schedule, subwords
from grainmill.operators import blend, evals, packing, samples, select
from grainmill.plans import catalog
from grainmill.plans.base import scratch
from grainmill.sources import cache, files, indexed, register
from grainmill.streaming import consumption


def test_running_sum_of_sparse_keys_and_nulls(spark):
    rng = random.Random(1)
    keys = [None, *{rng.randrange(-(2**63), 2**63) for _ in range(300)}]
    rows = [(k, rng.choice([None, *range(9)]), rng.choice([None, "a", "b"])) for k in keys]
    table = spark.createDataFrame(rows, "k long, v long, g string")
    for within in (None, ["g"]):
        got = {r.k: r.before for r in prefix.running_sum(table, "k", F.col("v"), "before", within=within).collect()}
        order = sorted(rows, key=lambda r: -(2**64) if r[0] is None else r[0])
        want = {k: sum(x[1] or 0 for x in order[:i] if not within or x[2] == g) for i, (k, _, g) in enumerate(order)}
        assert got == want
    assert prefix.position(table.limit(0), "k").collect() == []


def test_softmax_of_a_large_vocabulary(spark):
    rng = np.random.default_rng(0)
    logits = [[float(x) for x in rng.normal(size=20_000)] for _ in range(4)]
    rows = spark.createDataFrame([(x,) for x in logits], "l array<double>")
    got = rows.select(select.softmax(F.col("l"), 0.5).alias("p"), F.size(select.nucleus(select.softmax(F.col("l")), 0.9)).alias("n")).collect()
    for r, x in zip(got, logits, strict=True):
        e = np.exp((np.array(x) - max(x)) / 0.5)
        assert np.allclose(r.p, e / e.sum())
        e = np.exp(np.array(x) - max(x))
        assert abs(r.n - (np.cumsum(np.sort(e / e.sum())) > 0.1).sum()) <= 1


def test_chosen_is_proportional(spark):
    rows = spark.range(4000).select(F.array(*(F.struct(F.lit(w).alias("value"), F.lit(i).alias("idx")) for i, w in ((7, 1.0), (3, 3.0)))).alias("c"), ((F.col("id") + 0.5) / 4000).alias("u"))
    counts = {r.t: r["count"] for r in rows.select(select.chosen(F.col("c"), F.col("u")).alias("t")).groupBy("t").count().collect()}
    assert counts == {7: 1000, 3: 3000}


def test_domain_slots_fill_the_batch(spark):
    for counts in ([1, 1, 1, 997], [5, 5, 5, 5], [1, 300, 300, 300, 99]):
        rows = spark.createDataFrame([(f"d{i}", c) for i, c in enumerate(counts)], "key string, weight long")
        got = [r.n_samples for r in blend.domain_slots(rows, 16).collect()]
        assert sum(got) == 16 and min(got) >= 1


def test_mixture_errors(spark):
    docs = spark.createDataFrame([(1, "a", "train")], "doc_id long, source string, split string")
    with pytest.raises(ValueError):
        samples.mixture(docs, {"a": -0.1}, ["train"], "s")
    with pytest.raises(ValueError):
        samples.mixture(docs, {"a": 0.1}, ["validation"], "s")


@pytest.mark.parametrize("drop_last,n_samples", [(True, 20), (False, 20), (False, 3), (False, 37)])
def test_shuffled_samples_against_a_walk(spark, drop_last, n_samples):
    rng = random.Random(n_samples)
    texts = {i: "".join(rng.choices("abcdef", k=rng.choice([0, 1, 5, 17]))) for i in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = samples.shuffled_samples(docs, n_samples, 8, "t", drop_last).orderBy("sample_id").collect()
    tokens = sum(map(len, texts.values()))
    epochs = samples.epochs_for(tokens, n_samples, 8)
    apart = samples.last_epoch_apart(tokens, epochs, n_samples, 8)
    order = sorted((r.pos, r.doc_id) for r in samples.document_order(docs, epochs, apart, "t-docs").collect())
    assert [p for p, _ in order] == list(range(epochs * 12))
    stream = "".join(texts[i] for _, i in order)
    n = (len(stream) - 1) // 8 if drop_last else -(-(len(stream) - 1) // 8)
    assert n >= n_samples and [r.sample_id for r in got] == list(range(n)) and sorted(r.pos for r in got) == list(range(n))
    assert [(r.tokens, r.n_pad) for r in got] == [(stream[8 * i : 8 * i + 9], 9 - len(stream[8 * i : 8 * i + 9])) for i in range(n)]
    if apart:  # what the early epochs give is shuffled among itself
        early = ((epochs - 1) * tokens - 1) // 8
        assert {r.sample_id for r in got if r.pos < early} == set(range(early))


def test_weighted_epochs(spark):
    rows = samples.weighted_epochs(spark, [8, 2, 5, 5], [1, 5, 3, 1], 50, "w").orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(50)) and [(r.dataset_id, r.sample_id) for r in rows[:20]] == [(r.dataset_id, r.sample_id) for r in rows[20:40]]
    pattern = blend.greedy_pattern([1, 5, 3, 1], 20)
    assert sorted((r.dataset_id, r.sample_id) for r in rows[:20]) == sorted((d, pattern[:i].count(d) % [8, 2, 5, 5][d]) for i, d in enumerate(pattern))


def test_resumed_batches_are_the_fresh_ones(spark, sf):
    fresh, resumed = (catalog.queries()[k](spark, sf) for k in ("nanoset_batches", "nanoset_resume"))
    assert sorted(fresh.where("step >= 12").withColumn("step", F.col("step") - 12).select(*resumed.columns).collect()) == sorted(resumed.collect())
    assert fresh.groupBy("rank", "step").count().where("count != 4").isEmpty()


def fim_walk(text, doc, draw):
    def permuted(part, key):
        if draw(f"fimr-{key}") % 100 >= 50:
            return part
        lo, hi = sorted((draw(f"fima-{key}") % (len(part) + 1), draw(f"fimb-{key}") % (len(part) + 1)))
        return f"<P>{part[:lo]}<S>{part[hi:]}<M>{part[lo:hi]}"

    def marked(parts, mark, use):
        head = [use(p, i) + mark for i, p in enumerate(parts[:-1]) if p]
        return "".join(head) + use(parts[-1], len(parts) - 1)

    def document(part, i):
        if "." not in part:
            return permuted(part, f"{doc}/{i}")
        if draw(f"fimd-{doc}/{i}") % 100 >= 50:
            return part
        return marked(part.split("."), ".", lambda f, j: permuted(f, f"{doc}/{i}/{j}"))

    return marked(text.split("\n"), "\n", document)[: len(text)].ljust(len(text))


def test_fim_documents(spark):
    import hashlib

    rng = random.Random(9)
    texts = {i: "".join(rng.choices("ab.\n", k=rng.randint(0, 40))) for i in range(150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    draw = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:7], 16)
    assert {r.doc_id: r.text for r in packing.fim_documents(docs, ".").collect()} == {i: fim_walk(t, i, draw) for i, t in texts.items()}


def test_numpy_order(spark, sf):
    got = [r.doc_id for r in catalog.queries()["numpy_shuffle"](spark, sf).orderBy("pos").collect()]
    ids = np.array(sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()))
    np.random.RandomState(1234).shuffle(order := np.arange(len(ids)))
    assert got == ids[order].tolist()


def test_subwords(spark):
    from tokenizers import Tokenizer

    texts = ["", "one two", "<|endoftext|> é中", None]
    whole = Tokenizer.from_file(subwords.VOCABULARY)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", subwords.bpe_ids(spark)("t").alias("ids")).collect()
    assert {r.t: list(r.ids) for r in rows} == {t: whole.encode(t or "", add_special_tokens=False).ids for t in texts}


def test_token_files(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "ds")
    docs = spark.createDataFrame([([i] * 10,) for i in range(20)], "input_ids array<long>").coalesce(1)
    for part in ("a", "b"):
        docs.write.format("ds").option("max_file_tokens", 55).mode("append").save(f"{path}/{part}")
    found = files.listed(path, ".ds")
    assert len(found) == 8 and all(size == 100 for _, size in found)  # five documents of ten tokens, two bytes each
    assert len(files.listed(f"{path}/a", ".ds", depth=0)) == 4
    with pytest.raises(FileNotFoundError):
        files.listed(path, ".ds", depth=0)
    read = lambda **o: [r.file for r in spark.read.format("ds").options(sequence_length=49, with_folder=True, **o).load(path).collect()]
    names = read()
    assert read(file_seed=3) == [names[i] for i in np.random.default_rng(3).permutation(8)]
    files.require(path, names)
    with pytest.raises(FileNotFoundError):
        files.require(path, [*names, "none.ds"])


def test_indexed_documents(spark, tmp_path):
    register(spark)
    rows = [([[1, 2, 3], [], [4]],), ([],), ([[5]],)]
    spark.createDataFrame(rows, "sequences array<array<long>>").coalesce(1).write.format("mmidx").mode("append").save(str(tmp_path))
    got = spark.read.format("mmidx").load(str(tmp_path)).orderBy("seq_id").collect()
    assert [(r.doc_id, r.tokens) for r in got] == [(0, [1, 2, 3]), (0, []), (0, [4]), (2, [5])]
    cut = spark.read.format("mmidx").option("offset", 1).option("length", 1).load(str(tmp_path)).orderBy("seq_id").collect()
    assert [r.tokens for r in cut] == [[2], [], [], []]
    a, b = (indexed.parse_index(indexed.build_index(8, sizes, [0, len(sizes)])) for sizes in ([3, 1], [2]))
    merged = indexed.parse_index(indexed.merged_index(a, b))
    assert list(merged.sizes) == [3, 1, 2] and list(merged.pointers) == [0, 6, 8] and list(merged.documents) == [0, 2]


def test_kept_table(spark, tmp_path):
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    assert cache.kept(spark, str(tmp_path), "k", build).count() == cache.kept(spark, str(tmp_path), "k", build).count() == 3 and calls == [1]
    with pytest.raises(FileNotFoundError):
        cache.kept(spark, str(tmp_path), "other", None)


def test_streams(spark, sf, tmp_path):
    """A restart goes on where it stopped; an endless source wraps."""
    folder, docs = str(tmp_path / "in"), spark.read.parquet(f"{sf}/documents.parquet")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for part in (0, 1):
        docs.where(F.col("doc_id") % 2 == part).coalesce(1).write.mode("append").parquet(folder)
        stream = consumption.document_stream(spark, folder, docs.schema, glob="*.parquet").select("doc_id")
        stream.writeStream.format("parquet").option("checkpointLocation", mark).option("path", out).trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(out).count() == docs.where(F.col("doc_id") % 2 <= part).count()
    query = consumption.endless(spark, 7, 100).writeStream.format("memory").queryName("endless").trigger(processingTime="1 second").start()
    try:
        for _ in range(40):
            query.awaitTermination(0.5)
            if spark.table("endless").where("epoch > 0").count():
                break
    finally:
        query.stop()
    assert spark.table("endless").where("epoch > 0 and sample_id between 0 and 6").count()


def test_small_columns(spark):
    one = spark.range(1)
    assert one.select(schedule.init_scale(F.lit("NUM_LAYERS"), F.lit(2))).first()[0] == 2.0
    with pytest.raises(Exception, match="no init scale"):
        one.select(schedule.init_scale(F.lit("LAYER_INDEX"), F.lit(2))).collect()
    with pytest.raises(ValueError):
        evals.prompt("arc", "none", F.col("id"))
    line = one.select(F.struct(F.lit("Q?").alias("question"), F.lit(True).alias("answer")).alias("line"))
    assert line.select(evals.prompt("boolq", "cf", F.col("line")).alias("p")).first().p == ("Question: Q?\nAnswer:", [" yes", " no"], 0)
    assert scratch(spark, "x") != scratch(spark, "x")
