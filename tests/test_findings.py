"""What the reviewer's third round found: each would have failed before."""

from pyspark.sql import functions as F

from grainmill.operators import collate, shard
from grainmill.plans import catalog
from grainmill.sources import register
from grainmill.streaming import consumption


def folder_of_parts(spark, d, name, df, parts):
    """A table as a folder of several files."""
    df.repartition(parts).write.parquet(f"{d}/{name}.parquet")
    return str(d)


def test_merged_parts_of_several_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "ab\nc" if i % 2 else "xyz", [None, "en", "de"][i % 3], "s", 4) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    d = folder_of_parts(spark, tmp_path, "documents", docs, 4)
    got = {r.part: (r.n_documents, r.n_sequences, r.n_tokens) for r in catalog.queries()["mmidx_merged"](spark, d).collect()}
    assert got == {None: (10, 15, 30), True: (10, 15, 30), False: (10, 15, 30)}


def test_a_tail_is_shared_by_no_ranks(spark, tmp_path):
    docs = spark.range(5).selectExpr("id AS doc_id", "'a' AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    d = folder_of_parts(spark, tmp_path, "documents", docs, 2)
    assert [r.shared for r in catalog.queries()["intersect_ranks"](spark, d).collect()] == [0]
    rows = spark.range(5).select(F.col("id").alias("pos"), (F.col("id") + 10).alias("doc_id"))
    got = shard.strided(rows, "pos", 4, 5, drop_last=False, fill_last=False, keep=("doc_id",)).collect()
    assert sorted((r["rank"], r.ordinal, r.pos, r.doc_id) for r in got) == [(0, 0, 0, 10), (0, 1, 4, 14), (1, 0, 1, 11), (2, 0, 2, 12), (3, 0, 3, 13)]


def test_streams_of_tables_in_folders(spark, sf, tmp_path):
    for table, query in (("documents", "streaming_consumption"), ("events", "stream_hourly_events")):
        own = spark.read.parquet(f"{sf}/{table}.parquet")
        d = folder_of_parts(spark, tmp_path, table, own, 3)
        run = lambda at: sorted(map(tuple, catalog.queries()[query](spark, at).collect()), key=repr)  # noqa: B023, E731
        assert run(d) == run(sf) != []


def test_indexed_batches_are_bounded_by_tokens(spark, tmp_path):
    """No token becomes a Python object, and long sequences come few at once."""
    import pyarrow as pa

    from grainmill.sources import files, indexed

    values, bounds = files.list_values(pa.array([[1, 2], None, [], [3]]).slice(1))
    assert values.to_pylist() == [3] and bounds.tolist() == [0, 0, 0, 1]
    register(spark)
    path = str(tmp_path / "mmidx")
    spark.range(30).selectExpr("array_repeat(id, 100000) AS tokens").coalesce(1).write.format("mmidx").mode("append").save(path)
    reader = indexed.IndexedReader({"path": path})
    (part,) = reader.partitions()
    batches = list(reader.read(part))
    assert max(b.num_rows for b in batches) == indexed.PIECE // 100000 and sum(b.num_rows for b in batches) == 30
    assert [set(t) for b in batches for t in b.column("tokens").to_pylist()] == [{i} for i in range(30)]
    cut = indexed.IndexedReader({"path": path, "offset": "99990", "length": "7"})
    assert [len(t) for b in cut.read(cut.partitions()[0]) for t in b.column("tokens").to_pylist()] == [7] * 30


def test_a_folder_of_files_read_as_one(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "ds")
    ids = [list(range(i * 7 % 50)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(ids)), "i long, input_ids array<long>")
    for k in range(2):
        docs.where(F.col("i") % 2 == k).repartitionByRange(5, "i").sortWithinPartitions("i").select("input_ids").write.format("ds").mode("append").save(f"{path}/{k}")
    whole = [[x for i in range(k, 60, 2) for x in ids[i]] for k in range(2)]
    for partition in (1, 30, 10**6):
        read = spark.read.format("ds").options(sequence_length=9, skip_tokens=25, max_tokens=len(whole[0]) + 88, join_folders="true", with_folder="true", partition_tokens=partition).load(path)
        got = {(r.file, r.sample_idx): list(r.input_ids) for r in read.collect()}
        taken = {"0": whole[0][25:], "1": whole[1][:113]}
        assert got == {(f, i): t[i * 10 : i * 10 + 10] for f, t in taken.items() for i in range(len(t) // 10)}


def test_budgeted_folders_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """All tokens of a folder went through one task."""
    from grainmill.plans import composed

    monkeypatch.setattr(composed, "scratch", lambda s, name: str(tmp_path / name))
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('ab', 20) AS text", "'en' AS lang", "'s' AS source", "40L AS n_chars")
    d = folder_of_parts(spark, tmp_path, "documents", docs, 4)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        composed.ds_folder_budget(spark, d)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(list((tmp_path / "ds" / "0").rglob("*.ds"))) > 1


def test_scanned_folders_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Four tasks wrote all tokens."""
    from grainmill.plans import files

    monkeypatch.setattr(files, "scratch", lambda s, name: str(tmp_path / name))
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('ab', 20) AS text", "'en' AS lang", "'s' AS source", "40L AS n_chars")
    d = folder_of_parts(spark, tmp_path, "documents", docs, 4)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = files.ds_folder_scan(spark, d)
        assert {r.file for r in got.select("file").distinct().collect()} == {f"{k:05d}" for k in range(4)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(list((tmp_path / "ds").rglob("*.ds"))) > 4


def test_subwords_in_small_batches(spark, monkeypatch):
    from tokenizers import Tokenizer

    from grainmill.functions import subwords

    monkeypatch.setattr(subwords, "TEXT_AT_ONCE", 20)
    assert [len(g) for g in subwords._groups(["a" * 15, "b" * 5, None, "c", "d" * 50, ""])] == [3, 1, 1, 1]
    texts = ["", "one two", "<|endoftext|> é中", None, "x" * 400]
    whole = Tokenizer.from_file(subwords.VOCABULARY)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = subwords.with_bpe_ids(docs).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == {i: whole.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_attention_sums_of_runs(spark):
    texts = ["ab\nc\n\ndefgh\n", "\n\n\n\n\n\n\n\n\n\n\n\n", "abcdefghijkl", "abcdefghijk\n"]
    for window in (None, 1, 3):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", F.slice(collate.line_positions(F.col("t"), F.lit(12)), 1, 10)).withColumn("r", collate.line_runs(F.col("t"), 10))
        got = rows.select("r", collate.attention_pairs("p", window).alias("x"), collate.pair_sums("r", window).alias("s")).collect()
        assert all((r.s.start, r.s.n_pairs, r.s.kv_sum) == (10, len(r.x), sum(x.kv for x in r.x)) for r in got)
    n = 1 << 17  # its pairs would be 8.6 billion
    long = spark.createDataFrame([([n],)], "r array<int>").select(collate.pair_sums("r").alias("s")).first().s
    assert tuple(long) == (n, n * (n + 1) // 2, sum(q * (q + 1) // 2 for q in range(n)))


def test_sliding_window_sums_of_a_long_row(spark):
    n, back = 1 << 17, 1 << 16  # its pairs would be 6.4 billion
    long = spark.createDataFrame([([n],)], "r array<int>").select(collate.pair_sums("r", back).alias("s")).first().s
    keys = [(max(q - back, 0), q) for q in range(n)]
    assert tuple(long) == (n, sum(b - a + 1 for a, b in keys), sum((a + b) * (b - a + 1) // 2 for a, b in keys))


def test_positions_of_a_long_padded_row(spark):
    """A pass for each token would be 4e10 steps."""
    n = 200_000
    row = spark.range(1).select(F.concat(F.array_repeat(F.lit(0).cast("long"), n // 2), F.array_repeat(F.lit(7).cast("long"), n // 2)).alias("ids"))
    p = row.select(collate.left_pad_positions("ids", 0).alias("p")).select(F.size("p"), F.element_at("p", 1), F.element_at("p", n // 2 + 1), F.element_at("p", -1)).first()
    assert tuple(p) == (n, 0, 0, n // 2 - 1)
    small = spark.createDataFrame([([0, 0, 5, 6],), ([5, 6],), ([0, 0],), ([],)], "ids array<long>").select(collate.left_pad_positions("ids", 0).alias("p"))
    assert [list(r.p) for r in small.collect()] == [[0, 0, 0, 1], [0, 1], [0, 0], []]


def test_a_zero_in_a_padded_text(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "u", "a\x00b"), (1, 1, "u", "abcde"), (None, 0, "u", "xy"), (2, 0, "u", "")], "conv_id long, turn int, role string, text string")
    d = folder_of_parts(spark, tmp_path, "conversations", turns, 2)
    got = {tuple(r) for r in catalog.queries()["left_pad_positions"](spark, d).collect()}
    assert got == {(1, 0, 2, 2, 3), (1, 1, 0, 4, 10), (None, 0, 0, 1, 1)}


def test_streamed_sums_keep_no_tokens(spark, tmp_path):
    """Less is written than the stream has tokens; a batch that runs again counts once."""
    import os

    register(spark)
    path, out, mark = (str(tmp_path / x) for x in ("ds", "out", "mark"))
    spark.range(4000).selectExpr("array_repeat(id, 10) AS input_ids").coalesce(1).write.format("ds").mode("append").save(path)
    sums = lambda ids: ids.groupBy("epoch").agg(F.count("*").alias("tokens"), F.sum(F.col("input_ids")[0]).alias("s"))
    stream = lambda: consumption.token_stream(spark, path, f"{mark}/progress", sequence_length=0, samples_per_batch=30_000, max_samples=80_000)
    for k in range(4):
        consumption.summed(stream(), sums, out, f"{mark}/checkpoint")
        if k == 1:
            for name in ("1", ".1.crc"):
                os.remove(f"{mark}/checkpoint/commits/{name}")
    got = {r.epoch: (r.n, r.s) for r in spark.read.parquet(out).groupBy("epoch").agg(F.sum("tokens").alias("n"), F.sum("s").alias("s")).collect()}
    assert got == dict.fromkeys((0, 1), (40_000, 10 * sum(range(4000))))
    assert sum(os.path.getsize(os.path.join(a, f)) for a, _, fs in os.walk(out) for f in fs) < 80_000


def test_token_epochs_write_sums_alone(spark, sf, monkeypatch):
    monkeypatch.setattr(consumption, "appended", None)
    assert catalog.queries()["stream_token_epochs"](spark, sf).count() == 2


def test_short_last_samples_are_kept(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "ds")
    spark.range(37).selectExpr("array(id) AS input_ids").coalesce(1).write.format("ds").mode("append").save(path)
    for partition in (1, 20, 10**6):
        read = spark.read.format("ds").options(sequence_length=9, keep_rest="true", skip_tokens=3, max_tokens=33, partition_tokens=partition).load(path)
        assert {r.sample_idx: list(r.input_ids) for r in read.collect()} == {i: list(range(3 + 10 * i, min(13 + 10 * i, 36))) for i in range(4)}
