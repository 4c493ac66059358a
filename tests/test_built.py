"""Sinks, requests, listings, manifests, streams, blends and joins against plain walks."""

import dataclasses
import json
import os
import random
import re
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill import config
from grainmill.functions import prefix, tokens
from grainmill.operators import blend, build, collate, evals, intervals, packing, samples
from grainmill.sources import commits, csv_log, files, indexed, listing, manifest, register
from grainmill.streaming import consumption

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


# --- sinks


LOST = """
import sys
sys.path.insert(0, {root!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession
from grainmill.sources import register
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "100").getOrCreate()
register(spark)

def fails_once(batches):
    for i, batch in enumerate(batches):
        if i == 15 and TaskContext.get().partitionId() == 1 and TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("lost")
        yield batch

rows = spark.range(0, 4000, 1, 2).selectExpr("array_repeat(id % 1000, 100) AS tokens").mapInArrow(fails_once, "tokens array<long>")
rows.write.format("mmidx").mode("append").save({path!r} + "/m")
rows.withColumnRenamed("tokens", "input_ids").write.format("ds").mode("append").save({path!r} + "/d")
m = spark.read.format("mmidx").load({path!r} + "/m").selectExpr("sum(size)", "sum(aggregate(tokens, 0L, (a, x) -> a + x))").first()
d = spark.read.format("ds").option("sequence_length", 0).load({path!r} + "/d").selectExpr("count(*)", "sum(input_ids[0])").first()
print("READ", *m, *d)
"""


def test_a_lost_task_doubles_nothing(tmp_path):
    code = LOST.format(root=ROOT, path=str(tmp_path))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    total = sum(i % 1000 for i in range(4000)) * 100
    assert f"READ 400000 {total} 400000 {total}" in out.stdout, out.stderr[-3000:]
    left = [x for _, _, names in os.walk(tmp_path / "d" / commits.DATA) for x in names if x.endswith(".ds")]
    assert len(left) == 2  # the failed attempt's file is gone


def ids(spark, path, **options):
    return sorted(x for r in spark.read.format("ds").options(sequence_length=0, **options).load(path).collect() for x in r.input_ids)


def test_commits(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "ds")
    rows = lambda *v: spark.createDataFrame([([x],) for x in v], "input_ids array<long>")
    save = lambda mode, *v: rows(*v).write.format("ds").mode(mode).save(path)
    save("append", 1, 2)
    save("append", 3)
    assert ids(spark, path) == [1, 2, 3]
    os.makedirs(f"{path}/{commits.DATA}/writing/0")
    with open(f"{path}/{commits.DATA}/writing/0/0.ds", "wb") as f:  # of an attempt that isn't done
        f.write(np.array([9], "<u2").tobytes())
    with open(f"{path}/other.ds", "wb") as f:  # of somebody else
        f.write(np.array([7], "<u2").tobytes())
    assert ids(spark, path) == [1, 2, 3, 7]
    with pytest.raises(Exception):
        save("append", 1, -1)
    assert ids(spark, path) == [1, 2, 3, 7]
    save("overwrite", 5)
    assert ids(spark, path) == [5]
    save("append", 6)
    assert ids(spark, path) == [5, 6]
    with pytest.raises(FileNotFoundError):
        files.listed(path, ".none")


# --- indexed requests


def test_slices_read_few_bytes():
    rng = random.Random(1)
    sequences = [[rng.randrange(1000) for _ in range(rng.choice([0, 1, 50, 300]))] for _ in range(5000)]
    documents = [0, 0, *sorted(rng.sample(range(1, 5000), 900)), 5000]
    idx = indexed.build_index(4, [len(s) for s in sequences], documents)
    data = np.array([x for s in sequences for x in s], "<i4").tobytes()
    count = {"idx": 0, "bin": 0}

    def reader(raw, name):
        def read(start, size):
            count[name] += size
            return raw[start : start + size]
        return read

    index = indexed.IndexFile(reader(idx, "idx"))
    near = [(i, 2, 3) for i in range(4000, 4050)]
    got = indexed.slices(index, reader(data, "bin"), near)
    assert [g.tolist() for g in got] == [sequences[i][2:5] for i, _, _ in near]
    assert count["idx"] < 34 + 12 * 60 and count["bin"] < sum(len(sequences[i]) for i, _, _ in near) * 4 + 1
    count["bin"] = 0
    far = [(4999, 0, 2**62), (10, 5, 7), (10, 5, 7), (0, 10**9, 3), (2500, 0, 0)]
    assert [g.tolist() for g in indexed.slices(index, reader(data, "bin"), far)] == [sequences[4999], sequences[10][5:12], sequences[10][5:12], [], []]
    assert count["bin"] <= 4 * (300 + 7)
    want = [sum(b <= i for b in documents) - 1 for i in range(5000)]
    for first, stop in ((0, 5000), (17, 900), (4990, 5000), (3, 3)):
        assert index.documents(first, stop).tolist() == want[first:stop]


def test_requests(spark, tmp_path):
    register(spark)
    path = str(tmp_path)
    rows = [[i * 10 + k for k in range(i % 9)] for i in range(100)]
    spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, tokens array<long>").repartitionByRange(3, "i").sortWithinPartitions("i").select("tokens").write.format("mmidx").mode("append").save(path)
    wanted = [(0, 0, 5, "a"), (8, None, None, "b"), (8, 3, 2, "c"), (99, 0, 1, "d"), (100, 0, 1, "e"), (-1, 0, 1, "f"), (None, 0, 1, "g"), (8, 20, 1, "h"), (8, 3, 2, "c")]
    got = indexed.requested(spark, path, spark.createDataFrame(wanted, "seq_id long, offset long, length long, `tag x` string"))
    assert sorted(((r["tag x"], r.tokens) for r in got.collect()), key=repr) == sorted([("a", []), ("b", rows[8]), ("c", rows[8][3:5]), ("c", rows[8][3:5]), ("d", []), ("e", None), ("f", None), ("g", None), ("h", [])], key=repr)
    assert indexed.requested(spark, path, spark.createDataFrame([], "seq_id long, offset long, length long")).collect() == []


def test_stated_sizes(spark, tmp_path):
    register(spark)
    rows = spark.createDataFrame([([70_000, 1],)], "input_ids array<long>")
    save = lambda path, **o: rows.write.format("ds").options(**o).mode("append").save(f"{tmp_path}/{path}")
    save("a/x", token_size=4, tokenizer="t")
    assert ids(spark, f"{tmp_path}/a") == [1, 70_000]  # by the metadata beside the files
    with pytest.raises(Exception, match="out of range"):
        save("b", token_size=2)
    save("a/y", token_size=4, tokenizer="other")
    with pytest.raises(Exception, match="different tokenizers"):
        ids(spark, f"{tmp_path}/a")
    with pytest.raises(Exception, match="token_size 3"):
        save("c", token_size=3)


def test_pieces_of_a_long_file(spark, tmp_path, monkeypatch):
    """Ranges are streamed in pieces, wherever samples begin."""
    from grainmill.sources import token_files

    register(spark)
    spark.createDataFrame([(list(range(1000)),)], "input_ids array<long>").coalesce(1).write.format("ds").mode("append").save(str(tmp_path))
    monkeypatch.setattr(token_files, "PIECE", 64)
    reader = token_files.TokenFileReader({"path": str(tmp_path), "sequence_length": "6", "skip_tokens": "5", "positions": "true", "partition_tokens": "300"})
    parts = reader.partitions()
    batches = [b for p in parts for b in reader.read(p)]
    assert len(parts) > 1 and len(batches) > 10
    rows = [r for b in batches for r in b.to_pylist()]
    assert [r["input_ids"] for r in rows] == [list(range(a, a + 7)) for a in range(5, 995, 7)][: len(rows)] and len(rows) == 995 // 7
    assert [r["pos"] for r in rows] == [r["sample_idx"] for r in rows] == list(range(len(rows)))


def test_merged_folders(spark, tmp_path):
    register(spark)
    a, b, both, other = (str(tmp_path / x) for x in ("a", "b", "both", "other"))
    put = lambda path, rows, **o: spark.createDataFrame([(r,) for r in rows], "sequences array<array<long>>").coalesce(1).write.format("mmidx").options(**o).mode("append").save(path)
    put(a, [[[1, 2], [3]], []])
    put(b, [[[4]]])
    put(b, [[[5, 6, 7]]])
    put(other, [[[1]]], vocab_size=10)
    indexed.merge_indexed(spark, [a, b], both)
    rows = spark.read.format("mmidx").load(both).collect()
    assert sorted((r.file[:5], r.tokens) for r in rows) == [("00000", [1, 2]), ("00000", [3]), ("00001", [4]), ("00001", [5, 6, 7])]
    with pytest.raises(ValueError):
        indexed.merge_indexed(spark, [a, other], str(tmp_path / "no"))
    with pytest.raises(FileNotFoundError):
        files.listed(str(tmp_path / "no"), ".idx")


def test_a_log_of_many_runs(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/log.csv"
    rows = lambda i: spark.createDataFrame([(i, f'a "quoted", {i}'), (i, None)], "run int, note string")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: csv_log.append_csv(rows(i), path), range(8)))
    got = csv_log.read_csv(spark, path, "run int, note string")
    assert sorted((r.run, r.note or "") for r in got.collect()) == sorted([(i, f'a "quoted", {i}') for i in range(8)] + [(i, "") for i in range(8)])
    with open(f"{tmp_path}/log.csv") as f:
        assert f.read().count("run,note") == 1
    with pytest.raises(ValueError):
        csv_log.append_csv(spark.range(1), path)
    open(f"{tmp_path}/log.csv.lock", "w").close()
    with pytest.raises(csv_log.Locked):
        csv_log.append_csv(rows(9), path, wait=0.3)
    csv_log.append_csv(rows(9), path, wait=0.3, stale=0.0)
    assert not os.path.exists(f"{tmp_path}/log.csv.lock")


def test_filters_are_pushed(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    register(spark)
    spark.range(1000).selectExpr("array(id) AS tokens").coalesce(1).write.format("mmidx").mode("append").save(str(tmp_path))
    reader = indexed.IndexedReader({"path": str(tmp_path), "partition_sequences": "10"})
    assert sum(p.stop - p.first for p in reader.partitions()) == 1000
    asked = [GreaterThanOrEqual(("seq_id",), 95), LessThan(("seq_id",), 120)]
    assert list(reader.pushFilters(asked)) == asked
    assert [(p.first, p.stop) for p in reader.partitions()] == [(95, 105), (105, 115), (115, 120)]
    reader.pushFilters([EqualTo(("file",), "none")])
    assert [p.path for p in reader.partitions()] == [""]
    read = spark.read.format("mmidx").load(str(tmp_path))
    assert [r.tokens for r in read.where("seq_id between 7 and 8").orderBy("seq_id").collect()] == [[7], [8]]
    assert read.where("seq_id = 3").rdd.getNumPartitions() == 1


def test_ranges():
    rng = random.Random(2)
    for _ in range(200):
        spans = [(a, a + rng.randint(0, 20)) for a in (rng.randint(0, 300) for _ in range(rng.randint(0, 20)))]
        got = list(files.ranges(spans, 5, 60))
        assert sorted(i for _, _, m in got for i in m) == list(range(len(spans)))
        for start, stop, members in got:
            assert all(start <= spans[i][0] and spans[i][1] <= stop for i in members) and stop - start <= 60


# --- blends


def test_walked_blend_is_the_greedy_walk(spark):
    rng = random.Random(3)
    for weights in ([rng.randint(1, 10**6) for _ in range(20)], [0.123456789, 0.3, 0.576543211], [10**12 + 1, 10**9, 7]):
        whole = blend.integer_weights(weights)
        assert sum(whole) > blend.PERIOD
        want = blend.greedy_pattern(whole, 20_000)
        counts, rows = [0] * len(whole), []
        for i, ds in enumerate(want):
            rows.append((i, ds, counts[ds]))
            counts[ds] += 1
        assert [tuple(r) for r in blend.blend(spark, weights, 20_000).orderBy("pos").collect()] == rows


def test_blocks_that_began_elsewhere_are_walked_again(spark):
    rng = random.Random(4)
    weights = [int(rng.paretovariate(0.5) * 10) + 1 for _ in range(30)]
    n, block = 4000, 128
    want = blend.greedy_pattern(weights, n)
    first = {b: [want[: b * block].count(j) for j in range(30)] for b in range(-(-n // block))}
    assert any(blend.fair_counts(weights, b * block) != c for b, c in first.items())  # so that there is something to mend
    for warm_up in (0, 16):
        assert {r.block: r.counts for r in blend.block_starts(spark, weights, n, block, warm_up).collect()} == first


def test_weights():
    assert blend.integer_weights([0.1, 0.5, 0.3, 0.1]) == [1, 5, 3, 1] and blend.integer_weights([4, 6]) == [2, 3]
    with pytest.raises(ValueError):
        blend.integer_weights([0, 0])
    with pytest.raises(ValueError):
        blend.integer_weights([1, -1])


# --- running sums


@pytest.mark.parametrize("keys", [[*range(20_000), 2**60], [*range(0, -10_000, -1), *range(10**15, 10**15 + 10_000)], [i * i * i for i in range(20_000)]])
def test_blocks_are_even(spark, keys):
    rows = spark.createDataFrame([(k,) for k in keys], "k long").repartition(4)
    sizes = [r["count"] for r in prefix.with_block(rows, "k", 64).groupBy("_block").count().collect()]
    assert max(sizes) <= 2 * len(keys) / 64 and len(sizes) > 60
    got = prefix.position(rows, "k").agg(F.sum(F.col("pos") * 3), F.max("pos")).first()
    assert tuple(got) == (3 * sum(range(len(keys))), len(keys) - 1)
    order = [r.k for r in prefix.position(rows, "k").orderBy("pos").collect()]
    assert order == sorted(keys)


def test_totals_of_groups(spark):
    rows = spark.createDataFrame([(i, i % 3 or None, i) for i in range(90)], "k long, g long, v long")
    got = prefix.running_sum(rows, "k", F.col("v"), "s", within=["g"], total="t", dense=89).collect()
    for r in got:
        own = [i for i in range(90) if (i % 3 or None) == r.g]
        assert (r.s, r.t) == (sum(i for i in own if i < r.k), sum(own))


# --- rows without keys or groups


def test_null_keys_and_groups_stay(spark):
    rows = spark.createDataFrame([(None, "a", 1), (None, None, 2), (3, None, 3), (4, "a", 4), (5, "a", 5)], "id long, g string, v int")
    got = blend.shuffled_position(rows, F.md5(F.col("id").cast("string")), "pos", ["g"]).collect()
    assert sorted((r.g or "", r.pos) for r in got) == [("", 0), ("", 1), ("a", 0), ("a", 1), ("a", 2)] and {r.v for r in got} == {1, 2, 3, 4, 5}
    whole = samples.concatenated(rows, "g", "id").orderBy("global_id").collect()
    assert [r.global_id for r in whole] == list(range(5)) and [r.g for r in whole] == [None, None, "a", "a", "a"]
    texts = spark.createDataFrame([(None, "abc"), (1, None), (2, ""), (3, "defgh")], "doc_id long, text string")
    made = samples.shuffled_samples(texts, 2, 4, "n", drop_last=False).collect()  # two epochs, as samples share a token
    assert sorted("".join(r.tokens[:4] for r in made)) == sorted("abcdefgh" * 2) and len(made) == 4
    assert samples.shuffled_samples(texts.limit(0), 2, 4, "n").collect() == [] == samples.shuffled_samples(texts.where("doc_id = 2"), 2, 4, "n").collect()


def test_lookup_out_of_range(spark):
    data = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "global_id long, v string")
    lists = spark.createDataFrame([(1, [0, 5, 1]), (2, [9]), (3, []), (4, None), (5, [1, None, 2, 1])], "list_id long, ids array<long>")
    assert {r.list_id: r.vs for r in samples.looked_up(data, lists, "v").collect()} == {1: ["a", None, "b"], 2: [None], 3: [], 4: [], 5: ["b", None, None, "b"]}


def test_domain_batches_with_a_null_domain(spark):
    docs = spark.createDataFrame([(i, ["x", None, "y"][i % 3]) for i in range(60)], "doc_id long, d string")
    slots = blend.domain_slots(docs.groupBy("d").agg(F.count("*").alias("c")), 6, "d", "c").select("d", "n_samples")
    got = blend.domain_batches(docs, slots, "d", 3, 2, 1).collect()
    assert len(got) == 60 and {r.domain_idx for r in got if r.d is None} == {0}
    assert all(len({(r.rank, r.micro_batch, r.slot) for r in got if r.step == s}) == 6 for s in range(10))


# --- streams


def test_token_stream_wraps_and_restarts(spark, tmp_path):
    register(spark)
    docs = spark.createDataFrame([(i, "".join(random.Random(i).choices("abcde", k=i * 7 % 23))) for i in range(40)], "doc_id long, text string")
    path, out, mark = (str(tmp_path / x) for x in ("ds", "out", "mark"))
    one = docs.coalesce(1).sortWithinPartitions("doc_id").select(tokens.char_ids(F.col("text")).alias("input_ids"))
    one.write.format("ds").mode("append").save(path)
    n = packing.fixed_chunks(docs, 9).count()
    for _ in range(4):  # each query ends within an epoch
        stream = consumption.token_stream(spark, path, f"{mark}/progress", sequence_length=9, samples_per_batch=n * 3 // 5)
        consumption.appended(stream, out, f"{mark}/checkpoint")
    got = spark.read.parquet(out).orderBy("pos").collect()
    total = 4 * (n * 3 // 5)
    assert [r.pos for r in got] == list(range(total)) and [r.epoch for r in got] == [i // n for i in range(total)]
    chunks = {r.chunk_id: r.tokens for r in packing.fixed_chunks(docs, 9).collect()}
    assert ["".join(map(chr, r.input_ids)) for r in got] == [chunks[i % n] for i in range(total)]


def uncommit(checkpoint):
    """As if the query had stopped before it noted that its second batch is done."""
    for name in ("1", ".1.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")


def test_token_stream_after_a_crash(spark, tmp_path):
    """A batch was planned and promised but not committed: it is read again, once."""
    register(spark)
    path, out, mark = (str(tmp_path / x) for x in ("ds", "out", "mark"))
    spark.range(50).selectExpr("array(id) AS input_ids").coalesce(1).write.format("ds").mode("append").save(path)
    run = lambda: consumption.appended(consumption.token_stream(spark, path, f"{mark}/progress", sequence_length=0, samples_per_batch=20), out, f"{mark}/checkpoint")
    run()
    run()
    uncommit(f"{mark}/checkpoint")
    run()
    got = sorted(r.pos for r in spark.read.parquet(out).collect())
    assert got == list(range(len(got))) and len(got) >= 40
    with pytest.raises(Exception, match="no whole sample"):
        consumption.appended(consumption.token_stream(spark, path, f"{mark}/other", sequence_length=100), f"{out}2", f"{mark}/2")


def test_consumption_counts_each_row_once(spark, tmp_path):
    folder, state, mark = (str(tmp_path / x) for x in ("in", "state", "mark"))
    run = lambda: consumption.record_consumption(consumption.document_stream(spark, folder, "folder string, n long", glob="*.parquet"), state, mark)
    now = lambda: {r.folder: r.n for r in consumption.consumed(spark, state).collect()}
    assert now() == {}
    put = lambda *rows: spark.createDataFrame(rows, "folder string, n long").coalesce(1).write.mode("append").parquet(folder)
    put(("a", 3), ("b", 1), ("a", 2))
    run()
    put(("b", 4), ("c", 1))
    run()
    assert now() == {"a": 5, "b": 5, "c": 1}
    uncommit(mark)  # stopped after the state was written, before that was noted
    run()
    assert now() == {"a": 5, "b": 5, "c": 1}
    shutil.rmtree(f"{state}/v000000001")  # stopped while it was written
    uncommit(mark)
    run()
    assert now() == {"a": 5, "b": 5, "c": 1}
    order = spark.createDataFrame([(0, "a", 0), (1, "a", 1), (2, "d", 5)], "pos long, folder string, ordinal long")
    sizes = spark.createDataFrame([("a", 6), ("d", 4)], "folder string, size long")
    assert sorted(r.sample for r in blend.blended_lookup(order, sizes, consumption.consumed(spark, state)).collect()) == [0, 1, 5]


# --- builder and joins


def test_built_splits(spark):
    docs = spark.createDataFrame([(p, i, 1 + (i * 37) % 90) for p, n in (("a", 60), ("b", 25), ("unused", 5)) for i in range(n)], "prefix string, doc_id long, n_tokens long")
    want = {"train": 200, "valid": 0, "test": 20}
    rows = build.built_splits(docs, {"a": 0.6, "b": 0.4}, [0.7, 0.1, 0.2], want, 16, "t").collect()
    assert {s: sum(r.split == s for r in rows) for s in want} == want
    assert all(r.doc_id is not None and 0 <= r.doc_offset < 1 + (r.doc_id * 37) % 90 for r in rows)
    assert abs(sum(r.prefix == "a" for r in rows) / len(rows) - 0.6) < 0.05
    held = {r.doc_id: r.split for r in build.split_documents(docs.where("prefix = 'a'"), [0.7, 0.1, 0.2]).collect()}
    assert all(held[r.doc_id] == r.split for r in rows if r.prefix == "a")
    own = [r for r in rows if r.prefix == "b" and r.split == "train"]
    assert len({r.sample_id for r in own}) == len(own) and sorted(r["index"] for r in own) == list(range(len(own)))


def test_interval_join(spark):
    rng = random.Random(5)
    for longest in (3, 100, 10**12):
        make = lambda n: [(i, a, rng.choice([a, a + 1, a + rng.randint(-2, longest), None])) for i, a in ((i, rng.randint(-longest, longest)) for i in range(n))]  # noqa: B023, E731
        left, right = make(80), [*make(60), (100, -(10**13), 10**13), (101, None, 5)]
        tables = [spark.createDataFrame(x, "id long, lo long, hi long") for x in (left, right)]
        joined = intervals.interval_join(*tables)
        got = sorted((r.left.id, r.right.id, r.lo, r.hi) for r in joined.collect())
        fine = lambda x: None not in x and x[1] < x[2]
        assert got == sorted((a[0], b[0], max(a[1], b[1]), min(a[2], b[2])) for a in left if fine(a) for b in right if fine(b) and max(a[1], b[1]) < min(a[2], b[2]))
    assert not re.search("NestedLoop|Cartesian", joined._jdf.queryExecution().executedPlan().toString())


# --- listings and manifests


def test_a_kept_listing_is_not_made_again(spark, tmp_path, monkeypatch):
    register(spark)
    root, keep = str(tmp_path / "tree"), str(tmp_path / "keep")
    for folder in ("a", "a/b", "a/b/c", "d"):
        os.makedirs(f"{root}/{folder}")
        for k in range(3):
            with open(f"{root}/{folder}/{k}.ds", "wb") as f:
                f.write(b"\0\1" * (k + 1))
    spark.range(3).selectExpr("array(id) AS input_ids").coalesce(1).write.format("ds").mode("append").save(f"{root}/d")
    os.makedirs(f"{root}/d/{commits.DATA}/open/0")
    open(f"{root}/d/{commits.DATA}/open/0/x.ds", "wb").close()
    table, where = listing.kept_listing(spark, root, keep)
    every = {r.name: r.size for r in table.collect()}
    assert {n for n in every if n.endswith(".ds")} == {files.relative(p, root) for p, _ in files.listed(root, ".ds")} and every["a/b/2.ds"] == 6
    assert listing.read_listing(where, root, ".ds") == files.listed(root, ".ds")
    assert {r.name.count("/") for r in listing.walk(spark, root, str(tmp_path / "s"), depth=1).collect()} == {1}
    assert {r.name for r in listing.walk(spark, root, str(tmp_path / "t"), pattern=r"a/[0-9]\.ds").collect()} == {"a/0.ds", "a/1.ds", "a/2.ds"}
    monkeypatch.setattr(listing, "walk", lambda *_: pytest.fail("listed again"))
    assert {r.name: r.size for r in listing.kept_listing(spark, root, keep)[0].collect()} == every
    read = spark.read.format("ds").options(sequence_length=0, token_size=2, listing=where, pattern="a/b/.*").load(root)
    assert read.count() == 12


def test_manifests(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    assert manifest.latest_version(spark, path) == 0
    with pytest.raises(FileNotFoundError):
        manifest.resolve(spark, path)
    assert manifest.publish(spark, path, {"step": 1}) == 1
    assert manifest.publish(spark, path, {"step": 2}, after=1) == 2
    with pytest.raises(manifest.Conflict):
        manifest.publish(spark, path, {"step": "lost"}, after=1)
    with pytest.raises(ValueError):
        manifest.publish(spark, path, {}, after=7)
    assert manifest.resolve(spark, path) == {"step": 2} and manifest.resolve(spark, path, 1) == {"step": 1}
    os.remove(f"{tmp_path}/m/latest")  # a pointer that is stale or gone costs a listing
    assert manifest.latest_version(spark, path) == 2
    with open(f"{tmp_path}/m/000000003.json", "w") as f:
        json.dump({"format": 99, "version": 3, "content": {}}, f)
    with pytest.raises(ValueError):
        manifest.resolve(spark, path)
    assert not [n for n in os.listdir(f"{tmp_path}/m") if n.endswith(".part")]


def test_two_writers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/m"

    def write(who):
        won = 0
        for step in range(6):
            try:
                manifest.publish(spark, path, {"who": who, "step": step}, after=step)
                won += 1
            except (manifest.Conflict, ValueError):
                pass
        return won

    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(write, range(4)))
    last = manifest.latest_version(spark, path)
    assert sum(won) == last >= 1 and [manifest.resolve(spark, path, v)["step"] for v in range(1, last + 1)] == list(range(last))


# --- settings, collators, evaluation lines


def test_overridden_classes():
    @dataclasses.dataclass(frozen=True)
    class Stage(config.DataStage):
        note: str = ""

    run = {"stages": [{"name": "a", "start_training_step": 1, "note": "x"}], "batching": {"micro_batch_size": 1, "ranks": 1}, "train_steps": 5}
    with pytest.raises(ValueError):
        config.from_dict(config.Run, run)
    assert config.from_dict(config.Run, run, {config.DataStage: Stage}).stages[0].note == "x"
    with pytest.raises(ValueError):
        config.from_dict(config.Run, run, {config.DataStage: config.Batching})


def test_collators(spark):
    rows = spark.createDataFrame([([1, 2, 3, 4, 5], [0, 1, 2, 0, 1], "b"), ([6, 7, 8, 9, 0], [0, 1, 2, 3, 4], None)], "ids array<long>, pos array<long>, domain string")
    first = collate.collate(rows, "documents", length=4).first()
    assert (first.input_ids, first.label_ids, first.position_ids, first.label_mask) == ([1, 2, 3, 4], [2, 3, 4, 5], [0, 1, 2, 0], [True, True, False, True])
    names = spark.createDataFrame([("a", 0), ("b", 1)], "domain string, domain_idx long")
    assert sorted(r.domain_idx for r in collate.collate(rows, "domains", length=4, names=names).collect()) == [-1, 1]
    with pytest.raises(ValueError):
        collate.collate(rows, "none")
    with pytest.raises(ValueError):
        collate.collator("causal")(lambda s: s)

    @collate.collator("of_the_test")
    def own(samples, k):
        return samples.withColumn("k", F.lit(k))

    assert collate.collate(rows, "of_the_test", k=3).first().k == 3


def test_unreadable_lines(spark):
    line = spark.createDataFrame([("{no json",), (None,)], "line string")
    for family in evals.FAMILIES:
        for form in ("cf", "mcf", "hybrid"):
            assert [r.p.prompt for r in line.select(evals.json_prompt(family, form, F.col("line")).alias("p")).collect()] == [None, None]


def test_topk_mask_of_random_rows(spark):
    rng = random.Random(6)
    rows = [(g, i, rng.randint(1, 6), rng.choice([0.0, 0.5, 1.0, 2.0])) for g in range(60) for i in range(rng.randint(1, 9))]
    table = spark.createDataFrame(rows, "g int, i int, rank int, mask double")
    for k, percent in ((2, 100), (1, 50), (3, 0), (1, 34)):
        want = {}
        for g in range(60):
            own = [r for r in rows if r[0] == g]
            active = [r for r in own if r[3] > 0]
            out = sorted((r for r in active if r[2] > k), key=lambda r: (-r[2], r[1]))[: int(percent / 100 * len(active))]
            if len(out) == len(active):
                out = []
            want |= {(g, r[1]): 0.0 if r in out else r[3] for r in own}
        assert {(r.g, r.i): r.new_mask for r in collate.topk_loss_mask(table, k, percent, "g", "i").collect()} == want


