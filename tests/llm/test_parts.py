"""Pieces that the operators are made of, the classifier and the pipeline."""

import collections
import os
import random
import tempfile

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainmill.llm import common, induced_sort, jaccard, packing, quality, streams


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=60) | st.text("ab", min_size=1, max_size=60).map(str.encode), st.sampled_from([(3, 2, 1), (17, 5, 4), (10**6, 1 << 16, 1 << 12)]))
def test_induced_sort(text, bounds):
    """The exact order and common prefixes, with queues, blocks and windows of a few rows too."""
    in_memory, block, window = bounds
    with tempfile.TemporaryDirectory() as folder, pytest.MonkeyPatch.context() as patch:
        patch.setattr(induced_sort, "BLOCK", block)
        patch.setattr(induced_sort, "WINDOW", window)
        path = os.path.join(folder, "t")
        with open(path, "wb") as f:
            f.write(text)
        got = [(int(i), int(n)) for at, shared in induced_sort.suffix_blocks(path, folder, 6, in_memory) for i, n in zip(at, shared, strict=True)]
        assert os.listdir(folder) == ["t"]
    order = sorted(range(len(text)), key=lambda i: text[i:], reverse=True)
    shared = [0] + [next((n for n in range(6) if text[a + n : a + n + 1] != text[b + n : b + n + 1] or not text[a + n : a + n + 1]), 6) for a, b in zip(order, order[1:], strict=False)]
    assert got == list(zip(order, shared, strict=True))


def test_induced_sort_beyond_memory(tmp_path):
    """A text of some hundred times what a queue may hold, with long repeats."""
    rng = random.Random(4)
    line = bytes(rng.choices(b"abcdef", k=3000))
    text = b"".join(line[a : a + rng.randint(1, 400)] for a in (rng.randrange(3000) for _ in range(400)))
    (tmp_path / "t").write_bytes(text)
    got = [int(i) for at, _ in induced_sort.suffix_blocks(str(tmp_path / "t"), str(tmp_path), 50, 500) for i in at]
    assert got == sorted(range(len(text)), key=lambda i: text[i:], reverse=True) and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_shared_flags():
    rng = random.Random(1)
    for _ in range(300):
        rows = sorted((rng.randrange(6), rng.randrange(4)) for _ in range(rng.randrange(40)))
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(4))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in p], pa.int64()) for i in (0, 1)], ["k", "m"]) for p in parts]
        got = [(int(k), int(m), bool(f), int(x)) for c, flags, first in streams.shared_flags(batches, 1) for k, m, f, x in zip(*c, flags, first, strict=True)]
        members = {k: {m for j, m in rows if j == k} for k, _ in rows}
        assert got == [(k, m, len(members[k]) > 1, min(members[k])) for k, m in rows]


def test_id_set(spark):
    ids = spark.range(0, 3000, 3)
    held = streams.id_set(ids, "id", 1000)
    assert held.holds(np.arange(0, 3000, 3)).all() and held.holds(np.arange(1, 3000, 3)).mean() < 0.2


def test_piecewise_ids():
    from tokenizers import Tokenizer

    rng = random.Random(1)
    parts = [*" \n\t\r aB1'.,!<|>é中\0", " the", " it's", "<|endoftext|>", "\n\n", " \n", "  "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)] + ["", " ", "a ", " a", "a  b"]
    whole = Tokenizer.from_file(packing.tokenizer_path())
    for ranks in (None, packing.tokenizer_path("byte_bpe_50k.tiktoken")):
        got = packing.Ids(packing.tokenizer_path(), ranks).of(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_isotonic():
    fit = quality.pool_adjacent(np.array([0.1, 0.5, 0.3, 0.9, 0.2]), np.ones(5))
    assert (np.diff(fit) >= 0).all() and np.allclose(fit, [0.1, 0.4, 0.4, 0.55, 0.55])


def test_statistics_are_per_text():
    texts = [b"", b"one two two", b"A!! B!!\nc", "é中".encode(), b" "]
    together = quality.statistics(texts)
    assert np.allclose(together, np.concatenate([quality.statistics([t]) for t in texts])) and not together[0].any() and np.isfinite(together).all()


def test_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score_documents(docs, labels)
    judged = got.where("held_out").join(labels, "doc_id").select(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert judged > 0.9
    assert got.where("score is null or score < 0 or score > 1 or predicted != cast(score >= 0.3 as int)").count() == 0
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.score_documents(docs, flipped).collect()}
    assert again == {r.doc_id: r.score for r in got.collect()}  # held-out labels are not read


def test_quality_odd(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert quality.score_documents(docs, labels).count() == docs.count()
    assert all(r.score == 0.5 for r in quality.score_documents(docs, labels.limit(0)).collect())
    assert quality.score_documents(empty, labels).collect() == []
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_pipeline(spark, sf):
    """Stage by stage on its own input: what goes, and that the rest is untouched."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from grainmill.llm import decontaminate, jaccard, line_dedup

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("n_lines", F.lit("mine")).withColumn("items", F.lit(7)).cache()
    stages = dict(pipeline.STAGES)
    assert [k for k, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, sf)
        assert out.dtypes == docs.dtypes, name
        if name != "line_dedup":
            assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}, name
    labels, bench = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(stages["quality"](spark, docs, sf)) == ids(quality.score_documents(docs, labels).where("predicted = 1"))
    assert ids(stages["near_duplicates"](spark, docs, sf)) == ids(jaccard.similar_components(docs).where("doc_id = component_id"))
    assert ids(stages["decontamination"](spark, docs, sf)) == ids(decontaminate.contamination(docs.select("doc_id", "text"), bench).where("not contaminated"))
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs.select("doc_id", "text")).collect()}
    changed = stages["line_dedup"](spark, docs, sf).collect()
    assert {r.doc_id: r.text for r in changed} == texts and all(r.n_lines == "mine" and r["items"] == 7 and r.n_chars == len(r.text) for r in changed)
    assert pipeline.run(spark, sf).count() > 0


def test_keys_are_packed_whatever_the_partitions():
    """Round 3, op5: first keys took 13 to 15 bytes each, more the more partitions."""
    from grainmill.llm import jaccard

    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2**63, 200_000, dtype=np.uint64)
    keys[::7] = keys[3]  # one key that very many sets have
    keys[1::11] = keys[::11][: len(keys[1::11])]
    sets = np.repeat(rng.integers(0, 2**48, 2_000), 100)
    for partitions in (12, 51, 211):
        buckets = jaccard.BUCKETS * partitions
        parts = [jaccard._packed([(keys[i::2], sets[i::2])], buckets) for i in range(2)]
        assert all(sum(c.nbytes for c in p.columns[1:3]) < 11 * 100_000 for p in parts)
        rows = pa.Table.from_batches([*parts, jaccard._noted(3, np.array([[7], [8], [-1]]))]).sort_by("bucket")
        pairs = {(int(k >> np.uint64(32)) % buckets << 32 | int(k) & 0xFFFFFFFF, s) for k, s in zip(keys, sets.tolist(), strict=True)}
        owners = collections.Counter(k for k, _ in pairs)
        want = {(k, s, 0) for k, s in pairs if owners[k] > 1} | {(7, 8, -1)}
        for most in (1 << 21, 50):  # of a bucket at once, and some keys at a time
            got = [r for b in jaccard._mixed(rows.to_batches(max_chunksize=100), most) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            assert set(got) == want


def test_shards_of_repeats_are_sorted_in_batches_and_parts():
    """Round 3, op7: a shard's segments were told apart row by row; minimizers and spans
    took objects and whole places. Any batches and parts give what one batch gives."""
    from grainmill.llm import suffix_dedup

    rng = random.Random(9)
    base = ["".join(rng.choices("abc ", k=300)).encode() for _ in range(6)]
    texts = [b[rng.randrange(40) : 300 - rng.randrange(40)] + rng.choice(base)[:120] for b in base for _ in range(4)]
    rows = []
    for doc, text in enumerate(texts):
        h, start, end, place = suffix_dedup.segments_of(text)
        found = suffix_dedup._described_segments(text, h, 50, 20)
        ends = np.cumsum(found[3])
        rows += [(int(found[0][i]), int(found[1][i]), doc, doc + 100, int(found[2][i]), int(found[4][i]), int(found[5][i]), found[6][ends[i] - found[3][i] : ends[i]].tobytes()) for i in range(len(h))]
        low = [suffix_dedup.PolyHash(41)]
        low = low[0].ranges(low[0].prefix(np.frombuffer(text, np.uint8)), np.arange(len(text) - 19), np.arange(20, len(text) + 1))
        assert [int(np.argmin(low[i : i + 31])) + i for i in start] == place.tolist()
    rows.sort(key=lambda r: r[:3])
    names = ["hash", "digest", "doc", "cls", "start", "left", "right", "bytes"]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    table = pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    strings = {}
    for doc, text in enumerate(texts):
        for i in range(len(text) - 49):
            strings.setdefault(text[i : i + 50], []).append((doc, i))
    want = {(doc, j) for places in strings.values() for doc, i in places if doc > places[0][0] for j in range(i, i + 50)}
    for size in (1, 7, 10_000):
        for part in (0, 100, 4 << 20):
            spans = [r for b in suffix_dedup._repeats(table.to_batches(max_chunksize=size), 50, 400_000, part) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            assert {(doc, j) for doc, cls, start, stop in spans for j in range(start, stop)} == want
            assert all(cls == doc + 100 for doc, cls, _, _ in spans)


def test_batches_are_bounded_by_bytes(spark):
    """Batches of long texts, up to 64 MB each, took an executor's memory; who sets a bound keeps it."""
    spark.conf.unset(common.BATCH_SETTING)
    common.ship(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    texts = spark.range(30).selectExpr("repeat('x', 1000000) AS text").coalesce(1)
    got = texts.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 30 and max(r.size for r in got) <= common.BATCH + 1_100_000
    try:
        spark.conf.set(common.BATCH_SETTING, "1234567")
        common.ship(spark)
        assert spark.conf.get(common.BATCH_SETTING).startswith("1234567")
    finally:
        spark.conf.unset(common.BATCH_SETTING)


def test_near_duplicates_carry_their_texts_once(spark, docs):
    """Rows that may have another near them went to Python with two copies of their text."""
    plan = jaccard.one_of_each(docs)._jdf.queryExecution().analyzed().toString()
    inputs = [line for line in plan.splitlines() if "Project" in line and "AS carried#" in line and "xxhash64" in line]
    assert inputs and not any("[doc_id#" in line or ", text#" in line.split("xxhash64")[0] for line in inputs)


def test_segments_of_texts_in_a_row_are_those_of_each():
    """Round 3, op7: texts were cut one by one, and segments sorted that share 35 bytes."""
    from grainmill.llm import suffix_dedup

    rng = random.Random(4)
    texts = [b"", b"x" * 49, b"x" * 50, b"x" * 200, *("".join(rng.choices("ab c", k=rng.choice([10, 60, 500]))).encode() for _ in range(20)), b"", b"y"]
    *got, of = (c.tolist() for c in suffix_dedup.segments_in(texts))
    want = []
    for k, text in enumerate(texts):
        begin = sum(map(len, texts[:k]))
        want += [(h, a + begin, b + begin, at + begin, k) for h, a, b, at in zip(*(c.tolist() for c in suffix_dedup.segments_of(text)), strict=True)]
    assert list(zip(*got, of, strict=True)) == want
    for k, text in enumerate(texts):
        hit = [p for h, a, b, at, i in want if i == k for p in range(a, b - 49)]
        begin = sum(map(len, texts[:k]))
        assert hit == list(range(begin, begin + len(text) - 49))
    assert [(a, b) for a, b in suffix_dedup._blocks(texts, 100)][-1][1] == len(texts)


def test_segments_that_share_too_few_bytes_are_not_sorted(tmp_path):
    """Of a string the bytes before and behind its minimizer vary, one document's own don't count."""
    from grainmill.llm import suffix_dedup

    rng = random.Random(5)
    text = bytes(rng.choices(range(97, 123), k=80))
    for before in range(31):
        for shared, docs, kept in ((50, (1, 2), True), (40, (1, 2), False), (50, (1, 1), False)):
            low, high = 30 - before, 30 - before + shared  # the minimizer stands at 30
            other = bytes(c if low <= i < high else 65 + i % 26 for i, c in enumerate(text))
            if not (low <= 30 and 50 <= high):
                continue
            path = tmp_path / "shard"
            path.write_bytes(text + other)
            rows = np.array([[80 * i, doc, 0, 80, 7, 1, 30] for i, doc in enumerate(docs)])
            assert suffix_dedup._in_context(str(path), rows, 50, 20).tolist() == [kept] * 2
