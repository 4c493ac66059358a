"""Golden cases, invariants and random cross-checks of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from grainmill.operators import blend, collate, packing, select, shard
from grainmill.sources import indexed


# Fixed values in the tests below: worked examples whose answers are given.


def test_greedy_example():
    weights = blend.integer_weights([0.1, 0.5, 0.3, 0.1])
    assert weights == [1, 5, 3, 1]
    assert blend.greedy_pattern(weights, 20) == [1, 2, 0, 1, 3, 1, 2, 1, 2, 1, 0, 1, 2, 1, 3, 1, 2, 1, 2, 1]


@pytest.mark.parametrize("weights", [[8, 2], [5, 3, 2], [1, 5, 3, 1], [7, 2, 1], [1, 1, 1]])
def test_blend_is_the_greedy_order(spark, weights):
    got = [(r.pos, r.dataset_id, r.ordinal) for r in blend.blend(spark, weights, 137).orderBy("pos").collect()]
    pattern = blend.greedy_pattern(weights, 137)
    assert got == [(i, ds, pattern[:i].count(ds)) for i, ds in enumerate(pattern)]


def test_blend_share(spark):
    shares = blend.blend(spark, [8, 2], 10_000).groupBy("dataset_id").count().collect()
    assert all(abs(r["count"] / 10_000 - (0.8, 0.2)[r.dataset_id]) < 0.05 for r in shares)


def test_bins():
    assert [b[1:3] for b in blend.bins([0.5, 0.3, 0.2], 10)] == list(zip([0, 0, 0, 0, 0, 1, 1, 1, 2, 2], [0, 1, 2, 3, 4, 0, 1, 2, 0, 1], strict=True))
    assert [b[1:3] for b in blend.bins([1, 1, 1], 10)] == list(zip([0, 0, 0, 1, 1, 1, 2, 2, 2, 2], [0, 1, 2, 0, 1, 2, 0, 1, 2, 2], strict=True))


@pytest.mark.parametrize("labels,mask,k,percent,expected", [
    ([0, 2, 1, 3], [1, 1, 1, 1], 2, 100, [1, 1, 0, 0]), ([2, 1], [1, 1], 2, 100, [1, 0]), ([0, 0, 1, 3], [1, 0, 1, 1], 2, 100, [1, 0, 0, 0]),
    ([0, 2, 1, 3], [0.5, 2, 0.5, 2], 2, 100, [0.5, 2, 0, 0]), ([0, 1, 2, 3], [1, 1, 1, 1], 4, 100, [1, 1, 1, 1]), ([1, 3], [0.5, 2], 1, 100, [0.5, 2]),
    ([0, 2, 1, 3], [1, 1, 1, 1], 1, 50, [1, 1, 0, 0]), ([3, 3, 3, 3], [1, 1, 1, 1], 1, 50, [0, 0, 1, 1]), ([0, 2, 1, 3], [1, 1, 1, 1], 1, 0, [1, 1, 1, 1]), ([0, 2, 1, 3], [1, 1, 1, 1], 1, 100, [1, 0, 0, 0]),
])
def test_topk_mask(spark, labels, mask, k, percent, expected):
    rows = spark.createDataFrame([(0, i, [3.0, 1.0, 2.0, 0.0], t, float(m)) for i, (t, m) in enumerate(zip(labels, mask, strict=True))], "g int, i int, l array<double>, t int, mask double")
    ranked = rows.withColumn("rank", select.target_rank(F.col("l"), F.col("t")))
    got = [r.new_mask for r in collate.topk_loss_mask(ranked, k, percent, "g", "i").orderBy("i").collect()]
    assert got == expected


def test_rank_ties(spark):
    rows = spark.createDataFrame([(t,) for t in (0, 1, 2)], "t int").withColumn("l", F.array(F.lit(5.0), F.lit(5.0), F.lit(1.0)))
    assert [r[0] for r in rows.orderBy("t").select(select.target_rank(F.col("l"), F.col("t"))).collect()] == [1, 1, 3]


def test_boundary_mask(spark):
    row = spark.createDataFrame([([0, 1, 2, 0, 1, 0, 1, 2],)], "p array<int>").select(collate.boundary_mask("p", 7)).first()[0]
    assert row == [True, True, False, True, False, True, True]


def test_chunk_counts(spark):
    for n, written, meant in [*((n, 0, 1) for n in (5, 8)), *((n, 1, 2) for n in (9, 12)), *((n, 2, 3) for n in (13, 16)), (17, 3, 4), (19, 3, 4)]:
        docs = spark.createDataFrame([(0, "x" * n)], "doc_id long, text string")
        assert packing.chunk_counts(docs, 4, 10).first().n_chunks == written
        assert packing.chunk_counts(docs, 4, 10, drop_last_chunk=False).first().n_chunks == meant


def test_sample_index_against_a_walk(spark):
    rng = random.Random(5)
    for extra in (0, 1):
        for _ in range(4):
            sizes = [rng.choice([0, 1, 2, 7, 30]) for _ in range(25)]
            sizes[0] = max(sizes[0], 1)
            docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "doc_id long, text string")
            got = sorted((r.sample_id, r.doc_id, r.doc_offset) for r in packing.sample_index(docs, 4, extra).collect())
            starts = [sum(sizes[:i]) for i in range(len(sizes))]
            want = []
            for s in range((sum(sizes) - extra) // 4 + 1):
                t = max(s * 4 - (1 - extra), 0)
                doc = next(i for i in range(len(sizes)) if starts[i] <= t < starts[i] + sizes[i])
                want.append((s, doc, s * 4 - starts[doc]))
            assert got == want


def test_ranks_do_not_overlap_and_resume(spark):
    rows = spark.range(1000).withColumnRenamed("id", "pos")
    parts = shard.strided(rows, "pos", 8, 1000)
    assert parts.count() == parts.select("pos").distinct().count() == 1000
    fresh = shard.megabatch(rows, "pos", 4, 6, 0, 1000).where("step >= 3").select("pos", "rank", "slot")
    resumed = shard.megabatch(rows, "pos", 4, 6, 72, 1000).select("pos", "rank", "slot")
    assert sorted(fresh.collect()) == sorted(resumed.collect())


def test_split_bounds():
    assert packing.split_bounds([98, 1, 1], 50)[-1] == 50


def test_stage_validation(spark):
    with pytest.raises(ValueError):
        shard.stage_at(spark.range(3).withColumnRenamed("id", "step"), [("a", 2)])


def test_index_bytes():
    raw = indexed.build_index(8, [3, 0, 5], [0, 1, 2, 3])
    index = indexed.parse_index(raw)
    assert list(index.sizes) == [3, 0, 5] and list(index.pointers) == [0, 6, 6] and list(index.documents) == [0, 1, 2, 3] and index.code == 8
    with pytest.raises(ValueError):
        indexed.parse_index(b"x" + raw[1:])


def test_flagship_plan_has_no_range_join(spark, sf):
    from grainmill.plans import catalog

    plan = catalog.queries()["sample_index"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "PushedFilters" in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
