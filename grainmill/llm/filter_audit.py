"""How five document filters interact: what each removes in every order of them.

Words are rows: texts are exploded, rows are counted by document and word, and these
counts by document give its words and distinct words. The other conditions are flags of
the row, joined with that. A document then is a set of failed filters; the documents of
a part that pass each of the 32 sets of filters are counted in as many columns, and
every order's steps, and the Shapley shares, are differences of these counts. All in
DataFrame functions. Each text moves once, to where its words are counted, as the words
with their document would be three times as much; all else that moves are a few numbers
a document.
"""

from __future__ import annotations

import itertools
import json
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
#: A word of no text; counted once a row, so that rows which repeat are told.
ROW = " "
#: Parts of the rows of one doc_id and text; texts told by a broadcast table at most.
SALTS, MANY = 32, 10_000


def word_totals(docs: DataFrame) -> DataFrame:
    """(doc_id, h, words, distinct_words) for each doc_id and hash of a text in docs
    (doc_id, h, text). Texts are dealt by document once, so that both aggregations of
    their words run where they are; rows that repeat are dealt in SALTS parts."""
    dealt = docs.withColumn("s", F.monotonically_increasing_id() % SALTS).repartition("doc_id", "h", "s")
    parts = F.concat(F.split("text", r"[ \t\n\x0B\f\r]+"), F.array(F.lit(ROW)))
    words = dealt.select("doc_id", "h", "s", F.explode(parts).alias("word")).where("word != ''")
    counts = words.groupBy("doc_id", "h", "s", "word").agg(F.count("*").alias("n"))
    held = counts.groupBy("doc_id", "h", "s").agg(F.sum("n").alias("n"), F.count("*").alias("m"), F.sum(F.when(F.col("word") == ROW, F.col("n"))).alias("rows"))
    return held.groupBy("doc_id", "h").agg(F.max(F.expr("n div rows - 1")).alias("words"), F.max(F.col("m") - 1).alias("distinct_words"))


def _first_ids(flags: DataFrame) -> DataFrame:
    """flags with the smallest doc_id of each row's text. Texts that make up more than
    one in MANY of all rows, so at most MANY, are looked up in a broadcast table; only
    the others' rows meet by text."""
    first = flags.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    n = flags.agg(F.count("*")).scalar()
    often = F.broadcast(first.where(F.col("n") > n / MANY).select(F.col("digest").alias("often"), F.col("first").alias("often_first")))
    told = flags.join(often, F.col("digest") == F.col("often"), "left")
    key = F.when(F.col("often").isNotNull(), F.concat_ws("/", "digest", F.xxhash64("doc_id", "h"))).otherwise(F.col("digest"))
    seldom = first.where(F.col("n") <= n / MANY).select(F.col("digest").alias("seldom"), "first")
    joined = told.withColumn("key", key).join(seldom, F.col("key") == F.col("seldom"), "left")
    return joined.withColumn("first", F.coalesce("often_first", "first")).drop("often", "often_first", "key", "seldom")


def failed_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) for each row of docs: the filters it fails, as bits."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("h", F.xxhash64("text"))
    flags = own.select(
        "doc_id", "part", "h", F.md5("text").alias("digest"),
        (100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 3 * F.length("text")).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
    )
    totals = word_totals(own.select("doc_id", "h", "text")).toDF("word_doc", "word_h", "words", "distinct_words")
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_doc")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    labelled = (F.coalesce("doc_id", "h") == F.col("label_doc")) & (F.col("doc_id").isNull() == F.col("unknown"))  # rows without an id are spread
    rows = (
        _first_ids(flags).join(totals, F.col("doc_id").eqNullSafe(F.col("word_doc")) & (F.col("h") == F.col("word_h")), "left")
        .join(marks.withColumn("unknown", F.lit(False)), labelled, "left")
    )
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    copies = F.col("first").isNotNull() & F.coalesce(F.col("doc_id") > F.col("first"), F.lit(True))
    fails = [words < 200, 100 * distinct < 50 * words, F.col("C"), F.col("D"), copies]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("part", mask.alias("mask"), *((F.coalesce(c, F.lit(0)) == 1).alias(c) for c in ("good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, filter_order and step, with long counts: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters of a whole text: A under 200 words, B less than half of its words distinct,
    C over 3 capitals of A-Z in 100 code points, D any of #$%&*|, E the text of a
    smaller doc_id. A null text is empty (it fails A alone, and E with a smaller empty
    one); a null lang is the part ''. A null doc_id is larger than all others and not
    smaller than another null. Rows with null or repeated ids are judged one by one,
    repeated rows each (two of one id don't fail E by one another). A document is good or
    toxic if any label row of its id says so. Very long texts are whole, their words
    spread over tasks. Empty tables give an empty result; other columns are ignored.
    """
    rows = failed_filters(docs.select("doc_id", "lang", "text"), labels.select("doc_id", "quality", "toxic"))
    passes = [(F.col("mask").bitwiseAND(F.lit(m)) == 0) for m in range(ALL + 1)]
    kinds = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = rows.groupBy("part").agg(*(F.count_if(p & k).alias(f"{name}_{m}") for name, k in kinds.items() for m, p in enumerate(passes)))
    shares = []
    for i in range(len(FILTERS)):
        others = [m for m in range(ALL + 1) if not m >> i & 1]
        weight = {m: factorial(m.bit_count()) * factorial(len(FILTERS) - 1 - m.bit_count()) for m in others}
        shares.append(sum((weight[m] * (F.col(f"all_{m}") - F.col(f"all_{m | 1 << i}")) for m in others), F.lit(0)))
    steps = [
        {"filter_order": "".join(order), "step": k + 1, "at": FILTERS.index(f), "before": sum(1 << FILTERS.index(x) for x in order[:k]), "after": sum(1 << FILTERS.index(x) for x in order[: k + 1])}
        for order in itertools.permutations(FILTERS) for k, f in enumerate(order)
    ]
    lists = counts.select("part", *(F.array(*(f"{name}_{m}" for m in range(ALL + 1))).alias(name) for name in kinds), F.array(*shares).alias("shares"))
    step = F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, at: int, before: int, after: int>>")).alias("x")
    lost = lambda c: F.expr(f"{c}[x.before] - {c}[x.after]")
    return lists.select("*", step).select(
        "part", "x.filter_order", "x.step", F.expr("all[x.after]").alias("kept"), lost("all").alias("removed"),
        F.expr("all[0] - all[shiftleft(1, x.at)] - (all[x.before] - all[x.after])").alias("redundant"),
        F.expr(f"all[{ALL} - shiftleft(1, x.at)] - all[{ALL}]").alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.expr("shares[x.at]").cast("long").alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^ 	-
]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
m AS (SELECT part, coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic,
    {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
     'D': regexp_matches(text, '[#$%&*|]'), 'E': w.doc_id > first} AS f
  FROM w LEFT JOIN labels ON w.doc_id = labels.doc_id),
fails AS (SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS fails FROM m),
letter(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE a.l NOT IN (b.l, c.l, d.l, e.l) AND b.l NOT IN (c.l, d.l, e.l) AND c.l NOT IN (d.l, e.l) AND d.l <> e.l),
steps AS (SELECT filter_order, k::INT AS step, filter_order[k] AS letter, string_split(filter_order[:k - 1], '') AS before FROM orders, range(1, 6) r(k)),
sets AS (SELECT part, good, toxic, fails, count(*) AS n FROM fails GROUP BY ALL),
t AS (SELECT part, filter_order, step, letter,
  coalesce(sum(n) FILTER (NOT list_contains(fails, letter) AND NOT list_has_any(fails, before)), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (list_contains(fails, letter) AND NOT list_has_any(fails, before)), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (list_contains(fails, letter) AND list_has_any(fails, before)), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails = [letter]), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (good AND list_contains(fails, letter) AND NOT list_has_any(fails, before)), 0)::BIGINT AS good_lost,
  coalesce(sum(n) FILTER (toxic AND list_contains(fails, letter) AND NOT list_has_any(fails, before)), 0)::BIGINT AS toxic_lost
  FROM sets, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM t
"""
