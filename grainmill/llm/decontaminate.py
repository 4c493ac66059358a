"""Benchmark decontamination with an Aho-Corasick automaton.

Words of items and documents are runs of letters, digits and all beyond ASCII, in
ASCII lower case. Windows of item words become the patterns of one automaton;
each document is scanned once over its words joined by spaces, and hits are
mapped back to the offsets of the original text.

Patterns are bounded: windows are dealt in slices by their hash, each slice gets
an automaton of bounded size, and a benchmark beyond one slice is scanned for
slice by slice within the same pass over the documents' rows.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, quoted, ship, small_batches, table, worker_latest

WINDOW = 10
#: Characters of patterns in one automaton; some 100 bytes of memory each at most.
SLICE_CHARS = 1_000_000
#: Fixed value: what a word is, after lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = {c: c + 32 for c in range(65, 91)}


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, each word and each text start led by one space.

    Returns the code points with every run of others cut to one space, the place
    in the joined original of each, and where each text starts in the result."""
    joined = np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where((joined >= 65) & (joined <= 90), joined + 32, joined)
    word = (c >= 128) | (c >= 97) & (c <= 122) | (c >= 48) & (c <= 57)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])  # of the zeros that part texts
    keep = word.copy()
    keep[1:] |= word[:-1]
    keep[starts] = True
    places = np.flatnonzero(keep)
    kept = np.where(word[places], c[places], 32).astype("<u4")
    return kept, places, np.searchsorted(places, starts)  # one more start than texts


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (pattern, item_id as string): the words of each window joined and
    enclosed by spaces. Null ids and texts without words give none."""
    ship(benchmark.sparkSession)

    def run(batches):
        for batch in small_batches(batches, 256):
            out = set()
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = re.findall(WORD, (text or "").translate(_UPPER))
                for i in range(max(1, len(words) - window + 1)) if words and item is not None else ():
                    out.add((" " + " ".join(words[i : i + window]) + " ", item))
            rows = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["pattern", "item"])

    return benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "pattern string, item string").distinct()


def _automaton(patterns: list[tuple[str, list[str]]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for pattern, items in patterns:
        a.add_word(pattern, (len(pattern), items))
    a.make_automaton()
    return a


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """All rows of docs with n_words, n_hit, items (sorted), spans and contaminated.

    A word inside any occurrence of a window is hit; spans are the (start, end)
    character offsets of the hit words in the original text. A null text or one
    without words has none. An item of fewer words than a window, but not none, is
    one window. Repeated items and rows change nothing for others. Empty tables
    give empty results, or documents without hits. Columns of docs that have one of
    the added names are replaced, all others are kept as they are. Very long texts are
    scanned whole, each in one task.
    """
    spark = docs.sparkSession
    ship(spark)
    windows = item_windows(benchmark, window)
    grouped = windows.groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))
    size = windows.agg(F.sum(F.length("pattern") + F.length("item"))).first()[0] or 0
    n_slices = max(1, -(-size // slice_chars))
    carried = F.struct(F.lit(0).alias("_"), *(F.col(quoted(c)) for c in docs.columns)).alias("carried")
    out = docs.select(carried, "text", F.lit(None).cast("long").alias("n_words"), F.array().cast(HITS).alias("hits"), F.array().cast("array<string>").alias("items"))
    for i in range(n_slices):
        rows = grouped if n_slices == 1 else grouped.where(F.pmod(F.xxhash64("pattern"), F.lit(n_slices)) == i)
        patterns = sorted((r.pattern, r["items"]) for r in rows.collect())  # about slice_chars
        out = _scan(out, spark.sparkContext.broadcast(patterns), uuid.uuid4().hex)
        if n_slices > 1:  # one automaton at a time in a worker's memory
            out = materialize(out, "scanned")
    spans = F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))
    added = {"n_words": F.col("n_words"), "items": F.col("items"), "n_hit": F.size("hits").cast("long"), "contaminated": F.size("hits") > 0, "spans": spans}
    return out.select(*(F.col("carried").getField(c).alias(c) for c in docs.columns if c not in added), *(c.alias(k) for k, c in added.items()))


HITS = "array<struct<word:int,start:int,end:int>>"


def _scan(docs: DataFrame, patterns, tag: str) -> DataFrame:
    """Adds the words hit and the items found by one automaton."""
    names = docs.columns
    text_at, words_at, hits_at, items_at = (names.index(n) for n in ("text", "n_words", "hits", "items"))

    def run(batches):
        automaton = worker_latest("automaton", tag, lambda: _automaton(patterns.value)) if patterns.value else None
        for batch in small_batches(batches, 64):
            texts = [t or "" for t in batch.column(text_at).to_pylist()]
            kept, places, starts = normalised(texts)
            space = kept == 32
            begins = np.flatnonzero(space[:-1] & ~space[1:]) + 1
            ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
            first = np.searchsorted(begins, starts)  # each text's first word
            hits, items = batch.column(hits_at).to_pylist(), batch.column(items_at).to_pylist()
            for i in range(len(texts)) if automaton else ():
                lo = starts[i]
                scanned = kept[lo : starts[i + 1] + 1].tobytes().decode("utf-32-le", "surrogatepass")
                found = [(end, *value) for end, value in automaton.iter(scanned)]
                if found:
                    own = begins[first[i] : first[i + 1]] - lo
                    inside = {h["word"] for h in hits[i] or ()}
                    for end, n, _ in found:
                        inside.update(range(np.searchsorted(own, end - n + 1), np.searchsorted(own, end)))
                    at = np.array(sorted(inside)) + first[i]
                    base = places[lo] + 1
                    hits[i] = [{"word": w - first[i], "start": places[begins[w]] - base, "end": places[ends[w] - 1] + 1 - base} for w in at]
                    items[i] = sorted({*(items[i] or ()), *(x for *_, many in found for x in many)})
            columns = list(batch.columns)
            columns[words_at] = pa.array(np.diff(first), pa.int64())
            columns[hits_at] = pa.array(hits, pa.list_(pa.struct([("word", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))
            columns[items_at] = pa.array(items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
dg AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT dg.doc_id, dg.n, dg.i, win.item_id FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
