"""Removal of repeated passages, found by difference-cover anchors.

A difference cover of a period has, for any two offsets, a shift that brings both
to cover positions. So if two documents share a passage of at least
``window`` words, some short window of ``window - period + 1`` words inside it
stands at a cover position in both. Hashes of short windows at cover positions
only (6 of 31 places) are grouped; where one is found in two different texts,
the windows around it are extended to the full length and compared by 128-bit
hashes. The smallest doc_id of equal windows keeps its words, others lose them.

Exact copies of a text are one class, so a large group of copies costs no more
than its rows. Classes are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classes import Classes, described
from .common import discard, materialize, ship, small_batches, table, text_bytes, worker_cache
from .polyhash import PolyHash, canonical, joined_words
from .streams import id_set, shared_flags

WINDOW = 50
#: A perfect difference set, so every residue is a difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


def _hashers():
    return worker_cache("substring-hash", lambda: (PolyHash(21), PolyHash(22)))


def _windows(text: bytes, n: int, at: np.ndarray | None, lanes: int):
    """Hashes of the n-word windows that start at the words `at` (all if None)."""
    joined, start, end = joined_words(text)
    places = np.arange(max(0, len(start) - n + 1)) if at is None else at[at <= len(start) - n]
    data = np.frombuffer(joined, np.uint8)
    out = []
    for hasher in _hashers()[:lanes]:
        prefix = hasher.prefix(data)
        out.append(hasher.ranges(prefix, start[places], end[places + n - 1]).view(np.int64))
    return places, out


def _cover_places(n: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    return (np.arange(0, n, period)[:, None] + np.array(sorted(cover))[None, :]).ravel()


def anchors(docs: DataFrame, classes: Classes, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """(hash, cls, pos) of each text's distinct short windows at cover positions,
    with the first place of each: a text that repeats itself gives no more rows."""
    short = window - period + 1

    def run(batches):
        for batch in small_batches(batches, 512):
            h, cls, pos = [], [], []
            for text in text_bytes(batch.column(0)):
                joined = canonical(text)
                n = joined.count(b" ") + 1
                if n >= window and joined:
                    places, (hashes,) = _windows(joined, short, _cover_places(n, period, cover), 1)
                    hashes, first = np.unique(hashes, return_index=True)
                    places = places[first]
                    h.append(hashes)
                    pos.append(places.astype(np.int32))
                    cls.append(np.full(len(places), classes.of(joined)))
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (h, cls, pos)], ["hash", "cls", "pos"])

    return docs.select("text").mapInArrow(run, "hash long, cls long, pos int")


def _all_like(words: bytes, n: int, at: np.ndarray, places: np.ndarray | None) -> np.ndarray:
    """All places (among those given) whose n words equal those at a place of at."""
    places, (hashes,) = _windows(words, n, places, 1)
    return places[np.isin(hashes, hashes[np.isin(places, at)])]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """doc_id, n_words, n_removed, kept: a row per row of docs.

    Words are runs of anything but 0x20 and 0x09-0x0D. A word goes when a window of
    `window` words over it also starts in a document of smaller doc_id. A null or
    empty text has no words and keeps the empty text; texts shorter than the window
    keep all. Rows of one doc_id never remove each other's words. A null doc_id
    counts as larger than all others, and as one document. Very long texts are cut
    into their words as a whole, in one task. An empty table gives an empty result.
    """
    if {(a - b) % period for a in cover for b in cover} != set(range(period)) or not 0 < period <= window:
        raise ValueError("not a difference cover")
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")

    def shared(batches):
        for columns, flags, _ in shared_flags(batches, 1):
            if flags.any():
                yield pa.RecordBatch.from_arrays([pa.array(columns[1][flags]), pa.array(columns[2][flags])], ["cls", "pos"])

    reps, classes = described(docs, canonical)
    found = anchors(docs, classes, window, period, cover).repartition("hash").sortWithinPartitions("hash", "cls").mapInArrow(shared, "cls long, pos int")
    places = materialize(reps.join(found.groupBy("cls").agg(F.collect_set("pos").alias("at")), "cls"), "anchors")
    wanted = spark.sparkContext.broadcast(id_set(places, "rep", places.count()))

    def classed(column):
        joined = [canonical(t) for t in text_bytes(column)]
        return pa.array([classes.of(j) for j in joined], pa.int64()), pa.array(joined, pa.binary())

    def texts(batches):  # those that have shared anchors; a few others may slip in
        for batch in small_batches(batches):
            flags = wanted.value.holds(np.asarray(batch.column(0)))
            part = batch.filter(pa.array(flags))
            yield pa.RecordBatch.from_arrays([part.column(0), *classed(part.column(1))], ["rep", "cls", "words"])

    short = window - period + 1

    def full(batches):
        for batch in small_batches(batches, 256):
            out = []
            for doc, cls, words, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = words.count(b" ") + 1
                near = np.zeros(n + 1, np.int32)  # windows that hold a shared anchor
                at = _all_like(words, short, np.array(at), _cover_places(n, period, cover))
                np.add.at(near, np.maximum(at - (window - short), 0), 1)
                np.add.at(near, np.minimum(at + 1, n), -1)
                starts, hashes = _windows(words, window, np.flatnonzero(np.cumsum(near[:-1]) > 0), 2)
                _, first = np.unique(hashes[0], return_index=True)
                out.append((hashes[0][first], hashes[1][first], np.full(len(first), doc), starts[first].astype(np.int32), np.full(len(first), cls)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["h1", "h2", "doc", "pos", "cls"])

    def repeated(batches):
        for columns, _, first in shared_flags(batches, 2):
            flags = columns[2] > first
            if flags.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[flags]) for c in columns[2:]], ["rep", "pos", "cls"])

    windows = docs.select("doc_id", "text").mapInArrow(texts, "rep long, cls long, words binary").join(places, ["rep", "cls"]).select("rep", "cls", "words", "at")
    windows = windows.mapInArrow(full, "h1 long, h2 long, doc long, pos int, cls long")
    gone = windows.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "doc").mapInArrow(repeated, "rep long, pos int, cls long")
    gone = materialize(gone.groupBy("rep", "cls").agg(F.collect_set("pos").alias("at")), "repeated")
    n_gone = gone.count()
    discard(places)
    cut = spark.sparkContext.broadcast(id_set(gone, "rep", n_gone))

    def rows(batches):
        """Each row's class; its words only where some may have to go."""
        for batch in small_batches(batches):
            flags = cut.value.holds(np.asarray(batch.column(0)))
            ids, words = classed(batch.column(2))
            n_words = [w.count(b" ") + 1 if w else 0 for w in words.to_pylist()]
            kept = pa.array([w if f else None for w, f in zip(words.to_pylist(), flags, strict=True)], pa.binary())
            full = pa.array([hashlib.sha256(w).hexdigest() for w in words.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, pa.array(n_words, pa.int64()), kept, full], ["doc_id", "no_id", "cls", "n_words", "words", "full_sha256"])

    info = reps.join(gone, ["rep", "cls"], "left")
    judged = docs.mapInArrow(rows, "doc_id long, no_id boolean, cls long, n_words long, words binary, full_sha256 string").join(info, "cls", "left")

    def finish(batches):
        for batch in small_batches(batches, 512):
            removed, shas = [], []
            for doc, n, words, sha, rep, at in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)), strict=True):
                if doc > rep and n >= window:  # a copy of a smaller document
                    removed.append(n)
                    shas.append(hashlib.sha256(b"").hexdigest())
                elif doc == rep and at:
                    depth = np.zeros(n + 1, np.int32)
                    at = _all_like(words, window, np.array(at), None)
                    np.add.at(depth, at, 1)
                    np.add.at(depth, at + window, -1)
                    keep = np.cumsum(depth[:-1]) == 0
                    parts = words.split(b" ")
                    removed.append(int(n - keep.sum()))
                    shas.append(hashlib.sha256(b" ".join([parts[i] for i in np.flatnonzero(keep)])).hexdigest())
                else:
                    removed.append(0)
                    shas.append(sha)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "no_id", "n_words", "n_removed", "kept_sha256"])

    out = judged.select("doc_id", "no_id", "n_words", "words", "full_sha256", "rep", "at").mapInArrow(finish, "doc_id long, no_id boolean, n_words long, n_removed long, kept_sha256 string")
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
d AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM g) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM d),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
k AS (SELECT t.doc_id, count(*) AS n, count(gone.p) AS r, string_agg(word, ' ' ORDER BY t.p) FILTER (gone.p IS NULL) AS kept FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id AND t.p = gone.p GROUP BY t.doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
