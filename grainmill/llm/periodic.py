"""Runs of repeated words: stretches that a short period explains.

Main-Lorentz divide and conquer on interned word ids. A text is halved again and
again; a run that crosses the middle of a part is found from Z-functions of its two
halves, which tell for every period how far the words before and behind the middle
repeat. What can be extended beyond its part crosses the middle of a larger one and is
found there; what is left are whole runs, of which equal intervals keep the smallest
period. Inside of a run, others have less than a third of its period, as two runs that
share both their periods would be one. All texts of a block are halved together, and a part gets its Z-functions only
if some period repeats next to its middle at all, which numpy tells for all parts of a
level at once. Nothing is shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, small_batches, table, text_bytes

#: Words of the texts that are halved together; a longer text is a block of its own.
BLOCK_WORDS = 1 << 19
#: Words compared before a part gets its Z-functions.
ROUNDS = 6

RUNS = "array<struct<start: long, length: long, period: long>>"


def z_function(s: list[int]) -> list[int]:
    """For each place, how many items from there on are those the list begins with."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def crossing(ids: np.ndarray, lo: int, mid: int, hi: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the repetitions of ids[lo:hi] around mid, for each
    period up to most; those of no length are among them."""
    left, right = ids[lo:mid].tolist(), ids[mid:hi].tolist()
    q = np.arange(1, most + 1)
    back = left[::-1]
    ahead, behind = np.array(z_function(right))[q], np.array(z_function(back))[q]
    #: Words before mid that stand before mid + q as well, and words from mid on that
    #: stand from mid - q on: at most q of them by the lists' ends.
    before = np.array(z_function([*back, -1, *right[::-1]]))[len(back) + 1 + len(right) - q]
    after = np.array(z_function([*right, -1, *left]))[len(right) + 1 + len(left) - q]
    square = before >= q  # then after is q too
    start = np.concatenate((np.where(square, mid - q - behind, mid - before), mid - q - behind))
    end = np.concatenate((mid + q + ahead, mid + np.where(square, q + ahead, after)))
    return start, end, np.concatenate((q, q))


def _repeating(ids: np.ndarray, mid: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Parts of which some period up to most may repeat from mid on or up to mid: a run
    of four periods has a whole period twice on one side."""
    out = np.zeros(len(mid), bool)
    part = np.repeat(np.arange(len(mid)), most)
    q = np.arange(len(part)) - np.repeat(np.cumsum(most) - most, most) + 1
    for first, step in ((mid, 1), (mid - 1, -1)):
        of, by, at = part, q, first[part]
        for t in range(ROUNDS):
            k = step * np.minimum(t, by - 1)  # a whole period is enough
            same = ids[at + k] == ids[at + k + step * by]
            of, by, at = of[same], by[same], at[same]
            if not len(of):
                break
        out[of] = True
    return out


def find_runs(ids: np.ndarray, bounds: np.ndarray, min_words: int, min_periods: int) -> tuple[np.ndarray, ...]:
    """All runs of texts ids[bounds[i]:bounds[i+1]]: (text, start, length, period), by
    text, start and period; min_periods is 4 or more."""
    found = [np.zeros((0, 4), np.int64)]
    text, lo, hi = np.arange(len(bounds) - 1), bounds[:-1], bounds[1:]
    #: Of a run that covers a part, so short a period that others inside have a third of it.
    cover = np.full(len(text), 1 << 62)
    while True:
        keep = (hi - lo >= max(min_words, min_periods)) & (cover > 3)
        text, lo, hi, cover = text[keep], lo[keep], hi[keep], cover[keep]
        if not len(text):
            break
        mid, most = (lo + hi) // 2, np.minimum((hi - lo) // min_periods, (cover - 1) // 3)
        covers = np.stack([cover, cover])
        for i in np.flatnonzero(_repeating(ids, mid, most)):
            s, e, q = crossing(ids, int(lo[i]), int(mid[i]), int(hi[i]), int(most[i]))
            kept = e - s >= np.maximum(min_words, min_periods * q)
            s, e, q = s[kept], e[kept], q[kept]
            for half, (a, b) in enumerate(((lo[i], mid[i]), (mid[i], hi[i]))):
                covers[half, i] = min(covers[half, i], *q[(s <= a) & (e >= b)], 1 << 62)
            first, last = bounds[text[i]], bounds[text[i] + 1]
            on_left = (s > first) & (ids[s - 1] == ids[s - 1 + q])
            on_right = (e < last) & (ids[np.minimum(e, last - 1)] == ids[e - q])
            whole = ~on_left & ~on_right
            found.append(np.stack([np.full(whole.sum(), text[i]), s[whole], e[whole], q[whole]], axis=1))
        text, lo, hi, cover = np.concatenate((text, text)), np.concatenate((lo, mid)), np.concatenate((mid, hi)), covers.ravel()
    rows = np.concatenate(found)
    rows = rows[np.lexsort(rows.T[::-1])]
    again = np.zeros(len(rows), bool)
    again[1:] = (rows[1:, :3] == rows[:-1, :3]).all(axis=1)
    of, start, end, q = rows[~again].T
    order = np.lexsort((q, start, of))
    of, start, end, q = of[order], start[order], end[order], q[order]
    return of, start - bounds[of], end - start, q


def _blocks(batches):
    """(ids, words of each text) of so many rows that their words fill a block."""
    for batch in small_batches(batches):
        ids, words, n, at = batch.column(0).to_pylist(), [t.split() for t in text_bytes(batch.column(1))], 0, 0
        for i, w in enumerate(words):
            if n and n + len(w) > BLOCK_WORDS:
                yield ids[at:i], words[at:i]
                n, at = 0, i
            n += len(w)
        yield ids[at:], words[at:]


def periodic_runs(docs: DataFrame, min_words: int = 6, min_periods: int = 4, places=None) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_runs, runs (start, length, period by
    start, then period), best (the run of most periods; ties: smallest start, then
    period; null without runs), collapsed (the words joined by one space, of each run
    only its first period).

    A run is a stretch of words of at least min_words and min_periods (4 or more) times
    its smallest period, in which words one period apart are the same, and which no
    neighbouring word extends. Words are what stands between white space in ASCII.
    places(doc_id, n), if given, tells which of its n words stands at each place of a
    text, as an array, or None for the text as it is. Null and empty texts have no words
    and an empty collapsed; rows with null or repeated ids are judged one by one. Very
    long texts are judged whole, each in one task. An empty table gives an empty result;
    further columns of docs are left out.
    """
    if min_periods < 4 or min_words < 1:
        raise ValueError("runs of at least four periods and one word are found")
    ship(docs.sparkSession)

    def run(batches):
        for doc_ids, texts in _blocks(batches):
            flat = pa.array([w for words in texts for w in words], pa.binary()).dictionary_encode().indices.to_numpy()
            bounds = np.concatenate(([0], np.cumsum([len(w) for w in texts]))).astype(np.int64)
            if places is not None:
                flat = flat.copy()
                for i, (doc, words) in enumerate(zip(doc_ids, texts, strict=True)):
                    of = places(doc, len(words)) if words else None
                    if of is not None:
                        flat[bounds[i] : bounds[i + 1]] = flat[bounds[i] : bounds[i + 1]][of]
                        texts[i] = [words[j] for j in of.tolist()]
            of, start, length, period = find_runs(flat, bounds, min_words, min_periods)
            ends = np.searchsorted(of, np.arange(len(texts) + 1))
            best, collapsed = [], []
            for i, words in enumerate(texts):
                s, n, q = (x[ends[i] : ends[i + 1]].tolist() for x in (start, length, period))
                kept = words
                top = None
                if s:
                    drop = np.zeros(len(words) + 1, np.int64)
                    for a, b, c in zip(s, n, q, strict=True):
                        drop[a + c] += 1
                        drop[a + b] -= 1
                        if top is None or b * top["period"] > top["length"] * c:
                            top = {"start": a, "length": b, "period": c}
                    kept = [words[j] for j in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
                best.append(top)
                collapsed.append(b" ".join(kept))
            run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(np.diff(bounds)), pa.array(np.diff(ends), pa.int64()), runs, pa.array(best, run_type), pa.array(collapsed, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_runs", "runs", "best", "collapsed"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, f"doc_id long, n_words long, n_runs long, runs {RUNS}, best struct<start: long, length: long, period: long>, collapsed string")


def periodic_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Every tenth document by its id's checksum ends in a repetition of its own words."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g, i = h // 10, np.arange(n)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(i < a, i, a + (i - a) % p)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(table(spark, sf_dir, "documents"), places=periodic_tail)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return out.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.concat_ws("\n", line), F.when(F.col("n_runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Runs of at least four periods hold three words that stand one period further again,
#: so equal triples give the candidates; consecutive ones are a run.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc FROM documents),
h AS (SELECT doc_id, w, len(w) AS n, xor(crc, 4294967295) AS h, xor(crc, 4294967295) // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM h),
t AS (SELECT doc_id, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM a)),
k AS (SELECT doc_id, n, i, word, hash(word, lead(word, 1) OVER o, lead(word, 2) OVER o) AS three, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.three = y.three AND x.word = y.word AND x.w1 = y.w1 AND x.w2 = y.w2
    AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS s, max(i) + 3 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, s, e - s AS n, min(q) AS q FROM s WHERE e - s >= greatest(6, 4 * q) GROUP BY doc_id, s, e),
agg AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id),
best AS (SELECT doc_id, s, n, q FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n::DOUBLE / q DESC, s, q) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM r),
kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS text FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id AND t.i = gone.i WHERE gone.i IS NULL GROUP BY t.doc_id)
SELECT a.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.n::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.n // best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM a LEFT JOIN agg ON a.doc_id = agg.doc_id LEFT JOIN best ON a.doc_id = best.doc_id LEFT JOIN kept ON a.doc_id = kept.doc_id
"""
