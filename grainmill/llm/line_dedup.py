"""Removal of lines that many documents share.

Two Bloom filters find suspects without moving lines: the first holds the keys
seen, the second those seen in two documents. Every task fills both for its part
of the corpus; the parts are merged shard by shard of the bits (a bit that two
first filters share is a suspect's as well), so the second filter holds every
repeated key and some others. Only digests of suspects are shuffled, counted
exactly, and the confirmed ones drop their lines.

The filters' size follows the input up to a fixed bound; past it more unrepeated
lines are shuffled, and results stay the same.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, materialize, quoted, ship, small_batches, table, text_bytes

#: log2 of the bits of a shard of a filter, and the bounds of a whole filter's.
SHARD_BITS, LEAST_BITS, MOST_BITS = 20, 22, 29
#: Confirmed digests that are sent to all tasks (16 bytes each); more are joined.
BROADCAST_KEYS = 1 << 20

ROWS = "k1 long, k2 long"


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip(SPACE) for line in text.lower().split(b"\n")]


def _digests(keys: list[bytes]) -> np.ndarray:
    """128-bit digests as an (n, 2) array."""
    return np.frombuffer(b"".join(hashlib.blake2b(k, digest_size=16).digest() for k in keys), "<i8").reshape(-1, 2)


def _is_key(key: bytes, min_chars: int) -> bool:
    """At least so many code points: bytes that don't continue one."""
    return len(key) >= min_chars and (min_chars <= 1 or sum(b & 0xC0 != 0x80 for b in key) >= min_chars)


def _distinct(batch, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the distinct keys of each row's text, and their rows."""
    per_row = [sorted({k for k in line_keys(t) if _is_key(k, min_chars)}) for t in text_bytes(batch)]
    rows = np.repeat(np.arange(len(per_row)), [len(x) for x in per_row])
    return _digests([k for x in per_row for k in x]), rows


def _slots(digests: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, bits = digests[:, 0].view(np.uint64), np.uint64((1 << SHARD_BITS) - 1)
    return (digests[:, 1].view(np.uint64) % np.uint64(shards)).astype(np.int64), (h & bits).astype(np.int64), (h >> np.uint64(32) & bits).astype(np.int64)


def filter_bits(docs: DataFrame) -> int:
    """log2 of a filter's bits: one for every 8 input bytes or so, within bounds."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(LEAST_BITS, min(MOST_BITS, (size // 8).bit_length()))


def repeated_filter(docs: DataFrame, bits: int, min_chars: int = 1) -> np.ndarray:
    """The second Bloom filter of a whole corpus: (shards, bytes of a shard)."""
    ship(docs.sparkSession)
    shards = 1 << (bits - SHARD_BITS)
    n_bytes = 1 << (SHARD_BITS - 3)

    def of_part(batches):
        parts = [d for batch in small_batches(batches) for d in [_distinct(batch.column(0), min_chars)[0]] if len(d)]
        if not parts:
            return
        digests, counts = np.unique(np.concatenate(parts), axis=0, return_counts=True)
        shard, p, q = _slots(digests, shards)
        out = []
        for s in np.unique(shard):
            of = shard == s
            seen = []
            for which in (of, of & (counts > 1)):
                flags = np.zeros(1 << SHARD_BITS, bool)
                flags[p[which]] = flags[q[which]] = True
                seen.append(zlib.compress(np.packbits(flags).tobytes(), 1))
            out.append((int(s), *seen))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "once", "twice"])

    def merged(batches):
        at, once, twice = None, None, None
        done = []

        def flush():
            rows, done[:] = list(done), []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "twice"])

        for batch in batches:
            for s, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if s != at:
                    if at is not None:
                        done.append((at, zlib.compress(twice.tobytes(), 1)))
                    at, once, twice = s, np.zeros(n_bytes, np.uint8), np.zeros(n_bytes, np.uint8)
                twice |= b | (once & a)
                once |= a
            if len(done) > 64:
                yield flush()
        if at is not None:
            done.append((at, zlib.compress(twice.tobytes(), 1)))
        yield flush()

    parts = docs.select("text").mapInArrow(of_part, "shard int, once binary, twice binary")
    whole = parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(merged, "shard int, twice binary")
    out = np.zeros((shards, n_bytes), np.uint8)
    for row in whole.collect():  # bounded: 2**MOST_BITS bits in all
        out[row.shard] = np.frombuffer(zlib.decompress(row.twice), np.uint8)
    return out


def _suspect(digests: np.ndarray, twice: np.ndarray) -> np.ndarray:
    shard, p, q = _slots(digests, len(twice))
    hit = lambda at: twice[shard, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
    return (hit(p) & hit(q)).astype(bool)


def repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Digests (k1, k2) of keys found in at least min_docs documents, with the
    smallest doc_id among these. Rows of one doc_id count as one document."""
    spark = docs.sparkSession
    ship(spark)
    twice = spark.sparkContext.broadcast(repeated_filter(docs, filter_bits(docs), min_chars)) if min_docs > 1 else None

    def suspects(batches):
        for batch in small_batches(batches):
            digests, rows = _distinct(batch.column(1), min_chars)
            if twice is not None:
                kept = _suspect(digests, twice.value)
                digests, rows = digests[kept], rows[kept]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(digests[:, 0]), pa.array(digests[:, 1])], ["doc_id", "k1", "k2"])

    found = docs.select("doc_id", "text").mapInArrow(suspects, f"doc_id long, {ROWS}")
    document = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return found.groupBy("k1", "k2").agg(F.countDistinct(document).alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") >= min_docs).drop("n")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """All rows of docs with text changed and n_lines, n_dropped added.

    A key is a line stripped of white space at both ends, in ASCII lower case. Keys
    of at least min_chars code points in at least min_docs documents lose all their
    lines (keep="none"), or all but the first in the smallest doc_id (keep="first").
    A null or empty text is one empty line and stays as it is; empty lines have no
    key. Rows of one doc_id are one document but are all returned. An empty table
    gives an empty result. Very long texts are split whole, each in one task. Columns of
    docs named n_lines or n_dropped are replaced; others, of any names, are carried.
    Up to broadcast_keys confirmed keys are sent to all tasks, more are joined.
    """
    if keep not in ("none", "first"):
        raise ValueError(keep)
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    rest = F.struct(F.lit(0).alias("_"), *(F.col(quoted(c)) for c in names if c not in ("doc_id", "text")))
    inner = docs.select(F.col("doc_id"), "text", rest.alias("rest"))  # so that no name clashes
    bad = materialize(repeated_lines(inner, min_docs, min_chars), "lines")
    if bad.count() <= broadcast_keys:
        out = _drop(inner, bad, min_chars, keep)
    else:
        out = _drop(_with_keys(inner, bad, min_chars), None, min_chars, keep)
    held = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    return out.select(*(held.get(c, F.col("rest").getField(c)).alias(c) for c in names), "n_lines", "n_dropped")


def _with_keys(docs: DataFrame, bad: DataFrame, min_chars: int) -> DataFrame:
    """docs (doc_id, text, rest) with the confirmed keys of each row's lines, by a join."""
    def keys(batches):
        for batch in small_batches(batches):
            digests, rows = _distinct(batch.column(2), min_chars)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(digests[:, 0]), pa.array(digests[:, 1])], ["d", "m", "k1", "k2"])

    row = [F.col("doc_id").cast("long").alias("d"), F.md5("text").alias("m")]
    held = docs.select(*row, "text").mapInArrow(keys, f"d long, m string, {ROWS}").join(bad, ["k1", "k2"])
    of_row = held.groupBy("d", "m").agg(F.collect_set(F.struct("k1", "k2", "first_doc")).alias("bad_keys"))
    return docs.join(of_row, docs.doc_id.eqNullSafe(of_row.d) & F.md5(docs.text).eqNullSafe(of_row.m), "left").select("doc_id", "text", "rest", "bad_keys")


def _drop(docs: DataFrame, bad: DataFrame | None, min_chars: int, keep: str) -> DataFrame:
    """docs (doc_id, text, rest and, without a table of bad keys, bad_keys) with their
    lines dropped and counted."""
    spark = docs.sparkSession
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text", T.StringType()), docs.schema["rest"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    lookup = None
    if bad is not None:
        rows = bad.toArrow()
        pairs = np.stack([rows.column("k1").to_numpy(), rows.column("k2").to_numpy()], axis=1).astype("<i8")
        lookup = spark.sparkContext.broadcast((pairs.tobytes(), rows.column("first_doc").to_pylist()))

    def run(batches):
        known = None
        if lookup is not None:
            raw, firsts = lookup.value
            known = {raw[16 * i : 16 * i + 16]: f for i, f in enumerate(firsts)}
        for batch in small_batches(batches):
            texts, n_lines, n_dropped = [], [], []
            own = batch.column(3).to_pylist() if known is None else [None] * batch.num_rows
            for doc, text, valid, of_row in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(1).is_valid().to_pylist(), own, strict=True):
                bad_keys = known
                if bad_keys is None:
                    bad_keys = {np.array([k["k1"], k["k2"]], "<i8").tobytes(): k["first_doc"] for k in of_row or ()}
                lines, kept, seen = text.split(b"\n"), [], set()
                for line, key in zip(lines, line_keys(text), strict=True):
                    digest = hashlib.blake2b(key, digest_size=16).digest() if bad_keys and _is_key(key, min_chars) else b""
                    if digest not in bad_keys or keep == "first" and bad_keys[digest] == doc and digest not in seen:
                        kept.append(line)
                    seen.add(digest)
                texts.append(b"\n".join(kept) if valid else None)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns = [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), batch.column(2), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "rest", "n_lines", "n_dropped"])

    ship(spark)
    return docs.mapInArrow(run, schema)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
bad AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, bad.key IS NOT NULL AS dropped FROM k LEFT JOIN bad ON k.key = bad.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
