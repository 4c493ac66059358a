"""Removal of repeated byte strings by suffix sorting.

Every 50-byte string is brought to the shard of its minimizer, the least hash
among its 20-byte strings, so all its occurrences meet in one shard; neighbouring
strings of one minimizer travel as one segment. Minimizers found in one text
only are left out, and equal segments are settled by their first owner. So are
segments that share with no other document 46 bytes around their minimizer, or, where a
string ends with it, all. What is left is a shard's text: external induced sorting gives
its suffixes with their common prefixes, and a run of suffixes that share 50 bytes is one
string's occurrences, of which the smallest doc_id keeps its bytes.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classes import described, digest_halves
from .common import discard, materialize, ship, small_batches, table, text_bytes, worker_cache
from .induced_sort import IN_MEMORY, suffix_blocks
from .polyhash import PolyHash
from .streams import id_set, shared_flags

LENGTH, SEED = 50, 20
#: Bytes of segments after which a part of a shard is sorted, where a minimizer ends.
PART = 4 << 20
#: No byte of UTF-8: it ends a segment in a shard's text.
END = 0xFF


def segments_of(text: bytes, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer hash, start, end and the minimizer's place of the segments that cover
    all strings of `length` bytes; each such string is in one segment, by its content."""
    return segments_in([text], length, seed)[:4]


def segments_in(texts: list[bytes], length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """segments_of() texts in a row, at places in the whole row; and the number of the
    text of each."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n, w = int(sizes.sum()) - seed + 1, length - seed + 1
    if n < w:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    hasher = worker_cache("suffix-hash", lambda: PolyHash(41))
    low = hasher.windows(hasher.prefix(np.frombuffer(b"".join(texts), np.uint8)), seed)
    least, into, span = low, np.zeros(n, np.min_scalar_type(w)), 1
    while span < w:  # least hash and its first place in windows of growing span
        step = min(span, w - span)
        later = least[step:] < least[:-step]
        into = np.where(later, into[step:] + into.dtype.type(step), into[:-step])
        least = np.minimum(least[step:], least[:-step])
        span += step
    at = np.arange(len(into)) + into
    new = np.concatenate(([True], at[1:] != at[:-1]))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    within = np.zeros(n + length + 1, np.int8)  # strings that cross the end of a text are none
    long = sizes >= length
    np.add.at(within, begins[long], 1)
    np.add.at(within, ends[long] - length + 1, -1)
    whole = np.cumsum(within[: len(at)], dtype=np.int8) > 0
    new[begins[long]] = True
    first = np.flatnonzero(new & whole)
    of = np.searchsorted(ends, first, "right")
    end = np.minimum(np.append(first[1:], n + length), ends[of] - length + 1) + length - 1
    return least[first].view(np.int64), first, end, at[first], of


def _described_segments(text: bytes, wanted: np.ndarray, length: int, seed: int) -> tuple:
    """_described_in() of one text."""
    return _described_in([text], wanted, length, seed)


def _blocks(texts: list[bytes], most: int = 1 << 16):
    """Ranges of texts of some `most` bytes each."""
    a, held = 0, 0
    for b, text in enumerate(texts):
        if held and held + len(text) > most:
            yield a, b
            a, held = b, 0
        held += len(text)
    if a < len(texts):
        yield a, len(texts)


def _described_in(texts: list[bytes], wanted: np.ndarray, length: int, seed: int) -> tuple:
    """Of the segments of texts with wanted minimizers: hash, digest, start, size, the place
    of the minimizer in the segment, the text's number, and all their bytes in a row."""
    h, start, end, place, of = segments_in(texts, length, seed)
    wanted = np.sort(wanted)
    chosen = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
    h, start, end, place, of = h[chosen], start[chosen], end[chosen], place[chosen], of[chosen]
    data, size = np.frombuffer(b"".join(texts), np.uint8), end - start
    hasher = worker_cache("segment-hash", lambda: PolyHash(43))
    digest = hasher.ranges(hasher.prefix(data), start, end).view(np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    return h, digest, start - (np.cumsum(sizes) - sizes)[of], size, place - start, of, data[at]


def dedup_suffixes(docs: DataFrame, length: int = LENGTH, seed: int = SEED, in_memory: int = IN_MEMORY, part: int = PART) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row per row of docs.

    A byte goes when a string of `length` bytes over it also starts in a document of
    smaller doc_id. Texts are UTF-8 bytes, a null text is an empty one; shorter texts
    keep all. Rows of one doc_id never remove each other's bytes. A null doc_id counts
    as larger than all others, and as one document. Other columns are ignored. Very
    long texts are cut into segments whole, each in one task. An empty table gives an
    empty result. in_memory bounds the tuples that a queue holds in memory; a part of a
    shard is some `part` bytes of segments, or one minimizer's, however many these are.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")

    reps, classes = described(docs, bytes)

    def minimizers(batches):
        for batch in small_batches(batches, 256):
            own, h, cls = text_bytes(batch.column(0)), [], []
            for a, b in _blocks(own):
                found, *_, of = segments_in(own[a:b], length, seed)
                order = np.lexsort((found, of))
                found, of = found[order], of[order]
                once = np.concatenate(([True], (found[1:] != found[:-1]) | (of[1:] != of[:-1])))[: len(found)]
                h.append(found[once])
                cls.append(np.array([classes.of(t) for t in own[a:b]], np.int64)[of[once]])
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (h, cls)], ["hash", "cls"])

    def shared(batches):
        for columns, flags, _ in shared_flags(batches, 1):
            if flags.any():
                yield pa.RecordBatch.from_arrays([pa.array(columns[1][flags]), pa.array(columns[0][flags])], ["cls", "hash"])

    found = docs.select("text").mapInArrow(minimizers, "hash long, cls long").repartition("hash").sortWithinPartitions("hash", "cls").mapInArrow(shared, "cls long, hash long")
    places = materialize(reps.join(found.groupBy("cls").agg(F.collect_set("hash").alias("hashes")), "cls"), "minimizers")
    wanted = spark.sparkContext.broadcast(id_set(places, "rep", places.count()))

    def texts(batches):
        for batch in small_batches(batches):
            part = batch.filter(pa.array(wanted.value.holds(np.asarray(batch.column(0)))))
            own = text_bytes(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([classes.of(t) for t in own], pa.int64()), pa.array([zlib.compress(t, 1) for t in own], pa.binary())], ["rep", "cls", "packed"])

    def cut(batches):
        for batch in small_batches(batches, 64):
            doc, cls = (np.asarray(c) for c in batch.columns[:2])
            own, hashes = [zlib.decompress(x) for x in batch.column(2).to_pylist()], batch.column(3)
            out = []
            for a, b in _blocks(own):
                # a minimizer that is shared is wanted of each text that has it
                h, digest, start, size, into, of, data = _described_in(own[a:b], np.asarray(hashes.slice(a, b - a).flatten()), length, seed)
                out.append((h, digest, doc[a:b][of], cls[a:b][of], start.astype(np.int32), into.astype(np.int16), size, data))
            if out:
                *columns, sizes, own = (np.concatenate(c) for c in zip(*out, strict=True))
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                data = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(own))])
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), data], ["hash", "digest", "doc", "cls", "start", "into", "bytes"])

    segments = docs.select("doc_id", "text").mapInArrow(texts, "rep long, cls long, packed binary").join(places, ["rep", "cls"]).select("rep", "cls", "packed", "hashes")
    segments = segments.mapInArrow(cut, "hash long, digest long, doc long, cls long, start int, into short, bytes binary")

    def sort_shard(batches):
        yield from _repeats(batches, length, in_memory, part, seed)

    gone = segments.repartition("hash").sortWithinPartitions("hash", "digest", "doc").mapInArrow(sort_shard, "rep long, cls long, start int, stop int")
    gone = materialize(gone.groupBy("rep", "cls").agg(F.collect_set(F.struct("start", "stop")).alias("at")), "repeated")
    touched = spark.sparkContext.broadcast(id_set(gone, "rep", gone.count()))
    discard(places)

    def rows(batches):
        for batch in small_batches(batches):
            flags = touched.value.holds(np.asarray(batch.column(0)))
            own = text_bytes(batch.column(2))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([classes.of(t) for t in own], pa.int64()), pa.array([len(t) for t in own], pa.int64()),
                pa.array([zlib.compress(t, 1) if f else None for t, f in zip(own, flags, strict=True)], pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in own], pa.string()),
            ], ["doc_id", "no_id", "cls", "n_bytes", "packed", "full_sha256"])

    info = reps.join(gone, ["rep", "cls"], "left")
    judged = docs.mapInArrow(rows, "doc_id long, no_id boolean, cls long, n_bytes long, packed binary, full_sha256 string").join(info, "cls", "left")

    def finish(batches):
        for batch in small_batches(batches, 512):
            out = []
            for doc, n, packed, sha, rep, start, stop in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6, 7)), strict=True):
                if doc > rep and n >= length:  # a copy of a smaller document
                    out.append((n, 1, hashlib.sha256(b"").hexdigest()))
                elif doc == rep and start:
                    depth = np.zeros(n + 1, np.int32)
                    np.add.at(depth, start, 1)
                    np.add.at(depth, stop, -1)
                    keep = np.cumsum(depth[:-1]) == 0
                    kept = np.frombuffer(zlib.decompress(packed), np.uint8)[keep]
                    out.append((int(n - keep.sum()), int((~keep & np.append(True, keep[:-1])).sum()), hashlib.sha256(kept.tobytes()).hexdigest()))
                else:
                    out.append((0, 0, sha))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "no_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = judged.select("doc_id", "no_id", "n_bytes", "packed", "full_sha256", "rep", "at.start", "at.stop").mapInArrow(finish, "doc_id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _repeats(batches, length: int, in_memory: int, part: int, seed: int = SEED):
    """(doc, class, start, stop) of repeated bytes in a shard, from its segments sorted
    by hash, digest and doc; a doc's texts are told apart by their classes. The shard
    is sorted in parts that end where a hash ends."""
    def batch_of(doc, cls, start, stop):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, kind)) for x, kind in ((doc, np.int64), (cls, np.int64), (start, np.int32), (stop, np.int32))], ["rep", "cls", "start", "stop"])

    def sort_part():
        """Sort what was written so far and begin anew."""
        for f in files:
            f.flush()
        rows = np.fromfile(path + ".rows", np.int64).reshape(-1, 7)
        keep = _in_context(path, rows, length, seed)
        if keep.any():
            number = np.cumsum(keep) - 1
            repeats = np.fromfile(path + ".again", np.int64).reshape(-1, 3)
            repeats = repeats[keep[repeats[:, 0]]]
            repeats[:, 0] = number[repeats[:, 0]]
            rows = _written(path, rows[keep])
            segment, into = _string_groups(path + ".kept", folder, rows, length, in_memory)
            for k, cls, start in chain([(segment, rows[segment, 4], rows[segment, 2] + into)], _moved(segment, into, repeats)):
                if len(k):
                    yield batch_of(*_spans(rows[k, 1], cls, start, length))
        for f in files:
            f.seek(0)
            f.truncate()

    with tempfile.TemporaryDirectory(prefix="suffix-") as folder:
        path = os.path.join(folder, "shard")
        files = [open(path + suffix, "wb") for suffix in ("", ".rows", ".again")]  # noqa: SIM115
        text, places, again = files
        at, n_written, last, part = 0, 0, None, max(part, 1)
        for columns, mixed, _ in shared_flags(batches, 1):
            h, digest, doc, cls, start, into, *_, own = columns
            size = np.fromiter(map(len, own), np.int64, len(own))
            ends = np.concatenate(([last is None or h[0] != last[0]], h[1:] != h[:-1]))  # another hash begins
            new = ends | np.concatenate(([last is None or digest[0] != last[1]], digest[1:] != digest[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
            owner = np.where(first < 0, last[2] if last else 0, doc[first])
            last = h[-1], digest[-1], owner[-1]
            if (covered := doc > owner).any():  # all of it is the owner's as well
                yield batch_of(doc[covered], cls[covered], start[covered], (start + size)[covered])
            written = mixed & new  # the minimizer has other segments
            repeated = mixed & ~new & ~covered  # its text, or another of its doc, repeats the segment
            total, number = (np.concatenate(([0], np.cumsum(x))) for x in (size * written, written))
            a = 0
            while True:
                full = np.flatnonzero(ends[a:] & (at + total[a:-1] - total[a] >= part))
                b = a + int(full[0]) if len(full) else len(h)
                k, again_k = a + np.flatnonzero(written[a:b]), a + np.flatnonzero(repeated[a:b])
                text.write(b"".join(own[k].tolist()))
                places.write(np.stack([at + total[k] - total[a], doc[k], start[k], size[k], cls[k], h[k], into[k]], axis=1).astype(np.int64).tobytes())
                again.write(np.stack([n_written + number[again_k] - number[a] - 1, cls[again_k], start[again_k]], axis=1).astype(np.int64).tobytes())
                if not len(full):
                    break
                yield from sort_part()
                at, n_written, a = 0, 0, b
            at, n_written = at + int(total[b] - total[a]), n_written + int(number[b] - number[a])
        yield from sort_part()
        for f in files:
            f.close()


#: Bytes by which a context is shorter than a string. A string lies around its minimizer
#: in one of the ways that are this far apart, and holds a context whole in that way.
STEP = 5


def _in_context(path: str, rows: np.ndarray, length: int, seed: int, block: int = 1 << 12) -> np.ndarray:
    """Segments that share a context of their minimizer, which is in it, with one in another
    document, as all do that share a string. The segments' bytes are in the file."""
    keep, span = np.zeros(len(rows), bool), length - seed
    if not len(rows) or not rows[:, 3].any():
        return keep
    source, hasher = np.memmap(path, np.uint8, "r"), worker_cache("segment-hash", lambda: PolyHash(43))
    ways = [(a, min(a + STEP - 1, span)) for a in range(0, span + 1, STEP)]
    found = np.zeros((len(ways), len(rows)), np.uint64)
    for i in range(0, len(rows), block):
        at, size, into = (rows[i : i + block, c] for c in (0, 3, 6))
        prefix = hasher.prefix(np.array(source[at[0] : at[-1] + size[-1]]))
        place = at - at[0] + into
        for k, (near, far) in enumerate(ways):  # strings with `near` to `far` bytes before the minimizer
            held = np.flatnonzero((into >= near) & (into + seed + span - far <= size))
            found[k, i + held] = hasher.ranges(prefix, place[held] - near, place[held] + seed + span - far) | np.uint64(1)
    for own in found:
        which = np.flatnonzero(own)
        order = which[np.argsort(own[which])]
        new = np.concatenate(([True], own[order[1:]] != own[order[:-1]]))[: len(order)]
        cuts, doc = np.flatnonzero(new), rows[order, 1]
        if len(cuts):
            mixed = np.minimum.reduceat(doc, cuts) != np.maximum.reduceat(doc, cuts)
            keep[order[mixed[np.cumsum(new) - 1]]] = True
    return keep


def _written(path: str, rows: np.ndarray, block: int = 1 << 12) -> np.ndarray:
    """Write the bytes of these segments, each ended, and return their rows with the
    places there."""
    source, rows = np.memmap(path, np.uint8, "r"), rows.copy()
    with open(path + ".kept", "wb") as f:
        for a in range(0, len(rows), block):
            start, size = rows[a : a + block, 0], rows[a : a + block, 3] + 1
            at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
            own = source[np.minimum(at, len(source) - 1)]
            own[np.cumsum(size) - 1] = END
            f.write(own.tobytes())
    rows[:, 0] = np.cumsum(rows[:, 3] + 1) - rows[:, 3] - 1
    return rows


def _moved(segment: np.ndarray, into: np.ndarray, repeats: np.ndarray, block: int = 1 << 16):
    """Where strings found in a segment start at the other places of its doc that have
    it: (segment, class, start), block by block of the places (segment, class, start)."""
    for at in range(0, len(repeats), block):
        number, cls, there = repeats[at : at + block].T
        low = np.searchsorted(segment, number)
        n = np.searchsorted(segment, number, "right") - low
        found = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        yield segment[found], np.repeat(cls, n), np.repeat(there, n) + into[found]


def _spans(doc: np.ndarray, cls: np.ndarray, start: np.ndarray, length: int):
    """(doc, class, start, stop) of the bytes that strings of a length at these places cover."""
    order = np.lexsort((start, cls, doc))
    doc, cls, start = doc[order], cls[order], start[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (cls[1:] != cls[:-1]) | (start[1:] > start[:-1] + 1)))
    cuts = np.flatnonzero(new)
    last = np.append(cuts[1:] - 1, len(doc) - 1)
    return doc[cuts], cls[cuts], start[cuts], start[last] + length


def _string_groups(path: str, folder: str, rows: np.ndarray, length: int, in_memory: int):
    """Segment and place in it, in order, of the occurrences of shared strings whose
    doc isn't the smallest."""
    offsets = rows[:, 0]
    out_segment, out_into = [], []

    def settle(positions: np.ndarray, groups: np.ndarray):
        k = np.searchsorted(offsets, positions, "right") - 1
        into = positions - offsets[k]
        inside = into + length <= rows[k, 3]
        k, into, groups = k[inside], into[inside], groups[inside]
        if len(k):
            doc = rows[k, 1]
            cuts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
            least = np.repeat(np.minimum.reduceat(doc, cuts), np.diff(np.append(cuts, len(doc))))
            gone = doc > least
            out_segment.append(k[gone])
            out_into.append(into[gone])

    blocks = suffix_blocks(path, folder, length, in_memory)
    where, group, number = [], [], 0
    for positions, shared in blocks:
        own = number + np.cumsum(shared < length)  # a fall below the length begins a group
        cut = int(np.searchsorted(own, own[-1]))  # where the last one begins, which may go on
        if cut:
            where.append(positions[:cut])
            group.append(own[:cut])
            settle(np.concatenate(where), np.concatenate(group))
            where, group = [], []
        where.append(positions[cut:])
        group.append(own[cut:])
        number = int(own[-1])
    if where:
        settle(np.concatenate(where), np.concatenate(group))
    if not out_segment:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    segment, into = np.concatenate(out_segment), np.concatenate(out_into)
    order = np.lexsort((into, segment))
    return segment[order], into[order]


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(table(spark, sf_dir, "documents"))
