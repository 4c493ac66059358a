"""Near-duplicate documents by an exact Jaccard join on word shingles.

Sets of 80 % similarity differ in at most two ninths of the larger one's size H.
The universe of shingles is hashed into m = H + 1 + slack segments, where m goes by
a band of set sizes; by the pigeonhole principle similar sets agree in at least
slack + 1 segments. A set is indexed by the contents of its segments in its own
band and in the next, where it may meet larger sets. Sets that share too few
contents with any other go at once.

Contents are allocated by cost. First the sets of each content are compared to the
set that shares most (as a rule the original of its near copies), so a large group
of copies costs a few comparisons a document. Of the contents that components are
then still divided over, those that would give more than `costly` pairs a row get
nothing, which a set can bear as long as it has no more of these, and of empty
segments, than the slack. Sets that have more meet through one-deletion
neighbourhoods of their segments. What even these leave in costly groups is first
thinned out by tokens that no other component has, then compared group by group in
blocks of bounded size, each an index of tokens that all of its group's sets pass.
So no group's pairs are ever listed, and every link is verified on its shingles.

Classes of equal texts are 64-bit digests; `clashes` finds those that two texts
share by 128 bits, and these get others.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .classes import Classes
from .common import discard, filtered, materialize, quoted, ship, small_batches, table, text_bytes, worker_cache
from .components import connected_components
from .polyhash import PolyHash, canonical, mix, word_ends
from .streams import id_set, mixed_flags, whole_groups

SHINGLE, PERCENT = 5, 80
#: Pairs a row that a group of equal contents may give before it is costly, and the
#: rows of a group that one task may take.
COSTLY, GATHERED = 8, 4096
#: Tokens of a block of sets that others pass.
BLOCK = 1 << 20
#: Comparisons with one text in a task's group.
PER_TEXT = 256
#: Classes that a task remembers, to index a text once.
REMEMBERED = 100_000

_NORMAL, _DELETED, _TOKEN = 1, 2, 3


def shingles(joined: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of lower-cased joined words;
    of fewer words, the hash of all."""
    return shingle_sets([joined], n)[0]


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """shingles() of all texts in a row, and how many each has."""
    sizes = np.zeros(len(texts), np.int64)
    which = [i for i, t in enumerate(texts) if t]
    if not which:
        return np.zeros(0, np.uint64), sizes
    start, end = word_ends(buffer := b" ".join(texts[i] for i in which))
    hasher = worker_cache("jaccard-hash", lambda: PolyHash(31))
    words = np.array([texts[i].count(b" ") + 1 for i in which])
    per = np.maximum(words - n + 1, 1)
    stop = np.cumsum(per)
    at = np.arange(stop[-1]) + np.repeat(np.cumsum(words) - words - stop + per, per)
    found = hasher.ranges(hasher.prefix(np.frombuffer(buffer, np.uint8)), start[at], end[at + np.repeat(np.minimum(words, n), per) - 1])
    for i, j in zip((stop - per).tolist(), stop.tolist(), strict=True):
        found[i:j].sort()
    new = np.concatenate(([True], found[1:] != found[:-1]))
    new[stop[:-1]] = True
    sizes[which] = np.add.reduceat(new, stop - per)
    return found[new], sizes


def lowered(texts: list[bytes]) -> list[bytes]:
    return [canonical(t.lower()) for t in texts]


def band_limits(most: int, percent: int) -> np.ndarray:
    """Largest set size of each band; similar sets are in one band or in neighbours."""
    limits = [1]
    while limits[-1] < most:
        limits.append(max(limits[-1] + 1, limits[-1] * 100 // percent))
    return np.array(limits)


def segments(limit: int, percent: int) -> tuple[int, int, int]:
    """H, slack and the number of segments of a band of sets up to limit."""
    h = 2 * limit * (100 - percent) // (100 + percent)
    slack = 0 if h == 0 else 1 + -(-h // 5)
    return h, slack, h + 1 + slack


def contents(tokens: np.ndarray, band: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens' segments in a band, and per segment its size and its content's hash
    (an order-free sum, so that deletions subtract)."""
    of = (mix(tokens ^ np.uint64(0x51ED27 * (band + 1))) % np.uint64(m)).astype(np.int64)
    value = mix(tokens + np.uint64(0xA5A5A5A5))
    size = np.bincount(of, minlength=m)
    total = np.zeros(m, np.uint64)
    np.add.at(total, of, value)
    return of, size, total


def _key(space: int, band, segment: np.ndarray, total: np.ndarray) -> np.ndarray:
    salt = np.asarray((space << 16) + band).astype(np.uint64) * np.uint64(0x9E3779B1)
    return mix(total + mix(segment.astype(np.uint64) + (salt << np.uint64(24)))).view(np.int64)


class Bands:
    def __init__(self, percent: int):
        self.percent, self.limits = percent, band_limits(2**31, percent)
        self.m = np.array([segments(int(x), percent)[2] for x in self.limits])

    def slack(self, band: int) -> int:
        return segments(int(self.limits[band]), self.percent)[1]

    def of(self, size: int) -> list[int]:
        """The bands a set of this size is indexed in."""
        own = int(np.searchsorted(self.limits, size))
        return [own, own + 1] if size * 100 // self.percent > self.limits[own] else [own]

    def normal(self, tokens: np.ndarray, band: int) -> tuple[np.ndarray, int]:
        """Keys of the non-empty segments, and how many are empty."""
        keys, n = self.normal_sets(tokens, np.array([len(tokens)]), np.array([band]))
        return keys, segments(int(self.limits[band]), self.percent)[2] - int(n[0])

    def normal_sets(self, tokens: np.ndarray, sizes: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the non-empty segments of sets in a row, and how many each has."""
        own = np.repeat(np.arange(len(sizes)), sizes)
        m = self.m[bands]
        first = np.cumsum(m) - m
        of = first[own] + (mix(tokens ^ (np.uint64(0x51ED27) * (bands + 1).astype(np.uint64))[own]) % m[own].astype(np.uint64)).astype(np.int64)
        size, total = np.bincount(of, minlength=int(m.sum())), np.zeros(int(m.sum()), np.uint64)
        np.add.at(total, of, mix(tokens + np.uint64(0xA5A5A5A5)))
        full = np.flatnonzero(size)
        own = np.searchsorted(first, full, "right") - 1
        return _key(_NORMAL, bands[own], full - first[own], total[full]), np.bincount(own, minlength=len(sizes))

    def differing(self, size: int, band: int) -> int:
        """Tokens by which a set may differ from any that it links to."""
        partner = min(int(self.limits[band]), size * 100 // self.percent)
        return (size + partner) * (100 - self.percent) // (100 + self.percent)

    def needed(self, size: int, band: int, filled: int) -> int:
        """Non-empty segments that a set shares with any that it links to: those that
        remain when each token by which the two may differ spoils one."""
        return filled - self.differing(size, band)

    def deleted(self, tokens: np.ndarray, band: int) -> np.ndarray:
        """Keys of contents and of those less one token, of the first segments that can
        take more differences than there may be: of two sets, the one that ends first
        has a segment there that both have keys for. With too few tokens for that, of
        all segments and of each token."""
        of, size, total = contents(tokens, band, int(self.m[band]))
        reach = np.cumsum(np.minimum(size, 2))
        last = int(np.searchsorted(reach, self.differing(len(tokens), band) + 1))
        full, inside = np.flatnonzero(size[: last + 1]), of <= last
        less = inside & (size[of] >= 2)
        keys = [_key(_DELETED, band, full, total[full]), _key(_DELETED, band, of[less], total[of[less]] - mix(tokens[less] + np.uint64(0xA5A5A5A5)))]
        if last == len(size):
            keys.append(_key(_TOKEN, band, np.zeros(len(tokens), np.int64), mix(tokens)))
        return np.unique(np.concatenate(keys))


def similar_components(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE, costly: int = COSTLY) -> DataFrame:
    """doc_id, n_shingles and component_id, a row per row of docs.

    Words are runs of anything but 0x20 and 0x09-0x0D, with A-Z lower-cased; the set
    of a text is its distinct n-word shingles, of fewer words the whole sequence. Two
    texts link when 100 * intersection >= percent * union; component_id is the
    smallest doc_id within reach. A null text, or one without words, has an empty
    set and is its own component. Rows of one doc_id link by any of their texts. A
    null doc_id links as others do but is never a component_id; a component of
    nothing else has a null one. Very long texts are cut into shingles as a whole, in
    one task. Other columns are ignored; an empty table gives an empty result.
    """
    own, roots, _ = linked_classes(docs, percent, n, costly)
    lowest = roots.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = roots.join(lowest, "component").select("cls", "component_id")
    out = own.join(of_class, "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def linked_classes(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE, costly: int = COSTLY) -> tuple[DataFrame, DataFrame, Classes]:
    """(doc_id, cls, n_shingles) of each row; (cls, rep, size, component) of each class
    of rows with equal words: its smallest doc_id, its set's size and the least class
    within reach; and how classes are told."""
    spark = docs.sparkSession
    ship(spark)
    bands = Bands(percent)
    docs = docs.select("doc_id", "text")
    classes = Classes()
    while True:
        shared = _shared(docs, classes, bands, n)
        noted = lambda kind: shared.where((F.col("tag") < 0) & (F.pmod(-1 - F.col("tag"), F.lit(3)) == kind))  # noqa: E731, B023
        value = F.floor((-1 - F.col("tag")) / 3).cast("long")
        own = noted(_ROW).select(F.when(value % 2 == 0, F.col("key")).alias("doc_id"), "cls", F.floor(value / 2).cast("long").alias("n_shingles"))
        reps = own.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size"))
        checks = noted(_CHECK).groupBy("cls").agg(F.min("key").alias("low"), F.max("key").alias("high"))
        if not (clashing := classes.clashes(checks)):
            break
        discard(shared)
        classes = Classes(clashing)
    own, reps = materialize(own, "rows"), materialize(reps, "classes")
    work = _Work(spark, docs, reps, classes, bands, n)
    sets = noted(_SET).select(F.col("key").alias("set"), "cls", value.alias("tag")).distinct()
    heavy = work.by_contents(shared.where("tag >= 0").select("key", F.col("cls").alias("set")), sets, costly)
    discard(shared)
    if not heavy.isEmpty():
        work.by_deletions(heavy, costly)
    discard(heavy)
    discard(work.texts)
    roots = reps.join(work.components, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    return own, roots, classes


ROWS = "key long, cls long, tag long"
#: Kinds of notes among the rows, whose tag is -1 - (3 * value + kind): a row of docs with
#: its doc_id as key, a class's check as key, a set (a class in a band) with its id as key.
#: The other rows, which are many, have a tag of 0 and the set's id in place of the class.
_ROW, _CHECK, _SET = 0, 1, 2


def _rows_of(parts: list[tuple], names=("key", "cls", "tag")):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], list(names))


#: Keys that a task packs at once, about as many as are told apart at once; packed rows
#: for each partition, so that these are about even.
PACKED, BUCKETS = 1 << 20, 16
#: A packed row: some keys of a bucket, the lower KEY bytes of each; their sets' ids,
#: of SET bytes each; notes, as whole integers.
PACKS, KEY, SET = "bucket long, keys binary, sets binary, notes binary", 4, 6


def _shared(docs: DataFrame, classes: Classes, bands: Bands, n: int) -> DataFrame:
    """Keys of all sets in their bands that two sets or more have, with notes of all rows
    and classes. A tag holds the band and how many contents a set needs to share.

    Keys are moved in rows of many, in KEY and SET bytes a key however many partitions
    there are. A key is its bucket and the lower bytes; two that agree in these by chance
    let more pairs through."""
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def keys(batches):
        seen: dict[int, int] = {}
        held, n_held = [], 0
        for batch in small_batches(batches, 128):
            texts = lowered(text_bytes(batch.column(1)))
            both = [classes.both(t) for t in texts]
            cls = np.array([c for c, _ in both])
            new = [i for i, (c, _) in enumerate(both) if c not in seen]
            tokens, sizes = shingle_sets([texts[i] for i in new], n)
            if len(seen) < REMEMBERED:
                seen.update(zip(cls[new].tolist(), sizes.tolist(), strict=True))
            size = np.array([seen[c] if c in seen else -1 for c in cls.tolist()])
            size[new] = sizes
            ids = batch.column(0)
            nothing = np.asarray(ids.is_null())
            notes = [(np.asarray(ids.fill_null(0)), cls, -1 - (3 * (2 * size + nothing) + _ROW))]
            notes.append((np.array([both[i][1] for i in new], np.int64), cls[new], np.full(len(new), -1 - _CHECK)))
            if rows := _set_rows(bands, cls[new], tokens, sizes):
                notes.append(rows[1])
                held.append(rows[0])
                n_held += len(rows[0][0])
            if len(cls):
                yield _noted(int(cls[0]) % buckets, np.stack([np.concatenate(c) for c in zip(*notes, strict=True)]))
            if n_held >= PACKED:
                yield _packed(held, buckets)
                held, n_held = [], 0
        if held:
            yield _packed(held, buckets)

    packed = docs.mapInArrow(keys, PACKS).repartition("bucket").sortWithinPartitions("bucket")
    return materialize(packed.mapInArrow(_mixed, ROWS), "shared")


def _packs(buckets, keys, sets, notes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), *(x if isinstance(x, pa.Array) else pa.array(x, pa.binary()) for x in (keys, sets, notes))], ["bucket", "keys", "sets", "notes"])


def _noted(bucket: int, notes: np.ndarray) -> pa.RecordBatch:
    return _packs([bucket], [b""], [b""], [notes.astype(np.int64).tobytes()])


def _packed(held: list[tuple], buckets: int) -> pa.RecordBatch:
    """Rows of keys and sets' ids, one for each bucket that has any."""
    keys, sets = (np.concatenate(c).view(np.uint64) for c in zip(*held, strict=True))
    bucket = ((keys >> np.uint64(8 * KEY)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    ends = np.append(cuts, len(bucket))

    def column(values: np.ndarray, width: int):
        own = np.ascontiguousarray(values[order].view(np.uint8).reshape(-1, 8)[:, :width])
        return pa.BinaryArray.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(own)])

    return _packs(bucket[cuts], column(keys, KEY), column(sets, SET), [b""] * len(cuts))


def _unpacked(packs: list[bytes], width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(packs), np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view(np.int64).ravel()


def _mixed(batches, most: int = PACKED):
    """From packed rows in order of their buckets, the notes and, of keys that two sets
    or more have, (key, set, 0). Of a bucket of more than `most` keys those are held that
    one set has had so far, and those known to be shared; the rest goes on."""
    def told(bucket, key, own, known):
        """Rows of shared keys; (key, set) of the other keys, and the keys known to be shared."""
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        once = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])))  # copies of a text come from several tasks
        key, own = key[once], own[once]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        many = (size > 1) | np.isin(key[start], known)
        flags = np.repeat(many, size)
        rows = _rows_of([(key[flags] | bucket << 8 * KEY, own[flags], np.zeros(flags.sum(), np.int64))])
        return rows, (key[~flags], own[~flags]), np.union1d(known, key[start][many])

    none = np.zeros(0, np.int64)
    at, keys, sets, n, left, known = None, [], [], 0, (none, none), none

    def bucket_of():
        return told(at, np.concatenate((left[0], _unpacked(keys, KEY))), np.concatenate((left[1], _unpacked(sets, SET))), known)

    for batch in small_batches(batches, 256):
        for bucket, key, own, notes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if notes:
                yield _rows_of([tuple(np.frombuffer(notes, np.int64).reshape(3, -1))])
            if not key:
                continue
            if bucket != at or n >= max(most, 2 * len(left[0])):
                if keys:
                    rows, left, known = bucket_of()
                    if rows.num_rows:
                        yield rows
                if bucket != at:
                    left, known = (none, none), none
                at, keys, sets, n = bucket, [], [], 0
            keys.append(key)
            sets.append(own)
            n += len(key) // KEY
    if keys and (rows := bucket_of()[0]).num_rows:
        yield rows


#: A tag: band, contents that a set needs to share, size of the set; the last two have
#: this many bits and are held down to them, which lets more pairs through.
BITS = 24


def _tag(band, needed, size):
    most = (1 << BITS) - 1
    return band << 2 * BITS | np.minimum(needed, most) << BITS | np.minimum(size, most)


def _set_rows(bands: Bands, cls: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> list[tuple]:
    """(key, set) of sets in a row, in each of their bands, and a note of each set."""
    ends = np.cumsum(sizes)
    of = [(i, band) for i, size in enumerate(sizes.tolist()) if size for band in bands.of(size)]
    if not of:
        return []
    which, band = (np.array(x) for x in zip(*of, strict=True))
    again = np.concatenate([tokens[ends[i] - sizes[i] : ends[i]] for i in which])
    keys, filled = bands.normal_sets(again, sizes[which], band)
    needed = np.array([bands.needed(s, b, f) for s, b, f in zip(sizes[which].tolist(), band.tolist(), filled.tolist(), strict=True)])
    tag = _tag(band, np.maximum(needed, 0), sizes[which])
    ids = mix(cls[which].view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (band + 1).astype(np.uint64))
    ids = (ids >> np.uint64(64 - 8 * SET)).view(np.int64)
    return [(keys, np.repeat(ids, filled)), (ids, cls[which], -1 - (3 * tag + _SET))]


class _Work:
    """The joins of one run, and the components (cls, component) found so far."""

    def __init__(self, spark: SparkSession, docs: DataFrame, reps: DataFrame, classes: Classes, bands: Bands, n: int):
        self.spark, self.docs, self.reps, self.classes, self.bands, self.n = spark, docs, reps, classes, bands, n
        self.components: DataFrame | None = None
        self.texts: DataFrame | None = None

    def rooted(self, rows: DataFrame) -> DataFrame:
        """With the component of column cls."""
        return rows.join(self.components, "cls", "left").withColumn("component", F.coalesce("component", "cls"))

    def by_contents(self, shared: DataFrame, sets: DataFrame, costly: int) -> DataFrame:
        """Links of sets of which one is not heavy; (cls, bands) of the heavy ones."""
        counts = shared.groupBy("set").agg(F.count(F.lit(1)).cast("int").alias("n"))
        enough = sets.join(counts, "set").where(F.col("n") >= _needed())
        likely = materialize(shared.join(enough, "set").drop("set"), "likely")
        notes = sets.where(_needed() == 0).select("cls", "tag")
        self.texts = self._texts(likely.select("cls").union(notes.select("cls")).distinct())

        # each set with the one of its group that shares most of its contents
        size = F.col("tag").bitwiseAND((1 << BITS) - 1).cast("int").alias("size")
        hubs = likely.groupBy("key").agg(F.max(F.struct("n", "cls", size)).alias("hub"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
        hubs = hubs.select("key", F.col("hub.cls").alias("hub"), F.col("hub.size").cast("long").alias("hub_tag"))
        grouped = materialize(likely.join(hubs, "key").select("key", "cls", "tag", "hub", "hub_tag"), "grouped")
        near = grouped.where((F.col("hub") != F.col("cls")) & _fit("tag", "hub_tag", self.bands.percent))
        pairs = near.groupBy("hub", "cls", "tag").agg(F.count(F.lit(1)).alias("n")).where(2 * F.col("n") >= _needed())
        self.link(pairs.select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct())
        discard(likely)

        rooted = materialize(self.rooted(grouped.select("key", "cls", "tag")), "rooted")
        discard(grouped)
        spread = materialize(_costs(rooted, costly), "spread")
        discard(rooted)
        enough = spread.groupBy("cls", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("costly").cast("int")).alias("lost")).where(F.col("n") >= _needed())
        open_rows = materialize(spread.join(enough, ["cls", "tag"]).select("key", "component", "cls", "tag", "costly", "lost"), "open")
        discard(spread)
        found = _across(open_rows.where("not costly"), ("cls", "tag", "lost")).groupBy("a_cls", "b_cls", "a_tag", "b_tag", "a_lost", "b_lost").agg(F.count(F.lit(1)).alias("n"))
        enough = F.greatest(_needed("a_tag") - F.col("a_lost"), _needed("b_tag") - F.col("b_lost"))
        self.link(found.where((F.col("n") >= enough) & _fit("a_tag", "b_tag", self.bands.percent)).select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")).distinct())
        heavy = open_rows.where(_needed() <= F.col("lost")).select("cls", "tag").union(notes)
        heavy = materialize(heavy.groupBy("cls").agg(F.collect_set(F.shiftright("tag", 2 * BITS).cast("int")).alias("bands")), "heavy")
        discard(open_rows)
        return heavy

    def by_deletions(self, heavy: DataFrame, costly: int) -> None:
        """Links between heavy sets.

        A set goes if too few of its tokens are in heavy sets of other components, by a
        Bloom filter of bounded size. The rest is dealt out evenly, as few texts may hold
        most of the work."""
        bands, n = self.bands, self.n

        def tokens(batches):
            for batch in small_batches(batches, 512):
                found, sizes = shingle_sets([zlib.decompress(w) for w in batch.column(0).to_pylist()], n)
                lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int64()), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists.cast(pa.list_(pa.int64()))], ["cls", "component", "bands", "tokens"])

        rows = self.rooted(self.texts.select("cls", "words").join(heavy, "cls")).select("words", "cls", "component", "bands")
        sets = materialize(rows.repartition("cls").mapInArrow(tokens, "cls long, component long, bands array<int>, tokens array<long>"), "sets")
        each = sets.repartition("cls").select("component", F.explode("tokens").alias("token"))
        mixed = each.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
        mixed = materialize(mixed, "mixed")
        common = self.spark.sparkContext.broadcast(id_set(mixed, "token", mixed.count()))

        def kept(batches):
            for batch in small_batches(batches, 512):
                held, sizes = _lists(batch.column(3))
                ends = np.concatenate(([0], np.cumsum(sizes)))
                known = np.concatenate(([0], np.cumsum(common.value.holds(held))))
                yield batch.filter(pa.array((known[ends[1:]] - known[ends[:-1]]) * 100 >= bands.percent * sizes))

        def deleted(batches):
            for batch in small_batches(batches, 128):
                held, sizes = _lists(batch.column(3))
                ends, out = np.cumsum(sizes), []
                for cls, end, size, of in zip(batch.column(0).to_pylist(), ends.tolist(), sizes.tolist(), batch.column(2).to_pylist(), strict=True):
                    for band in of:
                        k = bands.deleted(held[end - size : end].view(np.uint64), band)
                        out.append((k, np.full(len(k), cls), np.full(len(k), _tag(band, 0, size))))
                if out:
                    yield _rows_of(out)

        def grouped(batches):
            for columns, flags in mixed_flags(batches, 1):
                if flags.any():
                    yield _rows_of([tuple(c[flags] for c in columns)])

        left = materialize(sets.mapInArrow(kept, sets.schema), "left")
        keys = left.repartition("cls").mapInArrow(deleted, ROWS)
        shared = materialize(keys.repartition("key").sortWithinPartitions("key").mapInArrow(grouped, ROWS), "shared")
        spread = materialize(_costs(self.rooted(shared), costly), "open")
        found = _across(spread.where("not costly"), ("cls", "tag"))
        self.link(found.where(_fit("a_tag", "b_tag", bands.percent)).select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")).distinct())
        dear = materialize(self.rooted(spread.where("costly").select("key", "cls")), "costly")
        if not dear.isEmpty():
            self.by_blocks(dear, left.select("cls", "tokens"))
        for done in (sets, mixed, left, shared, spread, dear):
            discard(done)

    def by_blocks(self, dear: DataFrame, sets: DataFrame) -> None:
        """Links between sets (cls, tokens) that share a key: (key, cls, component).

        They meet by the hubs of their keys: a hub's sets outside of its component are
        dealt in blocks of BLOCK tokens, and all of its sets pass each block."""
        percent = self.bands.percent
        counted = dear.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("cls")))  # a set's own keys
        best = counted.groupBy("key").agg(F.max(F.struct("n", "cls", "component")).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        members = dear.join(best, "key").select(F.col("hub.cls").alias("hub"), F.col("hub.component").alias("home"), "cls", "component").distinct()
        members = materialize(members.join(sets, "cls"), "members")
        outside = members.where("component != home")
        parts = outside.groupBy("hub").agg(F.ceil(F.sum(F.size("tokens")) / BLOCK).cast("long").alias("parts"))
        index = outside.join(parts, "hub").select("hub", F.pmod(F.xxhash64("cls"), "parts").alias("part"), F.lit(0).alias("side"), "cls", "component", "tokens")
        probe = members.join(parts, "hub").select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "cls", "component", "tokens")
        together = index.unionByName(probe).repartition("hub", "part").sortWithinPartitions("hub", "part", "side")
        self.link(together.mapInArrow(lambda batches: _passed(batches, percent), "a long, b long"), verified=True)
        discard(members)

    def link(self, pairs: DataFrame, verified: bool = False) -> None:
        """Join the components of the pairs (a, b) that link."""
        links = materialize(pairs if verified else self._compared(pairs), "links")
        if links.isEmpty():
            if self.components is None:
                self.components = self.spark.createDataFrame([], "cls long, component long")
            return
        if self.components is None:
            self.components = materialize(connected_components(links).withColumnRenamed("node", "cls"), "components")
            return
        before = self.components
        root = lambda side: before.select(F.col("cls").alias(side), F.col("component").alias(f"{side}_root"))
        lifted = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        above = materialize(connected_components(lifted).toDF("component", "top"), "above")
        old = before.join(above, "component", "left").select("cls", F.coalesce("top", "component").alias("component"))
        new = above.toDF("cls", "component").join(before, "cls", "left_anti")
        self.components = materialize(old.unionByName(new), "components")
        for done in (before, above, links):
            discard(done)

    def _texts(self, wanted: DataFrame) -> DataFrame:
        """(cls, size, words) of wanted classes, each from the rows of its smallest doc_id."""
        ids = materialize(wanted.join(self.reps, "cls").select(F.coalesce("rep", F.lit(2**63 - 1)).alias("rep"), "cls", "size"), "wanted")
        held, classes = self.spark.sparkContext.broadcast(id_set(ids, "rep", ids.count())), self.classes

        def run(batches):
            for batch in small_batches(batches):
                part = batch.filter(pa.array(held.value.holds(np.asarray(batch.column(0)))))
                joined = lowered(text_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([classes.of(j) for j in joined], pa.int64()), pa.array([zlib.compress(j, 1) for j in joined], pa.binary())], ["rep", "cls", "words"])

        rows = self.docs.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("rep"), "text").mapInArrow(run, "rep long, cls long, words binary")
        out = materialize(rows.join(ids, ["rep", "cls"]).dropDuplicates(["rep", "cls"]).select("cls", "size", "words"), "words")
        discard(ids)
        return out

    def _compared(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that link.

        The words of b are brought to a, whose words are repeated for every PER_TEXT
        comparisons, so that no text's many partners meet in one task."""
        percent, n = self.bands.percent, self.n
        pairs = materialize(pairs, "pairs")
        parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_TEXT).cast("long").alias("parts"))
        hubs = parts.select(F.col("a").alias("cls"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
        others = pairs.join(parts, "a").select(F.col("b").alias("cls"), "a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b")
        asked = hubs.unionByName(others).join(self.texts.select("cls", "words"), "cls").select("a", "part", "b", "words")

        def compare(batches):
            mine, tokens = None, None
            for batch in small_batches(batches, 256):
                out = []
                for a, part, b, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = shingles(zlib.decompress(words), n)
                    if b is None:
                        mine, tokens = (a, part), own
                        continue
                    if mine != (a, part):
                        raise ValueError("words of a pair are missing")
                    both = len(np.intersect1d(tokens, own, assume_unique=True))
                    if 100 * both >= percent * (len(tokens) + len(own) - both):
                        out.append((a, b))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

        together = asked.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        return together.mapInArrow(compare, "a long, b long")


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column in a row, and how many each row has."""
    return np.asarray(column.flatten()), np.asarray(column.value_lengths()).astype(np.int64)


def _needed(tag: str = "tag"):
    return F.shiftright(tag, BITS).bitwiseAND((1 << BITS) - 1)


def _fit(a_tag: str, b_tag: str, percent: int):
    """Whether two sets' sizes allow a link."""
    a, b = (F.col(t).bitwiseAND((1 << BITS) - 1) for t in (a_tag, b_tag))
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _costs(rows: DataFrame, costly: int) -> DataFrame:
    """Rows of groups with two components or more, and whether their group's pairs
    across components would be more than `costly` a row, or its rows too many."""
    parts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).cast("double").alias("n"))
    groups = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    pairs = (F.col("n") * F.col("n") - F.col("within")) / 2
    return rows.join(groups.select("key", ((pairs > costly * F.col("n")) | (F.col("n") > GATHERED)).alias("costly")), "key")


def _across(rows: DataFrame, held: tuple[str, ...]) -> DataFrame:
    """Pairs of rows of one key and different components: the held columns of each,
    as a_ and b_, where a has the smaller cls (the first held)."""
    names = [f"{side}_{c}" for side in "ab" for c in held]

    def run(batches):
        for key, component, cls, *rest in whole_groups(batches):
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(start, len(key)))
            later = np.repeat(start + size, size) - np.arange(len(key)) - 1  # a row meets those behind it
            for a, b in _cuts(later, 1 << 17):
                i = np.repeat(np.arange(a, b), later[a:b])
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later[a:b]) - later[a:b], later[a:b])
                good = component[i] != component[j]
                i, j = i[good], j[good]
                if len(i):
                    i, j = np.where(cls[i] < cls[j], i, j), np.where(cls[i] < cls[j], j, i)
                    yield _rows_of([tuple(c[k] for k in (i, j) for c in (cls, *rest))], names)

    rows = rows.select("key", "component", *(F.col(c).cast("long").alias(c) for c in held))
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _passed(batches, percent: int):
    """Pairs of sets that link, from rows (hub, part, side, cls, component, tokens) in this
    order: the sets of side 0 of a block, then those of side 1 that pass it."""
    block, held, index = None, [], None
    for batch in batches:
        hub, part, side, cls, component = (np.asarray(batch.column(i)) for i in range(5))
        tokens, sizes = _lists(batch.column(5))
        ends = np.cumsum(sizes)
        cuts = np.flatnonzero((hub[1:] != hub[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(hub)], strict=True):
            if a == b:
                continue
            own = (tokens[ends[a] - sizes[a] : ends[b - 1]], sizes[a:b], cls[a:b], component[a:b])
            if block != (hub[a], part[a]):
                block, held, index = (hub[a], part[a]), [], None
            if side[a] == 0:
                held.append(own)
                continue
            if index is None:
                all_tokens, all_sizes, all_cls, all_components = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 4
                order = np.argsort(all_tokens, kind="stable")
                index = all_tokens[order], np.repeat(np.arange(len(all_sizes)), all_sizes)[order], all_sizes, all_cls, all_components
            yield from _links(own, index, percent)


def _links(own, index, percent: int):
    """Pairs of sets in `own` and in a block's index that link, across components."""
    tokens, sizes, cls, component = own
    known, owner, known_sizes, known_cls, known_components = index
    low = np.searchsorted(known, tokens)
    hits = np.searchsorted(known, tokens, "right") - low
    of = np.repeat(np.arange(len(sizes)), sizes)
    for a, b in _cuts(np.bincount(of, weights=hits, minlength=len(sizes)).astype(np.int64), 1 << 20):
        at = np.flatnonzero((of >= a) & (of < b) & (hits > 0))
        n = hits[at]
        found = np.repeat(low[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pair, both = np.unique(np.repeat(of[at], n) * len(known_sizes) + owner[found], return_counts=True)
        x, y = pair // max(len(known_sizes), 1), pair % max(len(known_sizes), 1)
        good = (component[x] != known_components[y]) & (100 * both >= percent * (sizes[x] + known_sizes[y] - both))
        if good.any():
            yield _rows_of([(cls[x[good]], known_cls[y[good]])], ("a", "b"))


def _cuts(weights: np.ndarray, most: int):
    """Ranges of rows whose weights sum up to some `most`."""
    total = np.cumsum(weights)
    a = 0
    while a < len(weights):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def one_of_each(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """The rows of docs but for near-duplicates: of the rows whose texts are within
    reach of each other one stays, that with the smallest doc_id, then class of its
    text, then hash of all columns; a null doc_id comes last. Rows are judged one by
    one, also where ids are null or repeat. Texts without words all stay. Columns may
    have any names; an empty table gives an empty result.

    Rows without another near them are told by a filter of bounded size and stay where
    they are; only the others are moved with their texts, to meet what was decided."""
    _, roots, classes = linked_classes(docs, percent, n)
    columns = docs.columns
    row = F.xxhash64(*(F.col(quoted(c)) for c in columns)).alias("row")
    carried = docs.select(row, F.struct(*(F.col(quoted(c)) for c in columns)).alias("carried"))
    at = {c: columns.index(c) for c in ("doc_id", "text")}

    def own_classes(texts: list[bytes]) -> np.ndarray:
        return np.array([classes.of(t) for t in lowered(texts)], np.int64)

    def told(batches):
        """doc_id, cls and row of all rows."""
        for batch in small_batches(batches, 512):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own_classes(text_bytes(batch.column(1)))), batch.column(2)], ["doc_id", "cls", "row"])

    def moved(batches):
        """Rows of wanted classes; their text is held once, in what is carried."""
        for batch in small_batches(batches, 64):
            whole = batch.column(1)
            ids = own_classes(text_bytes(pc.struct_field(whole, [at["text"]])))
            out = pa.RecordBatch.from_arrays([pc.struct_field(whole, [at["doc_id"]]), pa.array(ids), *batch.columns], ["doc_id", "cls", "row", "carried"])
            yield out.filter(pa.array(wanted.value.holds(ids)))

    own = StructType([docs.schema["doc_id"], StructField("cls", LongType()), StructField("row", LongType())])
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "cls", "row")
    known = roots.select("cls", "component")
    meta = materialize(docs.select("doc_id", "text", row).mapInArrow(told, own).join(known, "cls"), "meta")
    first = meta.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
    same = meta.join(first, "component").where(order == F.col("first")).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    first = materialize(first.join(same, "component"), "first")
    info = materialize(known.join(first.select("component", "first", "n"), "component"), "info")
    discard(meta)
    wanted = docs.sparkSession.sparkContext.broadcast(id_set(info, "cls", info.count()))
    in_place = filtered(docs, lambda texts: ~wanted.value.holds(own_classes(texts)))  # rows that have no other near them
    judged = carried.mapInArrow(moved, StructType([*own, carried.schema["carried"]])).join(info, "cls", "left").where(F.col("component").isNull() | (order == F.col("first")))
    if not first.where("n > 1").isEmpty():
        once = judged.where("n > 1").dropDuplicates(["component"]).select("carried")
        judged = judged.where("n is null or n = 1").select("carried").unionByName(once)
    return in_place.unionByName(judged.select(*(F.col("carried").getField(c).alias(c) for c in columns)))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT w.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id FROM w JOIN r ON r.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""
