"""Indexed token data: a .bin file of tokens and an .idx file that describes it.

Rows are written from `tokens` (a document of one sequence) or `sequences` (a document
of several), in two phases (sources/commits.py); read with offset and length, of each
sequence only that slice. Filters on file and seq_id narrow what is read. `requested`
reads other slices of other sequences for every row of a table.

Of an index and of the data only the bytes in need are read, near ones together. The
index holds a mark, a version, a type code, counts, then sizes (int32),
byte pointers (int64) and document bounds (int64), all little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .commits import Commit, Written
from .files import list_values, listed, range_reader, ranges, read_range, store

#: Bytes of an index before its arrays; sequences and bytes between two requests that
#: are read along with them; bytes read at once; tokens written or handed on at once
#: (more only where one sequence has more).
HEADER, GAP_SEQUENCES, GAP_BYTES, MOST_BYTES, PIECE = 34, 1024, 1 << 16, 1 << 23, 1 << 20

#: Fixed values of the format: its mark, and the type of each code.
MARK = b"MMIDIDX\x00\x00"
CODES = {1: "u1", 2: "i1", 3: "<i2", 4: "<i4", 5: "<i8", 6: "<f8", 7: "<f8", 8: "<u2"}


def code_of(vocab_size: int | None) -> int:
    """Two bytes where the vocabulary is known to fit, else four."""
    return 8 if vocab_size is not None and vocab_size < 65500 else 4


@dataclass
class Index:
    code: int
    sizes: np.ndarray
    pointers: np.ndarray
    documents: np.ndarray


def parse_index(raw: bytes) -> Index:
    if raw[:9] != MARK or struct.unpack_from("<Q", raw, 9)[0] != 1:
        raise ValueError("not an index of version 1")
    (code,), (n, n_docs) = struct.unpack_from("<B", raw, 17), struct.unpack_from("<QQ", raw, 18)
    at = 34
    sizes = np.frombuffer(raw, "<i4", n, at)
    pointers = np.frombuffer(raw, "<i8", n, at + 4 * n)
    return Index(code, sizes, pointers, np.frombuffer(raw, "<i8", n_docs, at + 12 * n))


def build_index(code: int, sizes: list[int] | np.ndarray, documents: list[int] | np.ndarray) -> bytes:
    sizes = np.array(sizes, "<i4")
    pointers = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))[:-1])) * np.dtype(CODES[code]).itemsize if len(sizes) else np.zeros(0, np.int64)
    return MARK + struct.pack("<QBQQ", 1, code, len(sizes), len(documents)) + sizes.tobytes() + pointers.astype("<i8").tobytes() + np.array(documents, "<i8").tobytes()


def merged_index(first: Index, second: Index) -> bytes:
    """The index of two data files in a row: all sequences of both, the documents of the
    first alone, as builders of this format write it."""
    if first.code != second.code:
        raise ValueError("different types")
    return build_index(first.code, [*first.sizes.tolist(), *second.sizes.tolist()], first.documents.tolist())


class IndexFile:
    """The arrays of an index, read in parts; read(start, size) gives bytes of the file."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        raw = read(0, HEADER)
        if raw[:9] != MARK or struct.unpack_from("<Q", raw, 9)[0] != 1:
            raise ValueError("not an index of version 1")
        (code,), (self.n, self.n_docs) = struct.unpack_from("<B", raw, 17), struct.unpack_from("<QQ", raw, 18)
        self.dtype = np.dtype(CODES[code])

    def sizes(self, first: int, stop: int) -> np.ndarray:
        return np.frombuffer(self.read(HEADER + 4 * first, 4 * (stop - first)), "<i4")

    def pointers(self, first: int, stop: int) -> np.ndarray:
        return np.frombuffer(self.read(HEADER + 4 * self.n + 8 * first, 8 * (stop - first)), "<i8")

    def _bounds(self, first: int, stop: int) -> np.ndarray:
        return np.frombuffer(self.read(HEADER + 12 * self.n + 8 * first, 8 * (stop - first)), "<i8")

    def documents(self, first: int, stop: int) -> np.ndarray:
        """The document of each sequence: the last one that begins at it or before. A
        bisection finds the first; from there on a document a sequence at most is read,
        and those that are empty."""
        low, high = 0, self.n_docs
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self._bounds(mid, mid + 1)[0] <= first else (low, mid)
        bounds, at = [], low
        while at < self.n_docs:
            part = self._bounds(at, min(at + 65536, self.n_docs))
            bounds.append(part[part < stop])
            at += len(part)
            if len(bounds[-1]) < len(part):
                break
        held = np.concatenate(bounds) if bounds else np.zeros(0, np.int64)
        return low - 1 + np.searchsorted(held, np.arange(first, stop), "right")


def slices(index: IndexFile, read: Callable[[int, int], bytes], wanted: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """The tokens of each wanted (sequence, offset, length), in their order. Sequences
    that lie near one another are looked up together, and so are their bytes."""
    spans: list[tuple[int, int]] = [(0, 0)] * len(wanted)
    for first, stop, members in ranges([(q, q + 1) for q, _, _ in wanted], GAP_SEQUENCES, MOST_BYTES // 8):
        sizes, pointers = index.sizes(first, stop), index.pointers(first, stop)
        for i in members:
            q, offset, length = wanted[i]
            offset = max(offset, 0)
            n = max(0, min(int(sizes[q - first]) - offset, length))
            start = int(pointers[q - first]) + offset * index.dtype.itemsize
            spans[i] = (start, start + n * index.dtype.itemsize)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(wanted)
    held = [i for i, (a, b) in enumerate(spans) if b > a]
    for start, stop, members in ranges([spans[i] for i in held], GAP_BYTES, MOST_BYTES):
        raw = read(start, stop - start)
        for k in members:
            a, b = spans[held[k]]
            out[held[k]] = np.frombuffer(raw, index.dtype, (b - a) // index.dtype.itemsize, a - start).astype(np.int64)
    return out


@dataclass
class Part(InputPartition):
    path: str
    first: int
    stop: int


class IndexedSource(DataSource):
    @classmethod
    def name(cls):
        return "mmidx"

    def schema(self):
        return "file string, seq_id long, doc_id long, size int, pointer long, tokens array<long>"

    def reader(self, schema):
        return IndexedReader(self.options)

    def writer(self, schema, overwrite):
        return IndexedWriter(self.options, overwrite)


def _headers(path: str) -> list[tuple[str, int]]:
    """(index path, sequences) of all files in order; of each the header is read."""
    filesystem, _ = store(path)
    return [(p, IndexFile(lambda start, size, p=p: read_range(filesystem, p, start, size)).n) for p, _ in listed(path, ".idx")]


class IndexedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.block = options["path"], int(options.get("partition_sequences", 100_000))
        self.offset, self.length = int(options.get("offset", 0)), int(options.get("length", 2**31))
        self.low, self.high, self.only = 0, 2**62, None

    def pushFilters(self, filters):
        """Ranges of seq_id and names of files narrow the partitions; Spark filters again."""
        for f in filters:
            column, value = ".".join(f.attribute) if hasattr(f, "attribute") else "", getattr(f, "value", None)
            if column == "seq_id":
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.low = max(self.low, value)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.high = min(self.high, value + 1)
                if isinstance(f, GreaterThan):
                    self.low = max(self.low, value + 1)
                if isinstance(f, LessThan):
                    self.high = min(self.high, value)
                if isinstance(f, In) and value:
                    self.low, self.high = max(self.low, min(value)), min(self.high, max(value) + 1)
            if column == "file" and isinstance(f, (EqualTo, In)):
                names = {value} if isinstance(f, EqualTo) else set(value)
                self.only = names if self.only is None else self.only & names
        return filters

    def partitions(self):
        out = []
        for path, n in _headers(self.path):
            if self.only is None or path.rsplit("/", 1)[-1] in self.only:
                stop = min(n, self.high)
                out += [Part(path, i, min(i + self.block, stop)) for i in range(self.low, stop, self.block)]
        return out or [Part("", 0, 0)]

    def read(self, part):
        if part.first == part.stop:
            return
        filesystem, _ = store(self.path)
        index, data = IndexFile(range_reader(filesystem, part.path)), range_reader(filesystem, part.path[:-4] + ".bin")
        name, first = part.path.rsplit("/", 1)[-1], part.first
        docs = index.documents(part.first, part.stop)
        taken = np.clip(index.sizes(part.first, part.stop).astype(np.int64) - max(self.offset, 0), 0, max(self.length, 0))
        before = np.concatenate(([0], np.cumsum(taken)))
        while first < part.stop:
            fits = part.first + int(np.searchsorted(before, before[first - part.first] + PIECE, "right")) - 1
            stop = min(max(fits, first + 1), first + 4096, part.stop)
            tokens = slices(index, data, [(i, self.offset, self.length) for i in range(first, stop)])
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(tokens)))
            own = docs[first - part.first : stop - part.first].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (stop - first)), pa.array(np.arange(first, stop)), pa.array(own), pa.array(index.sizes(first, stop)), pa.array(index.pointers(first, stop)), lists], ["file", "seq_id", "doc_id", "size", "pointer", "tokens"])
            first = stop


def requested(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """requests (seq_id, offset, length and any other columns) with the tokens of each:
    of sequence seq_id, counted over all files in the order of their names, `length`
    tokens from `offset` on, fewer where it ends. A null length means to the end, a null
    offset 0. A null seq_id or one that isn't there gives null, an offset past the end
    an empty array. A column of the requests that is named tokens is replaced.

    Requests are dealt in ranges of sequences and sorted, so each task reads a stretch of
    a few files; a sequence that very many ask for is split by the rest of their columns.
    The files' names are sent to all tasks, one for each file."""
    from . import ship

    ship(spark)
    heads = _headers(path)
    paths = [p for p, _ in heads]
    first = np.concatenate(([0], np.cumsum([n for _, n in heads]))).astype(np.int64)
    own = requests.drop("tokens")
    names = own.columns
    at = [names.index(c) for c in ("seq_id", "offset", "length")]
    schema = T.StructType([*own.schema.fields, T.StructField("tokens", T.ArrayType(T.LongType()))])

    def run(batches):
        filesystem, _ = store(path)
        opened: dict[int, tuple] = {}
        for whole in batches:
            for low in range(0, whole.num_rows, 4096):
                batch = whole.slice(low, 4096)
                seq, offset, length = (batch.column(i).to_pylist() for i in at)
                out: list = [None] * batch.num_rows
                by_file: dict[int, list[int]] = {}
                for i, q in enumerate(seq):
                    if q is not None and 0 <= q < first[-1]:
                        by_file.setdefault(int(np.searchsorted(first, q, "right")) - 1, []).append(i)
                for file, rows in by_file.items():
                    if file not in opened:
                        opened.clear()
                        opened[file] = IndexFile(range_reader(filesystem, paths[file])), range_reader(filesystem, paths[file][:-4] + ".bin")
                    index, data = opened[file]
                    wanted = [(int(seq[i] - first[file]), offset[i] or 0, 2**62 if length[i] is None else length[i]) for i in rows]
                    for i, tokens in zip(rows, slices(index, data, wanted), strict=True):
                        out[i] = tokens
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*names, "tokens"])

    dealt = own.repartitionByRange("seq_id", F.xxhash64(*(F.col(f"`{c}`") for c in names))).sortWithinPartitions("seq_id")
    return dealt.mapInArrow(run, schema)


def merge_indexed(spark: SparkSession, sources: list[str], target: str) -> None:
    """Copy the files of several folders, data and indexes, into one, in tasks, and publish
    them together. Files keep their order: that of the folders, then of their names. The
    types of all must agree. The driver holds a name a file."""
    from . import ship

    ship(spark)
    files = [(i, s, path) for i, s in enumerate(sources) for path, _ in listed(s, ".idx")]
    to = Commit(target)

    def run(batches):
        filesystem, folder, name = to.attempt()
        for batch in batches:
            for k, source, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, _ = store(source)
                code = parse_index(read_range(own, path, 0, own.get_file_info(path).size)).code
                paths = [f"{folder}/{k:05d}-{path.rsplit('/', 1)[-1][:-4]}{end}" for end in (".bin", ".idx")]
                for end, into in zip((".bin", ".idx"), paths, strict=True):
                    with own.open_input_stream(path[:-4] + end) as f, filesystem.open_output_stream(into) as out:
                        while part := f.read(MOST_BYTES):
                            out.write(part)
                yield pa.RecordBatch.from_arrays([pa.array([code]), pa.array([to.written(paths).files])], ["code", "files"])

    rows = spark.createDataFrame(files, "k int, source string, path string").repartition(max(1, len(files)), "path").mapInArrow(run, "code long, files array<string>").collect()
    if len({r.code for r in rows}) > 1:
        to.cancel()
        raise ValueError("different types")
    to.publish([Written(list(r.files)) for r in rows])


class IndexedWriter(DataSourceArrowWriter):
    """Each row ends a document."""

    def __init__(self, options, overwrite=False):
        self.to = Commit(options["path"], overwrite)
        vocab = options.get("vocab_size")
        self.code = code_of(int(vocab) if vocab else None)

    def write(self, iterator):
        filesystem, folder, name = self.to.attempt()
        stem = f"{folder}/{name}"
        sizes, documents, n = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0
        with filesystem.open_output_stream(stem + ".bin") as f:
            for batch in iterator:
                rows = batch.column(batch.schema.get_field_index("sequences" if "sequences" in batch.schema.names else "tokens"))
                if "sequences" in batch.schema.names:
                    rows, ends = list_values(rows)
                else:
                    ends = np.arange(len(rows) + 1)
                tokens, bounds = list_values(rows)
                if tokens.null_count:
                    raise TypeError("a null token")
                for at in range(0, len(tokens), PIECE):
                    f.write(tokens[at : at + PIECE].to_numpy(zero_copy_only=False).astype(CODES[self.code]).tobytes())
                sizes.append(np.diff(bounds))
                documents.append(ends[1:] + n)
                n += len(rows)
        with filesystem.open_output_stream(stem + ".idx") as f:
            f.write(build_index(self.code, np.concatenate(sizes), np.concatenate(documents)))
        return self.to.written([stem + ".bin", stem + ".idx"])

    def commit(self, messages):
        self.to.publish(messages)

    def abort(self, messages):
        self.to.cancel()
