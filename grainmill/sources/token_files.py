"""Flat token files (*.ds): tokens of 2 or 4 bytes without a header, document ends
in a .index file beside it, 'tokenizer|size' in the first line of a .metadata file.

Read as fixed samples of sequence_length + 1 tokens, partitioned by byte ranges that
begin on samples and streamed in pieces; written in two phases (sources/commits.py),
one or several files a task. As a stream, the samples are read over and over: a position
is an epoch, a file and a sample, and a restart goes on where the checkpoint says.

Options: path, sequence_length (read), token_size (2 or 4), pattern, max_tokens and
skip_tokens (a running budget over the files in order), join_folders (the files of each
folder, of one write, are one in the order of their names: samples go on from each into
the next), keep_rest (the last sample of a file may be short), file_seed (the files in the
order of numpy's generator of that seed), with_folder (names relative to path), listing
(a table of path and size, as sources/listing.py keeps it, in place of a walk),
positions (columns pos and epoch as well), partition_tokens; written: eos,
max_file_tokens (a task begins another file there); streamed: samples_per_batch,
max_samples (where the stream ends; unlimited without), progress (a folder in which the
source notes how far it has promised samples, before it does; the checkpoint's will do).
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition

from .commits import Commit
from .files import list_values, listed, range_reader, read_range, relative, store

#: Tokens read and handed on at once.
PIECE = 1 << 18


@dataclass
class Range(InputPartition):
    path: str
    first_sample: int
    start: int
    samples: int
    pos: int = 0
    epoch: int = 0
    tokens: int = 0
    #: (path, first token, stop) of the files that hold these tokens, counted in their row
    held: list = field(default_factory=list)


class TokenFileSource(DataSource):
    @classmethod
    def name(cls):
        return "ds"

    def schema(self):
        more = ", pos long, epoch long" if _flag(self.options, "positions") else ""
        return "file string, sample_idx long, input_ids array<long>" + more

    def reader(self, schema):
        return TokenFileReader(self.options)

    def streamReader(self, schema):
        return TokenStreamReader(self.options)

    def writer(self, schema, overwrite):
        return TokenFileWriter(self.options, overwrite)


def _flag(options, name: str) -> bool:
    return options.get(name, "false").lower() == "true"


def token_type(size: int) -> np.dtype:
    if size not in (2, 4):
        raise ValueError(f"token_size {size}")
    return np.dtype(f"<u{size}")


class Samples:
    """The samples of a folder's files in order, and how ranges of them are read."""

    def __init__(self, options):
        self.path = options["path"]
        self.length = int(options.get("sequence_length", 1024)) + 1
        self.dtype = token_type(int(options.get("token_size", self._stated_size(options))))
        self.pattern, self.listing = options.get("pattern"), options.get("listing")
        self.budget, self.skip = int(options.get("max_tokens", 2**62)), int(options.get("skip_tokens", 0))
        self.seed, self.with_folder, self.positions = options.get("file_seed"), _flag(options, "with_folder"), _flag(options, "positions")
        self.join, self.rest = _flag(options, "join_folders"), _flag(options, "keep_rest")
        self.block = max(1, int(options.get("partition_tokens", 4_000_000)) // self.length)

    @staticmethod
    def _stated_size(options) -> int:
        """From the metadata files, which must agree; 2 without any."""
        filesystem, _ = store(options["path"])
        try:
            files = listed(options["path"], ".ds.metadata")
        except FileNotFoundError:
            return 2
        lines = {read_range(filesystem, f, 0, n).split(b"\n")[0] for f, n in files}
        if len(lines) > 1:
            raise ValueError(f"files of different tokenizers: {sorted(lines)}")
        return int(lines.pop().rpartition(b"|")[2])

    def files(self) -> list[tuple[str, int, int, int, list]]:
        """(path, first token, samples, tokens of these, files in a row that hold them) of
        each file, or each folder whose files are joined, under skip and budget."""
        if self.listing:
            from .listing import read_listing

            files = read_listing(self.listing, self.path, ".ds", self.pattern)
        else:
            files = listed(self.path, ".ds", self.pattern)
        _, root = store(self.path)
        groups: dict[str, list[tuple[str, int, int]]] = {}
        for path, size in files:
            name = path
            if self.join:
                name = f"{root.rstrip('/')}/{relative(path, root)}".rpartition("/")[0]
            row = groups.setdefault(name, [])
            start = row[-1][2] if row else 0
            row.append((path, start, start + size // self.dtype.itemsize))
        rows = list(groups.items())
        if self.seed is not None:
            rows = [rows[i] for i in np.random.default_rng(int(self.seed)).permutation(len(rows))]
        out, before, left = [], self.skip, self.budget
        for path, held in rows:
            tokens = held[-1][2]
            skipped = min(before, tokens)
            before -= skipped
            taken = min(tokens - skipped, left)
            left -= taken
            samples = -(-taken // self.length) if self.rest else taken // self.length
            out.append((path, skipped, samples, min(taken, samples * self.length), held))
        return out

    def parts(self, file: tuple[str, int, int, int, list], first: int, stop: int, pos: int, epoch: int) -> list[Range]:
        """Samples [first, stop) of a file as ranges; pos is that of its first sample."""
        path, skipped, _, tokens, held = file
        out = []
        for i in range(first, stop, self.block):
            n = min(self.block, stop - i)
            start, end = skipped + i * self.length, skipped + min((i + n) * self.length, tokens)
            here = bisect_right(held, start, key=lambda h: h[2])
            own = held[here : bisect_left(held, end, lo=here, key=lambda h: h[1])]
            out.append(Range(path, i, start, n, pos + i, epoch, end - start, own))
        return out

    def read(self, part: Range):
        filesystem, root = store(self.path)
        name = relative(part.path, root) if self.with_folder else part.path.rsplit("/", 1)[-1]
        step, held = max(1, PIECE // self.length), [(range_reader(filesystem, path), start, stop) for path, start, stop in part.held]
        for at in range(0, part.samples, step):
            n = min(step, part.samples - at)
            tokens = min(n * self.length, part.tokens - at * self.length)
            ids = self._tokens(held, part.start + at * self.length, tokens)
            offsets = pa.array(np.minimum(np.arange(n + 1) * self.length, tokens).astype(np.int32))
            first = part.first_sample + at
            columns = {"file": pa.repeat(pa.scalar(name), n), "sample_idx": pa.array(np.arange(first, first + n)), "input_ids": pa.ListArray.from_arrays(offsets, pa.array(ids))}
            if self.positions:
                columns |= {"pos": pa.array(np.arange(part.pos + at, part.pos + at + n)), "epoch": pa.array(np.full(n, part.epoch))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def _tokens(self, held: list, start: int, n: int) -> np.ndarray:
        """Tokens [start, start + n) of files in a row."""
        size, found = self.dtype.itemsize, []
        for get, first, stop in held:
            low, high = max(start, first), min(start + n, stop)
            if low < high:
                found.append(np.frombuffer(get((low - first) * size, (high - low) * size), self.dtype))
        return (found[0] if len(found) == 1 else np.concatenate(found)).astype(np.int64)


class TokenFileReader(DataSourceReader):
    def __init__(self, options):
        self.samples = Samples(options)

    def partitions(self):
        out, before = [], 0
        for file in self.samples.files():
            out += self.samples.parts(file, 0, file[2], before, 0)
            before += file[2]
        return out or [Range("", 0, 0, 0)]

    def read(self, part):
        return self.samples.read(part) if part.samples else iter(())


class TokenStreamReader(DataSourceStreamReader):
    """Offsets are (epoch, file, sample), the next sample to read. The engine asks for
    the latest offset without saying where it is, also after a restart; so each offset is
    noted in the progress folder before it is given, and the next lies beyond it. What
    was promised but not processed is in the checkpoint's range of the next batch."""

    def __init__(self, options):
        self.samples = Samples(options)
        self.files = [f for f in self.samples.files() if f[2]]
        if not self.files:
            raise ValueError("no whole sample to read")
        self.first = [0]
        for f in self.files:
            self.first.append(self.first[-1] + f[2])
        self.step = int(options.get("samples_per_batch", 1000))
        self.most = int(options.get("max_samples", 2**62))
        self.progress = options["progress"]

    def _offset(self, pos: int) -> dict:
        epoch, at = divmod(pos, self.first[-1])
        file = bisect_right(self.first, at) - 1
        return {"epoch": epoch, "file": file, "sample": at - self.first[file]}

    def _pos(self, offset: dict) -> int:
        return offset["epoch"] * self.first[-1] + self.first[offset["file"]] + offset["sample"]

    def initialOffset(self):
        return self._offset(0)

    def latestOffset(self):
        filesystem, root = store(self.progress)
        filesystem.create_dir(root, recursive=True)
        note = f"{root.rstrip('/')}/promised.json"
        noted = filesystem.get_file_info(note).type == fs.FileType.File
        pos = min(self.most, (self._pos(json.loads(read_range(filesystem, note, 0, 1 << 16))) if noted else 0) + self.step)
        with filesystem.open_output_stream(note + ".part") as f:
            f.write(json.dumps(self._offset(pos)).encode())
        filesystem.move(note + ".part", note)
        return self._offset(pos)

    def partitions(self, start, end):
        out, at, stop, total = [], self._pos(start), self._pos(end), self.first[-1]
        while at < stop:
            epoch, inside = divmod(at, total)
            file = bisect_right(self.first, inside) - 1
            n = min(stop - at, self.first[file + 1] - inside)
            first = inside - self.first[file]
            out += self.samples.parts(self.files[file], first, first + n, epoch * total + self.first[file], epoch)
            at += n
        return out

    def read(self, part):
        return self.samples.read(part)


class TokenFileWriter(DataSourceArrowWriter):
    """Rows with an input_ids array, a document each."""

    def __init__(self, options, overwrite=False):
        self.to = Commit(options["path"], overwrite)
        self.dtype = token_type(int(options.get("token_size", 2)))
        self.tokenizer = options.get("tokenizer", "none")
        eos = options.get("eos")
        self.eos = [int(eos)] if eos is not None else []
        self.most = int(options.get("max_file_tokens", 10**9))

    def write(self, iterator):
        filesystem, folder, name = self.to.attempt()
        rows = self._documents(iterator)
        tokens, paths = next(rows, None), []
        while tokens is not None or not paths:
            target = f"{folder}/{name}-{len(paths) // 3:04d}.ds"
            ends, n = [], 0
            with filesystem.open_output_stream(target) as f:
                while tokens is not None and (not n or n + len(tokens) <= self.most):
                    f.write(tokens.tobytes())
                    n += len(tokens)
                    ends.append(n)
                    tokens = next(rows, None)
            with filesystem.open_output_stream(target + ".index") as f:
                f.write(np.array(ends, "<u8").tobytes())
            with filesystem.open_output_stream(target + ".metadata") as f:
                f.write(f"{self.tokenizer}|{self.dtype.itemsize}\n{n}\n".encode())
            paths += [target, target + ".index", target + ".metadata"]
        return self.to.written(paths)

    def _documents(self, iterator):
        end = self._stored(np.array(self.eos, np.int64))
        for batch in iterator:
            ids, bounds = list_values(batch.column(batch.schema.get_field_index("input_ids")))
            if ids.null_count:
                raise TypeError("a null token")
            stored = self._stored(ids.to_numpy(zero_copy_only=False))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                yield np.concatenate((stored[a:b], end)) if len(end) else stored[a:b]

    def _stored(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and (ids.min() < 0 or ids.max() > np.iinfo(self.dtype).max):
            raise ValueError("token id out of range")
        return ids.astype(self.dtype)

    def commit(self, messages):
        self.to.publish(messages)

    def abort(self, messages):
        self.to.cancel()
