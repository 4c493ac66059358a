"""Files of any store that Arrow reaches (local, S3, HDFS ...), by uri or path."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs

from .commits import logical, visible


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def relative(path: str, root: str) -> str:
    """A file's name below root, without the folders of a write's attempts."""
    return logical(path[len(root) :].lstrip("/"))


def listed(path: str, suffix: str, pattern: str | None = None, recursive: bool = True, depth: int | None = None) -> list[tuple[str, int]]:
    """(path, size) of the committed files below path, at most `depth` folders down, that
    end in suffix and match a pattern in full by their relative name, in the order of
    these names. None at all is an error."""
    filesystem, root = store(path)
    every = [f for f in filesystem.get_file_info(fs.FileSelector(root, recursive=recursive)) if f.type == fs.FileType.File]
    found = [(relative(f.path, root), f) for f in visible(filesystem, root, every) if f.path.endswith(suffix)]
    if depth is not None:
        found = [(name, f) for name, f in found if name.count("/") <= depth]
    if pattern:
        found = [(name, f) for name, f in found if re.fullmatch(pattern, name)]
    if not found:
        raise FileNotFoundError(f"no *{suffix} in {path}")
    return [(f.path, f.size) for _, f in sorted(found, key=lambda x: x[0])]


def read_range(filesystem: fs.FileSystem, path: str, start: int, size: int) -> bytes:
    with filesystem.open_input_file(path) as f:
        return f.read_at(size, start)


def list_values(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All values of a list column in a row, and the bounds of its rows in them; a null
    row has none. No value becomes a Python object."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), np.concatenate(([0], np.cumsum(sizes)))


def ranges(spans: list[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int, list[int]]]:
    """Spans (start, stop) joined to larger ones where at most `gap` lies between and the
    result is no longer than `most`: (start, stop, numbers of the spans in it), in order."""
    order = sorted(range(len(spans)), key=lambda i: spans[i])
    at = 0
    while at < len(order):
        start, stop = spans[order[at]]
        members = [order[at]]
        at += 1
        while at < len(order) and spans[order[at]][0] <= stop + gap and max(stop, spans[order[at]][1]) - start <= max(most, stop - start):
            stop = max(stop, spans[order[at]][1])
            members.append(order[at])
            at += 1
        yield start, stop, members


def range_reader(filesystem: fs.FileSystem, path: str) -> Callable[[int, int], bytes]:
    """read(start, size) of one file that stays open."""
    f = filesystem.open_input_file(path)
    return lambda start, size: f.read_at(size, start)


def require(path: str, names: list[str]) -> None:
    """All of these files must be below path."""
    filesystem, root = store(path)
    found = filesystem.get_file_info([f"{root.rstrip('/')}/{n}" for n in names])
    missing = {n for n, f in zip(names, found, strict=True) if f.type != fs.FileType.File}
    if missing:
        every = [f for f in filesystem.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
        missing -= {relative(f.path, root) for f in visible(filesystem, root, every)}
    if missing:
        raise FileNotFoundError(", ".join(sorted(missing)))
