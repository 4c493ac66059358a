"""Listing of large trees: breadth first, a round of tasks for each level, kept.

Each round lists all folders of a level in tasks; what they hold is a table, of which
the files are results and the folders the next round's work. The driver counts folders
and holds no names. A listing is kept under the hash of its folder, pattern and depth,
so a later run with the same lists nothing.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import cache_key
from .cache import kept
from .commits import COMMITS, DATA
from .files import listed, relative, store

#: Folders that a task lists at least; more tasks than that for small levels only cost.
FOLDERS_A_TASK = 16


def _level(spark: SparkSession, root: str, folders: DataFrame, n: int) -> DataFrame:
    """(path, name, size, folder) of all that lies directly in these folders. A folder
    with committed writes is taken as its manifests say, in one piece."""
    def run(batches):
        filesystem, top = store(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                inside = filesystem.get_file_info(fs.FileSelector(folder))
                found = []
                if any(x.path.endswith(f"/{COMMITS}") for x in inside):
                    try:
                        found = [(p, relative(p, top), s, False) for p, s in listed(_uri(root, top, folder), "") if "/" not in relative(p, folder)]
                    except FileNotFoundError:
                        pass
                    inside = [x for x in inside if x.type == fs.FileType.Directory]
                found += [(x.path, relative(x.path, top), max(x.size or 0, 0), x.type == fs.FileType.Directory) for x in inside if x.path.rsplit("/", 1)[-1] not in (DATA, COMMITS)]
                columns = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "name", "size", "is_folder"])

    return folders.repartition(max(1, n // FOLDERS_A_TASK), "path").mapInArrow(run, "path string, name string, size long, is_folder boolean")


def _uri(root: str, top: str, folder: str) -> str:
    """folder, a path of the store, written as root is."""
    return root[: len(root) - len(top)] + folder if root.endswith(top) else folder


def walk(spark: SparkSession, root: str, scratch: str, depth: int | None = None, pattern: str | None = None) -> DataFrame:
    """(path, name, size) of the files below root, at most `depth` folders down, whose
    names below root match a pattern in full. Levels are written below scratch."""
    from . import ship

    ship(spark)
    _, top = store(root)
    folders, n, level, found = spark.createDataFrame([(top.rstrip("/"),)], "path string"), 1, 0, []
    while n and (depth is None or level <= depth):
        path = f"{scratch.rstrip('/')}/level-{level}"
        _level(spark, root, folders, n).write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path)
        found.append(path)
        folders = rows.where("is_folder").select("path")
        n, level = folders.count(), level + 1
    files = spark.read.parquet(*found).where("NOT is_folder").select("path", "name", "size")
    return files.where(F.col("name").rlike(f"^(?:{pattern})$")) if pattern else files


def kept_listing(spark: SparkSession, root: str, keep: str, depth: int | None = None, pattern: str | None = None) -> tuple[DataFrame, str]:
    """The listing of root under these parameters, and the folder where it is kept."""
    key = "listing-" + cache_key(root=root, depth=depth, pattern=pattern)
    table = kept(spark, keep, key, lambda: walk(spark, root, f"{keep.rstrip('/')}/{key}-levels", depth, pattern))
    return table, f"{keep.rstrip('/')}/{key}"


def read_listing(listing: str, root: str, suffix: str, pattern: str | None = None) -> list[tuple[str, int]]:
    """(path, size) from a kept listing, as files.listed gives them."""
    import pyarrow.dataset as ds

    filesystem, at = store(listing)
    _, top = store(root)
    rows = ds.dataset(at, format="parquet", filesystem=filesystem, exclude_invalid_files=True).to_table(columns=["path", "name", "size"]).to_pylist()
    found = [(relative(r["path"], top), r["path"], r["size"]) for r in rows if r["path"].startswith(top) and r["path"].endswith(suffix)]
    if pattern:
        found = [f for f in found if re.fullmatch(pattern, f[0])]
    if not found:
        raise FileNotFoundError(f"no *{suffix} in {listing}")
    return [(p, s) for _, p, s in sorted(found)]
