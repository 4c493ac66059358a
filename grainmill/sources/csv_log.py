"""A small CSV that many runs append to: one file, a header if it is new, a lock.

For logs of results, a few rows a run. The file is written anew beside the old one and
put in its place, so readers see all of a run's rows or none.
"""

from __future__ import annotations

import csv
import io
import random
import time

from pyspark.sql import DataFrame, SparkSession

#: Rows of one append that are taken to the driver; more belong in a table.
MOST_ROWS = 10_000


class Locked(Exception):
    """The lock was held for as long as was waited."""


def append_csv(rows: DataFrame, path: str, wait: float = 60.0, stale: float = 600.0) -> None:
    """Append the rows to the file at path, under its lock `path.lock`; wait so many
    seconds for others, with longer and longer pauses. A lock older than `stale` seconds
    was left by a run that died and is taken away. Columns must be those of the header."""
    spark = rows.sparkSession
    found = rows.limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows for a log")
    jvm = spark._jvm
    target, lock = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".lock"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    _acquire(fs, lock, wait, stale)
    try:
        old = _text(jvm, fs, target) if fs.exists(target) else ""
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        if not old:
            writer.writerow(rows.columns)
        elif next(csv.reader(io.StringIO(old))) != rows.columns:
            raise ValueError(f"{path} has other columns")
        writer.writerows(["" if v is None else v for v in r] for r in found)
        aside = jvm.org.apache.hadoop.fs.Path(path + ".part")
        stream = fs.create(aside, True)
        stream.write(bytearray((old + out.getvalue()).encode()))
        stream.close()
        if fs.exists(target):
            fs.delete(target, False)
        fs.rename(aside, target)
    finally:
        fs.delete(lock, False)


def _acquire(fs, lock, wait: float, stale: float) -> None:
    end, pause = time.monotonic() + wait, 0.02
    while not fs.createNewFile(lock):
        try:
            if time.time() - fs.getFileStatus(lock).getModificationTime() / 1000 > stale:
                fs.delete(lock, False)
                continue
        except Exception:  # it has just gone
            continue
        if time.monotonic() > end:
            raise Locked(str(lock))
        time.sleep(pause * random.uniform(0.5, 1.5))
        pause = min(pause * 2, 2.0)


def _text(jvm, fs, path) -> str:
    stream = fs.open(path)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log as a table; it must be there."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
