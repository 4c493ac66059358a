"""Things several corpus operators share: shipping code, scratch tables, text bytes."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words under the whitespace rule are split at exactly these bytes.
SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch of rows that go to a Python worker, by which its memory and the
#: executor's buffers are bounded; a longer row is a batch of its own.
BATCH, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python
    workers can import it wherever they run; and bound the batches of this session."""
    if spark.conf.get(BATCH_SETTING, None) is None:  # who sets it knows better
        spark.conf.set(BATCH_SETTING, str(BATCH))
    sc = spark.sparkContext
    if getattr(sc, "_grainmill_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="grainmill-"), "grainmill_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("grainmill", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._grainmill_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables: spark.checkpoint.dir as
    the cluster names it, or a folder of our own where it is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = getattr(spark.sparkContext, "_grainmill_scratch", None)
        if root is None:
            root = spark.sparkContext._grainmill_scratch = "file://" + tempfile.mkdtemp(prefix="grainmill-scratch-")
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/grainmill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return the table read back: lineage is
    cut and every executor can read it, also after others were lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._grainmill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    path = getattr(df, "_grainmill_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as F.col takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def filtered(docs: DataFrame, keep) -> DataFrame:
    """The rows of docs for whose texts keep(texts as bytes) is true, in place. Columns
    may have any names, as they travel in one."""
    names = docs.columns
    at = names.index("text")
    row = docs.select(F.struct(*(F.col(quoted(c)) for c in names)).alias("row"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in small_batches(batches, 64):
            yield batch.filter(pa.array(keep(text_bytes(pc.struct_field(batch.column(0), [at])))))

    return row.mapInArrow(run, row.schema).select(*(F.col("row").getField(c).alias(c) for c in names))


def worker_cache(key: str, make):
    """A value kept for the life of a Python worker."""
    store = sys.modules.setdefault("_grainmill_worker_cache", type(sys)("_grainmill_worker_cache")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def worker_latest(key: str, tag: str, make):
    """As worker_cache, but only the value of the latest tag is kept."""
    held = worker_cache(key, dict)
    if tag not in held:
        held.clear()
        held[tag] = make()
    return held[tag]


def small_batches(batches, max_rows: int = 1024):
    """Slices of at most max_rows rows, to bound what one step holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, max_rows):
            yield batch.slice(at, max_rows)


def text_bytes(column):
    """Values of an Arrow string column as Python bytes, nulls as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary() if column.type != pa.large_string() else pa.large_binary()).to_pylist()]


def ascii_lower(col):
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
