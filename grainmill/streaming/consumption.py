"""Tokens per source as documents stream in, and what stages have consumed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import word_count


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema) -> DataFrame:
    """A replay of a table, whether it is one file or a folder of them. A pattern is given
    for the name, as the engine takes a plain path for a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/{name}.parque[t]")


def document_stream(spark: SparkSession, folder: str, schema, glob: str | None = None, files_per_trigger: int = 1) -> DataFrame:
    """A replay of a folder's parquet files, a few at a time; offsets are kept by
    the query's checkpoint, so a restart goes on where it stopped."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def running_consumption(docs: DataFrame) -> DataFrame:
    """Running tokens per source; state is one row per source."""
    return docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("tokens"))


def hourly_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly counts by type; rows later than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = timed.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def endless(spark: SparkSession, samples: int, per_second: int) -> DataFrame:
    """(epoch, sample_id) of an unending pass over a number of samples, at a rate."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rate.select(F.floor(F.col("value") / samples).alias("epoch"), (F.col("value") % samples).alias("sample_id"))


def token_stream(spark: SparkSession, path: str, progress: str, **options) -> DataFrame:
    """(file, sample_idx, input_ids, pos, epoch): the samples of a folder of token files
    over and over, some of them a batch; see sources/token_files.py."""
    from ..sources import register

    register(spark)
    return spark.readStream.format("ds").options(progress=progress, positions="true", **options).load(path)


def appended(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that there is to read now, written to a table; each batch once, also after a
    restart."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def summed(stream: DataFrame, sums: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """All that there is to read now, each batch as sums gives it in a folder of its own
    below path. So the stream itself is never kept, and a batch that runs again, also
    after a restart, writes the same folder again."""
    def kept(batch: DataFrame, number: int) -> None:
        sums(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    stream.writeStream.foreachBatch(kept).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def record_consumption(stream: DataFrame, state: str, checkpoint: str) -> None:
    """Add what the stream (folder, n) has to read now to the totals kept below state.

    Every batch writes a version of the totals, a row a folder, from the version before
    its own; a batch that runs again writes the same version again. So totals count each
    row once, whenever the query stopped."""
    def merged(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.select("folder", "n")
        before = [v for v in _versions(spark, state) if v < number]
        if before:
            own = own.unionByName(spark.read.parquet(_version(state, max(before))))
        own.groupBy("folder").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(_version(state, number))

    stream.writeStream.foreachBatch(merged).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def consumed(spark: SparkSession, state: str) -> DataFrame:
    """(folder, n): the totals of the latest whole version; none before the first."""
    found = _versions(spark, state)
    return spark.read.schema("folder string, n long").parquet(_version(state, max(found))) if found else spark.createDataFrame([], "folder string, n long")


def _version(state: str, number: int) -> str:
    return f"{state.rstrip('/')}/v{number:09d}"


def _versions(spark: SparkSession, state: str) -> list[int]:
    """Versions that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{state.rstrip('/')}/v*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return [int(str(x.getPath().getParent().getName())[1:]) for x in found]


def drained(stream: DataFrame, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that there is to read now, as a table in memory (for small results)."""
    import uuid

    name = f"drained_{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
