"""Tables kept between runs under the hash of the parameters that made them, and places
for tables that are not."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder that spark.checkpoint.dir names. Where it is
    unset, a temporary folder will do for a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="grainmill-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a new place in the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame] | None) -> DataFrame:
    """The table of a key: written by the first run and read by all later ones. Without
    build it must be there. A run that broke off leaves no _SUCCESS and is redone."""
    path = f"{root.rstrip('/')}/{key}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        if build is None:
            raise FileNotFoundError(path)
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
