"""Data sources of token files; register(spark) makes both formats known."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .indexed import IndexedSource
from .token_files import TokenFileSource


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenFileSource)
    spark.dataSource.register(IndexedSource)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers."""
    import os
    import tempfile
    import zipfile

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
