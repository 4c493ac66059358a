"""From raw documents to packed sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of docs. In a stage:

quality         documents that the classifier scores below its threshold go
line_dedup      lines that many documents share go, n_chars follows
near_duplicates of each group of near-duplicates the smallest doc_id stays; rows
                without an id come last, rows of one doc_id are judged each by its text
decontamination documents with a benchmark passage go
packing         what is left becomes pieces of sequences

A null text is an empty one, which the classifier judges, which has one empty line,
is near nothing and holds no passage; packed it is the end id alone. Null and repeated
ids are ids like others: rows are judged one by one. Very long texts are taken whole,
each in one task. Repeated rows: near-duplicates, so one stays if it has words. Columns
of any name are carried along, up to packing. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import discard, materialize, quoted, table
from grainmill.llm.decontaminate import contamination
from grainmill.llm.jaccard import one_of_each
from grainmill.llm.line_dedup import dedup_lines
from grainmill.llm.packing import pack
from grainmill.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(_carried(docs))
    chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("carried.n_chars")) if "n_chars" in docs.columns else None
    return _restored(out, docs, {} if chars is None else {"n_chars": chars.cast(docs.schema["n_chars"].dataType)})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _restored(contamination(_carried(docs), table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")), docs, {})


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


def _carried(docs: DataFrame) -> DataFrame:
    """The id, the text, and all else in one column, so that no name clashes."""
    rest = [F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("carried"))


def _restored(out: DataFrame, docs: DataFrame, changed: dict) -> DataFrame:
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")} | changed
    return out.select(*(own.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: A classifier can't be expressed in SQL; tests compare every stage with a brute-force
#: version on its own input (the classifier's with a plain fit of the same model).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name)
        discard(docs)  # what the stage before had written
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
