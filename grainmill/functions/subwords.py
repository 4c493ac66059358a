"""Subword tokenizers from vocabulary files, in Arrow batches."""

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary file is unless a path is given.
VOCABULARY = os.environ.get("GRAINMILL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")

#: Characters that are encoded and handed on at once.
TEXT_AT_ONCE = 1 << 18


def bpe_ids(spark: SparkSession, path: str = VOCABULARY):
    """A column function: text to ids without special tokens, a null text to none. Its
    batches are as large as Spark's; with_bpe_ids hands on smaller ones."""
    from ..sources import ship

    ship(spark)

    @F.pandas_udf("array<long>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([x.astype(np.int64) for group in _groups(texts) for x in _encoded(group, path)])

    return ids


def with_bpe_ids(docs: DataFrame, text: str = "text", out: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """docs with the ids of each text in place of it, in batches of TEXT_AT_ONCE characters
    or one text, so that a task holds no more however many rows it has."""
    from ..sources import ship

    ship(docs.sparkSession)
    names = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(out, T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            others = batch.select(names)
            at = 0
            for group in _groups(batch.column(text)):
                ids = _encoded(group, path)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*others.slice(at, len(group)).columns, lists], [*names, out])
                at += len(group)

    return docs.mapInArrow(run, schema)


def _groups(texts) -> Iterator[list[str]]:
    """Texts (pandas' or Arrow's) in a row, some at once."""
    group, n = [], 0
    for text in texts:
        text = (text.as_py() if isinstance(text, pa.Scalar) else text) or ""
        if group and n + len(text) > TEXT_AT_ONCE:
            yield group
            group, n = [], 0
        group.append(text)
        n += len(text)
    if group:
        yield group


def _encoded(texts: list[str], path: str) -> list[np.ndarray]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
    from tokenizers import Tokenizer

    tokenizer = _loaded.get(path) or _loaded.setdefault(path, Tokenizer.from_file(path))
    return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_loaded: dict = {}
