"""Classes of equal texts: 64-bit ids that no two different texts share.

A text's id is half of its 128-bit digest. Where two texts of a table have one id
but different other halves, which takes some 10**9 texts, that id is noted and its
texts get ids of the other half instead.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, text_bytes
from .polyhash import mix_one


#: Bits of an id; fewer only in tests.
BITS = 64


def digest_halves(text: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(text, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Classes:
    """How texts are told apart; sent to workers as it is."""

    def __init__(self, clashing: frozenset[int] = frozenset()):
        self.clashing, self.bits = clashing, BITS

    def both(self, text: bytes) -> tuple[int, int]:
        """The text's id and its check, which differs among texts that share an id."""
        own, check = digest_halves(text)
        own >>= 64 - self.bits
        return (mix_one(check, own) if own in self.clashing else own), check

    def of(self, text: bytes) -> int:
        return self.both(text)[0]

    def clashes(self, reps: DataFrame) -> frozenset[int]:
        """Ids that have more than one check (low, high); at 10**11 texts some hundreds."""
        return frozenset(r.cls for r in reps.where("low < high").select("cls").collect())


def described(docs: DataFrame, of) -> tuple[DataFrame, Classes]:
    """(cls, rep): each class of docs (doc_id, text) with its smallest doc_id, and how
    classes are told. of(text) is what makes two texts equal, as bytes."""
    def run(classes: Classes) -> DataFrame:
        def rows(batches):
            for batch in small_batches(batches):
                both = [classes.both(of(t)) for t in text_bytes(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*both, strict=True))], ["rep", "cls", "check"])

        own = docs.select("doc_id", "text").mapInArrow(rows, "rep long, cls long, check long")
        return materialize(own.groupBy("cls").agg(F.min("rep").alias("rep"), F.min("check").alias("low"), F.max("check").alias("high")), "classes")

    classes = Classes()
    reps = run(classes)
    if clashing := classes.clashes(reps):
        discard(reps)
        classes = Classes(clashing)
        reps = run(classes)
    return reps.select("cls", "rep"), classes
