"""Sorted key streams in Python workers, and compact sets of ids."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship


def group_blocks(batches, n_keys: int):
    """Blocks of whole groups from batches sorted by their first n_keys columns.

    Yields (columns as numpy arrays, group number of each row). A group larger
    than a block is yielded in parts, with ``head`` telling that the block's first
    group goes on: (columns, groups, head)."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(c) for c in batch.columns]
        keys = columns[:n_keys]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        head = last is not None and all(k[0] == v for k, v in zip(keys, last, strict=True))
        last = [k[-1] for k in keys]
        yield columns, np.cumsum(new), head


def shared_flags(batches, n_keys: int):
    """From batches sorted by n_keys columns and then a member column, yield for
    each row whether its group has another member, with the group's first member:
    (columns, shared, first member). One row is held back where a batch ends, so
    memory is a batch; rows of one member of a group may repeat."""
    held: list[np.ndarray] | None = None  # rows of the group that goes on, all of one member
    first = None
    mixed = False

    for columns, group, head in group_blocks(batches, n_keys):
        if held is not None and not head:
            yield held, np.full(len(held[0]), False), np.full(len(held[0]), first)
            held = None
        member = columns[n_keys]
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        firsts = member[starts].copy()
        if head:
            firsts[0] = first
        lasts = member[np.concatenate((starts[1:] - 1, [len(member) - 1]))]
        many = lasts != firsts
        if head:
            many[0] |= mixed
            if many[0] and held is not None:
                yield held, np.full(len(held[0]), True), np.full(len(held[0]), first)
                held = None
        if held is not None and len(starts) > 1:
            yield held, np.full(len(held[0]), False), np.full(len(held[0]), firsts[0])
            held = None
        first, mixed = firsts[-1], bool(many[-1])
        flags, of_first = many[group], firsts[group]
        if mixed:
            yield columns, flags, of_first
            continue
        at = starts[-1]  # the last group may go on with another member
        if at:
            yield [c[:at] for c in columns], flags[:at], of_first[:at]
        tail = [c[at:] for c in columns]
        held = tail if held is None else [np.concatenate(x) for x in zip(held, tail, strict=True)]
    if held is not None:
        yield held, np.full(len(held[0]), False), np.full(len(held[0]), first)


def mixed_flags(batches, n_keys: int):
    """From batches sorted by n_keys columns, followed by a member column in any order,
    yield for each row whether its group has another member: (columns, flags). Of a
    group that may go on and has had one member only, one row is held back; its other
    rows, copies of that, are left out."""
    held = None
    mixed = False
    for columns, group, head in group_blocks(batches, n_keys):
        member = columns[n_keys]
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        firsts = member[starts].copy()
        if held is not None and head:
            firsts[0] = held[n_keys][0]
        many = np.logical_or.reduceat(member != firsts[group], starts)
        if head:
            many[0] |= mixed
        if held is not None and (not head or many[0] or len(starts) > 1):
            yield held, np.array([bool(head and many[0])])
            held = None
        mixed = bool(many[-1])
        at = len(member) if mixed else int(starts[-1])
        if at:
            yield [c[:at] for c in columns], many[group[:at]]
        if not mixed and held is None:
            held = [c[at : at + 1] for c in columns]
    if held is not None:
        yield held, np.array([False])


def whole_groups(batches):
    """Blocks of whole groups, as lists of arrays, from batches sorted by the first column."""
    parts: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(c) for c in batch.columns]
        key = columns[0]
        cut = int(np.searchsorted(key, key[-1]))  # where the last group begins
        if parts and (cut or parts[-1][0][-1] != key[0]):
            yield [np.concatenate(c) for c in zip(*parts, [c[:cut] for c in columns], strict=True)]
            parts = []
        elif cut:
            yield [c[:cut] for c in columns]
        parts.append([c[cut:] for c in columns])
    if parts:
        yield [np.concatenate(c) for c in zip(*parts, strict=True)]


#: log2 of the bits of an id set, bounds; 16 MB at most.
LEAST, MOST = 16, 27


class IdSet:
    """A Bloom filter of integer ids with one hash; ids in it are always found."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def holds(self, ids: np.ndarray) -> np.ndarray:
        at = _slot(ids, self.bits)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def id_set(df: DataFrame, column: str, expected: int) -> IdSet:
    """The ids of a column, of which some `expected` are distinct. Parts are
    merged in a few tasks; at most 2**MOST bits each reach the driver."""
    ship(df.sparkSession)
    bits = max(LEAST, min(MOST, int(expected * 16).bit_length()))
    n, slots = 1 << (bits - 3), 4

    def part(batches):
        flags = np.zeros(1 << bits, bool)
        for batch in batches:
            flags[_slot(np.asarray(batch.column(0)), bits)] = True
        yield _row(TaskContext.get().partitionId() % slots, np.packbits(flags, bitorder="little"))

    def whole(batches):
        packed = np.zeros(n, np.uint8)
        for batch in batches:
            for x in batch.column(1).to_pylist():
                packed |= np.frombuffer(zlib.decompress(x), np.uint8)
        yield _row(0, packed)

    rows = df.select(F.col(column).cast("long")).where(F.col(column).isNotNull()).mapInArrow(part, "slot int, bits binary")
    packed = np.zeros(n, np.uint8)
    for row in rows.repartition(slots, "slot").mapInArrow(whole, "slot int, bits binary").collect():  # a few rows
        packed |= np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return IdSet(bits, packed)


def _row(slot: int, packed: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([zlib.compress(packed.tobytes(), 1)], pa.binary())], ["slot", "bits"])
