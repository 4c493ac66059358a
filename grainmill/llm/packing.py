"""Packing of documents into fixed windows by Karmarkar-Karp differencing.

Documents are tokenized and ended; whole windows are cut off, the rest is cut
into pieces that are dealt in groups. In a group, multiway differencing starts
with one partial partition per piece and keeps merging the two with the largest
imbalance, the fullest window of one with the emptiest of the other. When the
fullest window exceeds the capacity, the group is packed again with a window more.

A task packs what it reads, so there is no shuffle; a group is bounded, and so
is the memory of a task.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import ship, small_batches, table, worker_cache

CAPACITY = 2048
#: Pieces of the rests are no longer than this, which keeps windows near-equal.
PIECE = 512
#: Windows that a group fills.
GROUP = 32
#: Word pieces that a worker remembers the ids of.
REMEMBERED = 150_000


#: Below this every Unicode version has the same letters and digits.
SETTLED = "\u0250"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ids(dict):
    """Ids of word pieces as little-endian uint32 bytes, found in batches.

    Byte-level BPE never merges over the start of a space that follows a
    character, so a text is the concatenation of its space-separated pieces; only
    texts with two spaces in a row are tokenized as a whole.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        super().__init__()
        self.fast = _by_ranks(ranks) if ranks else None
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()

        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        out = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in out]

    def encode_pieces(self, pieces: list[str], at_once: int = 1000) -> list[bytes]:
        """Pieces that follow a space, with it. They are encoded as one text, which
        costs far less than one by one, and parted where tokens open with a space."""
        out: list[bytes] = []
        for i in range(0, len(pieces), at_once):
            part = pieces[i : i + at_once]
            if "" not in part:
                ids = self._together(" " + " ".join(part))
                cuts = np.flatnonzero(self.opens[ids])
                if len(cuts) == len(part) and cuts[0] == 0:
                    raw, edges = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                    out += [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
                    continue
            out += self.encode([" " + p for p in part])
        return out

    def _together(self, text: str) -> np.ndarray:
        if self.fast and "<|" not in text and max(text) < SETTLED:
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def of(self, texts: list[str]) -> list[bytes]:
        if len(self) > REMEMBERED:
            self.clear()
        whole = [i for i, t in enumerate(texts) if "  " in t]
        found = dict(zip(whole, self.encode([texts[i] for i in whole]), strict=True))
        split = {i: t.split(" ") for i, t in enumerate(texts) if i not in found}
        for parts in split.values():  # a text's first piece has no space before it; its key has one, as no other key has
            parts[0] = " " + parts[0]
        unknown = {p for parts in split.values() for p in parts}.difference(self)
        first = [p for p in unknown if p[:1] == " "]
        self.update(zip(first, self.encode([p[1:] for p in first]), strict=True))
        if "" in unknown:
            self[""] = self.encode([" "])[0]
        rest = unknown.difference(self)
        odd = {p for p in rest if not p.isascii() and max(p) >= SETTLED}
        for pieces in (list(rest - odd), list(odd)):
            self.update(zip(pieces, self.encode_pieces(pieces), strict=True))
        get = self.__getitem__
        return [found[i] if i in found else b"".join(map(get, split[i])) for i in range(len(texts))]


def _by_ranks(path: str):
    """The same vocabulary in an encoder that is three times as fast."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k near-equal groups of indices. Ties go by the order of entry, so equal
    input gives equal output. A partial partition is kept as its non-empty
    windows in falling order; the others are empty."""
    heap = [(-s, i, [(s, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        # the fullest of one meets the emptiest of the other
        over = max(0, len(a) + len(b) - k)
        merged = a[: len(a) - over] + b[: len(b) - over]
        for j in range(over):
            x, y = a[len(a) - 1 - j], b[len(b) - over + j]
            merged.append((x[0] + y[0], x[1] + y[1]))
        merged.sort(key=lambda w: -w[0])
        low = merged[-1][0] if len(merged) == k else 0
        # the common part of all windows doesn't count as imbalance
        heapq.heappush(heap, (-(merged[0][0] - low), order, merged))
        order += 1
    return [list(w[1]) for w in heap[0][2]] if heap else []


def pack_group(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        k += max(1, k // 64)


def pack(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, end_id: int = 1, capacity: int = CAPACITY, piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. A null text is an empty one, so it is its end id alone; a very long one
    fills windows of its own and leaves a rest. Repeated rows are packed each on
    its own, in rows that carry the same doc_id. sequence_id is unique, and its
    upper bits are the task's number. Other columns are ignored. An empty table gives
    an empty result.

    tokenizer is a tokenizers file, ranks a rank file of the same vocabulary and
    pattern (both of the production vocabulary by default); it serves text of
    settled characters, the other file the rest.
    """
    ship(docs.sparkSession)
    if tokenizer is None:
        tokenizer, ranks = tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken")

    def run(batches):
        ids_of = worker_cache(f"ids-{tokenizer}-{ranks}", lambda: Ids(tokenizer, ranks))
        sequence = TaskContext.get().partitionId() << 40
        done, rest, held = [], [], 0

        def emit():
            rows, done[:] = list(zip(*done, strict=True)) or [[]] * 7, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], NAMES)

        def fill():
            nonlocal sequence, held
            for window in pack_group([p[2] for p in rest], capacity):
                at = 0
                for i in window:
                    done.append((*rest[i], sequence, at))
                    at += rest[i][2]
                sequence += 1
            rest.clear()
            held = 0

        for batch in small_batches(batches, 512):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of.of(texts), strict=True):
                ids += end_id.to_bytes(4, "little")
                total, start = len(ids) // 4, 0
                while total - start >= capacity:
                    done.append((doc, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), total, sequence, 0))
                    sequence += 1
                    start += capacity
                while start < total:
                    n = min(piece, total - start)
                    rest.append((doc, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total))
                    start, held = start + n, held + n
                    if held >= group * capacity - capacity // 2:
                        fill()
            if len(done) > 4096:
                yield emit()
        if rest:
            fill()
        yield emit()

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in NAMES))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
