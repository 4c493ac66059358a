"""A document quality score.

Statistics of the whole text are standardised and mapped by random Fourier
features, whose inner products approximate a Gaussian kernel; the standardised
statistics themselves are kept beside them, so the kernel is Gaussian plus linear,
which extrapolates better from few labels. Every partition
sums its part of the normal equations; their sum gives ridge weights. Isotonic
regression on labelled documents kept out of that fit turns scores into
probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, filtered, materialize, ship, small_batches, table, text_bytes, worker_cache
from .polyhash import PolyHash
from .streams import id_set

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "upper", "lower", "digit", "space", "newline", "stop", "comma", "bang", "bar", "symbol",
    "beyond_ascii", "control", "entropy", "distinct_words", "distinct_pairs", "top_word", "same_as_before", "symbol_words", "capital_words", "bare_bars", "line_bytes",
]
FOURIER, RIDGE, THRESHOLD, SEED = 256, 1e-3, 0.3, 7
#: Bins of a score for isotonic regression, and rows to the driver for sums.
BINS, SUMS = 2000, 8

#: Character classes of bytes; the rest is "symbol".
_CLASSES = ["upper", "lower", "digit", "space", "newline", "stop", "comma", "bang", "bar", "symbol", "beyond_ascii", "control"]


def _class_table() -> np.ndarray:
    t = np.full(256, _CLASSES.index("symbol"), np.uint8)
    for name, values in {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "control": [*range(32), 127], "space": b" \t\r\x0b\x0c", "newline": b"\n", "stop": b".?", "comma": b",;:'\"-()", "bang": b"!", "bar": b"|", "beyond_ascii": range(128, 256)}.items():
        t[list(values)] = _CLASSES.index(name)
    return t


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS per text; an empty text has zeros."""
    n, k = len(texts), len(_CLASSES)
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)  # a space ends each text
    starts = np.cumsum([0, *(sizes + 1)])
    classes = worker_cache("quality-classes", _class_table)
    c = classes[data]
    counts = np.bincount(np.repeat(np.arange(n) * k, sizes + 1) + c, minlength=n * k).reshape(n, k).astype(float)
    counts[:, _CLASSES.index("space")] -= 1
    share = counts / np.maximum(sizes, 1)[:, None]
    white = (c == _CLASSES.index("space")) | (c == _CLASSES.index("newline"))
    solid = np.concatenate(([False], ~white, [False]))
    begin, end = np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(~solid[1:] & solid[:-1])
    doc = np.searchsorted(starts, begin, "right") - 1
    words = np.bincount(doc, minlength=n).astype(float)
    per_word = lambda x: np.bincount(doc, weights=x, minlength=n) / np.maximum(words, 1)
    length = (end - begin).astype(float)
    mean = per_word(length)
    hasher = worker_cache("quality-hash", lambda: PolyHash(11))
    h = hasher.ranges(hasher.prefix(data), begin, end)
    joined = np.concatenate((doc[1:] == doc[:-1], [False])) if len(doc) else np.zeros(0, bool)
    pair = (h * np.uint64(0x9E3779B97F4A7C15) + np.roll(h, -1))[joined]
    kind_sums = np.concatenate(([0], np.cumsum(c == _CLASSES.index("symbol"))))
    distinct, top = _distinct(doc, h, n)
    distinct_pairs, _ = _distinct(doc[joined], pair, n)
    pairs = np.bincount(doc[joined], minlength=n)
    herdan = lambda d, m: np.where(m > 1, np.log(np.maximum(d, 1)) / np.log(np.maximum(m, 2)), 1.0)
    p = np.maximum(share, 1e-12)
    same = np.zeros(len(h))
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & joined[:-1]
    capital = (c[begin] == _CLASSES.index("upper")) & (c[np.minimum(begin + 1, len(c) - 1)] == _CLASSES.index("upper")) if len(h) else np.zeros(0)
    named = {name: share[:, i] for i, name in enumerate(_CLASSES)} | {
        "log_bytes": np.log1p(sizes), "log_words": np.log1p(words), "word_bytes": np.minimum(mean, 50), "word_bytes_sd": np.sqrt(np.minimum(np.maximum(per_word(length**2) - mean**2, 0), 2500)),
        "entropy": -(share * np.log(p)).sum(1), "distinct_words": herdan(distinct, words), "distinct_pairs": herdan(distinct_pairs, pairs), "top_word": top / np.maximum(words, 1),
        "same_as_before": per_word(same), "symbol_words": per_word((kind_sums[end] > kind_sums[begin]).astype(float)), "capital_words": per_word(np.asarray(capital, float)),
        "bare_bars": per_word(((length == 1) & (c[begin] == _CLASSES.index("bar"))).astype(float)) if len(h) else np.zeros(n),
        "line_bytes": np.log1p(sizes / (counts[:, _CLASSES.index("newline")] + 1)),
    }
    return np.stack([named[x] for x in STATISTICS], axis=1) * (sizes > 0)[:, None]


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the most frequent one, per document."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, doc))
    d, s = doc[order], h[order]
    first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] != s[:-1]))))
    run = np.diff(np.concatenate((first, [len(s)])))
    top = np.zeros(n)
    np.maximum.at(top, d[first], run)
    return np.bincount(d[first], minlength=n).astype(float), top


def text_statistics(docs: DataFrame, among=None) -> DataFrame:
    """doc_id and its statistics as an array, a row per row of docs, or of those whose
    doc_id a broadcast set of ids holds. Both in one pass: passes in a row would keep a
    Python worker each, with its memory, on every core."""
    ship(docs.sparkSession)

    def run(batches):
        if among is not None:
            batches = (batch.filter(pa.array(among.value.holds(np.asarray(batch.column(0))))) for batch in batches)
        for batch in small_batches(batches, 64):
            x = statistics(text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(x)], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def labelled_statistics(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """As text_statistics, of the rows that may train: those with a label, outside of
    the held-out fold, and a few others. The ids go out as a Bloom filter of bounded
    size, so no text is moved."""
    known = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id")).where(fold(F.col("doc_id")) > 0)
    wanted = docs.sparkSession.sparkContext.broadcast(id_set(known, "doc_id", known.count()))
    return text_statistics(docs.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) > 0)), wanted)


def _lists(x: np.ndarray):
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.ravel()))


def _matrix(column, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


class Fourier:
    """Standardised statistics, their random Fourier features and a constant."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, n: int = FOURIER, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w = rng.normal(size=(len(mean), n)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        return np.concatenate([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), z, np.ones((len(z), 1))], axis=1)


def _summed(rows: DataFrame, f, width: int) -> tuple[np.ndarray, ...]:
    """f of (x, y) blocks gives arrays; their sums over all partitions."""
    def part(batches):
        total = None
        for batch in small_batches(batches, 4096):
            if batch.num_rows:
                one = f(_matrix(batch.column(0), width), np.asarray(batch.column(1)))
                total = one if total is None else [a + b for a, b in zip(total, one, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS]), _blob(total)], ["slot", "sums"])

    def whole(batches):
        total = None
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                one = _arrays(blob)
                total = one if total is None else [a + b for a, b in zip(total, one, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0]), _blob(total)], ["slot", "sums"])

    sums = rows.select("x", "y").mapInArrow(part, "slot long, sums binary").repartition(SUMS, "slot").mapInArrow(whole, "slot long, sums binary")
    total = None
    for row in sums.collect():  # a few rows
        one = _arrays(row.sums)
        total = one if total is None else [a + b for a, b in zip(total, one, strict=True)]
    return tuple(total) if total is not None else ()


def _blob(arrays: list[np.ndarray]):
    import pickle

    return pa.array([pickle.dumps([np.asarray(a) for a in arrays])], pa.binary())


def _arrays(blob: bytes) -> list[np.ndarray]:
    import pickle

    return pickle.loads(blob)


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic (non-decreasing) fit by pooling neighbours that fall."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


class Model:
    def __init__(self, features: Fourier, weights: np.ndarray, grid: np.ndarray, calibrated: np.ndarray):
        self.features, self.weights, self.grid, self.calibrated = features, weights, grid, calibrated

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return np.clip(np.interp(raw, self.grid, self.calibrated), 0, 1) if len(self.grid) else np.full(len(x), 0.5)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; fold 0 is held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0))


def train(statistics: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows of folds 2-4, calibrate on fold 1; no row of fold 0 is
    read. Rows without a label or id are left out, repeated ones count each. Where one
    of both parts has no labelled row, the other serves for both, so small tables are
    still scored. With no labelled row at all, every score is 0.5; with a single class,
    that class's."""
    spark, width = statistics.sparkSession, len(STATISTICS)
    ship(spark)
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("y"))
    rows = materialize(statistics.join(known, "doc_id").withColumn("fold", fold(F.col("doc_id"))).where("fold > 0"), "labelled")
    fit = rows.where("fold > 1")
    moments = _summed(fit, lambda x, y: [np.array(len(x)), x.sum(0), (x**2).sum(0)], width) or _summed(rows, lambda x, y: [np.array(len(x)), x.sum(0), (x**2).sum(0)], width)
    if not moments:
        return Model(Fourier(np.zeros(width), np.ones(width)), np.zeros(FOURIER + width + 1), np.zeros(0), np.zeros(0))
    n, s1, s2 = moments
    features = Fourier(s1 / n, np.sqrt(np.maximum(s2 / n - (s1 / n) ** 2, 0)))

    def equations(x, y):
        z = features(x)
        return [z.T @ z, z.T @ y, np.array(len(y))]

    xx, xy, n = _summed(fit, equations, width) or _summed(rows, equations, width)
    weights = np.linalg.solve(xx + (RIDGE * n + 1.0) * np.eye(len(xy)) * np.where(np.arange(len(xy)) < len(xy) - 1, 1.0, 1e-6), xy)
    model = Model(features, weights, np.zeros(0), np.zeros(0))

    def binned(x, y):
        at = np.clip(np.round((model.raw(x) + 0.5) * (BINS / 2)), 0, BINS).astype(int)
        return [np.bincount(at, minlength=BINS + 1).astype(float), np.bincount(at, weights=y, minlength=BINS + 1)]

    count, good = _summed(rows.where("fold = 1"), binned, width) or _summed(rows, binned, width)
    discard(rows)
    used = np.flatnonzero(count)
    model.grid = used * (2 / BINS) - 0.5
    model.calibrated = pool_adjacent(good[used] / count[used], count[used])
    return model


def score(statistics: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    ship(statistics.sparkSession)
    shared, width = statistics.sparkSession.sparkContext.broadcast(model), len(STATISTICS)

    def run(batches):
        for batch in small_batches(batches, 4096):
            s = shared.value(_matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return statistics.mapInArrow(run, "doc_id long, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs.

    A null text is an empty one and is scored like it. Rows of one doc_id are
    scored each by its text; if labelled, all train. A null doc_id is in the held-out
    fold. Very long texts are read whole. Other columns are never read. An empty table
    gives an empty result.
    """
    x = materialize(text_statistics(docs), "statistics")
    return score(x, train(x, labels), threshold).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, as they are. The rows
    are scored where they are read, so nothing is joined or moved."""
    model = docs.sparkSession.sparkContext.broadcast(train(labelled_statistics(docs, labels), labels))
    return filtered(docs, lambda texts: model.value(statistics(texts)) >= threshold)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
