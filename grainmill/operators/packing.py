"""Concatenating, chunking and packing token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import running_sum
from ..functions.tokens import ceil_div, char_count, floor_div, fraction_of, shuffle_key


def spans(docs: DataFrame, count=None, key: str = "doc_id", within: list[str] | None = None) -> DataFrame:
    """(key, within, n_tokens, start, stop, total): each document's half-open token range
    in their concatenation, and its length. Texts are sized once and stay behind: only
    keys and sizes are moved."""
    n = char_count(F.col("text")) if count is None else count
    sized = docs.select(key, *(within or []), n.alias("n_tokens"))
    return running_sum(sized, key, F.col("n_tokens"), "start", within=within, total="total").withColumn("stop", F.col("start") + F.col("n_tokens"))


def sample_index(docs: DataFrame, length: int, extra: int = 1) -> DataFrame:
    """Where each sample of `length` tokens (plus `extra` shared with the next)
    starts: (sample_id, doc_id, doc_offset), the end of the last one included.

    Each document yields the sample ids that start in it, so no range join is
    needed; with extra=0 a start on a boundary counts to the document before."""
    ranged = spans(docs.select("doc_id", "text")).where("n_tokens > 0")
    shift = 0 if extra else 1
    first = F.greatest(ceil_div(F.col("start") + shift, length), F.lit(0))
    first = F.when((F.col("start") == 0), F.lit(0)).otherwise(first).cast("long")
    last = F.least(floor_div(F.col("stop") - 1 + shift, length), floor_div(F.col("total") - extra, length))
    held = ranged.withColumns({"first": first, "last": last}).where("first <= last")
    ids = held.select("doc_id", "start", F.explode(F.sequence("first", "last")).alias("sample_id"))
    return ids.select("sample_id", "doc_id", (F.col("sample_id") * length - F.col("start")).alias("doc_offset"))


def pieces(ranged: DataFrame, length: int, overlap: int, limit: str, keys: list[str]) -> DataFrame:
    """(keys, chunk_id, at, piece): cuts of each document for every chunk
    [k * length, k * length + length + overlap) that it meets; chunks k < limit (a
    column). A text is cut in one pass, its head up to the next chunk apart; the
    first tokens of a chunk are given to the one before as well."""
    head = F.pmod(-F.col("start"), F.lit(length)).cast("int")
    body = F.expr(f"regexp_extract_all(substring(text, _head + 1), '(?s).{{1,{length}}}', 0)")
    cuts = F.when(F.col("_head") > 0, F.concat(F.array(F.substring(F.col("text"), F.lit(1), F.col("_head"))), body)).otherwise(body)
    first = floor_div(F.col("start"), length)
    each = ranged.where("n_tokens > 0").withColumn("_head", head).select(*keys, "start", limit, first.alias("_first"), F.posexplode(cuts).alias("_i", "piece"))
    each = each.where("piece != ''").withColumn("chunk_id", F.col("_first") + F.col("_i")).withColumn("at", F.when(F.col("_i") == 0, F.col("start")).otherwise(F.col("chunk_id") * length))
    own = F.struct("chunk_id", "at", "piece")
    shared = F.lit(overlap) - (F.col("at") - F.col("chunk_id") * length)
    before = F.struct((F.col("chunk_id") - 1).alias("chunk_id"), "at", F.substring(F.col("piece"), F.lit(1), shared.cast("int")).alias("piece"))
    both = F.when((shared > 0) & (F.col("chunk_id") > 0), F.array(own, before)).otherwise(F.array(own)) if overlap else F.array(own)
    return each.select(*keys, limit, F.inline(both)).where(F.col("chunk_id") < F.col(limit)).drop(limit)


def joined(cut: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of one chunk in order: (keys, tokens)."""
    parts = F.array_sort(F.collect_list(F.struct("at", "piece")))
    return cut.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias("tokens"))


def clm_chunks(docs: DataFrame, length: int, batch: int, drop_last_chunk: bool = True) -> DataFrame:
    """(batch_id, chunk_id, tokens): within each batch of documents, all tokens in
    a row cut into chunks of length + 1 that overlap by one token.

    drop_last_chunk keeps the count of a pass that stops one chunk early."""
    batched = docs.select("doc_id", "text").withColumn("batch_id", floor_div(F.col("doc_id"), batch))
    ranged = spans(batched, within=["batch_id"]).withColumn("n_chunks", _n_chunks(F.col("total"), length, drop_last_chunk))
    cut = pieces(docs.select("doc_id", "text").join(ranged, "doc_id"), length, 1, "n_chunks", ["batch_id"])
    return joined(cut, ["batch_id", "chunk_id"])


def _n_chunks(tokens, length: int, drop_last_chunk: bool):
    return F.greatest(floor_div(tokens - 1, length) - int(drop_last_chunk), F.lit(0)).cast("long")


def chunk_counts(docs: DataFrame, length: int, batch: int, drop_last_chunk: bool = True) -> DataFrame:
    per = docs.groupBy(floor_div(F.col("doc_id"), batch).alias("batch_id")).agg(F.sum(char_count(F.col("text"))).alias("n_tokens"))
    return per.withColumn("n_chunks", _n_chunks(F.col("n_tokens"), length, drop_last_chunk))


def fixed_chunks(docs: DataFrame, length: int) -> DataFrame:
    """(chunk_id, tokens): non-overlapping chunks of length + 1 tokens, the rest dropped."""
    return joined(_cut(docs, length + 1, 0), ["chunk_id"])


def _cut(docs: DataFrame, length: int, overlap: int) -> DataFrame:
    """Pieces of all whole chunks of all documents."""
    ranged = spans(docs.select("doc_id", "text")).withColumn("n_chunks", floor_div(F.col("total") - overlap, length))
    return pieces(docs.select("doc_id", "text").join(ranged, "doc_id"), length, overlap, "n_chunks", [])


def samples(docs: DataFrame, length: int, extra: int = 1) -> DataFrame:
    """(sample_id, tokens): materialised samples of one epoch, each with the first
    token of the next."""
    return joined(_cut(docs, length, extra), ["chunk_id"]).withColumnRenamed("chunk_id", "sample_id")


def token_budget(files: DataFrame, max_tokens: int, skip_tokens: int) -> DataFrame:
    """files (path_id, n_tokens) in order: how many tokens each one skips and gives
    under a running skip and a running budget; files that give none are dropped."""
    ranged = running_sum(files, "path_id", F.col("n_tokens"), "start")
    skipped = F.least(F.greatest(F.lit(skip_tokens) - F.col("start"), F.lit(0)), F.col("n_tokens"))
    used_before = F.greatest(F.col("start") - skip_tokens, F.lit(0))
    taken = F.greatest(F.least(F.col("n_tokens") - F.col("skipped"), F.lit(max_tokens) - used_before), F.lit(0))
    return ranged.withColumn("skipped", skipped.cast("long")).withColumn("taken", taken.cast("long")).where("taken > 0").select("path_id", "n_tokens", "skipped", "taken")


def epochs_needed(tokens: DataFrame, n_samples: int, length: int, extra: int = 1) -> DataFrame:
    """tokens (tokens_per_epoch): the fewest whole epochs that give n_samples."""
    need = n_samples * length + extra
    return tokens.withColumn("num_epochs", F.greatest(F.ceil(F.lit(need) / F.col("tokens_per_epoch")), F.lit(1)).cast("long"))


def sentence_blocks(sentences: DataFrame, target, min_sentences: int, longest: int = 512, end_at_least: bool = False) -> DataFrame:
    """Greedy blocks of a document's sentences: (doc_id, block_id, start, stop, n_tokens).

    sentences: doc_id, sizes (array in order). target: column with a block's wanted
    tokens. A block ends when it has enough tokens, at least min_sentences, and more
    than one sentence remains (end_at_least: at least min_sentences remain), or where
    the document ends. Documents with fewer sentences or a longer one give none.
    The fold runs inside each row, so nothing is shuffled.
    """
    state = "struct<start:int,n:int,tokens:bigint,done:array<struct<start:int,stop:int,n_tokens:bigint>>>"
    zero = F.from_json(F.lit('{"start":0,"n":0,"tokens":0,"done":[]}'), state)
    remain = f"{min_sentences} <= size(sizes) - i - 1" if end_at_least else "size(sizes) - i - 1 > 1"
    ranged = sentences.where((F.size("sizes") >= min_sentences) & ~F.exists("sizes", lambda s: s > longest)).withColumn("_target", target)
    ranged = ranged.withColumns({"_steps": F.sequence(F.lit(0), F.size("sizes") - 1), "_zero": zero})
    fold = F.expr(f"""aggregate(_steps, _zero, (s, i) ->
      CASE WHEN (s.tokens + sizes[i] >= _target AND {remain} AND s.n + 1 >= {min_sentences}) OR i = size(sizes) - 1
      THEN named_struct('start', i + 1, 'n', 0, 'tokens', 0L, 'done', concat(s.done, array(named_struct('start', s.start, 'stop', i + 1, 'n_tokens', s.tokens + sizes[i]))))
      ELSE named_struct('start', s.start, 'n', s.n + 1, 'tokens', s.tokens + sizes[i], 'done', s.done) END, s -> s.done)""")
    blocks = ranged.select("doc_id", F.posexplode(fold).alias("block_id", "b"))
    return blocks.select("doc_id", F.col("block_id").cast("long").alias("block_id"), F.col("b.start").cast("long").alias("start"), F.col("b.stop").cast("long").alias("stop"), F.col("b.n_tokens").alias("n_tokens"))


def block_samples(blocks: DataFrame, n: int, most: int, seed: str) -> DataFrame:
    """n blocks repeated for whole epochs until there are `most`, in a shuffled order."""
    from .blend import shuffled_position

    epochs = max(1, -(-most // max(n, 1)))
    each = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
    key = shuffle_key(F.concat_ws("/", "epoch", "doc_id", "block_id"), seed)
    return shuffled_position(each, key, "pos").select("pos", "epoch", "doc_id", "block_id", "start", "stop")


def wrapped(samples: DataFrame, key: str, epochs: float) -> DataFrame:
    """samples (key from 0 on) read for that many epochs: position i is sample i mod n."""
    n = samples.agg(F.count(F.lit(1))).scalar()
    top = F.floor(n * F.lit(float(epochs))).cast("long") - 1
    each = samples.withColumn("pos", F.explode(F.sequence(F.col(key), F.greatest(top, F.col(key)), n))).where(F.col("pos") <= top)
    return each.withColumn("epoch", floor_div(F.col("pos"), n)).select("pos", "epoch", *samples.columns)


def fim(docs: DataFrame, psm: bool, rate: int = 50, seed: str = "fim", skip_prefix: str | None = None) -> DataFrame:
    """Fill-in-the-middle permutation of text at two hash-derived cuts, for rate
    percent of the documents: prefix, suffix, middle with marks, or suffix first."""
    n = F.length("text") + 1
    a, b = F.pmod(fraction_of(F.col("doc_id"), seed + "a"), n), F.pmod(fraction_of(F.col("doc_id"), seed + "b"), n)
    cut = docs.withColumns({"lo": F.least(a, b).cast("int"), "hi": F.greatest(a, b).cast("int"), "hit": F.pmod(fraction_of(F.col("doc_id"), seed + "r"), F.lit(100)) < rate})
    if skip_prefix is not None:
        cut = cut.withColumn("hit", F.col("hit") & ~F.col("text").startswith(skip_prefix))
    prefix, middle, suffix = F.substring(F.col("text"), F.lit(1), F.col("lo")), F.substring(F.col("text"), F.col("lo") + 1, F.col("hi") - F.col("lo")), F.substring(F.col("text"), F.col("hi") + 1, F.length("text"))
    mixed = F.concat(F.lit("<P>"), prefix, F.lit("<S>"), suffix, F.lit("<M>"), middle) if psm else F.concat(F.lit("<P><S>"), suffix, F.lit("<M>"), prefix, middle)
    return cut.select("doc_id", F.when(F.col("hit"), mixed).otherwise(F.col("text")).alias("text"))


def fim_documents(docs: DataFrame, split: str, end: str = "\n", rate: int = 50, fragment_rate: int = 50, seed: str = "fim", pad: str = " ") -> DataFrame:
    """Samples (doc_id, text) of documents that end with `end` and of files that end with
    `split`, permuted in place. Each non-empty document is permuted as a whole if it
    holds no split mark, with a chance of `rate`; else, with that chance, each of its
    non-empty files is, with a chance of `fragment_rate`. What follows the last mark is
    always taken; empty parts go with their mark. The result is cut or padded to the
    sample's length. All draws go by hashes, and nothing leaves its row."""
    def permuted(part, key, percent):
        n = F.length(part) + 1
        a, b = fraction_of(key, seed + "a") % n, fraction_of(key, seed + "b") % n
        lo, hi = F.least(a, b).cast("int"), F.greatest(a, b).cast("int")
        mixed = F.concat(F.lit("<P>"), F.substring(part, F.lit(1), lo), F.lit("<S>"), F.substring(part, hi + 1, F.length(part)), F.lit("<M>"), F.substring(part, lo + 1, hi - lo))
        return F.when(fraction_of(key, seed + "r") % 100 < percent, mixed).otherwise(part)

    def marked(parts, mark, use):
        """use(part, number) of all parts but empty ones before the last, each but the last with its mark."""
        last = F.size(parts) - 1
        return F.array_join(F.transform(parts, lambda p, i: F.when((p == "") & (i < last), F.lit("")).otherwise(F.concat(use(p, i), F.when(i < last, F.lit(mark)).otherwise(F.lit(""))))), "")

    def document(part, i):
        key = F.concat_ws("/", "doc_id", i)
        files = F.split(part, f"[{split}]")
        by_file = marked(files, split, lambda f, j: permuted(f, F.concat_ws("/", "doc_id", i, j), fragment_rate))
        return F.when(~F.contains(part, F.lit(split)), permuted(part, key, rate)).when(fraction_of(key, seed + "d") % 100 < rate, by_file).otherwise(part)

    text = marked(F.split("text", f"[{end}]"), end, document)
    n = F.length("text")
    return docs.select("doc_id", F.rpad(F.substring(text, F.lit(1), n), n, F.lit(pad)).alias("text"))


def split_bounds(weights: list[float], n: int) -> list[int]:
    """Bounds of consecutive splits: rounded shares, with the overshoot of the last
    taken from all."""
    weights = [w / sum(weights) for w in weights]
    bounds = [0]
    for w in weights:
        bounds.append(bounds[-1] + round(w * n))
    over = bounds[-1] - n
    return [0, *(b - over for b in bounds[1:])]
