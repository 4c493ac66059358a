"""License notices: phrases at their exact words, and notices by exact set similarity.

Every notice (template) is a set of words, and so is every block of a text: each line,
and each paragraph of several lines, between lines without words. A template is found
in a block that holds at least a given share of its words. The words of all templates
are ordered by how many texts of the whole corpus hold them, rarest first. A block that
reaches the share must hold one of a template's rarest words (prefix filter: so many
may be missing, and one more), must have enough words of templates at all (length
filter), and from the first word they share enough must follow in both (positional
filter). What passes is counted exactly.

The templates are sent to all tasks and looked up by their prefix words: one pass over
the texts counts words, a second finds blocks, and no text is shuffled. All but the
texts with a rare word of a template are passed by at the speed of a set's lookup.
"""

from __future__ import annotations

from collections import Counter
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, small_batches, table, text_bytes

#: Words of all templates that are sent to the tasks; more are refused.
MOST_WORDS = 1 << 22

# Phrases and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Notices in their published wording, with label and family. Of a family
# a block gets the best template's label only.
TEMPLATES = [
    ("agpl-3", "gnu", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("apache-2", "apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("bsd", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "cc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-nd", "cc", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "cc", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nd", "cc", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-sa", "cc", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2", "gnu", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-2", "gnu", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-3", "gnu", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "gnu", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("isc", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-3", "gnu", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("mit", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "unlicense", "This is free and unencumbered software released into the public domain"),
]

#: Bytes of words stay, A-Z in lower case; lines end where they did; all else is a space.
_MAP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 10 else 32 for b in range(256))


def license_words(text: bytes) -> list[bytes]:
    return text.translate(_MAP).split()


class Index:
    """Templates by the words of their prefixes, under an order of words."""

    def __init__(self, templates, percent: int, frequency: dict[bytes, int]):
        self.sets = [sorted(set(license_words(text.encode())), key=lambda w: (frequency.get(w, 0), w)) for _, _, text in templates]
        self.names = [(label, family) for label, family, _ in templates]
        self.needed = [-(-percent * len(s) // 100) for s in self.sets]
        vocabulary = sorted({w for s in self.sets for w in s}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.by_rank = [frozenset(self.rank[w] for w in s) for s in self.sets]
        self.least = min((n for n, s in zip(self.needed, self.sets, strict=True) if s), default=0)
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, (s, n) in enumerate(zip(self.sets, self.needed, strict=True)):
            for i, w in enumerate(s[: len(s) - n + 1]):
                self.postings.setdefault(w, []).append((t, i))
        self.rare = frozenset(self.postings)

    def found(self, block: set[bytes]) -> list[tuple[str, Fraction]]:
        """(label, share) of each family's best template that the block holds enough of."""
        own = sorted((self.rank[w], w) for w in block if w in self.rank)
        if len(own) < self.least:  # length filter
            return []
        ranks, seen, best = {r for r, _ in own}, set(), {}
        for j, (_, w) in enumerate(own[: len(own) - self.least + 1]):
            for t, i in self.postings.get(w, ()):
                if t in seen:
                    continue
                seen.add(t)  # from its first common word, so many can be common at most
                if min(len(self.sets[t]) - i, len(own) - j) < self.needed[t]:
                    continue
                common = len(self.by_rank[t] & ranks)
                if common >= self.needed[t]:
                    label, family = self.names[t]
                    key = (-Fraction(common, len(self.sets[t])), -len(self.sets[t]), label)
                    best[family] = min(best.get(family, key), key)
        return sorted((label, -share) for share, _, label in best.values())


def blocks(text: bytes):
    """(first word, words) of each line with words, and of each paragraph of several."""
    at, start, paragraph = 0, 0, []
    for line in [*text.translate(_MAP).split(b"\n"), b""]:
        words = line.split()
        if words:
            yield at, words
            paragraph.append(words)
        else:
            if len(paragraph) > 1:
                yield start, [w for own in paragraph for w in own]
            paragraph = []
        at += len(words)
        if not paragraph:
            start = at


def _places(words: list[bytes], phrases: list[tuple[bytes, str]]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand, overlaps too."""
    line, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases:
        at = line.find(phrase)
        while at >= 0:
            out.append((line.count(b" ", 0, at), label))
            at = line.find(phrase, at + 1)
    return out


def word_frequency(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many rows of docs each word of the vocabulary stands."""
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                counts.update(vocabulary.intersection(license_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in rows.collect()}  # one row a word of the templates


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, percent: int = 80) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_base (places of phrases), first_word and
    last_word (the first words of the first and the last place, else null), base_labels
    (array), found (array of label, first_word, n_words, share: each block that holds
    percent of a template's words), labels (array, of both), score (1 with a phrase, else
    the largest share found, else 0).

    Words are ASCII letters in lower case, digits and all beyond ASCII. Null and empty
    texts have no words and no labels, score 0. Rows with null or repeated ids are
    judged one by one; very long texts whole, each in one task. Of templates of one
    family that a block holds, the one with the largest share counts, of equal ones
    that with most words, then the smallest label; of repeated places each counts. An
    empty table gives an empty result; further columns of docs are left out. Templates
    of more than MOST_WORDS words are refused.
    """
    if not 0 < percent <= 100:
        raise ValueError(percent)
    spark = docs.sparkSession
    ship(spark)
    vocabulary = frozenset(w for _, _, text in templates for w in license_words(text.encode()))
    if sum(len(license_words(text.encode())) for _, _, text in templates) > MOST_WORDS:
        raise ValueError("templates have too many words to send them to all tasks")
    index = spark.sparkContext.broadcast(Index(templates, percent, word_frequency(docs, vocabulary)))
    spaced = [(b" " + b" ".join(license_words(p.encode())) + b" ", label) for p, label in phrases]
    found_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64())]))

    def run(batches):
        own = index.value
        for batch in small_batches(batches):
            out = []
            for text in text_bytes(batch.column(1)):
                words = license_words(text)
                places = _places(words, spaced)
                found = []
                if not own.rare.isdisjoint(words):
                    for at, block in blocks(text):
                        inside = set(block)
                        if not own.rare.isdisjoint(inside):  # prefix filter
                            found += [{"label": label, "first_word": at, "n_words": len(block), "share": float(share)} for label, share in own.found(inside)]
                base = sorted({label for _, label in places})
                starts = [i for i, _ in places]
                labels = sorted({*base, *(f["label"] for f in found)})
                out.append((len(words), len(places), min(starts, default=None), max(starts, default=None), base, found, labels, 1.0 if places else max((f["share"] for f in found), default=0.0)))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), found_type, pa.list_(pa.string()), pa.float64()]
            columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "found", "labels", "score"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, found array<struct<label: string, first_word: long, n_words: long, share: double>>, labels array<string>, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x + "'" for x in row) + ")" for row in rows)


def _sql() -> str:
    sets = [sorted({w.decode() for w in license_words(text.encode())}) for _, _, text in TEMPLATES]
    tokens = [(t, w) for t, s in enumerate(sets) for w in s]
    heads = [(t, label, family, len(s)) for t, ((label, family, _), s) in enumerate(zip(TEMPLATES, sets, strict=True))]
    phrases = [(p, label, len(p.split())) for p, label in PHRASES]
    return rf"""
WITH token(t, word) AS (VALUES {_values(tokens)}), head(t, label, family, m) AS (VALUES {_values(heads)}), phrase(phrase, label, k) AS (VALUES {_values(phrases)}),
d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
places AS (SELECT doc_id, label, unnest(list_filter(range(len(w) - k + 1), lambda i: array_to_string(w[i + 1 : i + k], ' ') = phrase)) AS i FROM w, phrase WHERE contains(array_to_string(w, ' '), phrase)),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, i, regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
parts AS (SELECT doc_id, i, w, sum((len(w) = 0)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM lines),
words AS (SELECT doc_id, 'l' || i AS block, unnest(w) AS word FROM parts UNION ALL SELECT doc_id, 'p' || part, unnest(w) FROM parts),
held AS (SELECT doc_id, block, t, count(DISTINCT word) AS common FROM words JOIN token USING (word) GROUP BY doc_id, block, t),
found AS (SELECT doc_id, label, common / m AS share FROM held JOIN head USING (t) WHERE 100 * common >= 80 * m
  QUALIFY row_number() OVER (PARTITION BY doc_id, block, family ORDER BY common / m DESC, m DESC, label) = 1),
share AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM found)) GROUP BY doc_id),
base_named AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM places) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_named.labels, '') AS base_labels, coalesce(named.labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN share USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN base_named USING (doc_id)
"""


OP12_SQL = _sql()
