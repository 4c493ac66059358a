"""Filter audit, license notices and periodic runs against plain versions, on odd rows."""

import itertools
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_brute_force import sha

from grainmill.llm import filter_audit, licenses, periodic, quality, queries

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from test_queries import rows as sorted_rows  # noqa: E402


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_licenses", "op13_periodic_runs"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    mine, theirs = queries.queries()[name](spark, sf), con.sql(queries.oracle_sql()[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert sorted_rows(mine.columns, mine.collect()) == sorted_rows(theirs.columns, theirs.fetchall())


# --- filter audit


def plain_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", 2**63), 2**63 if i is None else i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": (2**63 if i is None else i) > first[t]}
        docs.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d[1:] for d in docs if d[0] == part]
        removed_in_all = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [d for d in own if f in d[0] and not d[0] & before]
                removed_in_all[f] += len(here)
                kept = sum(not d[0] & (before | {f}) for d in own)
                out[part, order, k + 1] = [kept, len(here), sum(f in d[0] and bool(d[0] & before) for d in own), sum(d[0] == {f} for d in own), sum(d[1] for d in here), sum(d[2] for d in here)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(removed_in_all[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit(spark):
    rng = random.Random(11)
    words = ["ab", "cd", "Ef", "GHI", "é", "x#", "klm", "no|p", "qr", "st", "u"]
    texts = [None, "", " \t\n", "A" * 10, "one\x85two"] + [" ".join(rng.choices(words[: rng.choice([2, 5, 11])] + [f"w{j}" for j in range(rng.choice([0, 5, 400]))], k=rng.choice([3, 199, 200, 201, 500]))) for _ in range(40)]
    texts.append(" ".join(f"v{j}" for j in range(30_000)))
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice([None, "", "en", "fr"])) for _ in range(150)]
    rows += [(i, t, "de") for i, t in enumerate(texts)] + [(3, "same row " * 300, "en")] * 3 + [(None, "same row " * 300, "en")] * 2
    labels = [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(40)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, mask int, `all` string").repartition(3)
    marks = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, first string")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(docs, marks).collect()}
    want = plain_audit(rows, labels)
    assert got == want and len(want) == 4 * 600
    assert filter_audit.audit(docs.limit(0), marks).collect() == []
    assert {k: v[:4] for k, v in plain_audit(rows, []).items()} == {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails) for r in filter_audit.audit(docs, marks.limit(0)).collect()}


def test_audit_is_native(spark, sf):
    plan = filter_audit.audit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


# --- licenses


def plain_licenses(text, templates=licenses.TEMPLATES, phrases=licenses.PHRASES, percent=80):
    """(n_words, places, found) by comparing every block with every template."""
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))

    words = split(text or "")
    places = sorted((i, label) for p, label in phrases for k in [p.split()] for i in range(len(words) - len(k) + 1) if words[i : i + len(k)] == k)
    lines = [split(x) for x in (text or "").split("\n")]
    blocks, at, start, part = [], 0, 0, []
    for line in [*lines, []]:
        if line:
            blocks.append((at, line))
            start = at if not part else start
            part.append(line)
        else:
            if len(part) > 1:
                blocks.append((start, sum(part, [])))
            part = []
        at += len(line)
    found = []
    for at, block in blocks:
        best = {}
        for label, family, notice in templates:
            t = set(split(notice))
            common = len(t & set(block))
            if t and 100 * common >= percent * len(t):
                key = (-common / len(t), -len(t), label)
                best[family] = min(best.get(family, key), key)
        found += [(label, at, len(block), -share) for share, _, label in best.values()]
    return len(words), places, sorted(found)


def test_licenses(spark):
    rng = random.Random(12)
    notices = [t for _, _, t in licenses.TEMPLATES]
    common = sorted({w for t in notices for w in t.lower().split()})
    rows = [(1, None), (1, ""), (None, "\n \n"), (None, "cc by nc cc by nc"), (2, "Under the M.I.T. license; UNDER THE MIT-LICENSE 2"), (2, "apache license version 2 é\x00apache license, version 2"), (3, "un der the mit license"), (3, "cc by\nnc")]
    for i in range(120):
        t = rng.choice(notices).split()
        for _ in range(rng.choice([0, 0, 1, 3, 6])):
            t[rng.randrange(len(t))] = rng.choice(["x", "the", ""])
        if rng.random() < 0.3:
            rng.shuffle(t)
        for _ in range(rng.choice([0, 0, 1, 2])):
            t.insert(rng.randrange(len(t)), "\n")
        noise = " ".join(rng.choices(common, k=rng.choice([0, 5, 60])))
        rows.append((i, noise + rng.choice(["\n", "\n\n", " ", "\r\n"]) + " ".join(t) + rng.choice(["", "\n", "\n\n "]) + noise))
    rows += [(7, "word " * 100_000 + notices[0]), rows[-1], rows[-1]]
    docs = spark.createDataFrame([(*r, "c", 2) for r in rows], "doc_id long, text string, labels string, found int").repartition(3)
    for percent in (80, 50, 100):
        want = []
        for i, t in rows:
            n, places, found = plain_licenses(t, percent=percent)
            starts = [p for p, _ in places]
            base = {x for _, x in places}
            want.append((i, n, len(places), min(starts, default=None), max(starts, default=None), sorted(base), found, sorted(base | {f[0] for f in found}), 1.0 if places else max((f[3] for f in found), default=0.0)))
        got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, sorted(tuple(f) for f in r.found), r.labels, r.score) for r in licenses.scan_licenses(docs, percent=percent).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert any(w[6] for w in want)
    assert licenses.scan_licenses(docs.limit(0)).collect() == []
    nothing = licenses.scan_licenses(docs, templates=[("none", "none", "...")], phrases=[]).collect()
    assert {(r.n_base, r.score, tuple(r.labels)) for r in nothing} == {(0, 0.0, ())}
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, percent=0)


def test_licenses_name_the_closest(spark):
    text = lambda label: next(t for x, _, t in licenses.TEMPLATES if x == label)
    rows = [(i, text(x)) for i, x in enumerate(["cc-by", "cc-by-nc", "cc-by-nc-sa", "gpl-2", "gpl-3", "lgpl-3", "cc0"])] + [(8, "the work under the license is free to use"), (9, text("bsd") + "\n" + text("mit"))]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: ["cc-by"], 1: ["cc-by-nc"], 2: ["cc-by-nc-sa"], 3: ["gpl-2"], 4: ["gpl-3"], 5: ["lgpl-3"], 6: ["cc0"], 8: [], 9: ["bsd", "mit"]}


# --- periodic runs


def plain_runs(w, min_words=6, min_periods=4):
    found = {}
    for q in range(1, len(w) // min_periods + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(min_words, min_periods * q):
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in found.items())


def some_words(rng, n):
    k = rng.choice([1, 2, 2, 3, 30])
    w = [f"w{rng.randrange(k)}" for _ in range(n)]
    for _ in range(rng.choice([0, 1, 2])):
        if n:
            p, a, m = rng.randint(1, 9), rng.randrange(n), rng.randint(1, 60)
            w[a : a + m] = [f"w{j % p}" for j in range(min(m, n - a))]
    return w


def test_find_runs():
    rng = random.Random(13)
    for _ in range(400):
        texts = [some_words(rng, rng.randint(0, 90)) for _ in range(5)]
        ids = np.array([zlib.crc32(w.encode()) % 997 for t in texts for w in t], np.int32)
        bounds = np.cumsum([0, *map(len, texts)]).astype(np.int64)
        for least, periods in ((6, 4), (1, 5)):
            of, *rest = periodic.find_runs(ids, bounds, least, periods)
            got = [[tuple(map(int, r)) for o, *r in zip(of, *rest, strict=True) if o == i] for i in range(len(texts))]
            assert got == [plain_runs(ids[a:b].tolist(), least, periods) for a, b in itertools.pairwise(bounds)]


def test_long_runs_are_found_in_linear_steps():
    n = 200_000
    of, start, length, period = periodic.find_runs(np.arange(n, dtype=np.int32) % 1000, np.array([0, n]), 6, 4)
    assert [x.tolist() for x in (of, start, length, period)] == [[0], [0], [n], [1000]]
    of, start, length, period = periodic.find_runs(np.zeros(n, np.int32), np.array([0, n]), 6, 4)
    assert [x.tolist() for x in (of, start, length, period)] == [[0], [0], [n], [1]]


def test_periodic_rows(spark):
    rng = random.Random(14)
    rows = [(None, None), (None, ""), (1, " \t"), (1, "a a a a a a\x85"), (2, "b\x0bb\x0cb b b b\x00 b"), (2, "a a a a a a"), (2, "a a a a a a"), (3, "c d " * 40_000 + "e")]
    rows += [(i, " ".join(some_words(rng, rng.randint(0, 200)))) for i in range(60)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, best string").repartition(3)

    def want(doc, text, planted):
        w = [x.decode() for x in (text or "").encode().split()]
        n = len(w)
        if planted and doc is not None and n and zlib.crc32(str(doc).encode()) % 10 == 0:
            g = zlib.crc32(str(doc).encode()) // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = [(0, 80_000, 2)] if n > 50_000 and not planted else plain_runs(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        return doc, n, runs, best, " ".join(x for i, x in enumerate(w) if i not in gone)

    for planted in (False, True):
        own = [(i, t) for i, t in rows if not planted or len(t or "") < 50_000]
        source = docs if not planted else docs.where(F.length(F.coalesce("text", F.lit(""))) < 50_000)
        got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], tuple(r.best) if r.best else None, r.collapsed) for r in periodic.periodic_runs(source, places=periodic.periodic_tail if planted else None).collect()]
        assert sorted(got, key=repr) == sorted((want(i, t, planted) for i, t in own), key=repr)
    assert periodic.periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, min_periods=3)


def test_digests_of_no_runs(spark, tmp_path):
    spark.createDataFrame([(5, "no run"), (6, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in periodic.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert got[5].runs_sha256 == got[6].runs_sha256 == got[6].collapsed_sha256 == sha(b"") and got[5].collapsed_sha256 == sha(b"no run")
    assert got[5].start is None and got[5].n_runs == 0


# --- the classifier's statistics


def plain_statistics(t: bytes) -> dict:
    """Every statistic of a text from its definition."""
    def kind(b):
        for name, values in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", b" \t\r\x0b\x0c"), ("newline", b"\n"), ("stop", b".?"), ("comma", b",;:'\"-()"), ("bang", b"!"), ("bar", b"|")):
            if b in values:
                return name
        return "beyond_ascii" if b > 127 else "control" if b < 32 or b == 127 else "symbol"

    n, words = len(t), t.split()
    if not n:
        return dict.fromkeys(quality.STATISTICS, 0.0)
    kinds = Counter(map(kind, t))
    share = {k: kinds[k] / n for k in ("upper", "lower", "digit", "space", "newline", "stop", "comma", "bang", "bar", "symbol", "beyond_ascii", "control")}
    lengths, m, pairs = [len(w) for w in words], max(len(words), 1), list(itertools.pairwise(words))
    mean = sum(lengths) / m
    variety = lambda x: math.log(len(set(x))) / math.log(len(x)) if len(x) > 1 else 1.0
    return share | {
        "log_bytes": math.log1p(n), "log_words": math.log1p(len(words)), "word_bytes": min(mean, 50), "word_bytes_sd": math.sqrt(min(max(sum(x * x for x in lengths) / m - mean**2, 0), 2500)),
        "entropy": -sum(p * math.log(p) for p in share.values() if p), "distinct_words": variety(words), "distinct_pairs": variety(pairs),
        "top_word": max(Counter(words).values(), default=0) / m, "same_as_before": sum(a == b for a, b in pairs) / m, "symbol_words": sum("symbol" in map(kind, w) for w in words) / m,
        "capital_words": sum(len(w) > 1 and kind(w[0]) == kind(w[1]) == "upper" for w in words) / m, "bare_bars": sum(w == b"|" for w in words) / m, "line_bytes": math.log1p(n / (t.count(b"\n") + 1)),
    }


def test_statistics():
    rng = random.Random(15)
    parts = ["the", "THE", "Ab", "é中", "x#", "|", "a|b", "!", "12", "\x00", "\x7f", ".", "(a)", "ZZ", "word" * 30]
    texts = ["", " ", "\n", "A", "AA", "| |", *(rng.choice(["", " "]) + "".join(rng.choice(parts) + rng.choice([" ", "\n", "\t", "  ", "\r\n"]) for _ in range(rng.choice([1, 2, 5, 60]))) for _ in range(150))]
    got = quality.statistics([t.encode() for t in texts])
    for t, row in zip(texts, got, strict=True):
        want = plain_statistics(t.encode())
        for name, value in zip(quality.STATISTICS, row.tolist(), strict=True):
            assert abs(value - want[name]) < 1e-6, (t, name, value, want[name])
