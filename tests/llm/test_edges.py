"""Null and repeated ids, repeated rows, very long texts, clashing names; and plain
versions of the classifier, the url judgement, the image feature and the pipeline."""

import hashlib
import random
import zlib
from collections import defaultdict
from html import escape as html_escape
from urllib.parse import urljoin, urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_brute_force import linked, sha

from grainmill.llm import decontaminate, jaccard, line_dedup, media, packing, quality, substring_dedup, suffix_dedup, url_filter
from grainmill.llm.common import SPACE

SOME = random.Random(5)
WORDS = ["".join(SOME.choices("abcdefgh", k=SOME.randint(2, 7))) for _ in range(500)]
LONG = " ".join(SOME.choices(WORDS, k=60_000)) + "\n" + "y" * 300_000
TAKEN = LONG[1000:1600]


@pytest.fixture(scope="module")
def odd(spark):
    """(doc_id, text) with null and repeated ids, repeated rows and a very long text."""
    shared = " ".join(SOME.choices(WORDS, k=80))
    rows = [(1, LONG), (2, f"own words here {TAKEN} and more"), (3, shared), (3, shared), (3, "another text of the same id"), (None, shared + " x"), (None, "lonely text without an id"), (None, None), (4, ""), (4, ""), (5, None), (6, shared.upper()), (7, "lonely text without an id")]
    return rows, spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, hits string, cls int")


def test_long_and_repeated_passages(odd):
    rows, docs = odd
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(docs).collect()), key=repr)
    words = [(i, (t or "").split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, 2**63), 2**63 if i is None else i)
    want = []
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            gone[k : k + 50] |= first[tuple(w[k : k + 50])] < (2**63 if i is None else i)
        want.append((i, len(w), int(gone.sum())))
    assert got == sorted(want, key=repr) and sum(n for *_, n in want) > 100
    by_bytes = {r.doc_id: r.n_removed for r in suffix_dedup.dedup_suffixes(docs).where("doc_id in (1, 2)").collect()}
    assert by_bytes[1] == 0 and 600 <= by_bytes[2] < 610


def test_components_of_odd_rows(odd):
    rows, docs = odd
    own = linked(dict(enumerate(t for _, t in rows)))
    ids = [i for i, _ in rows]
    root = {k: own[k][1] for k in own}
    lowest = {r: min((ids[k] for k in root if root[k] == r and ids[k] is not None), default=None) for r in set(root.values())}
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_components(docs).collect()), key=repr)
    assert got == sorted(((ids[k], own[k][0], lowest[root[k]] if own[k][0] else ids[k]) for k in own), key=repr)


def test_one_of_each(odd, spark):
    rows, docs = odd
    own = linked(dict(enumerate(t for _, t in rows)))
    groups = defaultdict(list)
    for k, (_, r) in own.items():
        groups[r].append(k)
    want = [rows[k] for r, members in groups.items() for k in (members if not own[r][0] else [min(members, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))])]
    got = jaccard.one_of_each(docs)
    assert got.dtypes == docs.dtypes and sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert jaccard.one_of_each(docs.limit(0)).collect() == []


def test_scans_of_odd_rows(odd, spark):
    rows, docs = odd
    bench = spark.createDataFrame([(1, TAKEN)], "item_id long, text string")
    got = decontaminate.contamination(docs, bench).collect()
    assert sorted(((r.doc_id, r.contaminated) for r in got), key=repr) == sorted(((i, i in (1, 2)) for i, _ in rows), key=repr)
    assert {r.hits for r in got} == {"c"}  # a column of the table's own
    lines = line_dedup.dedup_lines(docs, 2).collect()
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").encode().split(b"\n"):
            held[line.strip(SPACE).lower()].add(i)
    bad = {k for k, ids in held.items() if k and len(ids) >= 2}
    want = [(i, sum(line.strip(SPACE).lower() in bad for line in (t or "").encode().split(b"\n"))) for i, t in rows]
    assert sorted(((r.doc_id, r.n_dropped) for r in lines), key=repr) == sorted(want, key=repr)
    pieces = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("most")).collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in rows} and max(r.most for r in pieces) == packing.CAPACITY
    assert next(r.n for r in pieces if r.doc_id == 5) == 1  # a null text is its end id


def plain_hash(pixels):
    """The feature by loops over samples and coefficients."""
    h, w = pixels.shape
    bounds = lambda n: [(int(np.floor(i * n / 32)), max(int(np.ceil((i + 1) * n / 32)), 1)) for i in range(32)]
    small = np.array([[pixels[a:b, c:d].astype(float).mean() for c, d in bounds(w)] for a, b in bounds(h)])
    wave = lambda k: np.cos(np.pi / 32 * (np.arange(32) + 0.5) * k)
    c = np.array([[(small * np.outer(wave(u), wave(v))).sum() for v in range(8)] for u in range(8)]).round(6).ravel()
    bits = "".join("1" if x > np.median(c[1:]) else "0" for x in c)
    return f"{int(bits, 2):016x}"


def test_media_of_odd_rows(odd):
    rows, docs = odd
    stored = media.to_media(docs).collect()
    got = media.media_features(media.to_media(docs)).collect()
    assert sorted((r.media_sha256, r.media_bytes) for r in got) == sorted((hashlib.sha256(r.media).hexdigest(), len(r.media)) for r in stored)
    want = []
    for i, t in rows:
        b = (t or "").encode()
        payload = b + b"\0" * ((-len(b)) % 64 if b else 64)
        want.append((i, len(b), len(payload), sha(payload), zlib.crc32(payload[-64:]), plain_hash(np.frombuffer(payload, np.uint8).reshape(-1, 64))))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in got), key=repr) == sorted(want, key=repr)


def judged(pages, rules):
    """Verdicts by walking links from page to page."""
    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        path = rest[cut:].split("?")[0].split("#")[0]
        return rest[:cut].lower(), path

    def rule(url):
        host, path = parts(url)
        fit = [(len(h + p), kind == "allow", h + p, kind) for kind, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[2:] if fit else (None, None)

    near = defaultdict(set)
    for _, url, to in pages:
        if to:
            near[url].add(to)
            near[to].add(url)
    out = {}
    for i, url, _ in pages:
        seen, todo = {url}, [url]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        votes = {rule(x)[1] for x in seen}
        text, kind = rule(url)
        out[i] = (*parts(url), text, kind or ("block" if "block" in votes and "allow" not in votes else "allow"))
    return out


def test_redirect_graphs(spark):
    """Chains, hubs, loops and random links, with allow before block."""
    rng = random.Random(6)
    hosts = ["a.net", "example.net", "x.org", "b.io", "c.io", "d.io", "e.com", "example.com"]
    url = lambda: f"http://{rng.choice(hosts)}/{rng.choice(['en', 'fr', 'de', 'q'])}/{rng.randrange(40)}"
    pages = [(i, url(), url() if rng.random() < 0.25 else None) for i in range(300)]
    pages += [(1000 + i, f"http://f.io/{i}", f"http://f.io/{i + 1}") for i in range(40)] + [(1100, "http://f.io/40", "http://z.net/")]
    pages += [(2000 + i, f"http://g.io/{i}", "http://hub.io/") for i in range(80)] + [(2100, "http://hub.io/", "http://example.com/de/1")]
    pages += [(3000, "http://l.io/1", "http://l.io/2"), (3001, "http://l.io/2", "http://l.io/1")]
    html = lambda to: f'<html><link href="{to}" rel=canonical></html>' if to else None
    table = spark.createDataFrame([(i, u, html(to)) for i, u, to in pages], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(table).collect()}
    want = judged(pages, url_filter.RULES)
    assert got == want and sum(v[3] == "block" and v[2] is None for v in want.values()) > 100


def plain_node(url):
    """Scheme and host in lower case, dots resolved, no fragment."""
    parts = urlsplit(url)
    path = urlsplit(urljoin(f"http://h{parts.path}", parts.path)).path if parts.path else ""
    return f"{parts.scheme}://{parts.netloc.lower()}{path}" + (f"?{parts.query}" if parts.query else "")


def test_links_as_pages_write_them(spark):
    """Entities, letter case, dot segments and all kinds of references in random graphs."""
    rng = random.Random(8)
    hosts = ["a.net", "x.org", "b.io", "C.io", "d.IO", "example.com"]
    paths = ["", "/", "/de/", "/fr/1", "/a/b/c", "/a/b/", "/q?x=1&y=2", "/q?x=1", "/a/./b/../c", "/de/../fr/2", "/.."]
    refs = ["../z", "../../de/1", "./1", "?x=1&y=2", "?y=3", "/de/", "//b.io/q?x=1", "2", "1#top", "#f", "HTTP://A.net/de/", "https://d.io/a/b/../c", "mailto:a@b.io", "javascript:void(0)", "..", ".", "/fr/1#z", "a/../b", "//X.org"]
    written = [lambda t: t, lambda t: html_escape(t, quote=True), lambda t: t.replace("/", "&#x2F;").replace("&y", "&#38;y"), lambda t: t.replace("&", "&amp;").replace(".", "&#46;")]
    pages = []
    for i in range(400):
        url = f"{rng.choice(['http', 'HTTP', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '', '#f'])}"
        pages.append((i, url, rng.choice(refs) if rng.random() < 0.4 else None))
    tag = lambda t: f'<meta http-equiv="refresh" content="0; url={t}">' if rng.random() < 0.3 else f'<link data-href="/no" rel="canonical" href="{t}">'
    table = spark.createDataFrame([(i, u, tag(rng.choice(written)(to)) if to else "<p>") for i, u, to in pages], "page_id long, url string, html string")
    edges = sorted((r.a, r.b) for r in url_filter.link_edges(table).collect())
    web = [(u, urljoin(u, to)) for _, u, to in pages if to and not to.startswith(("mailto", "java"))]
    assert edges == sorted((plain_node(a), plain_node(b)) for a, b in web)
    plain = judged([(i, plain_node(u), plain_node(urljoin(u, to)) if to and not to.startswith(("mailto", "java")) else None) for i, u, to in pages], url_filter.RULES)
    got = {r.page_id: r for r in url_filter.judge_urls(table).collect()}
    for i, u, _ in pages:
        rule = judged([(i, u, None)], url_filter.RULES)[i][2]
        assert got[i].rule == rule and got[i].verdict == (judged([(i, u, None)], url_filter.RULES)[i][3] if rule else alias_verdict(plain, pages, i))
    assert sum(got[i].verdict == "block" and got[i].rule is None for i in got) > 10
    plan = url_filter.judge_urls(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def alias_verdict(plain, pages, i):
    """Of a page without a rule of its own: blocked if it has a blocked alias and none allowed."""
    near = defaultdict(set)
    for _, u, to in pages:
        if to and not to.startswith(("mailto", "java")):
            a, b = plain_node(u), plain_node(urljoin(u, to))
            if a != b:
                near[a].add(b)
                near[b].add(a)
    start = plain_node(pages[i][1])
    seen, todo = {start}, [start]
    while todo:
        for x in near[todo.pop()] - seen:
            seen.add(x)
            todo.append(x)
    if not near[start]:
        return "allow"
    kinds = {judged([(0, x, None)], url_filter.RULES)[0][3] if judged([(0, x, None)], url_filter.RULES)[0][2] else None for x in seen}
    return "block" if "block" in kinds and "allow" not in kinds else "allow"


def test_url_rows_one_by_one(spark):
    """Repeated rows, null page_ids, very long pages, and rules of one length."""
    page = "<p>" + "x" * 3_000_000 + '<link rel="canonical" href="http://bad.net/">'
    rows = [(None, "http://p.io/1", page), (None, "http://p.io/1", page), (1, "http://p.io/2", None), (1, "http://p.io/2", None), (2, "http://ab.io/xy", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.rule or "", r.verdict) for r in url_filter.judge_urls(table).collect())
    assert got == [(0, "", "block"), (0, "", "block"), (1, "", "allow"), (1, "", "allow"), (2, "", "allow")]
    equal = [("block", "ab.io", "/x"), ("allow", "b.io", "/xy"), ("allow", "ab.io", "/x"), ("block", "io", "/")]
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(table, rules=equal).collect()}[2] == ("ab.io/x", "allow")


def test_classifier_against_a_plain_fit(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(r.doc_id, quality.statistics([(r.text or "").encode()])[0]) for r in docs.collect()]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    part = lambda folds: (np.array([x for i, x in rows if i in known and fold(i) in folds]), np.array([known[i] for i, _ in rows if i in known and fold(i) in folds], float))
    x, y = part({2, 3, 4})
    features = quality.Fourier(x.mean(0), x.std(0))
    z = features(x)
    penalty = (quality.RIDGE * len(y) + 1) * np.diag([1.0] * (z.shape[1] - 1) + [1e-6])
    weights = np.linalg.lstsq(z.T @ z + penalty, z.T @ y, rcond=None)[0]
    x1, y1 = part({1})
    at = np.clip(np.round((features(x1) @ weights + 0.5) * (quality.BINS / 2)), 0, quality.BINS)
    grid = np.unique(at)
    level = [y1[at == g].mean() for g in grid]
    size = [int((at == g).sum()) for g in grid]
    fit = []  # isotonic by the greatest mean of what begins and the least of what ends at a bin
    for k in range(len(grid)):
        fit.append(max(min(np.average(level[a : b + 1], weights=size[a : b + 1]) for b in range(k, len(grid))) for a in range(k + 1)))
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in quality.score_documents(docs, labels).collect()}
    for i, s in rows:
        want = float(np.clip(np.interp((features(s[None]) @ weights)[0], grid * (2 / quality.BINS) - 0.5, fit), 0, 1))
        assert got[i][0] == (fold(i) == 0) and abs(got[i][1] - want) < 1e-4 and got[i][2] == int(got[i][1] >= 0.3)


HOSTILE = ["my col", "a.b", "x`y", "d", "m", "bad_keys", "rest", "carried", "row", "cls", "hits", "n_lines"]


@pytest.mark.parametrize("broadcast_keys", [0, 1 << 20])
def test_lines_beside_columns_of_any_name(spark, broadcast_keys):
    rows = [(None if i == 3 else i, f"Same line\nown {i}\n same LINE " if i < 12 else None, *(f"{c}{i}" for c in HOSTILE)) for i in range(14)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *HOSTILE])
    out = line_dedup.dedup_lines(docs, broadcast_keys=broadcast_keys)
    assert out.columns == ["doc_id", "text", *HOSTILE[:-1], "n_lines", "n_dropped"] and out.schema["doc_id"] == docs.schema["doc_id"]
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted(((r[0], r[1].split("\n")[1], *r[2:-1], 3, 2) if r[1] else (r[0], None, *r[2:-1], 1, 0) for r in rows), key=repr)


def test_stages_carry_columns_of_any_name(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    base = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = base.select("*", *(F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in HOSTILE))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        for r in out.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in HOSTILE), name
    assert pipeline.STAGES[-1][1](spark, docs, sf).count() > 0


def test_pipeline_of_odd_rows(spark, sf, odd):
    """Every stage on its own input against a plain version."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, docs = odd
    stages = dict(pipeline.STAGES)
    columns = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), "hits", "cls")
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    for name in list(stages)[:-1]:
        assert stages[name](spark, columns.limit(0), sf).collect() == [] and stages[name](spark, columns, sf).dtypes == columns.dtypes
    assert plain(stages["near_duplicates"](spark, columns, sf)) == plain(jaccard.one_of_each(columns))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(quality.text_statistics(columns), labels)
    good = {t: bool(model(quality.statistics([(t or "").encode()]))[0] >= quality.THRESHOLD) for _, t in rows}
    assert plain(stages["quality"](spark, columns, sf)) == sorted((tuple(r) for r in columns.collect() if good[r.text]), key=repr)
    lines = stages["line_dedup"](spark, columns, sf)  # no line is in ten documents
    assert plain(lines) == plain(columns)
    many = columns.withColumn("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")))).where("text = 'lonely text without an id'")
    assert {(r.text, r.n_chars) for r in stages["line_dedup"](spark, many, sf).collect()} == {("", 0)}
    assert plain(stages["decontamination"](spark, columns, sf)) == plain(columns)  # nothing of the benchmark is in them
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    assert stages["decontamination"](spark, columns.withColumn("text", F.lit(f"a {item} b")), sf).collect() == []
    packed = stages["packing"](spark, columns, sf)
    assert packed.groupBy("doc_id").agg(F.sum("length").alias("n")).count() == len({i for i, _ in rows}) and stages["packing"](spark, columns.limit(0), sf).collect() == []
