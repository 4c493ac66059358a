"""Each corpus operator against a plain walk over all documents."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.llm import components, decontaminate, jaccard, line_dedup, media, packing, substring_dedup, suffix_dedup, url_filter, warc
from grainmill.llm.common import SPACE, scratch_path

LOWER = {c: c + 32 for c in range(65, 91)}


def sha(b):
    return hashlib.sha256(b).hexdigest()


def gone_by_window(units, n):
    """Per document in id order, which units lie in a window of n that a smaller id has."""
    first, out = {}, {}
    for doc, seq in sorted(units.items()):
        flags = np.zeros(len(seq), bool)
        for i in range(len(seq) - n + 1):
            w = tuple(seq[i : i + n])
            if first.setdefault(w, doc) < doc:
                flags[i : i + n] = True
        out[doc] = flags
    return out


def test_substrings(docs, prose, empty):
    words = {i: (t or "").encode().split() for i, t in prose}
    gone = gone_by_window(words, 50)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(docs).collect()}
    assert got == {i: (len(w), int(gone[i].sum()), sha(b" ".join(x for x, g in zip(w, gone[i], strict=True) if not g))) for i, w in words.items()}
    assert any(g.any() and not g.all() for g in gone.values())
    assert substring_dedup.dedup_substrings(empty).collect() == []
    with pytest.raises(ValueError):
        substring_dedup.dedup_substrings(docs, cover=(1, 2))


@pytest.mark.parametrize("in_memory,part", [(50, 1), (2000, 1 << 30), (400_000, 4 << 20)])
def test_suffixes(docs, prose, empty, in_memory, part):
    texts = {i: (t or "").encode() for i, t in prose}
    gone = gone_by_window(texts, 50)
    spans = {i: int((g & ~np.append(False, g[:-1])).sum()) if len(g) else 0 for i, g in gone.items()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_suffixes(docs, in_memory=in_memory, part=part).collect()}
    assert got == {i: (len(t), int(gone[i].sum()), spans[i], sha(bytes(np.frombuffer(t, np.uint8)[~gone[i]]))) for i, t in texts.items()}
    assert suffix_dedup.dedup_suffixes(empty).collect() == []


def test_suffixes_before_a_repeat(spark):
    """P1 R P2 R, where a smaller document has the end of P1 with the start of R: the second R stays."""
    rng = np.random.default_rng(7)
    some = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    texts = {}
    for i in range(60):
        p1, r, p2 = some(120), some(200), some(90)
        texts[i], texts[100 + i] = some(60) + p1[-30:] + r[:40] + some(60), p1 + r + p2 + r
    gone = gone_by_window(texts, 50)
    assert all(70 <= gone[100 + i].sum() < 80 for i in range(60))
    table = spark.createDataFrame([(i, t.decode()) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_suffixes(table).collect()}
    assert got == {i: (int(gone[i].sum()), int(gone[i].any()), sha(bytes(np.frombuffer(t, np.uint8)[~gone[i]]))) for i, t in texts.items()}


def odd_ids():
    """Rows without an id and with one id and different texts, of which some share passages: (doc_id, text)."""
    rng = np.random.default_rng(8)
    some = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 4))) for _ in range(n))
    passage, other, own = some(70), some(60), some(150)
    return [
        (5, f"{some(10)} {passage} {some(9)}"), (3, f"{some(20)} {other}"), (None, f"{some(80)} {passage} {some(3)}"), (None, some(200)), (None, some(52)), (None, f"{other} {some(8)}"), (None, "short"),
        (8, f"{some(100)} {passage}"), (8, some(190)), (8, f"{own} {some(4)}"), (8, f"{some(5)} {own} {other}"), (9, f"{some(2)} {own}"), (None, own), (8, own), (None, None),
        (None, f"{passage} {some(70)} {passage}"), (None, f"{some(1)} {passage} {some(70)} {passage}"),
    ]


def gone_by_row(rows, n):
    """As gone_by_window, of rows (doc_id, units): no id is the largest, rows of one id are one document."""
    windows = [[tuple(u[i : i + n]) for i in range(len(u) - n + 1)] for _, u in rows]
    ids = [2**63 if i is None else i for i, _ in rows]
    first = {}
    for i, own in zip(ids, windows, strict=True):
        for w in own:
            first[w] = min(i, first.get(w, i))
    out = [np.zeros(len(u), bool) for _, u in rows]
    for i, own, flags in zip(ids, windows, out, strict=True):
        for at, w in enumerate(own):
            if first[w] < i:
                flags[at : at + n] = True
    return out


def test_substrings_odd_ids(spark):
    rows = [(i, (t or "").encode().split()) for i, t in odd_ids()]
    want = [(i, len(w), int(g.sum()), sha(b" ".join(x for x, f in zip(w, g, strict=True) if not f))) for (i, w), g in zip(rows, gone_by_row(rows, 50), strict=True)]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(odd_ids(), "doc_id long, text string")).collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got)


def test_suffixes_odd_ids(spark):
    rows = [(i, (t or "").encode()) for i, t in odd_ids()]
    want = [(i, len(t), int(g.sum()), sha(bytes(np.frombuffer(t, np.uint8)[~g]))) for (i, t), g in zip(rows, gone_by_row(rows, 50), strict=True)]
    got = suffix_dedup.dedup_suffixes(spark.createDataFrame(odd_ids(), "doc_id long, text string")).collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256)) for r in got)


@pytest.mark.parametrize("costly", [jaccard.COSTLY, 1])
def test_components(docs, prose, empty, costly):
    sets = {}
    for i, t in prose:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(docs, costly=costly).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in ids}
    assert jaccard.similar_components(empty).collect() == []


def linked(texts):
    """Smallest id within reach of each text, by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def crowd():
    """A passage in texts that are not similar, borderline copies of one text that link to
    some of each other, a chain, short texts, and a hot shingle."""
    rng = np.random.default_rng(11)
    words = ["w" + str(i) for i in range(3000)]
    some = lambda n: list(rng.choice(words, n))
    passage, base, texts = some(90), some(150), []
    texts += [some(int(rng.integers(5, 60))) + passage + some(int(rng.integers(5, 40))) for _ in range(60)]
    for _ in range(80):
        near = list(base)
        for at in rng.integers(0, len(near), int(rng.integers(1, 8))):
            near[at] = str(rng.choice(words))
        texts.append(near)
    chain = some(120)
    for _ in range(25):
        chain = list(chain)
        chain[int(rng.integers(0, 120))] = str(rng.choice(words))
        texts.append(chain)
    texts += [["a", "b", "c", "d", "e", *some(int(rng.integers(0, 6)))] for _ in range(40)]
    texts += [["a"] * int(n) for n in rng.integers(1, 30, 20)]
    order = rng.permutation(len(texts))
    return {int(i): " ".join(t) for i, t in zip(order, texts, strict=True)}


@pytest.mark.parametrize("costly", [jaccard.COSTLY, 0])
def test_components_of_a_crowd(spark, costly, monkeypatch):
    """Also with nothing allocated to any content, so that all goes through blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 3000)
    texts = crowd()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), costly=costly).collect()}
    assert got == linked(texts)


def test_clashing_classes(spark, docs, prose, monkeypatch):
    """With ids of six bits, so that all texts clash, results are the same."""
    from grainmill.llm import classes

    monkeypatch.setattr(classes, "BITS", 6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(docs).collect()}
    assert got == linked(dict(prose))
    gone = gone_by_window({i: (t or "").encode().split() for i, t in prose}, 50)
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(docs).collect()} == {i: int(g.sum()) for i, g in gone.items()}


def test_needed_of_large_sets():
    """Random pairs at the threshold share what is asked for, also with many empty segments."""
    rng = np.random.default_rng(2)
    bands = jaccard.Bands(80)
    for n in (5_000, 200_000, 400_000):
        common = rng.integers(1, 2**63, n).astype(np.uint64)
        own = [np.unique(np.concatenate((common, rng.integers(1, 2**63, n // 8 - k).astype(np.uint64)))) for k in (0, 3)]
        band = max(bands.of(len(x))[0] for x in own)
        both = len(np.intersect1d(*own))
        assert 100 * both >= 80 * (len(own[0]) + len(own[1]) - both)
        (kr, er), (ks, es) = (bands.normal(x, band) for x in own)
        m = int(bands.m[band])
        assert len(np.intersect1d(kr, ks)) >= max(bands.needed(len(x), band, m - e) for x, e in zip(own, (er, es), strict=True)) > 0


def test_pigeonhole():
    """Similar sets share a key: by contents if either is light, else by deletions."""
    rng = np.random.default_rng(1)
    bands = jaccard.Bands(80)
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        r = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
        s = np.unique(np.concatenate((r[rng.random(len(r)) > 0.1], rng.integers(1, 2**63, int(rng.integers(0, 1 + n // 8))).astype(np.uint64))))
        if len(s) and len(r) and 100 * len(np.intersect1d(r, s)) >= 80 * len(np.union1d(r, s)):
            band = max(bands.of(len(r))[0], bands.of(len(s))[0])
            assert band in bands.of(len(r)) and band in bands.of(len(s))
            (kr, er), (ks, es) = bands.normal(r, band), bands.normal(s, band)
            if min(er, es) <= bands.slack(band):
                assert len(np.intersect1d(kr, ks)) >= bands.slack(band) + 1 - min(er, es)
            assert len(np.intersect1d(bands.deleted(r, band), bands.deleted(s, band)))


@pytest.mark.parametrize("min_docs,keep,limit", [(2, "none", 1 << 20), (2, "first", 1 << 20), (2, "none", 0), (3, "first", 0), (1, "none", 1 << 20)])
def test_lines(docs, prose, empty, min_docs, keep, limit):
    key = lambda line: line.strip(SPACE).lower()
    lines = {i: (t or "").encode().split(b"\n") for i, t in prose}
    held = defaultdict(set)
    for i, own in lines.items():
        for line in own:
            if key(line):
                held[key(line)].add(i)
    want = {}
    for i, own in lines.items():
        seen, kept = set(), []
        for line in own:
            bad = len(held.get(key(line), ())) >= min_docs
            if not bad or keep == "first" and min(held[key(line)]) == i and key(line) not in seen:
                kept.append(line)
            seen.add(key(line))
        want[i] = (len(own), len(own) - len(kept), b"\n".join(kept))
    got = {r.doc_id: (r.n_lines, r.n_dropped, (r.text or "").encode()) for r in line_dedup.dedup_lines(docs, min_docs, keep=keep, broadcast_keys=limit).collect()}
    assert got == want
    assert line_dedup.dedup_lines(empty).collect() == []


def test_line_columns(spark):
    clash = spark.createDataFrame([(1, "a", 5), (1, None, 6)], "doc_id long, text string, n_lines int")
    assert sorted(r.n_lines for r in line_dedup.dedup_lines(clash).collect()) == [1, 1]


@pytest.mark.parametrize("slice_chars", [10**6, 300])
def test_contamination(spark, docs, prose, empty, slice_chars):
    words = {i: re.findall(decontaminate.WORD, (t or "").translate(LOWER)) for i, t in prose}
    longest = max(words.values(), key=len)
    items = [(1, " ".join(longest[20:45])), (2, "ONE two,THREE"), (3, None), (4, "!!"), (10, " ".join(longest[25:35])), (10, " ".join(longest[25:35])), (None, "word"), (12, "word")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for item, t in items:
        w = re.findall(decontaminate.WORD, (t or "").translate(LOWER))
        for k in range(max(1, len(w) - 9)) if w and item is not None else ():
            windows[tuple(w[k : k + 10])].add(str(item))
    want = {}
    for i, w in words.items():
        hit, found = set(), set()
        for pattern, own in windows.items():
            for k in range(len(w) - len(pattern) + 1):
                if tuple(w[k : k + len(pattern)]) == pattern:
                    hit.update(range(k, k + len(pattern)))
                    found |= own
        want[i] = (len(w), len(hit), sorted(found))
    got = decontaminate.contamination(docs, bench, slice_chars=slice_chars).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == want
    for r in got:
        assert all(re.fullmatch(decontaminate.WORD, r.text[s.start : s.end].translate(LOWER)) for s in r.spans) and len(r.spans) == r.n_hit
    assert decontaminate.contamination(empty, bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_archive(spark):
    pages = [(5, "http://a/\r\nX: y", "p"), (2, "http://b", "p"), (7, None, None), (9, "http://c", ""), (3, "u", "é\r\n\r\nWARC/1.1"), (3, "u", "é\r\n\r\nWARC/1.1"), (None, "v", "p")] + [(100 + i, "h", "hot") for i in range(1500)]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    path = scratch_path(spark, "test")
    warc.write_archive(table, path)
    got = warc.read_archive(spark, path).collect()
    assert sorted((r.page_id is None, r.page_id or 0, bytes(r.payload)) for r in got) == sorted((i is None, i or 0, (h or "").encode()) for i, _, h in pages)
    import base64

    for r in got:
        digest = base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
        assert r.stated_digest == digest
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert len(rest) == size + 4 and rest.endswith(b"\r\n\r\n") and head.count(b"WARC-Type") == 1
    kind = {(r.page_id, bytes(r.payload)): (r.record_type, r.refers_to) for r in got}
    assert kind[2, b"p"] == ("response", None) and kind[5, b"p"] == ("revisit", 2) and kind[None, b"p"] == ("revisit", 2) and kind[9, b""] == ("revisit", 7)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    none = scratch_path(spark, "test")
    warc.write_archive(table.limit(0), none)
    assert warc.read_archive(spark, none).collect() == []


def test_urls(spark):
    canon = '<html><LINK rel="canonical" href="{}"></html>'
    rows = [
        (1, "https://A.Example.COM/de/x?q#f", None), (2, "http://www.example.net/en/1", ""), (3, "http://other.net/x", ""), (4, "http://other.net?x", ""), (5, None, canon.format("http://x")), (6, "nonsense", ""),
        (7, "http://plain.io/a", canon.format("https://a.example.com/de/y")), (8, "http://plain.io/b", '<meta http-equiv="refresh" content="0; url=/a">'), (9, "http://mixed.io/a", canon.format("http://evil.net/p")),
        (10, "http://mixed.io/b", canon.format("http://mixed.io/a") + canon.format("http://www.example.net/en/2")), (11, "http://plain.io/b#frag", None), (12, "http://deep.org/fr/x", canon.format("http://bad.net/")), (13, "http://example.community/de/", ""),
    ]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, node int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert got[1] == ("a.example.com", "/de/x", "example.com/de/", "block")
    assert got[2][2:] == ("example.net/en/", "allow") and got[3][2:] == ("net/", "block") and got[4] == ("other.net", "", None, "allow")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert [got[i][3] for i in (7, 8, 11)] == ["block"] * 3  # aliases of a blocked page, over two steps
    assert [got[i][3] for i in (9, 10)] == ["allow"] * 2  # an allowed member beats a blocked one
    assert got[12][2:] == ("org/fr/", "allow") and got[13][2:] == (None, "allow")
    assert url_filter.judge_urls(pages.limit(0)).collect() == []


def test_connected_components(spark):
    import random

    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)] + [(None, 1), (5, 5)]
    table = spark.createDataFrame(edges, "a long, b long")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components.connected_components(table).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components.connected_components(table.limit(0)).collect() == []


def test_media(docs, prose, empty):
    got = {r.doc_id: r for r in media.media_features(media.to_media(docs)).collect()}
    for i, t in prose:
        b = (t or "").encode()
        payload = b + b"\0" * ((-len(b)) % 64 or (0 if b else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), sha(payload), zlib.crc32(payload[-64:]))
    assert media.media_features(media.to_media(empty)).collect() == []


def test_png_filters_and_checksums():
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (9, 7), dtype=np.uint8)
    rows = []
    for y in range(9):
        kind = y % 5
        line = [kind]
        for x in range(7):
            a, b, c = (int(pixels[y, x - 1]) if x else 0), (int(pixels[y - 1, x]) if y else 0), (int(pixels[y - 1, x - 1]) if x and y else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((int(pixels[y, x]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        rows.append(bytes(line))
    head = (7).to_bytes(4, "big") + (9).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    data = zlib.compress(b"".join(rows))
    png = media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", data[:5]) + media._chunk(b"IDAT", data[5:]) + media._chunk(b"IEND", b"")
    assert (media.decode_png(png) == pixels).all()
    with pytest.raises(ValueError):
        media.decode_png(png[:40] + bytes([png[40] ^ 1]) + png[41:])


def test_packing(docs, prose, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in prose}
    pieces = packing.pack(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        at = 0
        for start, length in sorted(own):
            assert start == at and length > 0
            at += length
        assert at == len(ids[doc])
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack(empty).collect() == []


def test_differencing():
    import random

    rng = random.Random(2)
    for _ in range(200):
        sizes, k = [rng.randint(1, 512) for _ in range(rng.randint(0, 60))], rng.randint(1, 12)
        windows = packing.differencing(sizes, k)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and len(windows) <= k
        assert all(sum(sizes[i] for i in w) <= packing.CAPACITY for w in packing.pack_group(sizes))
    even = packing.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in even) in ([14, 16], [15, 15])
    assert packing.pack_group([2048, 2048]) and packing.pack_group([]) == []
