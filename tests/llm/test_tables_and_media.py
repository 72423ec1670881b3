import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quiverine.llm import gif, topk, url_filter

# URL filters


def brute_rule(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: (r.host.count("."), len(r.path)), default=None)


URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "https://Example.ORG/es/1", "https://example.org/es", "https://example.org/en/1", "https://a.b.example.org/en/123?x#y", "https://notexample.org/en/1",
    "http://x.com/fr/", "http://x.com/fr", "http://x.com/de/?q=/fr/", "http://com/de/", "http://com?/de/", "ftp://x.net/de/", "a://b://c.org/", "http://x.org#/es/", "http://x.org//es/", "http://é.COM/fr/ü", "http://x.com\n/fr/", "http://.org/", "http://org./",
]


def test_urls_match_brute_force(spark):
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df, url_filter.RULES).collect()}
    for k, url in enumerate(URLS * 2):
        host, path, rule = brute_rule(url, url_filter.RULES)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == (host, path, rule.name if rule else None, rule.verdict if rule else "allow"), url
    assert url_filter.judge_urls(df.limit(0), url_filter.RULES).count() == 0


def test_tries_of_random_rules():
    rng = random.Random(1)
    host = lambda: ".".join(rng.choice(["a", "b", "org"]) for _ in range(rng.randrange(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(["", "x", "xy", "y"]) for _ in range(rng.randrange(0, 4)))
    for _ in range(200):
        rules = list({(h, p): url_filter.Rule(h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(8))}.values())
        trie = url_filter.UrlTrie(rules)
        for _ in range(30):
            h, p = host(), path()
            assert trie.find(h, p) == brute_rule(f"s://{h}{p}", rules)[2]


def test_rules_that_clash_and_hosts_in_capitals():
    rule = url_filter.Rule
    trie = url_filter.UrlTrie([rule("Example.ORG", "/", "block"), rule("example.org", "/", "block"), rule("ex.com", "/a", "allow")])
    assert trie.find("www.example.org", "/x").verdict == "block"
    for clash in (rule("EXAMPLE.org", "/", "allow"), rule("ex.com", "/a", "block")):
        with pytest.raises(ValueError, match="both allowed and blocked"):
            trie.add(clash)


def test_bad_verdicts_are_refused():
    with pytest.raises(ValueError, match="verdict"):
        url_filter.UrlTrie([url_filter.Rule("org", "/", "maybe")])


# Exact top-k


def brute_top(rows, k, scale=256):
    usable = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in dict((str(u), u) for u in usable if u[0] % 5 == 0).values():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(a) == len(b))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def vectors_of(spark, rows):
    return topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), "vec_id", "embedding", 256)


def answers(vectors, k):
    return sorted(tuple(r) for r in topk.top_k(vectors, vectors.filter(F.col("id") % 5 == 0), k).collect())


@pytest.mark.parametrize("kind", ["unit", "lengths", "ties", "few"])
def test_top_k_matches_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "FIRST", 20)
    monkeypatch.setattr(topk, "GROWTH", 4)
    monkeypatch.setattr(topk, "QUERY_BYTES", 2048)
    rng = np.random.default_rng(3)
    n = 6 if kind == "few" else 300
    data = rng.normal(size=(n, 8))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    if kind == "lengths":
        data *= rng.lognormal(0, 2, (n, 1))
    if kind == "ties":
        data = np.round(data)
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(data)]
    rows += [(1000, None), (1005, [1.0, None]), (1010, [float("nan")] * 8), (1015, [float("inf")] * 8), (None, rows[0][1]), (1020, [0.0] * 8), (1025, [1.0, 2.0]), (1026, [2.0, 1.0]), (3, rows[3][1])]
    got = answers(vectors_of(spark, [(*r, 0) for r in rows]), 5)
    assert got == brute_top(rows, 5)


def test_vectors_beside_columns_of_the_same_names(spark):
    rows = [(k, [float(k % 7), float(k % 5)], "x", "y", "z") for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, `a.b` string, bucket string")
    vectors = topk.integer_vectors(df, "vec_id", "embedding", 256)
    assert answers(vectors, 3) == brute_top([r[:2] for r in rows], 3)


def test_no_vectors(spark):
    assert answers(vectors_of(spark, []), 5) == []


def test_pruning_keeps_all_that_reaches_the_threshold():
    rng = np.random.default_rng(5)
    vectors = rng.integers(-300, 300, (400, 6))
    norms = np.sqrt((vectors**2).sum(axis=1).astype(float))
    group = topk.Group(np.arange(400), vectors, norms)
    pruned = 0
    for q in rng.integers(-300, 300, (60, 6)):
        norm = float(np.sqrt((q**2).sum()))
        scores = group.vectors @ q
        for share in (0.2, 0.6, 0.9):
            threshold = int(share * scores.max())
            left = group.candidates(q.astype(float), norm, threshold / norm * (1 - 1e-9))
            assert set(np.flatnonzero(scores >= threshold)) <= set(left.tolist())
            pruned += 400 - len(left)
    assert pruned > 0


def test_scans_take_every_share_once():
    rng = random.Random(3)
    for _ in range(50):
        sizes = [(b, rng.choice((1, 50, 10**5, 10**7))) for b in range(rng.randrange(1, 9))]
        plan = topk.scans(sizes)
        shares = {}
        for scan in plan:
            for b, low, high in scan:
                assert low == shares.get(b, 0.0) < high
                shares[b] = high
        assert shares == {b: 1.0 for b, _ in sizes}
        order = [b for scan in plan for b, _, _ in scan]
        assert order == sorted(order, reverse=True)
        assert len(plan) <= 8


def test_many_vectors_of_mixed_lengths(spark):
    """50,000 vectors, several scans, one vector thousands of times; against numpy."""
    rng = np.random.default_rng(9)
    data = rng.normal(size=(50_000, 16)).astype(np.float32)
    data *= (rng.lognormal(0, 1, (50_000, 1)) / 4).astype(np.float32)
    data[7000:12_000] = data[7]
    whole = np.floor(256 * data.astype(np.float64)).astype(np.int64)
    pdf = pa.table({"vec_id": pa.array(np.arange(50_000)), "embedding": pa.array(list(data), pa.list_(pa.float32()))})
    vectors = topk.integer_vectors(spark.createDataFrame(pdf).repartition(6), "vec_id", "embedding", 256)
    topk.FIRST, first = 2000, topk.FIRST
    try:
        got = sorted(tuple(r) for r in topk.top_k(vectors, vectors.filter(F.col("id") % 250 == 0), 5).collect())
    finally:
        topk.FIRST = first
    expected = []
    for q in range(0, 50_000, 250):
        scores = whole @ whole[q]
        scores[q] = -(1 << 62)
        best = np.lexsort((np.arange(50_000), -scores))[:5]
        expected += [(q, n + 1, int(i), int(scores[i])) for n, i in enumerate(best)]
    assert got == expected


def test_products_beyond_doubles():
    big = np.array([[1 << 40, 3]], np.int64)
    assert topk.exact_products(big, np.array([1 << 20, 1], np.int64))[0] == (1 << 60) + 3
    assert topk.exact_products(big, np.array([1 << 40, 1], np.int64))[0] == 2**63 - 1


# GIF


@pytest.mark.parametrize("least", [2, 4, 8])
def test_code_streams_come_back(least):
    rng = random.Random(least)
    for n in (0, 1, 2, 5, 576, 5000, 40_000):
        for alphabet in (1, 2, 1 << least):
            data = bytes(rng.randrange(min(alphabet, 1 << least)) for _ in range(n))
            assert gif.lzw_decode(gif.lzw_encode(data, least), least, n + 5) == data


def plain_decode(stream, least):
    """LZW code by code, from the definition."""
    bits = int.from_bytes(stream, "little")
    clear, end = 1 << least, (1 << least) + 1
    out, at = b"", 0
    while True:
        table = {k: bytes([k]) for k in range(clear)} | {clear: b"", end: b""}
        last, width = None, least + 1
        while True:
            code = bits >> at & (1 << width) - 1
            at += width
            if code in (clear, end):
                break
            entry = table[code] if code in table else last + last[:1]
            if last is not None and len(table) < 4096:
                table[len(table)] = last + entry[:1]
            if len(table) == 1 << width and width < 12:
                width += 1
            out, last = out + entry, entry
        if code == end:
            return out


def test_streams_read_by_the_definition():
    rng = random.Random(2)
    for n in (1, 700, 9216):
        data = bytes(rng.choice(b"abcdefgh ") for _ in range(n))
        assert plain_decode(gif.lzw_encode(data), 8) == data


def test_a_full_table_may_go_on_being_used():
    """Encoders may let the table stay full instead of clearing it."""
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(9000))
    codes, table, prefix = [256], {}, -1
    for b in data:
        if prefix >= 0 and (prefix, b) in table:
            prefix = table[prefix, b]
            continue
        if prefix >= 0:
            codes.append(prefix)
            if len(table) + 258 < 4096:
                table[prefix, b] = len(table) + 258
        prefix = b
    codes += [prefix, 257]
    bits = at = known = 0
    for n, code in enumerate(codes):
        known = 258 + max(0, n - 2)
        bits |= code << at
        at += 9 if n == 0 else min(12, max(9, min(known, 4096).bit_length()))
    assert gif.lzw_decode(bits.to_bytes(-(-at // 8), "little"), 8, 9000) == data


def hand_gif(frames, size=(4, 2), background=0):
    """A GIF of frames (x, y, w, h, samples, disposal, transparent or None, delay, interlaced, palette or None)."""
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x80 | 1, background, 0) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    for x, y, w, h, samples, disposal, transparent, delay, interlaced, palette in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent is not None), delay, transparent or 0, 0)
        out += b"\x2c" + struct.pack("<HHHHB", x, y, w, h, (0x40 if interlaced else 0) | (0x81 if palette else 0)) + (palette or b"")
        out += b"\x02" + gif._blocks(gif.lzw_encode(bytes(samples), 2))
    return out + b"\x21\xfe\x03abc\0" + b"\x3b"


def colours(frame):
    names = {(0, 0, 0, 0): ".", (0, 0, 0, 255): "k", (255, 0, 0, 255): "r", (0, 255, 0, 255): "g", (0, 0, 255, 255): "b", (9, 9, 9, 255): "x"}
    return ["".join(names[tuple(p)] for p in row.tolist()) for row in frame.pixels]


def test_disposal_transparency_and_time():
    full = (0, 0, 4, 2, [1] * 8, gif.LEAVE, None, 5, False, None)
    over = (1, 0, 2, 1, [2, 3], gif.RESTORE, 3, 7, False, None)
    clear = (2, 1, 2, 1, [3, 3], gif.BACKGROUND, None, 1, False, None)
    last = (0, 0, 1, 1, [0], 0, None, 0, False, bytes([9] * 12))
    got = list(gif.decode(hand_gif([full, over, clear, last])))
    assert [colours(f) for f in got] == [["rrrr", "rrrr"], ["rgrr", "rrrr"], ["rrrr", "rrbb"], ["xrrr", "rr.."]]
    assert [(f.start, f.delay) for f in got] == [(0, 5), (5, 7), (12, 1), (13, 0)]
    assert gif.histogram(got[0].pixels).tolist() == [0] * 7 + [8] + [8] + [0] * 7 + [8] + [0] * 7
    assert gif.histogram(got[3].pixels).sum() == 3 * 6


def test_interlaced_rows():
    rows = [0, 8, 4, 2, 6, 1, 3, 5, 7]  # as they are stored, for nine rows
    frame = (0, 0, 1, 9, [r % 4 for r in rows], 0, None, 0, True, None)
    got = next(gif.decode(hand_gif([frame], size=(1, 9))))
    assert "".join(colours(got)) == "".join("krgb"[r % 4] for r in range(9))


def test_broken_files_are_refused():
    whole = gif.encode(b"\1" * 576)
    for bad in (b"", b"PNG", whole[:20], whole[:-30], whole[:790]):
        with pytest.raises(ValueError):
            list(gif.decode(bad))
    for cut in range(len(whole)):  # anywhere
        with pytest.raises(ValueError):
            list(gif.decode(whole[:cut]))
    with pytest.raises(ValueError):
        gif.encode(b"")
    with pytest.raises(ValueError):
        gif.encode(b"\1" * 577)


def test_broken_media_in_a_table(spark):
    long = gif.encode(bytes(k % 251 for k in range(576 * 40)))
    media = [(1, long), (2, long[: len(long) // 2]), (3, b"PNG"), (4, None), (5, b""), (1, long)]
    df = spark.createDataFrame([(k, bytearray(m) if m is not None else None, "x") for k, m in media], "`a.b` long, media binary, frame string")
    got = gif.frames(df, key="a.b").collect()
    of = lambda k: sorted((r for r in got if r["a.b"] == k), key=lambda r: r["frame"])
    assert [r["error"] for r in of(1)] == [None] * 6
    assert [r["frame"] for r in of(2)] == list(range(len(of(2))))
    assert [r["error"] is None for r in of(2)] == [True] * (len(of(2)) - 1) + [False]
    assert of(2)[-1]["pixels"] is None
    assert [len(of(k)) for k in (3, 4, 5)] == [1, 0, 1]
    with pytest.raises(ValueError, match="key"):
        gif.frames(df, key="frame")


def test_payloads_come_back(docs, rows):
    got = sorted(str(tuple(r)[:5]) for r in gif.media_digests(docs).collect())
    expected = []
    for r in rows:
        own = (r[1] or "").encode()
        payload = own + b"\xff" * (-len(own) % 576 or (0 if own else 576))
        expected.append(str((r[0], len(own), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))))
    assert got == sorted(expected)


def test_media_columns(spark, docs, rows):
    stored = gif.store(docs.filter("doc_id < 4 or doc_id = 125"))
    media = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    for doc_id, data in media.items():
        own = gif.describe(next(r[1] for r in rows if r[0] == doc_id))
        assert (len(data), hashlib.sha256(data).hexdigest()) == own[4:6]
    found = gif.frames(stored).collect()
    assert {r["doc_id"] for r in found} == set(media)
    for r in found:
        assert len(bytes(r["pixels"])) == r["width"] * r["height"] * 4
        assert sum(r["histogram"]) == 3 * r["width"] * r["height"]
    assert gif.frames(stored.limit(0)).count() == gif.media_digests(docs.limit(0)).count() == 0
