"""Exact round trips: WARC archives with damage, lossless pictures with every feature of the format."""

import base64
import gzip
import hashlib
import heapq
import random
import struct
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from galena.llm import op8_warc as op8
from galena.llm import op10_media as op10
from galena.llm import webp


def record(payload, kind="response", **more):
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = {"WARC-Type": kind, "WARC-Record-ID": "<urn:page:7>", "WARC-Payload-Digest": digest, "Content-Type": "text/html", "Content-Length": str(len(payload))} | more
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + payload + b"\r\n\r\n"


def test_salvage_of_plain_archives():
    parts = [record(f"payload {k} WARC/1.0\r\n x".encode()) for k in range(5)]
    assert op8.salvage(b"".join(parts)).gaps == [] and len(op8.salvage(b"".join(parts)).records) == 5
    broken = parts[1].replace(b"payload", b"pAyload")  # the digest no longer fits
    short = record(b"abc").replace(b"Content-Length: 3", b"Content-Length: 9")
    data = parts[0] + broken + parts[2] + b"noise" + parts[3] + short + parts[4] + b"WARC/1.0\r\nunfinished"
    got = op8.salvage(data)
    assert [r.block[:9] for r in got.records] == [b"payload 0", b"payload 2", b"payload 3", b"payload 4"]
    covered = sorted([(r.start, r.end) for r in got.records] + [g[:2] for g in got.gaps])
    assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))
    assert [g[2] for g in got.gaps][:1] == ["the digest differs"]
    assert op8.salvage(b"").records == [] and op8.salvage(b"junk").gaps == [(0, 4, "no version line")]


def test_salvage_of_compressed_archives():
    parts = [gzip.compress(record(f"payload {k}".encode() * 20)) for k in range(4)]
    hurt = bytearray(parts[1])
    hurt[len(hurt) // 2] ^= 0xFF
    data = parts[0] + bytes(hurt) + parts[2] + b"\x1f\x8b\x08 no" + parts[3] + parts[0][:30]
    got = op8.salvage_gzip(data)
    assert [r.block[:9] for r in got.records] == [b"payload 0", b"payload 2", b"payload 3"]
    assert sum(r.end - r.start for r in got.records) + sum(b - a for a, b, _ in got.gaps) == len(data)


def test_salvage_of_members_with_several_records():
    parts = [record(f"payload {k}".encode() * 20) for k in range(5)]
    hurt = parts[2].replace(b"payload 2", b"payload X", 1)
    data = gzip.compress(parts[0] + parts[1]) + gzip.compress(hurt + parts[3] + b"rest") + gzip.compress(b"") + gzip.compress(parts[4])
    got = op8.salvage_gzip(data)
    assert [r.block[:9] for r in got.records] == [b"payload 0", b"payload 1", b"payload 3", b"payload 4"]
    reasons = [g[2] for g in got.gaps]
    assert [("the digest differs" in r, "no version line" in r, r == "an empty member") for r in reasons] == [(True, False, False), (False, True, False), (False, False, True)]
    whole = op8.salvage_gzip(gzip.compress(b"".join(parts)))
    assert len(whole.records) == 5 and not whole.gaps


@pytest.mark.parametrize("hot", [0, 1, 100])
def test_plan_of_repeated_payloads(spark, monkeypatch, hot):
    """The same rows, however many of the repeated payloads are broadcast."""
    monkeypatch.setattr(op8, "HOT", hot)
    rows = [(k, "u", ("a", "b", "c")[k % 3] * 1200 if k % 4 else f"{k}" * 900) for k in range(120)] + [(7, "u", "b" * 1200), (None, "u", "b" * 1200)]
    got = op8.plan(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    last = {}
    for k, _, t in rows:
        if k is not None and len(t) >= 1000:
            last[t] = max(k, last.get(t, k))
    want = [(k, t, last[t] if k is not None and last.get(t, k) != k else None) for k, _, t in rows]
    assert sorted(((r["page_id"], r["html"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)


def test_a_lost_page_is_an_error_and_its_gap_is_logged(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(k, "u", f"page {k}") for k in range(20)], "page_id long, url string, html string")
    write = op8.write

    def damaged(planned, folder):
        write(planned, folder)
        path = next(p for p in (tmp_path / "warc").rglob("*.txt") if p.stat().st_size)
        path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
        path.write_bytes(path.read_bytes().replace(b"WARC/1.1", b"WARC/9.9", 1))

    monkeypatch.setattr(op8, "write", damaged)
    with pytest.raises(op8.MissingError, match="19 of 20"):
        op8.archive(pages, str(tmp_path))
    assert [r["reason"] for r in spark.read.parquet(f"{tmp_path}/gaps").collect()] == ["no version line"]


def test_archive_round_trip(spark, tmp_path):
    big = "é" * 700
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (5, None, big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "x" * 100_000), (9, "u", "a\r\n\r\nWARC/1.1\r\nb" * 100), (None, "u", big), (5, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("n", F.lit(0))
    got = op8.digest(pages).collect()
    assert len(got) == len(rows)
    html = {}
    for k, _, t in rows:
        html[k] = (t or "").encode()
    for r in got:
        raw = html[r["page_id"]]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha1(raw).hexdigest()
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == {
        (1, "revisit", 5), (2, "revisit", 5), (5, "response", None), (3, "response", None), (4, "response", None), (6, "response", None),
        (7, "response", None), (8, "response", None), (9, "response", None), (None, "response", None),
    }
    assert op8.digest(pages.limit(0)).count() == 0


def test_reader_logs_gaps(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(b"one") + b"??" + record(b"two"))
    got = op8.read(spark, str(tmp_path), with_block=True).orderBy("start").collect()
    assert [(r["kind"], r["start"] is not None, r["block"] and bytes(r["block"])) for r in got] == [("record", True, b"one"), ("gap", True, None), ("record", True, b"two")]


def prefix_value(v):
    """(prefix, extra bits, their number) of a length or distance code."""
    if v <= 4:
        return v - 1, 0, 0
    high = (v - 1).bit_length() - 1
    return 2 * high + ((v - 1) >> (high - 1) & 1), (v - 1) & ((1 << (high - 1)) - 1), high - 1


def put_image(w, pixels, width, main=False, cache=0, copies=False, split=0):
    """Write an entropy-coded picture with the given features."""
    w.put(1, 1) if cache else w.put(0, 1)
    if cache:
        w.put(cache, 4)
    groups, which = 1, lambda at: 0
    if main:
        w.put(int(bool(split)), 1)
        if split:
            across, down = -(-width >> split), -(-(len(pixels) // width) >> split)
            w.put(split - 2, 3)
            put_image(w, [(k % 2) << 8 for k in range(across * down)], across)
            groups, which = 2, lambda at: ((at // width >> split) * across + (at % width >> split)) % 2
    tokens, seen, at = [], [0] * (1 << cache), 0
    remember = lambda p: seen.__setitem__((0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache), p) if cache else None
    while at < len(pixels):
        p, run = pixels[at], 0
        back = next((b for b in (1, width, 3) if copies and b <= at and pixels[at - b] == p and pixels[at : at + 3] == pixels[at - b : at - b + 3]), 0)
        while back and at + run < len(pixels) and run < 40 and pixels[at + run] == pixels[at + run - back]:
            run += 1
        if run >= 3:
            code = webp.NEAR.index((back, 0) if back != width else (0, 1)) + 1 if back != 3 else 3 + 120
            tokens.append((which(at), "copy", run, code))
            for q in pixels[at : at + run]:
                remember(q)
            at += run
            continue
        slot = (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache) if cache else -1
        if cache and seen[slot] == p:
            tokens.append((which(at), "cache", slot))
        else:
            tokens.append((which(at), "pixel", p))
        remember(p)
        at += 1
    counts = [[{} for _ in range(5)] for _ in range(groups)]
    flat = []
    for g, kind, *x in tokens:
        if kind == "pixel":
            symbols = [(0, x[0] >> 8 & 255, 0, 0), (1, x[0] >> 16 & 255, 0, 0), (2, x[0] & 255, 0, 0), (3, x[0] >> 24, 0, 0)]
        elif kind == "cache":
            symbols = [(0, 280 + x[0], 0, 0)]
        else:
            (a, ae, an), (b, be, bn) = prefix_value(x[0]), prefix_value(x[1])
            symbols = [(0, 256 + a, ae, an), (4, b, be, bn)]
        for c, s, _, _ in symbols:
            counts[g][c][s] = counts[g][c].get(s, 0) + 1
        flat.append((g, symbols))
    codes = []
    for g in range(groups):
        for c in range(5):
            n = counts[g][c] or {0: 1}
            if len(n) == 1 and max(n) > 255:
                n = n | {0: 1}
            lengths = webp.code_lengths(n)
            webp.write_code(w, lengths)
            codes.append(webp.canonical(lengths) if len(n) > 1 else {s: (0, 0) for s in n})
    for g, symbols in flat:
        for c, s, extra, bits in symbols:
            w.put(*codes[5 * g + c][s])
            w.put(extra, bits)


def picture(seed, width, height, colours=None):
    rnd = random.Random(seed)
    pool = colours or [rnd.getrandbits(32) for _ in range(40)]
    out = []
    while len(out) < width * height:
        out += [rnd.choice(pool)] * rnd.choice([1, 1, 2, 7])
    return out[: width * height]


def stream(w):
    return w.value.to_bytes(w.n // 8 + 1, "little")


def head(width, height):
    w = webp.BitWriter()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 4)
    return w


@pytest.mark.parametrize(("cache", "copies", "split"), [(0, False, 0), (4, False, 0), (0, True, 0), (6, True, 0), (0, False, 2), (3, True, 2)])
def test_entropy_coded_pictures(cache, copies, split):
    pixels = picture(cache + split, 19, 13)
    w = head(19, 13)
    w.put(0, 1)
    put_image(w, pixels, 19, True, cache, copies, split)
    width, height, got = webp.decode_vp8l(stream(w))
    assert (width, height, got.tolist()) == (19, 13, pixels)


def channels(p):
    return [p >> s & 255 for s in (0, 8, 16, 24)]


def joined(c):
    return sum((v & 255) << s for v, s in zip(c, (0, 8, 16, 24), strict=True))


def forecast(mode, left, top, right, corner):
    mean = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    clip = lambda c: [max(0, min(255, v)) for v in c]
    if mode == 11:
        e = [a + b - c for a, b, c in zip(left, top, corner, strict=True)]
        return left if sum(abs(a - b) for a, b in zip(e, left, strict=True)) < sum(abs(a - b) for a, b in zip(e, top, strict=True)) else top
    if mode == 13:
        return clip([a + int((a - c) / 2) for a, c in zip(mean(left, top), corner, strict=True)])
    return {
        0: [0, 0, 0, 255], 1: left, 2: top, 3: right, 4: corner, 5: mean(mean(left, right), top), 6: mean(left, corner), 7: mean(left, top), 8: mean(corner, top),
        9: mean(top, right), 10: mean(mean(left, corner), mean(top, right)), 12: clip([a + b - c for a, b, c in zip(left, top, corner, strict=True)]),
    }[mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    width, height = 11, 7
    pixels = picture(mode, width, height)
    c = [channels(p) for p in pixels]
    rest = []
    for at in range(len(c)):
        y, x = divmod(at, width)
        p = ([0, 0, 0, 255] if x == 0 else c[at - 1]) if y == 0 else c[at - width] if x == 0 else forecast(mode, c[at - 1], c[at - width], c[at - width + 1], c[at - width - 1])
        rest.append(joined([a - b for a, b in zip(c[at], p, strict=True)]))
    w = head(width, height)
    w.put(1, 1)
    w.put(webp.PREDICTOR, 2)
    w.put(0, 3)
    put_image(w, [mode << 8] * 6, 3)
    w.put(0, 1)
    put_image(w, rest, width, True)
    assert webp.decode_vp8l(stream(w))[2].tolist() == pixels


def test_cross_colour_and_subtract_green():
    width, height = 9, 6
    pixels = picture(5, width, height)
    factors = (17, 200, 99)  # green to red, green to blue, red to blue
    signed = lambda v: v - 256 if v > 127 else v
    delta = lambda f, v: (signed(f) * signed(v)) >> 5
    rest = []
    for p in pixels:
        b, g, r, a = channels(p)
        b, r = (b - g) & 255, (r - g) & 255
        rest.append(joined([b - delta(factors[1], g) - delta(factors[2], r), g, r - delta(factors[0], g), a]))
    w = head(width, height)
    w.put(1, 1)
    w.put(webp.SUBTRACT_GREEN, 2)
    w.put(1, 1)
    w.put(webp.CROSS_COLOUR, 2)
    w.put(1, 3)
    put_image(w, [255 << 24 | factors[2] << 16 | factors[1] << 8 | factors[0]] * 2, 2)
    w.put(0, 1)
    put_image(w, rest, width, True)
    assert webp.decode_vp8l(stream(w))[2].tolist() == pixels


@pytest.mark.parametrize("n", [2, 4, 13, 60])
def test_palette(n):
    rnd = random.Random(n)
    width, height, colours = 13, 5, [rnd.getrandbits(32) for _ in range(n)]
    pixels = picture(n, width, height, colours)
    packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    across, bits = -(-width >> packed), 8 >> packed
    index = [colours.index(p) for p in pixels]
    rows = []
    for y in range(height):
        for x in range(across):
            part = index[y * width + (x << packed) : min(y * width + ((x + 1) << packed), (y + 1) * width)]
            rows.append(255 << 24 | sum(v << (k * bits) for k, v in enumerate(part)) << 8)
    steps = [joined([a - b for a, b in zip(channels(c), channels(colours[k - 1]) if k else [0] * 4, strict=True)]) for k, c in enumerate(colours)]
    w = head(width, height)
    w.put(1, 1)
    w.put(webp.PALETTE, 2)
    w.put(n - 1, 8)
    put_image(w, steps, n)
    w.put(0, 1)
    put_image(w, rows, across, True)
    assert webp.decode_vp8l(stream(w))[2].tolist() == pixels


def means(media):
    """What a stream uses: its transforms, and whether it has a colour cache."""
    r = webp.BitReader(media[20:])
    r.read(8)
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(4)
    used = set()
    while r.read(1):
        kind = r.read(2)
        used.add(kind)
        if kind in (webp.PREDICTOR, webp.CROSS_COLOUR):
            bits = r.read(3) + 2
            webp.read_image(r, -(-width >> bits), -(-height >> bits), False)
        elif kind == webp.PALETTE:
            n = r.read(8) + 1
            webp.read_image(r, n, 1, False)
    return used, r.read(1) == 1


@pytest.mark.parametrize("kind", ["noise", "few", "pattern", "slope", "colours", "one", "text"])
def test_writer_round_trips_and_uses_what_pays(kind):
    rng = np.random.default_rng(len(kind))
    for k in range(25):
        width, height = (int(v) for v in rng.integers(1, 70, 2))
        n = width * height
        y, x = np.mgrid[0:height, 0:width]
        if kind == "noise":
            p = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        elif kind == "few":
            p = rng.choice(rng.integers(0, 1 << 32, int(rng.integers(2, 30)), dtype=np.uint32), n)
        elif kind == "pattern":
            p = np.resize(rng.integers(0, 1 << 32, 500, dtype=np.uint32), n)
        elif kind in ("slope", "colours"):
            green = (2 * x + 3 * y + rng.integers(0, 3, (height, width))) & 255
            red, blue = (green if kind == "colours" else (x + y) & 255), (x * y >> 3) & 255
            p = (0xFF000000 | red << 16 | green << 8 | blue).astype(np.uint32).ravel()
        elif kind == "one":
            p = np.full(n, rng.integers(0, 1 << 32), np.uint32)
        else:
            words = " ".join(rng.choice(["some", "words", "of", "a", "text", "come", "again"], n)).encode()[: 3 * n]
            p = op10.webp.decode(webp.encode_rgb(words, 1))[0][2][: n // width * width] if n >= width else np.zeros(0, np.uint32)
            p = p[: n // width * width]
        media = webp.encode(p, width)
        (w, h, got), = webp.decode(media)
        assert (w, h) == (width, len(p) // width) and np.array_equal(got, p), (kind, k)
        if n > 1500:
            used, cached = means(media)
            assert {"few": webp.PALETTE in used, "one": not used, "slope": webp.PREDICTOR in used, "colours": {webp.PREDICTOR, webp.CROSS_COLOUR} <= used, "text": cached}.get(kind, True)


def test_extended_containers_are_read():
    plain = webp.encode(np.arange(12, dtype=np.uint32), 4)
    chunk = lambda name, c: name + struct.pack("<I", len(c)) + c + bytes(len(c) & 1)
    file = lambda *parts: b"RIFF" + struct.pack("<I", 4 + sum(map(len, parts))) + b"WEBP" + b"".join(parts)
    picture = plain[12:]
    for media, n in ((file(chunk(b"VP8X", bytes(10)), chunk(b"ICCP", b"abc"), picture, chunk(b"EXIF", b"x")), 1), (file(chunk(b"VP8X", bytes(10)), chunk(b"ANIM", bytes(6)), chunk(b"ANMF", bytes(16) + picture), chunk(b"ANMF", bytes(16) + picture)), 2)):
        got = webp.decode(media)
        assert len(got) == n and all(g[2].tolist() == list(range(12)) for g in got)
    with pytest.raises(webp.CorruptError, match="lossy"):
        webp.decode(file(chunk(b"VP8 ", b"abcd")))


def test_corrupt_streams_are_refused():
    good = op10.store(op10.payload("some text " * 50)[1])
    for bad in (b"", b"RIFF", good[:-40], good[:20] + b"\0" + good[21:], b"X" + good[1:]):
        if bad:
            with pytest.raises(webp.CorruptError):
                webp.decode(bad)
    short = good[:4] + struct.pack("<I", len(good) - 8 - 60) + good[8:16] + struct.pack("<I", len(good) - 20 - 60) + good[20:-60]
    with pytest.raises(webp.CorruptError):
        webp.decode(short)


def test_media_round_trip(spark):
    rnd = random.Random(2)
    texts = [None, "", "a", "x" * 192, "x" * 193, "é𝄞 " * 100, "".join(chr(rnd.randrange(1, 0xD000)) for _ in range(3000)), "wide " * 700_000]
    rows = [*enumerate(texts), (2, "a"), (99, "a"), (None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1))
    got = op10.digest(docs).collect()
    assert len(got) == len(rows)
    texts_by = dict(rows)
    for r in got:
        raw = (texts_by[r["doc_id"]] or "").encode()
        full = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(full))
        assert r["payload_sha256"] == hashlib.sha256(full).hexdigest() and r["tail_crc32"] == zlib.crc32(full[-16:])
    same = [(r["media_sha256"], r["feature"]) for r in got if texts_by[r["doc_id"]] == "a"]
    assert len(same) == 3 and len(set(same)) == 1
    assert op10.digest(docs.limit(0)).count() == 0


def test_decode_gives_pixels_or_the_reason(spark):
    media = op10.store(op10.payload("abc")[1])
    df = spark.createDataFrame([(1, bytearray(media)), (2, bytearray(b"no")), (3, None)], "k long, media binary")
    got = {r["k"]: r["picture"] for r in op10.decode(df).collect()}
    assert (got[1]["width"], got[1]["height"], got[1]["error"]) == (64, 1, None)
    assert got[1]["pixels"][0] == 0xFF000000 | ord("a") << 16 | ord("b") << 8 | ord("c")
    assert got[2]["pixels"] is None and got[2]["error"] and got[3]["error"] == "no media"
    assert np.array_equal(op10.load(media)[2].tobytes()[:4], np.frombuffer(b"abc ", np.uint8)) or op10.load(media)[2].tobytes()[:4] == b"abc "


@pytest.mark.parametrize("seed", range(16))
def test_reader_follows_any_tokens(seed, monkeypatch):
    """Literals, copies and cache hits at random, also of slots that nothing has filled, over several stretches and by both of the reader's ways."""
    rnd = random.Random(seed)
    width, height, cache = rnd.choice([1, 7, 64]), rnd.choice([5, 90]), (0, 1, 4, 7)[seed % 4]
    pool, total = [rnd.getrandbits(32) for _ in range(40)], width * height
    slot = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache)
    out, seen, tokens = [], [0] * (1 << cache), []
    unfilled = 0.02 if seed % 3 else 0
    while len(out) < total:
        draw, filled = rnd.random(), [k for k, p in enumerate(seen) if p]
        begin = len(out)
        if cache and (draw < unfilled or filled and draw < 0.4):
            k = rnd.randrange(1 << cache) if draw < unfilled else rnd.choice(filled)
            out.append(seen[k])
            tokens.append([(0, 280 + k, 0, 0)])
        elif out and draw > 0.9:
            code = rnd.choice([120 + rnd.randint(1, begin), 1 + rnd.randrange(120)])
            x, y = webp.NEAR[code - 1] if code <= 120 else (code - 120, 0)
            back, length = max(1, x + y * width), min(rnd.choice([1, 2, 3, 9, 70]), total - begin)
            if back > begin:
                continue
            for _ in range(length):
                out.append(out[-back])
            (a, ae, an), (b, be, bn) = prefix_value(length), prefix_value(code)
            tokens.append([(0, 256 + a, ae, an), (4, b, be, bn)])
        else:
            p = rnd.choice(pool) if rnd.random() < 0.7 else rnd.getrandbits(32)
            out.append(p)
            tokens.append([(0, p >> 8 & 255, 0, 0), (1, p >> 16 & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)])
        for p in out[begin:] if cache else ():
            seen[slot(p)] = p
    counts = [{} for _ in range(5)]
    for c, s, _, _ in (t for token in tokens for t in token):
        counts[c][s] = counts[c].get(s, 0) + 1
    w, codes = head(width, height), []
    w.put(0, 1)
    w.put(1 | cache << 1 if cache else 0, 5 if cache else 1)
    w.put(0, 1)
    for n, alphabet in zip(counts, (280 + (1 << cache), 256, 256, 256, 40), strict=True):
        n = n or {0: 1}
        if len(n) == 1 and max(n) > 255:
            n = n | {0: 1}
        lengths = webp.code_lengths(n)
        webp.write_code(w, lengths, alphabet)
        codes.append(webp.canonical(lengths) if len(n) > 1 else {s: (0, 0) for s in n})
    for c, s, extra, bits in (t for token in tokens for t in token):
        w.put(*codes[c][s])
        w.put(extra, bits)
    assert webp.decode_vp8l(stream(w))[2].tolist() == out
    monkeypatch.setattr(webp, "_follow", lambda *_: None)
    assert webp.decode_vp8l(stream(w))[2].tolist() == out


def test_code_lengths_are_optimal_and_bounded():
    rnd = random.Random(8)
    for k in range(200):
        counts = {s: rnd.choice([1, 2, 3, rnd.randint(1, 1000), 2 ** rnd.randint(0, 24)]) for s in rnd.sample(range(300), rnd.randint(2, 200))}
        free, bounded = webp.code_lengths(counts, 64), webp.code_lengths(counts)
        heap = sorted(counts.values())
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a + b
            heapq.heappush(heap, a + b)
        assert sum(counts[s] * n for s, n in free.items()) == cost, k
        assert max(bounded.values()) <= webp.MOST_BITS and sum(2.0**-n for n in bounded.values()) == 1


def test_pictures_are_read_in_few_steps():
    """The lines that run to read a text's picture, a measure of its cost that does not vary: four for a literal or a cache hit, more for a copy, and those for its codes."""
    rnd = random.Random(1)
    words = ["".join(rnd.choices("etaoinshrdlucmfw", k=rnd.randint(2, 9))) for _ in range(60)]
    raw = op10.payload(" ".join(rnd.choices(words, k=4000)))[1]
    media, lines = op10.store(raw), 0

    def count(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return count

    before = sys.gettrace()
    op10.load(media)  # what is kept for later is not counted
    sys.settrace(count)
    try:
        rgb = op10.load(media)[2]
    finally:
        sys.settrace(before)
    assert rgb.tobytes() == raw
    assert lines < 8.5 * len(rgb), (len(rgb), lines)
