"""The lossless WebP bit stream: a full reader, and a writer that uses its means.

The reader handles prefix codes (simple and normal), meta prefix codes,
back-references, the colour cache, and the four transforms. Where a picture has
one group of codes, what follows each bit position of a stretch is looked up at
once and then followed, and all copies and cache hits are traced to the pixels that
they repeat; otherwise pixels are read one by one. The writer predicts,
decorrelates, or lists the colours of a picture where that costs less, and codes it
as literals, back-references and colour cache hits. Pixels are uint32 ARGB in
scan-line order.
"""

from __future__ import annotations

import math
import struct
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import repeat

import numpy as np

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
SIGNATURE, SIDE_BITS = 0x2F, 14
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
CACHE_FACTOR = 0x1E35A7BD
BLACK = 0xFF000000
#: Predictors: of the left pixel, and those that need no pixel of the same line.
LEFT, FROM_ABOVE = 1, (0, 2, 3, 4, 8, 9, 14, 15)
#: Near pixels in the order of their distance codes.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
#: Lengths of the writer's code for code lengths: fifteen symbols, complete.
TOKEN_LENGTHS = {k: 4 for k in (*range(13), 17, 18)} | {18: 3}
MOST_BITS = 12
#: The longest code of the format.
DEEPEST = 15


class CorruptError(ValueError):
    pass


class BitReader:
    """Bits of ``data``, the least significant of each byte first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)
        self.padded = data + b"\0\0\0\0\0\0\0\0"

    def peek(self, n: int) -> int:
        k = self.at >> 3
        return (int.from_bytes(self.padded[k : k + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise CorruptError("the bit stream ends early")
        return out

    def bits(self, at: int, n: int) -> int:
        """Any number of bits from ``at`` on."""
        return (int.from_bytes(self.padded[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


@lru_cache(maxsize=1)
def _mirrored() -> np.ndarray:
    """The numbers of ``DEEPEST`` bits, each with its bits in reverse."""
    out, k = np.zeros(1 << DEEPEST, np.int32), np.arange(1 << DEEPEST, dtype=np.int32)
    for b in range(DEEPEST):
        out |= ((k >> b) & 1) << (DEEPEST - 1 - b)
    return out


def canonical_codes(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, bits as they are written, lengths) of the canonical code of rising ``symbols`` with ``sizes`` above 0; shorter ones first."""
    order = np.argsort(sizes, kind="stable")
    n = sizes[order]
    room = 1 << (DEEPEST - n)
    return symbols[order], _mirrored()[np.cumsum(room) - room], n


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (bits as they are written, length)."""
    used = sorted(s for s, n in lengths.items() if n)
    found = canonical_codes(np.array(used, np.int32), np.array([lengths[s] for s in used], np.int32))
    return {s: (c, n) for s, c, n in zip(*(x.tolist() for x in found), strict=True)}


#: A symbol and its length in one number: the length is above these bits.
SYMBOL_BITS = 16


@lru_cache(maxsize=16)
def _places(bits: int) -> np.ndarray:
    """By the next ``bits`` bits, the place in a table of codes in their order."""
    return (_mirrored()[: 1 << bits] >> (DEEPEST - bits)).astype(np.int64)


class PrefixCode:
    """A lookup table: ``symbols`` and ``lengths`` by the next ``bits`` bits; from numbers ``length << SYMBOL_BITS | symbol``, lengths above 0."""

    def __init__(self, entries: list[int]):
        if len(entries) < 2:
            self.bits, self.symbols, self.lengths = 0, np.array([entries[0] & 0xFFFF if entries else 0], np.int64), np.zeros(1, np.int64)
            return
        entries = sorted(entries)  # shorter codes first
        e = np.array(entries, np.int64)
        self.bits = entries[-1] >> SYMBOL_BITS
        times = 1 << (self.bits - (e >> SYMBOL_BITS))
        if int(times.sum()) != 1 << self.bits:
            raise CorruptError("an incomplete prefix code")
        e = e.repeat(times).take(_places(self.bits))
        self.symbols, self.lengths = e & 0xFFFF, e >> SYMBOL_BITS

    def read(self, r: BitReader) -> int:
        k = r.peek(self.bits)
        r.at += int(self.lengths[k])
        if r.at > r.end:
            raise CorruptError("the bit stream ends early")
        return int(self.symbols[k])


@lru_cache(maxsize=256)
def _single_code(symbol: int) -> PrefixCode:
    """The code of one symbol, which takes no bits."""
    return PrefixCode([1 << SYMBOL_BITS | symbol])


@lru_cache(maxsize=256)
def _token_code(lengths: tuple[int, ...]) -> tuple[int, list[int], list[int]]:
    code = PrefixCode([n << SYMBOL_BITS | s for s, n in zip(LENGTH_ORDER, lengths, strict=False) if n])
    return code.bits, code.symbols.tolist(), code.lengths.tolist()


def read_code(r: BitReader, alphabet: int) -> PrefixCode:
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        symbols = [r.read(8 if wide else 1)] + ([r.read(8)] if two else [])
        return PrefixCode([1 << SYMBOL_BITS | s for s in set(symbols)]) if two else _single_code(symbols[0])
    count = 4 + r.read(4)
    packed = int.from_bytes(r.padded[r.at >> 3 : (r.at >> 3) + 9], "little") >> (r.at & 7)
    r.at += 3 * count
    bits, symbols, sizes = _token_code(tuple((packed >> 3 * k) & 7 for k in range(count)))
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
    entries, symbol, last, mask = [], 0, 8, (1 << bits) - 1
    start = r.at >> 3
    # a number of few bytes at a time: shifts of it are cheap
    ahead, have, used = 0, -1, r.at & 7
    while symbol < alphabet and left:
        if used > have - 16:
            start, used = start + (used >> 3), used & 7
            ahead, have = int.from_bytes(r.padded[start : start + 64], "little"), 512
        left -= 1
        k = (ahead >> used) & mask
        token = symbols[k]
        used += sizes[k]
        if token < 16:
            if token:
                last = token
                entries.append(token << SYMBOL_BITS | symbol)
            symbol += 1
            continue
        value, base, extra = ((last, 3, 2), (0, 3, 3), (0, 11, 7))[token - 16]
        times = base + ((ahead >> used) & ((1 << extra) - 1))
        used += extra
        if symbol + times > alphabet:
            raise CorruptError("code lengths beyond the alphabet")
        if value:
            entries += range(value << SYMBOL_BITS | symbol, (value << SYMBOL_BITS | symbol) + times)
        symbol += times
    r.at = 8 * start + used
    if r.at > r.end:
        raise CorruptError("the bit stream ends early")
    return PrefixCode(entries)


def _long_value(prefix: int, r: BitReader) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.read(extra) + 1


def _read_group(r: BitReader, cache: int) -> list[PrefixCode]:
    """The five codes of a group; a description that repeats the one before, bit by bit, is read once."""
    out: list[PrefixCode] = []
    begin = end = 0
    for k, n in enumerate((280 + cache, 256, 256, 256, 40)):
        size = end - begin
        if 1 < k < 4 and r.at + size <= r.end and r.bits(r.at, size) == r.bits(begin, size):
            out.append(out[-1])
            begin, end, r.at = r.at, r.at + size, r.at + size
            continue
        begin = r.at
        out.append(read_code(r, n))
        end = r.at
    return out


#: Bytes of a stretch, and the most that one pixel's symbols can take; a place beyond any stretch.
STRETCH, MOST_BYTES, FAR = 1 << 11, 20, 1 << 40


@lru_cache(maxsize=1)
def _positions() -> tuple[np.ndarray, np.ndarray]:
    """(bit positions of a stretch, each within its byte)."""
    here = np.arange(8 * (STRETCH + MOST_BYTES + 16), dtype=np.int64)
    return here, here & 7


def _value(symbol: int, bits: int, p: int) -> tuple[int, int]:
    """(length or distance code of a prefix symbol, place behind its extra bits, which come first in ``bits``)."""
    if symbol < 4:
        return symbol + 1, p
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + (bits & ((1 << extra) - 1)) + 1, p + extra


def _stretch(r: BitReader, group: list[PrefixCode], left: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], int]:
    """(symbols of the tokens, their pixels where they are literals, the copies: token, length, distance code; and the pixels still to come) of the next stretch of bits."""
    green, distance = group[0], group[4]
    start = r.at >> 3
    raw = r.data[start : start + STRETCH + MOST_BYTES] + bytes(16)
    words = np.ndarray(len(raw) - 3, "<u4", raw, strides=(1,))  # the four bytes from each one on
    n = 8 * len(words)
    here, within = (x[:n] for x in _positions())
    ahead = words.astype(np.int64).repeat(8) >> within
    known: dict[int, np.ndarray] = {}

    def behind(c: PrefixCode) -> np.ndarray:
        """From each place, the place behind a symbol of the code; equal codes are one object."""
        if id(c) not in known:
            known[id(c)] = here + c.lengths.take(ahead & ((1 << c.bits) - 1))
        return known[id(c)]

    rest = here
    for c in group[1:4]:
        if c.bits:
            rest = behind(c) if rest is here else behind(c).take(rest, mode="clip")
    # a literal goes on behind its other symbols, a cache hit at once, and a copy, which has more to read, leaves the stretch
    mask, ends = (1 << green.bits) - 1, np.concatenate((rest, here, [FAR]))
    skip = green.lengths + np.where(green.symbols < 256, 0, np.where(green.symbols < 280, 2 * n, n))
    follow, peek = memoryview(ends.take(here + skip.take(ahead & mask), mode="clip")), memoryview(ahead)
    places: list[int] = []
    copies: list[tuple[int, int, int]] = []
    add, p, limit = places.append, r.at - 8 * start, min(8 * STRETCH, r.end - 8 * start + 1)
    begun = left
    while left and p < limit:
        done = len(places)
        for _ in repeat(None, left):
            add(p)
            p = follow[p]
            if p >= limit:
                break
        left -= len(places) - done
        if p == FAR:
            p = places[-1]
            k = peek[p] & mask
            p += int(green.lengths[k])
            length, p = _value(int(green.symbols[k]) - 256, peek[p], p)
            k = peek[p] & ((1 << distance.bits) - 1)
            p += int(distance.lengths[k])
            code, p = _value(int(distance.symbols[k]), peek[p], p)
            left += 1 - length
            if left < 0:
                raise CorruptError("a back-reference out of the picture")
            copies.append((len(places) - 1, length, code))
    if r.end < 8 * start + p or (left == begun and left):
        raise CorruptError("the bit stream ends early")
    r.at = 8 * start + p
    spots = np.frombuffer(array("q", places), np.int64)
    at = ahead.take(spots) & mask
    symbols = green.symbols.take(at)
    spots = spots + green.lengths.take(at)
    pixels = (symbols & 255) << 8
    for c, shift in zip(group[1:4], (16, 0, 24), strict=True):
        if c.bits:
            at = ahead.take(spots, mode="clip") & ((1 << c.bits) - 1)
            pixels |= c.symbols.take(at) << shift
            spots += c.lengths.take(at)
        else:
            pixels |= int(c.symbols[0]) << shift
    return symbols, pixels.astype(np.uint32), copies, left


def _follow(r: BitReader, group: list[PrefixCode], cache_bits: int, width: int, total: int) -> np.ndarray | None:
    """The pixels of a picture with one group of codes; None if a slot of the colour cache is used before it is filled."""
    parts, copies, left, n = [], [], total, 0
    while left:
        *part, found, left = _stretch(r, group, left)
        copies += [(n + k, length, code) for k, length, code in found] if n else found
        n += len(part[0])
        parts.append(part)
    symbols, out = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts, strict=True))
    hit = symbols >= 280
    hits = np.count_nonzero(hit)
    if not hits and not copies:
        return out
    slots = np.where(hit, symbols - 280, _cache_slots(out, cache_bits)).astype(np.uint16) if hits else None
    source = np.arange(total)  # where each pixel comes from
    if copies:
        span = np.ones(n, np.int64)
        span[[token for token, _, _ in copies]] = [length for _, length, _ in copies]
        first = memoryview(np.cumsum(span) - span)
        for token, length, code in copies:
            x, y = NEAR[code - 1] if code <= 120 else (code - 120, 0)
            back, begin = max(1, x + y * width), first[token]
            if back > begin:
                raise CorruptError("a back-reference out of the picture")
            source[begin : begin + length] = source[begin - back : begin - back + length] if back >= length else np.resize(source[begin - back : begin], length)
        out = out.repeat(span)
        if hits:  # a copy has the slot of what it copies
            slots, hit = slots.repeat(span).take(source), hit.repeat(span)
    if hits:
        # a hit repeats the last pixel of its slot that is none
        order = np.argsort(slots, kind="stable")
        held = hit.take(order)
        rows = held.nonzero()[0]
        last = np.maximum.accumulate(np.where(held, -1, np.arange(total))).take(rows)
        to, of = order.take(rows), order.take(last, mode="clip")
        if int(last.min()) < 0 or (slots.take(to) != slots.take(of)).any():
            return None
        source[to] = of
        while copies and not np.array_equal(further := source.take(source), source):
            source = further
    return out.take(source)


def _slot(colour: int, bits: int) -> int:
    return (CACHE_FACTOR * colour & 0xFFFFFFFF) >> (32 - bits)


def _cache_slots(pixels: np.ndarray, bits: int) -> np.ndarray:
    return (pixels * np.uint32(CACHE_FACTOR) >> np.uint32(32 - bits)).astype(np.int64)


def read_image(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded picture; ``main``: meta prefix codes may follow the colour cache."""
    cache_bits = r.read(4) if r.read(1) else 0
    cache = [0] * (1 << cache_bits) if cache_bits else []
    block_bits, which = 0, None
    if main and r.read(1):
        block_bits = r.read(3) + 2
        across = -(-width >> block_bits)
        which = ((read_image(r, across, -(-height >> block_bits), False) >> np.uint32(8)) & np.uint32(0xFFFF)).tolist()
    groups = [_read_group(r, len(cache)) for _ in range(max(which) + 1 if which else 1)]
    total = width * height
    if len(groups) == 1:
        begin = r.at
        if (found := _follow(r, groups[0], cache_bits, width, total)) is not None:
            return found
        r.at = begin
    out: list[int] = []

    def emit(pixel: int) -> None:
        out.append(pixel)
        if cache:
            cache[_slot(pixel, cache_bits)] = pixel

    while (at := len(out)) < total:
        group = groups[which[(at // width >> block_bits) * across + (at % width >> block_bits)] if which else 0]
        symbol = group[0].read(r)
        if symbol < 256:
            red, blue, alpha = (c.read(r) for c in group[1:4])
            emit(alpha << 24 | red << 16 | symbol << 8 | blue)
        elif symbol < 280:
            length, code = _long_value(symbol - 256, r), _long_value(group[4].read(r), r)
            x, y = NEAR[code - 1] if code <= 120 else (code - 120, 0)
            back = max(1, x + y * width)
            if back > at or at + length > total:
                raise CorruptError("a back-reference out of the picture")
            for k in range(at - back, at - back + length):
                emit(out[k])
        else:
            if symbol - 280 >= len(cache):
                raise CorruptError("a colour cache index out of range")
            emit(cache[symbol - 280])
    return np.array(out, np.uint32)


def _channels(pixels: np.ndarray) -> np.ndarray:
    return pixels.astype("<u4").view(np.uint8).reshape(*pixels.shape, 4)


def predict(mode: int, left, top, right, corner):
    """The predicted pixel as four int channels, from left, top, top right and top left ones."""
    mean = lambda a, b: (a + b) >> 1
    clip = lambda v: np.clip(v, 0, 255)
    if mode == 11:
        estimate = left + top - corner
        return left if np.abs(estimate - left).sum() < np.abs(estimate - top).sum() else top
    if mode == 13:
        half = mean(left, top)
        d = half - corner
        return clip(half + np.fix(d / 2).astype(np.int64))
    black = np.array([0, 0, 0, 255])
    return (
        lambda: black, lambda: left, lambda: top, lambda: right, lambda: corner,
        lambda: mean(mean(left, right), top), lambda: mean(left, corner), lambda: mean(left, top),
        lambda: mean(corner, top), lambda: mean(top, right), lambda: mean(mean(left, corner), mean(top, right)),
        None, lambda: clip(left + top - corner), None, lambda: black, lambda: black,
    )[mode]()


def _undo_predictor(pixels: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray) -> np.ndarray:
    c = _channels(pixels).astype(np.int64).reshape(height, width, 4)
    across = -(-width >> bits)
    mode = ((modes >> np.uint32(8)) & np.uint32(15)).tolist()
    c[0, 0, 3] += 255
    c[0] = np.cumsum(c[0], axis=0) & 255
    c[:, 0] = np.cumsum(c[:, 0], axis=0) & 255
    flat = c.reshape(-1, 4)
    for y in range(1, height):
        for tile in range(across):
            a, b = max(1, tile << bits), min(width, (tile + 1) << bits)
            m, up = mode[(y >> bits) * across + tile], y * width - width
            if a >= b:
                continue
            if m == LEFT:
                c[y, a - 1 : b] = np.cumsum(c[y, a - 1 : b], axis=0) & 255
            elif m in FROM_ABOVE:
                above = flat[up + a - 1 : up + b + 1]
                c[y, a:b] = (c[y, a:b] + predict(m, None, above[1:-1], above[2:], above[:-2])) & 255
            else:
                for at in range(y * width + a, y * width + b):
                    p = predict(m, flat[at - 1], flat[at - width], flat[at - width + 1], flat[at - width - 1])
                    flat[at] = (flat[at] + p) & 255
    return c.astype(np.uint8).view("<u4").reshape(-1)


def colour_delta(factor: np.ndarray, value: np.ndarray) -> np.ndarray:
    return (factor.astype(np.int8).astype(np.int32) * value.astype(np.int8).astype(np.int32)) >> 5


def _undo_cross_colour(pixels: np.ndarray, width: int, height: int, bits: int, data: np.ndarray) -> np.ndarray:
    across = -(-width >> bits)
    y, x = np.divmod(np.arange(width * height), width)
    factor = _channels(data)[(y >> bits) * across + (x >> bits)]
    c = _channels(pixels).copy()
    red = c[:, 2] + colour_delta(factor[:, 0], c[:, 1])
    blue = c[:, 0] + colour_delta(factor[:, 1], c[:, 1]) + colour_delta(factor[:, 2], (red & 255).astype(np.uint8))
    c[:, 2], c[:, 0] = red & 255, blue & 255
    return c.view("<u4").reshape(-1)


def _undo_palette(pixels: np.ndarray, width: int, height: int, colours: np.ndarray, packed: int) -> np.ndarray:
    index = ((pixels >> np.uint32(8)) & np.uint32(255)).reshape(height, -1)
    if packed:
        bits = 8 >> packed
        index = ((index[:, :, None] >> (np.arange(1 << packed, dtype=np.uint32) * np.uint32(bits))) & np.uint32((1 << bits) - 1)).reshape(height, -1)[:, :width]
    index = index.ravel()
    return np.where(index < len(colours), colours[np.minimum(index, len(colours) - 1)], np.uint32(0))


def decode_vp8l(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, pixels) of a bit stream."""
    r = BitReader(data)
    if r.read(8) != SIGNATURE:
        raise CorruptError("no signature")
    width, height = r.read(SIDE_BITS) + 1, r.read(SIDE_BITS) + 1
    r.read(1)
    if r.read(3):
        raise CorruptError("an unknown version")
    undo, now = [], width
    while r.read(1):
        kind = r.read(2)
        if kind in [u[0] for u in undo]:
            raise CorruptError("a transform that occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            undo.append((kind, now, bits, read_image(r, -(-now >> bits), -(-height >> bits), False)))
        elif kind == PALETTE:
            n = r.read(8) + 1
            colours = np.cumsum(_channels(read_image(r, n, 1, False)), axis=0, dtype=np.uint8).view("<u4").reshape(-1)
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, now, packed, colours))
            now = -(-now >> packed)
        else:
            undo.append((kind, now, 0, None))
    pixels = read_image(r, now, height, True)
    for kind, across, bits, extra in reversed(undo):
        if kind == PREDICTOR:
            pixels = _undo_predictor(pixels, across, height, bits, extra)
        elif kind == CROSS_COLOUR:
            pixels = _undo_cross_colour(pixels, across, height, bits, extra)
        elif kind == PALETTE:
            pixels = _undo_palette(pixels, across, height, extra, bits)
        else:
            c = _channels(pixels).copy()
            c[:, 2] += c[:, 1]
            c[:, 0] += c[:, 1]
            pixels = c.view("<u4").reshape(-1)
    return width, height, pixels


def _chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(name, content) of the chunks of a file."""
    out, at = [], 0
    while at + 8 <= len(data):
        n = struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + n > len(data):
            raise CorruptError("a chunk that ends early")
        out.append((data[at : at + 4], data[at + 8 : at + 8 + n]))
        at += 8 + n + (n & 1)
    return out


def decode(media: bytes) -> list[tuple[int, int, np.ndarray]]:
    """The pictures of one or more concatenated lossless WebP files, plain or extended; of an animation, its frames."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 12] != b"WEBP" or at + 12 > len(media):
            raise CorruptError("no WebP file")
        size = struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            raise CorruptError("a file that ends early")
        parts = _chunks(media[at + 12 : at + 8 + size])
        parts = [inner for name, c in parts for inner in (_chunks(c[16:]) if name == b"ANMF" else [(name, c)])]
        if any(name == b"VP8 " for name, _ in parts):
            raise CorruptError("a lossy picture")
        found = [decode_vp8l(c) for name, c in parts if name == b"VP8L"]
        if not found:
            raise CorruptError("no lossless picture")
        out += found
        at += 8 + size + (size & 1)
    return out


def code_lengths(counts: dict[int, int], most: int = MOST_BITS) -> dict[int, int]:
    """Lengths of an optimal prefix code; counts are flattened until none exceeds ``most``."""
    return dict(zip(counts, _code_sizes(list(counts.values()), most), strict=True))


def _code_sizes(counts: list[int], most: int = MOST_BITS) -> list[int]:
    n, mask = len(counts), (1 << 12) - 1  # a count and a place in one number
    while True:
        leaves = sorted([c << 12 | k for k, c in enumerate(counts)])
        # nodes come about by rising count: the least of all is the next leaf or the next node
        nodes, above = [], [0] * (2 * n - 1)
        leaf = node = 0
        leaves.append(FAR << 12)
        nodes.append(FAR << 12)
        for k in range(n, 2 * n - 1):
            a, b = leaves[leaf], nodes[node]
            if a < b:
                leaf += 1
            else:
                a = b
                node += 1
            c, b = leaves[leaf], nodes[node]
            if c < b:
                leaf += 1
            else:
                c = b
                node += 1
            above[a & mask] = above[c & mask] = k
            nodes[-1] = ((a >> 12) + (c >> 12)) << 12 | k
            nodes.append(FAR << 12)
        depth = [1] * (2 * n - 1)  # of what is below a node
        for k in range(2 * n - 3, n - 1, -1):
            depth[k] = depth[above[k]] + 1
        sizes = [depth[k] for k in above[:n]]
        if max(sizes) <= most:
            return sizes
        counts = [(c + 1) // 2 for c in counts]


TOKENS = canonical(TOKEN_LENGTHS)
TOKEN_HEADER = sum(TOKEN_LENGTHS.get(s, 0) << 3 * k for k, s in enumerate(LENGTH_ORDER))


@lru_cache(maxsize=1024)
def _zeros(gap: int) -> tuple[int, int, int]:
    """(bits as they are written, their number, tokens) of a run of unused symbols."""
    value, n, tokens = 0, 0, 0
    while gap:
        run = min(gap, 138) if gap >= 11 else gap if gap >= 3 else 1
        token, extra, bits = (18, run - 11, 7) if run >= 11 else (17, run - 3, 3) if run >= 3 else (0, 0, 0)
        code, size = TOKENS[token]
        value |= (code | extra << size) << n
        n += size + bits
        tokens += 1
        gap -= run
    return value, n, tokens


@lru_cache(maxsize=4096)
def _after_gap(gap: int, length: int) -> tuple[int, int, int]:
    """The same of a run of unused symbols and the ``length`` of a used one."""
    value, n, tokens = _zeros(gap)
    code, size = TOKENS[length]
    return value | code << n, n + size, tokens + 1


def write_code(w: BitWriter, lengths: dict[int, int], alphabet: int = 0) -> None:
    """The description of a prefix code; ``alphabet`` is needed if more than 257 tokens describe it."""
    used = {s: n for s, n in lengths.items() if n}
    if len(used) <= 1 and max(used or lengths) < 256:
        w.put(0b101, 3)  # simple, one symbol of eight bits
        w.put(next(iter(used or lengths)), 8)
        return
    if len(used) == 1:  # a code needs two symbols, or a simple description
        used = used | {0: 1}
    _describe(w, sorted(used.items()), alphabet)


def _describe(w: BitWriter, used: Iterable[tuple[int, int]], alphabet: int) -> None:
    """The normal description of the code of ``used`` symbols, in their order, with lengths above 0."""
    value, n, tokens, last = 0, 0, 0, -1
    for s, length in used:
        code, size, more = _after_gap(s - last - 1, length)
        value |= code << n
        n += size
        tokens += more
        last = s
    if tokens < 2:
        code, size, more = _zeros(1)
        value, n, tokens = value | code << n, n + size, tokens + more
    if tokens > 257:
        code, size, _ = _zeros(alphabet - last - 1)
        value, n = value | code << n, n + size
        tail, bits = 0, 1
    else:
        tail, bits = 0b0111 | (tokens - 2) << 4, 12  # a number of eight bits follows: 1, then 3 in three bits
    w.put((len(LENGTH_ORDER) - 4) << 1 | TOKEN_HEADER << 5 | (tail | value << bits) << 5 + 3 * len(LENGTH_ORDER), 5 + 3 * len(LENGTH_ORDER) + bits + n)


def pack_bits(head: BitWriter, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """``head`` and then the codes, of 31 bits at most, bit by bit."""
    first, whole = head.value.to_bytes(head.n // 8 + 1, "little"), head.n // 8
    if not len(codes):
        return first
    ends = np.cumsum(lengths, dtype=np.int64) + head.n % 8
    start = ends - lengths
    code, word = codes.astype(np.uint64) << (start & 31).astype(np.uint64), start >> 5
    # codes begin in each word of 32 bits up to the last one; no two share a bit, so that sums are exact
    begins = np.concatenate(([0], (word[1:] > word[:-1]).nonzero()[0] + 1))
    words = np.zeros(len(begins) + 1, np.uint64)
    words[:-1] = np.add.reduceat(code, begins)
    words[1:] += words[:-1] >> np.uint64(32)
    body = words.astype("<u4").view(np.uint8)
    body[0] |= first[whole]
    return first[:whole] + body.tobytes()[: int(ends[-1]) // 8 + 1]


def riff(stream: bytes) -> bytes:
    pad = len(stream) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + pad) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + bytes(pad)


#: The writer's largest colour cache, and pixels that a back-reference covers at least and at most.
CACHE_BITS = 7
SHORTEST, LONGEST = 3, 4096


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra bits, their number) of a length or a distance code."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 2
    return 2 * n + 2 + ((v >> n) & 1), v & ((1 << n) - 1), n


def _before(pixels: np.ndarray) -> np.ndarray:
    """The place at which each pixel was last seen, -1 if it is new."""
    key = pixels.astype(np.uint64) << np.uint64(32) | np.arange(len(pixels), dtype=np.uint64)
    key.sort()
    order, pixel = (key & np.uint64(0xFFFFFFFF)).astype(np.int64), key >> np.uint64(32)
    out = np.full(len(pixels), -1, np.int64)
    out[order[1:]] = np.where(pixel[1:] == pixel[:-1], order[:-1], -1)
    return out


def _copies(pixels: np.ndarray, before: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, how far back) of the back-references, greedily: where pixels were last seen in a row."""
    step = before[1:] - before[:-1] == 1
    starts = np.flatnonzero((before[:-2] >= 0) & step[:-1] & step[1:]).tolist() if len(before) > SHORTEST else ()
    out, at, plain = [], 0, pixels.tolist() if len(starts) else []
    for i in starts:
        if i < at:
            continue
        p, k, most = int(before[i]), SHORTEST, min(LONGEST, len(plain) - i)
        while k < most and plain[p + k] == plain[i + k]:
            k += 1
        out.append((i, k, i - p))
        at = i + k
    return out


def _hits(pixels: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether each pixel is what the colour cache holds in its slot."""
    order = np.argsort(slots.astype(np.uint16), kind="stable")
    held = pixels[order]
    out = np.zeros(len(pixels), bool)
    out[order[1:]] = held[1:] == held[:-1]  # equal pixels have equal slots
    return out


#: A code and its number of bits in one number: the bits are the upper byte.
SIZE_AT = 24


def _written_code(w: BitWriter, seen: np.ndarray, alphabet: int) -> np.ndarray:
    """Write the description of the code for symbols that were ``seen`` so often; the codes, with their sizes, by symbol."""
    found = seen.nonzero()[0]
    if len(found) == 1 and found[0] > 255:
        found = np.array([0, found[0]])
    out = np.zeros(alphabet, np.uint32)
    if len(found) < 2:
        write_code(w, {(found.tolist() or [0])[0]: 0})
        return out
    sizes = _code_sizes(seen[found].tolist())
    _describe(w, zip(found.tolist(), sizes, strict=True), alphabet)
    at, bits, n = canonical_codes(found, np.array(sizes, np.int32))
    out[at] = bits | n << SIZE_AT
    return out


@lru_cache(maxsize=16)
def _near_codes(width: int) -> dict[int, int]:
    """How far back -> distance code, of the near pixels."""
    return {x + y * width: k + 1 for k, (x, y) in reversed(list(enumerate(NEAR))) if x + y * width > 0}


def put_pixels(w: BitWriter, pixels: np.ndarray, width: int, main: bool, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Write the header of an entropy-coded picture; the (codes, lengths) that follow it. ``before``: where each pixel was last seen."""
    n = len(pixels)
    before = _before(pixels) if before is None else before
    again = main and 16 * np.count_nonzero(before >= 0) > n
    copies = _copies(pixels, before) if again else []
    alone = np.ones(n, bool)
    for at, length, _ in copies:
        alone[at : at + length] = False
    bits, token, literal = 0, (pixels >> np.uint32(8) & np.uint32(255)).astype(np.int64), alone
    if again and n > 16:
        bits = min(CACHE_BITS, n.bit_length() - 2)
        slots = _cache_slots(pixels, bits)
        hit = _hits(pixels, slots) & alone
        # a hit saves about seven bits of fourteen, and each symbol of the code costs about six
        if 7 * np.count_nonzero(hit) - 6 * np.count_nonzero(np.bincount(slots[hit])) > 0.7 * n:
            token, literal = np.where(hit, 280 + slots, token), alone & ~hit
        else:
            bits = 0
    if copies:  # each is one token, in place of its first pixel
        near, use = _near_codes(width), alone.copy()
        at = np.array([i for i, _, _ in copies])
        use[at] = True
        kept = use.nonzero()[0]
        pixels, token, literal, at = pixels.take(kept), token.take(kept), literal.take(kept), kept.searchsorted(at)
        lengths, backs = (np.array([_prefix(v) for v in values]).T for values in ([k for _, k, _ in copies], [near.get(back, back + 120) for _, _, back in copies]))
        token[at] = 256 + lengths[0]
    w.put(bits << 1 | 1 if bits else 0, 5 if bits else 1)
    if main:
        w.put(0, 1)  # one group of codes
    own = pixels[literal]
    opaque = not len(own) or int(own.min()) >= BLACK
    columns = np.zeros((3 if opaque else 4, len(pixels)), np.uint32)
    columns[0] = _written_code(w, np.bincount(token), 280 + (1 << bits if bits else 0)).take(token)
    one, red, blue = BitWriter(), pixels >> np.uint32(16) & np.uint32(255), pixels & np.uint32(255)
    own_red, own_blue = (red, blue) if len(own) == len(pixels) else (red[literal], blue[literal])
    shared = _written_code(one, np.bincount(np.concatenate((own_red, own_blue)), minlength=256), 256)  # for red and blue
    w.put(one.value | one.value << one.n, 2 * one.n)
    shown = literal.astype(np.uint32)
    columns[1], columns[2] = shared.take(red) * shown, shared.take(blue) * shown
    if opaque:
        write_code(w, {255: 0})
    else:
        alpha = pixels >> np.uint32(24)
        columns[3] = _written_code(w, np.bincount(alpha[literal]), 256).take(alpha) * shown
    if copies:
        far_code = _written_code(w, np.bincount(backs[0]), 40)
        columns[0, at], columns[1, at], columns[2, at] = _joined(columns[0, at], *lengths[1:]), far_code.take(backs[0]), _joined(np.zeros(len(at), np.uint32), *backs[1:])
    else:
        write_code(w, {0: 0})
    flat = columns.T.ravel()
    flat = flat[flat > 0]
    return flat & np.uint32((1 << SIZE_AT) - 1), flat >> np.uint32(SIZE_AT)


def _joined(codes: np.ndarray, extra: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The codes, each with extra ``bits`` behind it."""
    sizes = codes >> np.uint32(SIZE_AT)
    return codes + (extra.astype(np.uint32) << sizes) + (bits.astype(np.uint32) << np.uint32(SIZE_AT))


def _bits_of(channels: np.ndarray) -> float:
    """Bits of the channels of pixels, each by its own entropy."""
    total = 0.0
    for k in range(channels.shape[-1]):
        n = np.bincount(channels[..., k].ravel(), minlength=256)
        n = n[n > 0]
        total += float((n * np.log2(n.sum() / n)).sum())
    return total


#: Of the writer: predictors that it tries, and side of a tile as a power of two.
TRIED, TILE = (1, 2, 7, 11, 12), 4


def _residues(pixels: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """(residues, modes of the tiles): in each tile the predictor with the smallest residues."""
    c = _channels(pixels).astype(np.int64).reshape(height, width, 4)
    left, top, corner = c[1:, :-1], c[:-1, 1:], c[:-1, :-1]
    if height < 2 or width < 2:
        guess = np.zeros((len(TRIED), 0, 0, 4), np.int64)
    else:
        e = left + top - corner
        select = np.where((np.abs(e - left).sum(-1) < np.abs(e - top).sum(-1))[..., None], left, top)
        guess = np.stack([left, top, (left + top) >> 1, select, np.clip(e, 0, 255)])
    down, across = -(-height >> TILE), -(-width >> TILE)
    modes = np.zeros((down, across), np.int64)
    out = c.copy()
    out[0, 1:] -= c[0, :-1]
    out[0, 0, 3] -= 255
    out[1:, 0] -= c[:-1, 0]
    if guess.size:
        rest = (c[1:, 1:] - guess + 128 & 255) - 128
        for i in range(down):
            for j in range(across):
                rows, columns = slice(max(1, i << TILE) - 1, ((i + 1) << TILE) - 1), slice(max(1, j << TILE) - 1, ((j + 1) << TILE) - 1)
                part = rest[:, rows, columns]
                if part.size:
                    modes[i, j] = best = int(np.abs(part).sum(axis=(1, 2, 3)).argmin())
                    out[1:, 1:][rows, columns] = part[best]
    return (out & 255).astype(np.uint8).view("<u4").reshape(-1), np.array(TRIED)[modes].ravel()


def _factor(value: np.ndarray, by: np.ndarray) -> int:
    """The cross-colour factor, of three and five bits, which leaves least of ``value``."""
    v, b = value.astype(np.int8).astype(np.float64), by.astype(np.int8).astype(np.float64)
    return int(np.clip(round(32 * float((v * b).sum()) / max(1.0, float((b * b).sum()))), -128, 127)) & 255


def encode(pixels: np.ndarray, width: int) -> bytes:
    """A WebP file of ARGB ``pixels``, rows of ``width``; the transforms are those that make its channels' entropy least."""
    pixels = np.ascontiguousarray(pixels, np.uint32)
    height, c = len(pixels) // width, _channels(pixels)
    w = BitWriter()
    w.put(SIGNATURE, 8)
    w.put(width - 1, SIDE_BITS)
    w.put(height - 1, SIDE_BITS)
    w.put(int(int(pixels.min()) < BLACK), 1)
    w.put(0, 3)  # version
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def image(x: np.ndarray, across: int, main: bool, seen: np.ndarray | None = None) -> None:
        one = BitWriter()
        body = put_pixels(one, x, across, main, seen)
        bits = np.frombuffer(pack_bits(one, *body), np.uint8)
        n = one.n + int(body[1].sum())
        parts.append((bits, np.array([n])))

    def tail() -> None:
        """What is written so far, and then a new stretch of bits."""
        parts.append((np.frombuffer(w.value.to_bytes(w.n // 8 + 1, "little"), np.uint8), np.array([w.n])))
        w.value = w.n = 0

    before = _before(pixels)
    distinct = np.count_nonzero(before < 0)
    green = c[:, 1].astype(np.int16)
    steps = np.abs(green[1:] - green[:-1])
    smooth = len(steps) > 0 and int(np.minimum(steps, 256 - steps).sum()) < 12 * len(steps)  # text is not; then no predictor is tried
    few = distinct <= 256 and 2 * distinct <= len(pixels)
    plain = _bits_of(c) if few or smooth else 0.0
    listed = math.inf
    if few:
        colours, index = np.unique(pixels, return_inverse=True)
        shares = np.bincount(index)
        listed = 24 * len(colours) + float((shares * np.log2(len(pixels) / shares)).sum())
    across, now = width, pixels
    if listed < plain:
        packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(colours) - 1, 8)
        tail()
        table = _channels(colours).astype(np.int16)
        image(np.diff(table, axis=0, prepend=np.zeros((1, 4), np.int16)).astype(np.uint8).view("<u4").reshape(-1), len(colours), False)
        across = -(-width >> packed)
        grid = np.zeros((height, across << packed), np.uint32)
        grid[:, :width] = index.reshape(height, width)
        shifts = np.arange(1 << packed, dtype=np.uint32) * np.uint32(8 >> packed)
        now = (np.uint32(BLACK) | (grid.reshape(height, across, -1) << shifts).sum(axis=2, dtype=np.uint32) << np.uint32(8)).ravel()
    elif smooth:
        rest, modes = _residues(pixels, width, height)
        r = _channels(rest)
        factors = _factor(r[:, 2], r[:, 1]), _factor(r[:, 0], r[:, 1])
        apart = r.copy()
        apart[:, 2] = (r[:, 2] - colour_delta(np.uint8(factors[0]), r[:, 1])) & 255
        apart[:, 0] = (r[:, 0] - colour_delta(np.uint8(factors[1]), r[:, 1])) & 255
        cost, apart_cost = _bits_of(r), _bits_of(apart)
        if min(cost, apart_cost) < plain:
            tiles = -(-width >> TILE), -(-height >> TILE)
            w.put(1, 1)
            w.put(PREDICTOR, 2)
            w.put(TILE - 2, 3)
            tail()
            image(np.uint32(BLACK) | modes.astype(np.uint32) << np.uint32(8), tiles[0], False)
            now = rest
            if apart_cost < cost:
                w.put(1, 1)
                w.put(CROSS_COLOUR, 2)
                w.put(TILE - 2, 3)
                tail()
                image(np.full(tiles[0] * tiles[1], BLACK | factors[1] << 8 | factors[0], np.uint32), tiles[0], False)
                now = apart.view("<u4").reshape(-1)
    w.put(0, 1)
    if not parts:
        return riff(pack_bits(w, *put_pixels(w, now, across, True, before)))
    tail()
    image(now, across, True)
    bits = np.concatenate([np.unpackbits(x, bitorder="little")[: int(n[0])] for x, n in parts])
    return riff(np.packbits(bits, bitorder="little").tobytes())


def encode_rgb(samples: bytes, width: int) -> bytes:
    """A WebP file of 8-bit samples: red, green, blue of each pixel."""
    rgb = np.frombuffer(samples, np.uint8).reshape(-1, 3)
    bgra = np.full((len(rgb), 4), 255, np.uint8)
    bgra[:, 2::-1] = rgb
    return encode(bgra.view("<u4").ravel(), width)
