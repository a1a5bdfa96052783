"""Benchmark decontamination: near copies of benchmark items within documents.

Texts are folded first (letters and digits in lower case, one gap for anything
else, with a map back to the offsets). An item is laid out in pieces of ``PIECE``
symbols (fewer for the shortest items). An edit spoils one piece at most, so a copy
within ``EDITS`` keeps all pieces but as many as it has edits, and these lie at offsets
that differ by no more than the edits: where a document has fewer there is no copy.
Around the places that are left, windows of the item's size begin at every half of
the allowed shift.

CGK's random walk embeds windows and items: at each step it writes the symbol under
its pointer and moves on or not, by a random bit for the step and the symbol. It takes
two steps a symbol on average; positions are sampled over these 2 n steps, and what
follows up to CGK's 3 n, mostly padding, is not walked. Strings at a small edit distance
get strings at a small Hamming distance, which sampled positions can find: each of
several tables hashes ``SAMPLED`` positions, and a window that meets an item in any
table is a candidate. The number of tables follows from the target recall at the
largest edit share. Candidates are verified by their exact edit distance, with free ends.

The places that are left by the pieces are a bound, not a sample: hashing each window
of each document for each item length would find no other copy, at some hundred
thousand steps of a walk for each symbol of text.

The benchmark is read in blocks of at most ``BLOCK_CHARS`` characters. Each is built,
broadcast, compared with all documents and dropped before the next one, so that
neither the driver nor a worker holds more than one.

Defined cases: null or empty texts match nothing; a text of any length is read whole;
an item shorter than ``SEED``, when folded, matches where its words occur exactly; an
item without letters or digits, or with a null id, matches nothing; of an item's
matches in a text the one with the fewest edits is given, and of these the first;
repeated documents and items each give their rows; a null doc_id is passed on; an
empty table gives an empty result; extra columns are not read by ``digest``, and
``mark`` replaces one that has its result's name.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm._base import materialize, release, shared_dir

SEED, EDITS, RECALL = 12, 0.1, 0.99
PIECE = 7
SAMPLED = 4
#: Share of embedded positions that still agree at the largest edit share.
AGREE = 0.4
BLOCK_CHARS = 8 << 20
BITS = 22
P = np.uint64(0x9E3779B97F4A7C15)
GAP = 32


@lru_cache(maxsize=1)
def _kept() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def fold(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets in the text) of the folded text, without gaps at its ends."""
    text = text or ""
    low = text.lower()
    if len(low) != len(text):  # a few capitals become two characters
        low = "".join(c.lower()[0] for c in text)
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = _kept()[points]
    points = np.where(kept, points, np.uint32(GAP))
    use = kept | np.append(False, kept[:-1])
    at = np.flatnonzero(use)
    if len(at) and not kept[at[-1]]:
        at = at[:-1]
    return points[at], at


def seeds(symbols: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` symbols from each place on."""
    n = len(symbols) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    a = symbols.astype(np.uint64) + np.uint64(1)
    out = a[:n]
    for k in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * P + a[k : k + n]
    return out ^ (out >> np.uint64(32))


def piece(n: int) -> tuple[int, int]:
    """(size of the pieces of an item of ``n`` symbols, how many of them any copy within ``EDITS`` keeps)."""
    most = int(EDITS * n)
    size = min(PIECE, n // (most + 1))
    return size, n // size - most


def tables() -> int:
    """Tables, of ``SAMPLED`` positions each, that reach the target recall."""
    return math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**SAMPLED))


@lru_cache(maxsize=8)
def _coins(block: int) -> np.ndarray:
    """The random bits of 128 steps, [steps, tables, symbols]; each table has a walk of its own."""
    return np.random.default_rng(1000 + block).integers(0, 2, (128, tables(), 256), np.uint8)


def embed(rows: np.ndarray, steps: int) -> np.ndarray:
    """CGK embeddings of the strings in ``rows``, each with zeros at its end; [steps, strings, tables]."""
    shape = len(rows), tables()
    out, at, walk = np.zeros((steps, *shape), np.uint8), np.zeros(shape, np.int64), np.arange(shape[1])[None, :]
    first, last, flat = (np.arange(len(rows)) * rows.shape[1])[:, None], rows.shape[1] - 1, rows.ravel()
    for k in range(steps):
        out[k] = flat[first + np.minimum(at, last)]
        at += _coins(k // 128)[k % 128].ravel()[walk * 256 + out[k]]
    return out


def table_hashes(symbols: list[np.ndarray]) -> np.ndarray:
    """The bit-sampling hashes of strings, [strings, tables]; only strings of one length meet."""
    out = np.empty((len(symbols), tables()), np.uint64)
    lengths = np.fromiter(map(len, symbols), np.int64, len(symbols))
    share = np.random.default_rng(0).random((SAMPLED, tables()))
    order, at = np.argsort(lengths, kind="stable")[::-1], 0
    while at < len(order):
        size = int(lengths[order[at]])
        part = order[at : at + max(1, (32 << 20) // (2 * size * tables()))]
        at += len(part)
        rows = np.zeros((len(part), size + 1), np.uint8)
        for k, x in enumerate(part):
            rows[k, : lengths[x]] = (symbols[x] * np.uint32(2654435761) >> np.uint32(24)).astype(np.uint8) | np.uint8(1)
        bits = embed(rows, 2 * size)
        every, t = np.arange(len(part))[:, None], np.arange(tables())[None, :]
        h = (t + 1).astype(np.uint64) * P + lengths[part][:, None].astype(np.uint64)
        for u in share:
            h = (h ^ (h >> np.uint64(29))) * P + bits[(u[None, :] * 2 * lengths[part][:, None]).astype(np.int64), every, t]
        out[part] = h
    return out


def bag(symbols: np.ndarray) -> np.ndarray:
    """How often each symbol occurs, by its lowest eight bits."""
    return np.bincount((symbols & np.uint32(255)).astype(np.int64), minlength=256)


def edit_window(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the substring of ``text`` nearest to ``item``, if within ``most`` edits."""
    n = len(text)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    ramp = np.arange(n + 1)
    for k, c in enumerate(item):
        swap = cost[:-1] + (text != c)
        drop = cost[1:] + 1
        best = np.concatenate([[k + 1], np.minimum(swap, drop)])
        come = np.concatenate([[0], np.where(swap <= drop, start[:-1], start[1:])])
        # insertions of the text's symbols: a running minimum of cost - place
        low = np.minimum.accumulate(best - ramp)
        first = np.maximum.accumulate(np.where(best - ramp == low, ramp, 0))
        cost, start = low + ramp, come[first]
        if cost.min() > most:
            return None
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


class Items:
    """A block of the benchmark, prepared for comparison."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.symbols, self.short = [], [], []
        for item_id, text in rows:
            symbols = fold(text)[0]
            if len(symbols) >= SEED:
                self.ids.append(item_id)
                self.symbols.append(symbols)
            elif len(symbols):
                self.short.append((item_id, symbols))
        self.most = np.array([int(EDITS * len(s)) for s in self.symbols], np.int64)
        self.need = np.array([piece(len(s))[1] for s in self.symbols], np.int64)
        #: size of pieces -> (their hashes in order, item, place, a filter by the lowest bits)
        self.pieces: dict[int, tuple[np.ndarray, ...]] = {}
        sizes = [piece(len(s))[0] for s in self.symbols]
        for size in sorted(set(sizes)):
            at = [(seeds(s, size)[::size], np.full(len(s) // size, k), np.arange(len(s) // size) * size) for k, s in enumerate(self.symbols) if sizes[k] == size]
            hashes, which, place = (np.concatenate([a[j] for a in at]) for j in range(3))
            order = np.argsort(hashes, kind="stable")
            known = np.zeros(1 << BITS, bool)
            known[(hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True
            self.pieces[size] = hashes[order], which[order], place[order], known
        self.signs = table_hashes(self.symbols)
        self.bags = [bag(s) for s in self.symbols]
        self.buckets: dict[int, list[int]] = defaultdict(list)
        for k, sign in enumerate(self.signs):
            for h in sign.tolist():
                self.buckets[h].append(k)

    def places(self, symbols: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first, last) of the offsets around which the text keeps enough of the item's pieces."""
        keys = []
        for size, (hashes, which, place, known) in self.pieces.items():
            h = seeds(symbols, size)
            at = np.flatnonzero(known[(h & np.uint64((1 << BITS) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            n = hi - lo
            entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            keys.append(which[entry] * (1 << 40) + np.repeat(at, n) - place[entry] + (1 << 32))
        key = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        item = key >> 40
        # from each offset on, the pieces within the allowed shift
        end = np.searchsorted(key, key + self.most[item], "right")
        good = np.flatnonzero(end - np.arange(len(key)) >= self.need[item])
        out = []
        for k, first, last in zip(item[good].tolist(), key[good].tolist(), key[end[good] - 1].tolist(), strict=True):
            first, last = first - (k << 40) - (1 << 32), last - (k << 40) - (1 << 32)
            if out and out[-1][0] == k and first <= out[-1][2]:
                out[-1] = k, out[-1][1], max(last, out[-1][2])
            else:
                out.append((k, first, last))
        return out

    def find_all(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text the (item id, start, end, edits) of the items that it holds, with its own offsets."""
        folded, looks, out = {}, [], [{} for _ in texts]
        for x, text in enumerate(texts):
            symbols, offsets = fold(text)
            found = self.places(symbols)
            if found or self.short:
                folded[x] = symbols, offsets.astype(np.int32)
            for k, first, last in found:
                size, most = len(self.symbols[k]), int(self.most[k])
                near = max(0, first - most), last + size + most
                if np.maximum(self.bags[k] - bag(symbols[slice(*near)]), 0).sum() > most:  # so many symbols of the item are missing
                    continue
                p = symbols[slice(*near)].tobytes().find(self.symbols[k].tobytes())
                while p >= 0 and p % 4:
                    p = symbols[slice(*near)].tobytes().find(self.symbols[k].tobytes(), p + 1)
                if p >= 0:  # an equal window meets its item in every table
                    s = near[0] + p // 4
                    self._keep(out[x], self.ids[k], int(offsets[s]), int(offsets[s + size - 1]) + 1, 0)
                    continue
                step = max(1, most // 2)
                for s in sorted({max(0, s) for s in range(first - most // step * step, last + most + 1, step)}):
                    window = symbols[s : s + size]
                    if len(window) >= size - most - step:
                        looks.append((x, k, near, s, np.append(window, np.full(size - len(window), GAP, np.uint32)).astype(np.uint32)))
        signs = table_hashes([w for *_, w in looks]).tolist() if looks else []
        verify = set()
        for (x, k, near, s, _), sign in zip(looks, signs, strict=True):
            for j in {c for h in sign for c in self.buckets.get(h, ())}:
                most = int(self.most[j])
                verify.add((x, j, *(near if j == k else (max(0, s - most), s + len(self.symbols[j]) + most))))
        for x, j, a, b in sorted(verify):
            (symbols, offsets), most = folded[x], int(self.most[j])
            if np.maximum(self.bags[j] - bag(symbols[a:b]), 0).sum() > most:
                continue
            got = edit_window(self.symbols[j], symbols[a:b], most)
            if got:
                self._keep(out[x], self.ids[j], int(offsets[a + got[1]]), int(offsets[a + got[2] - 1]) + 1, got[0])
        for x, (symbols, offsets) in folded.items() if self.short else ():
            found, padded = out[x], np.concatenate([[GAP], symbols, [GAP]]).astype(np.uint32).tobytes()
            for item_id, item in self.short:
                want = np.concatenate([[GAP], item, [GAP]]).astype(np.uint32).tobytes()
                p = padded.find(want)
                while p >= 0 and p % 4:
                    p = padded.find(want, p + 1)
                if p >= 0:
                    self._keep(found, item_id, int(offsets[p // 4]), int(offsets[p // 4 + len(item) - 1]) + 1, 0)
        return [[(k, *v) for k, v in sorted(found.items(), key=lambda f: (f[1][0], f[0]))] for found in out]

    @staticmethod
    def _keep(found: dict, item_id: int, start: int, end: int, edits: int) -> None:
        if item_id not in found or (edits, start) < (found[item_id][2], found[item_id][0]):
            found[item_id] = (start, end, edits)


def blocks(benchmark: DataFrame, item: str = "item_id") -> Iterator[Items]:
    """The benchmark (item_id, text) in blocks of bounded size."""
    rows, size = [], 0
    for r in benchmark.select(item, "text").filter(f"text is not null and {item} is not null").toLocalIterator():
        if rows and size + len(r["text"]) > BLOCK_CHARS:
            yield Items(rows)
            rows, size = [], 0
        rows.append((r[item], r["text"]))
        size += len(r["text"])
    if rows:
        yield Items(rows)


SPAN = "array<struct<item_id:long,start:int,end:int,edits:int>>"


def _marker(shared):
    """A function of a text column: the items of a broadcast block that each text holds."""

    @F.pandas_udf(SPAN)
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = (r for at in range(0, len(batch), 4000) for r in shared.value.find_all(batch.iloc[at : at + 4000].tolist()))
            yield pd.Series([[dict(zip(("item_id", "start", "end", "edits"), r, strict=True)) for r in found] for found in rows], dtype=object)
        release()

    return leaks


class _Shared:
    """The blocks of the benchmark, broadcast one at a time."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame):
        self.context, self.blocks, self.held = docs.sparkSession.sparkContext, blocks(benchmark), None
        self.next = next(self.blocks, None)

    def take(self):
        """(function of a text column, whether it is the last one) for the next block; what used the one before must be done."""
        if self.held is not None:
            self.held.destroy()
        self.held = self.context.broadcast(self.next)
        self.next = None
        self.next = next(self.blocks, None)
        return _marker(self.held), self.next is None


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "leaks") -> DataFrame:
    """``docs`` with the array ``into`` of (item_id, start, end, edits): every item that the text holds.

    With more than one block the rows are written after each but the last.
    """
    shared, folder, k = _Shared(docs, benchmark), shared_dir(docs.sparkSession), 0
    out, last = docs.withColumn(into, F.array().cast(SPAN)), shared.next is None
    while not last:
        leaks, last = shared.take()
        out = out.withColumn(into, F.concat(into, leaks(F.col(text))))
        if not last:
            out, k = materialize(out, f"marked-{k}", folder), k + 1
    return out


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each contaminated document and item; with more than one block, each reads the texts and writes its rows."""
    docs, shared, folder = docs.select("doc_id", "text"), _Shared(docs, benchmark), shared_dir(docs.sparkSession)
    parts, last = [], shared.next is None
    while not last:
        leaks, last = shared.take()
        found = docs.select("doc_id", F.explode(leaks("text")).alias("l")).select("doc_id", "l.item_id", "l.start", "l.end", "l.edits")
        parts.append(found if last else materialize(found, f"found-{len(parts)}", folder))
    if not parts:
        return docs.limit(0).select("doc_id", *(F.lit(None).cast(t).alias(n) for n, t in (("item_id", "long"), ("start", "int"), ("end", "int"), ("edits", "int"))))
    return reduce(DataFrame.unionByName, parts)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark; the columns stay. With more than one block the rows that are left are written after each but the last."""
    names, shared, folder, k = docs.columns, _Shared(docs, benchmark), shared_dir(docs.sparkSession), 0
    out, last = docs.select("text", F.struct(*names).alias("_row")), shared.next is None
    while not last:
        leaks, last = shared.take()
        out = out.withColumn("_leaks", leaks("text")).filter(F.size("_leaks") == 0).drop("_leaks")
        if not last:
            out, k = materialize(out, f"clean-{k}", folder), k + 1
    return out.select("_row.*")
