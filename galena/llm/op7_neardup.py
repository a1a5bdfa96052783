"""Near-duplicate detection with MinHash bands, odd sketches and exact confirmation.

1. One pass over the texts gives each document its number of distinct word
   shingles, a 128-bit key of the set, the band hashes of its MinHash samples and
   an odd sketch: the samples folded into a parity bitmap.
2. Documents with equal sets share a key; a key's smallest id stands for them.
3. In each bucket of a band the member with the most populous buckets is the hub,
   and every other member is paired with it only. The XOR of two sketches has a
   population count which estimates their similarity; pairs far below the
   threshold go. The rest are confirmed on full sets, and confirmed links are
   joined to components by alternating stars.
4. Buckets whose members are still in several components are searched in blocks:
   a pair across components is looked at in the first band that it shares. The
   members of a bucket's largest component meet only those of the others, so a
   bucket of one large group and some strays costs little more than its rows. A
   first pass over the sketches tells which members have such a pair that is similar
   enough, a second brings their full sets to the blocks; only confirmed links
   leave a block. No bucket is expanded into rows for all its pairs: with m members
   outside its largest component, of n, it gives n + m * n / ``BLOCK`` narrow rows.

What can be missed, of pairs at the threshold itself: with 32 bands of 4 rows two
sets of similarity 0.8 share no bucket with a probability of 5e-8, and the sketches
of two such sets differ in more bits than are allowed (``MARGIN``) with one below
1e-6. Both fall fast as the similarity rises. Shingles are 64-bit hashes; that two of
a pair of sets with n shingles collide has a probability of n * n / 2**64. Nothing
is collected but the bitmap of the ids whose sets are needed, of ``FILTER_BYTES``.

Defined cases: a text without words (or null) has no shingle and no link; a text of
any length is read whole; a row with a null id is never linked (null component,
kept); rows that repeat an id are told apart by their texts in ``keep_one``, and
share a component in ``near_duplicates`` if their texts do; of equal sets the
smallest id stands for all; an empty table gives an empty result; other columns are
not read, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.llm._base import materialize, release, shared_dir

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Standard deviations by which an estimate may fall short of the threshold.
MARGIN = 5.0
#: Members, and shingles, of a block.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
FILTER_BYTES = 8 << 20
M = np.uint64(0x9E3779B97F4A7C15)
SIGNATURE = "n long, key binary, sketch array<long>, bands array<long>"


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


FACTORS, MASKS = _odd(7, SAMPLES), _odd(8, SAMPLES)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= 100_000:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, parts), np.uint64, len(parts))
    k = min(words, len(parts))
    out = np.full(len(parts) - k + 1, np.uint64(k))
    for j in range(k):
        out = out * M + h[j : len(h) - k + 1 + j]
    return np.unique(_mix(out))


def samples(x: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set of hashes."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(x), 2048):
        np.minimum(least, ((x[k : k + 2048, None] ^ MASKS) * FACTORS).min(axis=0), out=least)
    return least


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parities of the samples, each with its place, folded to ``SKETCH_BITS`` bits."""
    at = (_mix(least + M * np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=SKETCH_BITS).astype(np.uint8) & 1).view(np.int64)


def band_hashes(least: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        h = h * M + least[j::ROWS]
    return _mix(h).view(np.int64)


def odd_count(threshold: float) -> int:
    """The largest population count that still allows ``threshold``, with the margin for the samples' error."""
    low = max(0.0, threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / SAMPLES))
    return int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - low) / SKETCH_BITS)))) + 8


def sign(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, key, sketch, bands) of every row."""

    @F.pandas_udf(SIGNATURE)
    def signature(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                x = shingles(text, words)
                if len(x):
                    least = samples(x)
                    rows.append((len(x), xxhash.xxh3_128_digest(x.tobytes()), odd_sketch(least), band_hashes(least)))
                else:
                    rows.append((0, b"", np.empty(0, np.int64), np.empty(0, np.int64)))
            yield pd.DataFrame(rows, columns=["n", "key", "sketch", "bands"])
        _words.clear()
        release()

    return docs.select("doc_id", signature("text").alias("s")).select("doc_id", "s.*")


def _stars(edges: DataFrame) -> DataFrame:
    """One alternation of the large and the small star."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(u, v) for every node u that isn't the smallest of its component, v.

    The stars alternate until every u has one v, which is no u itself.
    """
    edges, k = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v"), 0
    while True:
        edges = materialize(_stars(edges), f"stars-{k}", folder)
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("v").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
        if ends.groupBy("e.id").agg(F.sum("e.o").alias("o"), F.sum("e.i").alias("i")).filter("o > 1 or (o > 0 and i > 0)").isEmpty():
            return edges
        k += 1


def _shared(a: str, b: str, percent: int) -> Column:
    """Whether two sets have the similarity, in whole numbers."""
    both = F.size(F.array_intersect(a, b))
    return F.lit(100) * both >= F.lit(percent) * (F.size(a) + F.size(b) - both)


def _near(a: str, b: str, most: int) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x) <= most


def full_sets(docs: DataFrame, ids: DataFrame, n: int, words: int) -> DataFrame:
    """(id, x): the full sets of the documents whose ids occur in ``ids`` (id), of ``n`` rows, and of a few more.

    A bitmap of bounded size tells them apart, so that no text is shuffled.
    """
    spark = docs.sparkSession
    bits = min(8 * FILTER_BYTES, 1 << max(16, (16 * n).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words64 = ids.select(slot("id").alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b"))
    bitmap = np.zeros(bits // 64, np.int64)
    for r in words64.toLocalIterator():
        bitmap[r["w"]] = r["b"]
    shared = spark.sparkContext.broadcast(bitmap)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value.view(np.uint64)
        for batch in batches:
            h = batch["h"].to_numpy()
            batch = batch[(held[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1]
            for k in range(0, len(batch), 1000):
                part = batch.iloc[k : k + 1000]
                yield pd.DataFrame({"id": part["doc_id"], "x": [shingles(t, words).view(np.int64) for t in part["text"]]})
        _words.clear()
        release()

    return docs.filter("doc_id is not null").select("doc_id", "text", slot("doc_id").alias("h")).mapInPandas(build, "id long, x array<long>")


def confirm(docs: DataFrame, pairs: DataFrame, words: int, percent: int, folder: str) -> DataFrame:
    """The pairs (u, v) of ids whose full sets have the similarity."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id"))
    sets = materialize(full_sets(docs, ids, 2 * pairs.count(), words), "sets", folder)
    first, second = sets.select(F.col("id").alias("u"), F.col("x").alias("a")), sets.select(F.col("id").alias("v"), F.col("x").alias("b"))
    return pairs.select("u", "v").join(first, "u").join(second, "v").filter(_shared("a", "b", percent)).select("u", "v").distinct()


CELL = ["bucket", "i", "j"]


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition(*CELL).sortWithinPartitions(*CELL)


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each cell together, from batches in the order of the cells."""
    held = None
    for batch in batches:
        batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
        cell = batch[CELL]
        edge = np.flatnonzero((cell != cell.shift()).any(axis=1).to_numpy())
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            yield batch.iloc[a:b]
        held = batch.iloc[edge[-1] :] if len(edge) else None
    if held is not None and len(held):
        yield held


def _partners(cell: pd.DataFrame, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of a cell's pairs across components with near sketches that share no earlier band."""
    rep, comp, own = (cell[c].to_numpy() for c in ("rep", "comp", "own"))
    if (comp == comp[0]).all():
        return
    sketch, bands = (np.stack(cell[c].to_numpy()) for c in ("sketch", "earlier"))
    sketch, band = sketch.view(np.uint64), bands.shape[1]
    two = cell["i"].iloc[0] != cell["j"].iloc[0]
    for k in range(len(cell)):
        ok = (comp != comp[k]) & (rep > rep[k])
        if two:
            ok &= own != own[k]
        at = np.flatnonzero(ok)
        if len(at):
            at = at[np.bitwise_count(sketch[at] ^ sketch[k]).sum(axis=1) <= most]
        if len(at) and band:
            at = at[~(bands[at] == bands[k]).any(axis=1)]
        if len(at):
            yield k, at


def _dealt(members: DataFrame) -> DataFrame:
    """``members`` (bucket, rep, comp, n, sketch, bands), once for each cell (bucket, i, j) of two blocks in which a row has to be.

    Blocks of a bucket's largest component come last, and meet those of the others only.
    """
    parts = members.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    total = parts.groupBy("bucket").agg(F.max(F.struct("c", "comp", "s")).alias("l"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    blocks = lambda c, s: F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    few, many = blocks(F.col("c") - F.col("l.c"), F.col("s") - F.col("l.s")), blocks(F.col("l.c"), F.col("l.s"))
    counts = total.select("bucket", F.col("l.comp").alias("large"), few.alias("few"), many.alias("many"))
    inside = F.col("comp") == F.col("large")
    own = F.when(inside, F.col("few") + F.pmod(F.xxhash64("rep"), F.col("many"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("few"))).cast("int")
    others = F.sequence(F.lit(0), F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    earlier = F.slice("bands", 1, F.array_position("bands", F.col("bucket")).cast("int") - 1)
    rows = members.join(counts, "bucket").withColumns({"own": own, "earlier": earlier, "other": F.explode(others)})
    return rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "comp", "sketch", "earlier")


def across(docs: DataFrame, members: DataFrame, most: int, words: int, percent: int, folder: str) -> DataFrame:
    """The links (u, v) between ``members`` (bucket, rep, comp, n, sketch, bands) of a bucket in different components."""
    cells = _dealt(members)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in _cells(batches):
            use = np.zeros(len(cell), bool)
            for k, at in _partners(cell, most):
                use[k] = use[at] = True
            if use.any():
                yield cell[use]

    found = materialize(_by_cell(cells).mapInPandas(look, cells.schema), "found", folder)
    ids = found.select(F.col("rep").alias("id")).distinct()
    sets = materialize(full_sets(docs, ids, ids.count(), words), "sets", folder)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in _cells(batches):
            rep, comp, sets = (cell[c].to_numpy() for c in ("rep", "comp", "x"))
            top = {c: c for c in set(comp.tolist())}

            def root(c: int, top=top) -> int:
                while top[c] != c:
                    c = top[c]
                return c

            rows = []
            for k, at in _partners(cell, most):
                for m in at.tolist():
                    a, b = root(comp[k]), root(comp[m])
                    if a == b:  # already linked within this cell
                        continue
                    x, y = sets[k], sets[m]
                    if len(x) > len(y):
                        x, y = y, x
                    if 100 * len(x) < percent * len(y):
                        continue
                    place = np.searchsorted(y, x)
                    both = int(np.count_nonzero(y[np.minimum(place, len(y) - 1)] == x))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        top[max(a, b)] = min(a, b)
                        rows.append((rep[k], rep[m]))
            if rows:
                yield pd.DataFrame(rows, columns=["u", "v"])

    full = found.join(sets.select(F.col("id").alias("rep"), F.array_sort("x").alias("x")), "rep").select(*found.columns, "x")
    return _by_cell(full).mapInPandas(link, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text); links have ``percent`` similarity or more."""
    folder = shared_dir(docs.sparkSession)
    most = odd_count(percent / 100)
    docs = docs.select("doc_id", "text")
    signed = materialize(sign(docs, words), "signed", folder)
    keys = materialize(signed.filter("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep")), "keys", folder)
    one = signed.select("doc_id", "key", "n", "sketch", "bands").join(keys, "key").filter("doc_id = rep").dropDuplicates(["rep", "key"])
    reps = materialize(one.select("rep", "n", "sketch", "bands"), "reps", folder)

    buckets = reps.select("rep", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1")
    members = materialize(buckets.join(sizes, "bucket"), "members", folder)
    weight = members.groupBy("rep").agg(F.sum(F.log2(F.col("c").cast("double"))).alias("w"))
    hubs = members.join(weight, "rep").groupBy("bucket").agg(F.max(F.struct("w", (-F.col("rep")).alias("r"))).alias("h")).select("bucket", (-F.col("h.r")).alias("hub"))
    pairs = members.join(hubs, "bucket").filter("rep != hub").select(F.col("rep").alias("u"), F.col("hub").alias("v")).distinct()
    sketches = reps.select("rep", "sketch")
    left, right = sketches.toDF("u", "a"), sketches.toDF("v", "b")
    pairs = materialize(pairs.join(left, "u").join(right, "v").filter(_near("a", "b", most)).select("u", "v"), "pairs", folder)
    links = materialize(confirm(docs, pairs, words, percent, f"{folder}/first"), "links", folder)
    labels = components(links, f"{folder}/first")

    named = lambda rows, key: rows.join(labels.select(F.col("u").alias(key), F.col("v").alias("comp")), key, "left").withColumn("comp", F.coalesce("comp", key))
    labelled = named(members.select("bucket", "rep"), "rep")
    mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
    rest = labelled.join(mixed, "bucket").join(reps, "rep").select("bucket", "rep", "comp", "n", "sketch", "bands")
    more = materialize(across(docs, rest, most, words, percent, f"{folder}/second"), "more", folder)
    if not more.isEmpty():
        labels = components(links.unionByName(more), f"{folder}/second")
    final = materialize(named(keys.select("key", "rep"), "rep").select("key", "comp"), "final", folder)
    out = signed.select("doc_id", "n", "key").join(final, "key", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"),
    )


def digest(docs: DataFrame, words: int = 2) -> DataFrame:
    out = near_duplicates(docs, words)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; of rows that repeat an id and a text, one.

    Where ids repeat, each id and text gets a number in the order of the ids, and the numbers stand for the ids.
    """
    again = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if not again:
        return _smallest(docs, words, percent)
    folder, names = shared_dir(docs.sparkSession), docs.columns
    known = docs.filter("doc_id is not null").select("doc_id", F.coalesce(F.md5("text"), F.lit("")).alias("digest"), "text", F.struct(*names).alias("row"))
    # ids that are given after a sort rise with it, partition by partition
    numbers = materialize(known.select("doc_id", "digest").distinct().orderBy("doc_id", "digest").withColumn("number", F.monotonically_increasing_id()), "numbers", folder)
    numbered = known.join(numbers, ["doc_id", "digest"]).select(F.col("number").alias("doc_id"), "text", "row").dropDuplicates(["doc_id"])
    kept = _smallest(materialize(numbered, "numbered", folder), words, percent)
    return kept.select("row.*").unionByName(docs.filter("doc_id is null"))


def _smallest(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows of ``docs`` whose id, which no other row has, is the smallest of its group."""
    found = materialize(near_duplicates(docs, words, percent), "groups")
    gone = found.filter("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
