"""Secret scanning with DataFrame expressions only.

Three base patterns (an assignment to a secret-like name, an access key id, a
long lower-case hex run) are located by splitting the text at the pattern: the
gaps and the matches together give the code-point offsets of every match.

The entropy method adds spans. Candidate strings are maximal runs of a
character class that hold all kinds of symbols which the class asks for. A window
slides over each candidate; the counts of the symbols inside it are kept up to
date by adding the symbol that enters and removing the one that leaves, and with
them the sum of c*log2(c), from which the Shannon entropy of the window is
log2(w) - sum/w. A candidate is reported when its best window reaches the
threshold of its class, unless an allow-list pattern matches it (identifiers with
a public format, placeholders, inline media) or a base span already covers it.

Defined cases: a null or empty text has no spans, and a null id is passed on; a
text of any length is scanned whole, at a cost in proportion to its length and its
number of matches; spans that begin together are ordered by kind, as listed;
repeated rows each give a row; an empty table gives an empty result; other columns
are passed through by ``scan`` and replaced when they carry an output's name.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns with the least length of what they must match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class EntropyClass:
    """A character class: its run pattern, patterns that a run must contain, its alphabet, the window and the least entropy in bits."""

    kind: str
    run: str
    needs: tuple[str, ...]
    alphabet: str
    window: int
    threshold: float


# Character classes of encoded random bytes.
HEX_CLASS = EntropyClass("entropy_hex", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])", (), "0123456789abcdef", 32, 3.2)
BASE64_CLASS = EntropyClass(
    "entropy_base64",
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}",
    ("[0-9]", "[a-z]", "[A-Z]"),
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=",
    24,
    4.0,
)
CLASSES = (HEX_CLASS, BASE64_CLASS)

# Public formats and placeholders which are never reported by the entropy method.
ALLOW = (
    r"(?i)example|sample|placeholder|changeme|your[_-]|dummy|redacted|xxxx",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^(?:0123456789|abcdefghij|ABCDEFGHIJ)",
    r"^(?:iVBORw0KGgo|R0lGODlh|/9j/4AA)",
    # words of letters with single separators in between, as in a path
    r"^(?=[a-z]+[/_-])(?!.*[/_-](?:[/_-]|[0-9]|$))[A-Za-z/_-]+[0-9]{0,4}$",
)


#: Items that a scan takes together.
PART = 256
#: Windows of a block of ``window_entropy``.
BLOCK = 4096
SPAN = "struct<start:int,rank:int,end:int,kind:string,first:int,last:int>"
PIECE = "struct<start:int,end:int,first:int,last:int,value:string>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(items: Column, kind: str, state: Column, step, emit) -> Column:
    """For each item ``emit(state, item)``, of the SQL type ``kind``; the state is that of ``step`` over the items before it.

    An array is copied when it grows. So the items are taken in parts: a part's
    results grow one by one, and whole parts are put together at the end, which
    keeps the cost in proportion to the number of items.
    """
    none = F.array().cast(f"array<{kind}>")

    def part(acc: Column, xs: Column) -> Column:
        one = lambda a, x: F.struct(step(a["s"], x).alias("s"), F.concat(a["out"], F.array(emit(a["s"], x))).alias("out"))
        inside = F.aggregate(xs, F.struct(acc["s"].alias("s"), none.alias("out")), one)
        return _let(inside, lambda i: F.struct(i["s"].alias("s"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

    def over(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / PART).cast("int")), lambda k: F.slice(xs, k * PART + 1, F.lit(PART)))
        zero = F.struct(state.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(xs) > 0, F.flatten(F.aggregate(parts, zero, part, lambda acc: acc["out"]))).otherwise(none)

    return _let(items, over)


def _pieces(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """Matches of ``pattern`` as an array of ``PIECE``, leftmost and without overlap.

    ``start`` and ``end`` are code points, ``first`` and ``last`` bytes of UTF-8;
    ``gate``: a cheaper condition that every text with a match fulfils.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gap = lambda g, m: F.struct(F.length(g).alias("n"), F.octet_length(g).alias("b"), m.alias("m"))
    pairs = _let(found, lambda f: F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(f)), f, gap))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte"))
    step = lambda s, x: F.struct((s["at"] + x["n"] + F.length(x["m"])).alias("at"), (s["byte"] + x["b"] + F.octet_length(x["m"])).alias("byte"))

    def emit(s: Column, x: Column) -> Column:
        a, b = s["at"] + x["n"], s["byte"] + x["b"]
        return F.struct(a.alias("start"), (a + F.length(x["m"])).alias("end"), b.alias("first"), (b + F.octet_length(x["m"])).alias("last"), x["m"].alias("value"))

    may = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(may, _scan(pairs, PIECE, zero, step, emit)).otherwise(F.array().cast(f"array<{PIECE}>"))


def _spans(pieces: Column, kind: str, rank: int) -> Column:
    return F.transform(
        pieces,
        lambda p: F.struct(p["start"].alias("start"), F.lit(rank).alias("rank"), p["end"].alias("end"), F.lit(kind).alias("kind"), p["first"].alias("first"), p["last"].alias("last")),
    )


def _block_entropy(symbols: Column, cls: EntropyClass) -> Column:
    """The largest entropy of a short string's windows, or that of the string itself if it is shorter than a window.

    Counts are kept as eight bytes to a word. Each symbol that enters, and each that
    leaves the window, changes one byte, and its term of the sum of c*log2(c).
    """
    w, words = cls.window, (len(cls.alphabet) >> 3) + 1
    place = {c: k + 1 for k, c in enumerate(cls.alphabet)}
    slots = F.array(*(F.lit(place.get(chr(c), 0)) for c in range(128)))
    terms = F.array(*(F.lit(c * math.log2(c) if c > 1 else 0.0) for c in range(-1, w + 2)))
    term = lambda c: F.get(terms, c + 1)
    chars = F.transform(F.split(symbols, ""), lambda c: F.coalesce(F.get(slots, F.ascii(c)), F.lit(0)))
    # a symbol that enters as its slot, before it the one that leaves as -1 - slot
    moves = lambda cs: F.flatten(F.zip_with(cs, F.slice(F.concat(F.array_repeat(F.lit(-1), w), cs), 1, F.size(cs)), lambda c, gone: F.when(gone < 0, F.array(c)).otherwise(F.array(-1 - gone, c))))
    zero = F.struct(*(F.lit(0).cast("long").alias(f"w{k}") for k in range(words)), F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def move(acc: Column, code: Column) -> Column:
        enters = code >= 0
        slot, by = F.when(enters, code).otherwise(-1 - code), F.when(enters, F.lit(1)).otherwise(F.lit(-1))
        which, shift = F.shiftright(slot, 3), F.shiftleft(slot.bitwiseAND(F.lit(7)), 3)
        held = F.lit(0).cast("long")
        for k in range(words):
            held = F.when(which == k, acc[f"w{k}"]).otherwise(held)
        c = F.call_function("shiftright", held, shift).bitwiseAND(F.lit(255).cast("long")).cast("int")
        unit = F.call_function("shiftleft", by.cast("long"), shift)
        s, n = acc["s"] - term(c) + term(c + by), acc["n"] + by
        return F.struct(
            *(F.when(which == k, acc[f"w{k}"] + unit).otherwise(acc[f"w{k}"]).alias(f"w{k}") for k in range(words)),
            n.alias("n"),
            s.alias("s"),
            F.when(n == w, F.greatest(acc["best"], F.lit(math.log2(w)) - s / w)).otherwise(acc["best"]).alias("best"),
        )

    n = lambda acc: acc["n"].cast("double")
    finish = lambda acc: F.when((acc["n"] > 0) & (acc["n"] < w), F.log2(n(acc)) - acc["s"] / n(acc)).otherwise(acc["best"])
    return F.aggregate(_let(chars, moves), zero, move, finish)


def window_entropy(value: Column, cls: EntropyClass) -> Column:
    """The largest Shannon entropy, in bits, of any window of ``cls.window`` symbols of an ASCII string (of the whole if it is shorter).

    Long strings are taken in blocks that overlap by a window less one symbol, so
    that every window lies in one block and memory is bounded.
    """
    w, n = cls.window, F.length(value)
    symbols = F.lower(value) if cls is HEX_CLASS else value
    block = lambda b, k: _block_entropy(F.substring(b, k * BLOCK + 1, F.lit(BLOCK + w - 1)).cast("string"), cls)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), ((n - w) / BLOCK).cast("int")))
    return F.when(n > 0, _let(symbols.cast("binary"), lambda b: F.array_max(F.transform(starts, lambda k: block(b, k))))).otherwise(F.lit(0.0))


def _has_any(value: Column, patterns: tuple[str, ...]) -> Column:
    return functools.reduce(lambda a, p: a | value.rlike(p), patterns, F.lit(False))


def _has_all(value: Column, patterns: tuple[str, ...]) -> Column:
    return functools.reduce(lambda a, p: a & value.rlike(p), patterns, F.lit(True))


def span_array(text: Column, classes=CLASSES, allow=ALLOW) -> tuple[Column, Column]:
    """(base spans, entropy spans) of ``text``: arrays of (start, rank, end, kind, first, last); first and last are bytes."""
    text = F.coalesce(text, F.lit(""))
    assign = F.filter(_pieces(text, ASSIGN, text.contains("=") | text.contains(":")), lambda p: F.length(F.regexp_extract(p["value"], ASSIGN, 1)) >= 6)
    access = F.filter(_pieces(text, ACCESS, text.contains("AKIA")), lambda p: p["end"] - p["start"] >= 20)
    base = F.concat(_spans(assign, "assign", 0), _spans(access, "access", 1), _spans(_pieces(text, HEX), "hex", 2))
    extra = F.array().cast(f"array<{SPAN}>")
    for k, cls in enumerate(classes):
        runs = F.filter(_pieces(text, cls.run), lambda p: _has_all(p["value"], cls.needs) & ~_has_any(p["value"], allow) & (window_entropy(p["value"], cls) >= cls.threshold))  # noqa: B023
        extra = F.concat(extra, _spans(runs, cls.kind, 3 + k))
    return base, extra


def _uncovered(base: Column, extra: Column) -> Column:
    """The spans of ``extra`` that no span of ``base`` covers, in their order; one sweep with the furthest end so far."""
    step = lambda s, x: F.when(x["rank"] < 3, F.greatest(s, x["end"])).otherwise(s)
    emit = lambda s, x: F.struct(((x["rank"] >= 3) & (x["end"] > s)).alias("stays"), x.alias("span"))
    swept = _scan(F.array_sort(F.concat(base, extra)), f"struct<stays:boolean,span:{SPAN}>", F.lit(0), step, emit)
    return F.when(F.size(extra) > 0, F.transform(F.filter(swept, lambda x: x["stays"]), lambda x: x["span"])).otherwise(extra)


def scan(docs: DataFrame, text: str = "text", classes=CLASSES, allow=ALLOW) -> DataFrame:
    """``docs`` with ``base`` and ``added``: the spans of the patterns and of the entropy method."""
    base, extra = span_array(F.col(text), classes, allow)
    out = docs.withColumns({"base": F.array_sort(base), "added": extra})
    return out.withColumn("added", _uncovered(F.col("base"), F.col("added")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a hash of the base spans and all spans."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; the columns stay, and ``n_chars``, if there is one, follows the text.

    A span that begins within another goes with it.
    """
    names, sized = docs.columns, "n_chars" in docs.columns
    keep = [c for c in names if c != "text"]
    found = scan(docs.select("text", F.struct(*keep).alias("_kept") if keep else F.lit(None).alias("_kept")))
    step = lambda at, s: F.greatest(at, s["last"])
    emit = lambda at, s: F.struct(at.alias("first"), s["first"].alias("last"))
    gaps = F.filter(_scan(F.array_sort(F.concat("base", "added")), "struct<first:int,last:int>", F.lit(0), step, emit), lambda g: g["last"] >= g["first"])
    tail = F.struct(F.array_max(F.transform(F.concat("base", "added"), lambda s: s["last"])).alias("first"), F.octet_length("text").alias("last"))
    pieces = lambda raw: F.transform(F.concat(gaps, F.array(tail)), lambda g: F.substring(raw, g["first"] + 1, g["last"] - g["first"]).cast("string"))
    clean = _let(F.col("text").cast("binary"), lambda raw: F.array_join(pieces(raw), mark))
    fixed = found.withColumn("_hit", F.size("base") + F.size("added") > 0).withColumn("_text", F.when(F.col("_hit"), clean).otherwise(F.col("text")))
    new = {"text": F.col("_text")}
    if sized:
        new["n_chars"] = F.when(F.col("_hit"), F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_kept")["n_chars"])
    return fixed.select(*((new[c] if c in new else F.col("_kept")[c]).alias(c) for c in names))
