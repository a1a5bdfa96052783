"""WARC archives: written with revisit records for repeated payloads, read back by a salvaging reader.

Records are rows of text whose separator is the format's own blank line, so any
Hadoop file system can hold the archives. A file has a bounded number of records;
those of more than ``SMALL`` bytes are dealt to twice as many files for each doubling,
so that a file fits in memory.

The reader checks the version line, the header fields, the length, the closing
blank line and the payload's digest. After a failed check it looks for the next
valid version line (in compressed archives: the next member that can be opened),
goes on from there, and logs the bytes in between as a quarantined gap. All records
of a compressed member are read, and the gaps within it are logged with it. The query
keeps the log of gaps as a table beside the archives, and fails if a page is missing.

Of payloads that repeat, the ``HOT`` most frequent are known to every task, so that
one payload of many pages is neither shuffled nor gathered; the others are joined by
their digest.

Defined cases: a null html counts as empty; of equal payloads of ``least`` bytes
or more the one with the largest id is the response, rows that repeat an id with
an equal payload all are; a null id is written as an empty field and never chosen
as another's response; a page of any length is one record, of a file of its own if
it is very long; an empty table gives no archive and no record; other columns of
pages are not read, so names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.llm._base import materialize, release, shared_dir

CRLF = "\r\n"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes up to which a record is small, and records in a file.
SMALL, MOST = 32 << 10, 1000
#: Bytes of the bitmap of repeated digests, and the number of digests that are broadcast as they are.
FILTER_BYTES, HOT = 1 << 20, 10_000
#: Compressed bytes that are opened at a time.
STEP = 1 << 16


def _header(page_id: Column, kind: Column, sha1_hex: Column, length: Column, block: Column, uri: Column, refers: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    lines = [
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(uri, F.lit("")), r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1_hex)),
        line("X-Payload-Length", length.cast("string")),
        F.when(refers.isNotNull(), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers.cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", block.cast("string")),
        F.lit(CRLF),
    ]
    return F.concat(*lines)


def repeated(groups: DataFrame) -> Column:
    """Whether a row's digest may be in ``groups`` (digest); false only if it isn't.

    A bitmap of ``FILTER_BYTES`` at most is broadcast, so that records of other
    digests need no shuffle.
    """
    spark, bits = groups.sparkSession, 8 * FILTER_BYTES
    slot = F.pmod(F.xxhash64("digest"), F.lit(bits))
    words = groups.select(slot.alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b"))
    bitmap = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():
        bitmap[r["w"]] = r["b"]
    shared = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        k = h.to_numpy()
        return pd.Series((shared.value.view(np.uint64)[k >> 6] >> (k & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return test(slot)


def plan(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html, the payload's digest and length, and ``refers_to``: the id of the response that it revisits."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n"))
    may = (F.col("n") >= least) & F.col("page_id").isNotNull()
    groups = rows.filter(may).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).filter("copies > 1")
    groups = materialize(groups, "repeated")
    hot = groups.orderBy(F.desc("copies"), "digest").limit(HOT).select("digest", F.col("last").alias("hot"))
    known = rows.join(F.broadcast(hot), "digest", "left")  # HOT rows at most
    refers = lambda last: F.when(may & (F.col(last) != F.col("page_id")), F.col(last))
    settled = known.filter("hot is not null").withColumn("refers_to", refers("hot"))
    marked = known.filter("hot is null").withColumn("again", repeated(groups.join(F.broadcast(hot), "digest", "left_anti")))
    joined = marked.filter("again").drop("again").join(groups.drop("copies"), "digest", "left").withColumn("refers_to", refers("last")).drop("last")
    once = marked.filter("not again").drop("again").withColumn("refers_to", F.lit(None).cast("long"))
    return once.unionByName(joined).unionByName(settled).drop("hot")


def write(planned: DataFrame, folder: str) -> None:
    """Write the records of ``plan`` to archives below ``folder``."""
    kind = F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    block = F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(F.lit(""))
    header = _header(F.col("page_id"), kind, F.col("digest"), F.col("n"), F.octet_length(block), F.col("url"), F.col("refers_to"))
    size = F.octet_length(block)
    over = F.when(size > SMALL, F.ceil(F.log2(size / SMALL))).otherwise(F.lit(0)).cast("int")
    records = planned.select("page_id", F.concat(header, block).alias("value"), over.alias("over"))
    records = records.select("value", "over", F.expr("pmod(xxhash64(page_id), shiftleft(1L, over))").alias("part"))
    writer = records.write.partitionBy("over", "part").option("lineSep", 2 * CRLF)
    writer.option("maxRecordsPerFile", MOST).option("compression", "none").text(folder)


@dataclass
class Record:
    start: int
    end: int
    fields: dict[str, str]
    block: bytes


@dataclass
class Salvage:
    """What a reader has found in an archive: records and (start, end, reason) of the gaps."""

    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def digest_fits(fields: dict[str, str], block: bytes) -> bool:
    """Whether the payload digest, hexadecimal or base 32, is that of ``block``."""
    name, _, value = fields.get("warc-payload-digest", "").partition(":")
    if name.lower() != "sha1" or fields.get("warc-type") != "response" or not fields.get("content-type", "").startswith("text/"):
        return True
    raw = hashlib.sha1(block).digest()
    return value.lower() == raw.hex() or value.upper() == base64.b32encode(raw).decode()


def read_record(data: bytes, at: int) -> Record | str:
    """The record at ``at``, or why there is none."""
    if not (m := VERSION.match(data, at)):
        return "no version line"
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        return "the header doesn't end"
    fields = {}
    for line in data[m.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return "a header line without a name"
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not (length := fields.get("content-length", "")).isdigit():
        return "no length"
    body = end + 4
    close = body + int(length)
    if data[close : close + 4] != b"\r\n\r\n":
        return "the record doesn't end where its length says"
    block = data[body:close]
    return Record(at, close + 4, fields, block) if digest_fits(fields, block) else "the digest differs"


def salvage(data: bytes) -> Salvage:
    """Every record of a plain archive that passes the checks, and the gaps in between."""
    out, at, bad, why = Salvage(), 0, -1, ""
    while at < len(data):
        found = read_record(data, at)
        if isinstance(found, Record):
            if bad >= 0:
                out.gaps.append((bad, at, why))
                bad = -1
            out.records.append(found)
            at = found.end
            continue
        if bad < 0:
            bad, why = at, found
        m = VERSION.search(data, at + 1)
        at = m.start() if m else len(data)
    if bad >= 0:
        out.gaps.append((bad, len(data), why))
    return out


#: A member's first bytes: deflate, no reserved flag.
MEMBER = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]", re.S)


def _open(data: bytes, at: int) -> tuple[bytes, int] | str:
    """(plain bytes, end) of the member at ``at``, or why there is none."""
    opener, plain, end = zlib.decompressobj(31), [], at
    try:
        while end < len(data) and not opener.eof:
            plain.append(opener.decompress(data[end : end + STEP]))
            end = min(len(data), end + STEP)
    except zlib.error as e:
        return str(e)
    return (b"".join(plain), end - len(opener.unused_data)) if opener.eof else "the member ends early"


def salvage_gzip(data: bytes) -> Salvage:
    """The same for an archive of gzip members, each with one or more records; offsets are those of the member in the compressed bytes."""
    out, at, bad, why = Salvage(), 0, -1, ""
    while at < len(data):
        found = _open(data, at)
        inner = salvage(found[0]) if isinstance(found, tuple) else None
        if inner and inner.records:
            if bad >= 0:
                out.gaps.append((bad, at, why))
                bad = -1
            out.records += [Record(at, found[1], r.fields, r.block) for r in inner.records]
            out.gaps += [(at, found[1], f"bytes {a} to {b} of the member: {reason}") for a, b, reason in inner.gaps]
            at = found[1]
            continue
        if bad < 0:
            bad, why = at, found if isinstance(found, str) else inner.gaps[0][2] if inner.gaps else "an empty member"
        m = MEMBER.search(data, at + 1)
        at = m.start() if m else len(data)
    if bad >= 0:
        out.gaps.append((bad, len(data), why))
    return out


def _id(value: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value)
    return int(m[1]) if m else None


def read(spark, folder: str, with_block: bool = False) -> DataFrame:
    """One row for each record and each gap of the archives below ``folder``.

    kind (record or gap), path, start, end, reason, and of records page_id,
    record_type, payload_bytes, payload_digest, refers_to (and the block).
    """
    names = ["kind", "path", "start", "end", "reason", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["block"] * with_block
    schema = "kind string, path string, start long, end long, reason string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", block binary" * with_block

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                found = salvage_gzip(data) if data[:2] == b"\x1f\x8b" else salvage(data)
                rows = [("gap", path, a, b, why, None, None, None, None, None, *[None] * with_block) for a, b, why in found.gaps]
                for r in found.records:
                    f = r.fields
                    whole = hashlib.sha1(r.block).hexdigest() if f.get("warc-type") == "response" else f.get("warc-payload-digest", "").partition(":")[2]
                    size = len(r.block) if f.get("warc-type") == "response" else int(f.get("x-payload-length", "0"))
                    rows.append(("record", path, r.start, r.end, None, _id(f.get("warc-record-id", "")), f.get("warc-type"), size, whole, _id(f.get("warc-refers-to", "")), *[r.block] * with_block))
                yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to")})
        release()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return files.mapInPandas(run, schema)


class MissingError(RuntimeError):
    """Pages whose records could not be read back."""


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` to archives below ``folder``, read them back, and give a row for each record.

    Gaps go to the table ``gaps`` in the folder; a record too few is an error.
    """
    write(plan(pages), f"{folder}/warc")
    found = materialize(read(pages.sparkSession, f"{folder}/warc"), "found", folder)
    gaps = materialize(found.filter("kind = 'gap'").select("path", "start", "end", "reason"), "gaps", folder)
    records, wanted = found.filter("kind = 'record'"), pages.count()
    if (n := records.count()) != wanted:
        raise MissingError(f"{n} of {wanted} pages were read back; {gaps.count()} gaps are in {folder}/gaps")
    return records


def digest(pages: DataFrame) -> DataFrame:
    """One row per page, as read back from the archives that are written here."""
    rows = archive(pages, shared_dir(pages.sparkSession))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
