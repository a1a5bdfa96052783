"""Media columns: texts stored as lossless WebP pictures, read back to pixel arrays.

A text's UTF-8 bytes, filled with spaces to rows of 64 RGB pixels, become a
picture; where the format's greatest height is exceeded, several pictures follow
each other. The column is written as a table in the shared folder, and what is
computed comes from its bytes as they are read back. ``decode`` reads any lossless
WebP column, plain or extended, to pixel arrays; lossy pictures are refused.

Defined cases: a null text counts as empty and gives one row of spaces; a text of
any length is stored whole; a null id is passed on; media that is null or corrupt
decodes to null pixels with the reason in ``error``; equal texts have equal media;
repeated rows each give a row; an empty table gives an empty result; other columns
are not read by ``encode`` and ``digest``, and ``decode`` replaces one that has
the name of its result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm import webp
from galena.llm._base import materialize, release

WIDTH, MOST_ROWS = 64, 1 << 14
ROW = 3 * WIDTH


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, its bytes with spaces up to whole rows)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // ROW)) * ROW)


def store(raw: bytes) -> bytes:
    return b"".join(webp.encode_rgb(raw[k : k + ROW * MOST_ROWS], WIDTH) for k in range(0, len(raw), ROW * MOST_ROWS))


def samples(pixels: np.ndarray) -> np.ndarray:
    """Red, green, blue of each pixel."""
    return pixels.astype("<u4").view(np.uint8).reshape(-1, 4)[:, 2::-1]


def load(media: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, samples) of the pictures, one below the other."""
    parts = webp.decode(media)
    return parts[0][0], sum(h for _, h, _ in parts), np.concatenate([samples(p) for _, _, p in parts])


def feature(rgb: np.ndarray) -> str:
    """Size, mean and deviation of each channel, mean step between neighbours, and a 64-bit average hash of the columns."""
    n, x = len(rgb), rgb.astype(np.float64).ravel()
    columns, squares = (v.reshape(-1, ROW).sum(axis=0).reshape(WIDTH, 3) for v in (x, x * x))
    mean = [v / n for v in columns.sum(axis=0).tolist()]
    deviation = [math.sqrt(max(0.0, v / n - m * m)) for v, m in zip(squares.sum(axis=0).tolist(), mean, strict=True)]
    grey = columns.sum(axis=1)
    bits = np.packbits(grey > grey.sum() / WIDTH).tobytes().hex()
    step = float(np.abs(x[1:] - x[:-1]).sum()) / (3 * n - 1)
    return f"{WIDTH}x{n // WIDTH};" + ",".join([f"{v:.3f}" for v in (*mean, *deviation, step)]) + f";{bits}"


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                rows = [payload(t) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(), "n_bytes": [n for n, _ in rows], "media": [store(raw) for _, raw in rows]}).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_bytes long, media binary")


def decode(df: DataFrame, media: str = "media", into: str = "picture") -> DataFrame:
    """``df`` with the struct ``into`` (width, height, pixels, error); ``pixels`` are ARGB values by rows."""

    @F.pandas_udf("width int, height int, pixels array<long>, error string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for m in batch:
                try:
                    parts = webp.decode(bytes(m)) if m is not None else []
                    if not parts:
                        raise webp.CorruptError("no media")
                    rows.append((parts[0][0], sum(h for _, h, _ in parts), np.concatenate([p for _, _, p in parts]).astype(np.int64), None))
                except webp.CorruptError as e:
                    rows.append((None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["width", "height", "pixels", "error"]).astype({"width": "Int32", "height": "Int32"})

    return df.withColumn(into, read(F.col(media)))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document, computed from the stored table as it is read back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for n, m in zip(batch["n_bytes"], batch["media"], strict=True):
                rgb = load(m)[2]
                raw = rgb.tobytes()
                rows.append((n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(rgb)))
            out = pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out.astype({"doc_id": "Int64"})
        release()

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return materialize(encode(docs), "media").mapInPandas(run, schema)
