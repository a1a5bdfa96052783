"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else counts as a gap; n-grams of one to three
symbols are hashed to ``dim`` features. Document frequencies are counted over all
training rows. The weights are learned on a bounded sample of the labelled
training rows (``per_class`` rows a language in expectation, twice as many at
most), with follow-the-regularised-leader (proximal, per-coordinate rates) under
L1 and L2 penalties, and a temperature is fitted on a held-back fifth of the
sample.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is
every text when there is no labelled row; repeated rows each give a row; texts are
read whole, in blocks; rows with a null language are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm._base import fold, release

UND = "und"
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _symbols(text: str) -> np.ndarray:
    """Code points of the letters, 32 for a gap; empty if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return points[:0]
    points = np.where(letter, points, 32)
    gap = points == 32
    return np.concatenate([[np.uint32(32)], points[~(gap & np.append(False, gap[:-1]))], [np.uint32(32)]])


def gram_counts(text: str, dim: int, orders: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of the hashed n-grams of a text."""
    symbols = _symbols(text)
    total = None
    shift = np.uint64(64 - dim.bit_length() + 1)
    for at in range(0, len(symbols), BLOCK):
        a = symbols[at : at + BLOCK + orders - 1].astype(np.uint64)
        h, ids = a + np.uint64(1), []
        for n in range(1, orders + 1):
            if n > 1:
                h = h[:-1] * np.uint64(0x100000001B3) + a[n - 1 :]
            ids.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> shift)[:BLOCK])
        got = np.bincount(np.concatenate(ids).astype(np.int64), minlength=dim)
        total = got if total is None else total + got
    if total is None:
        return np.empty(0, np.int64), np.empty(0)
    features = np.flatnonzero(total)
    return features, total[features]


def tfidf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    features, counts = gram_counts(text, len(idf))
    x = np.log1p(counts) * idf[features]
    return features, x / (np.sqrt(x @ x) or 1.0)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: list[int], dim: int, classes: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    """Weights [dim, classes] by FTRL-proximal with elastic-net penalties."""
    z, n = np.zeros((dim, classes)), np.zeros((dim, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            f, x = rows[k]
            w = weights(z[f], n[f])
            error = _softmax(x @ w)
            error[y[k]] -= 1.0
            g = x[:, None] * error
            step = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - step * w
            n[f] += g * g
    return weights(z, n)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        top = s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s - top).sum(axis=1)) + top[:, 0] - s[np.arange(len(y)), y]))

    a, b, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass
class LanguageModel:
    classes: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    weights: np.ndarray | None = None
    temperature: float = 1.0

    def __call__(self, text: str | None) -> tuple[str, float]:
        features, x = tfidf(text, self.idf) if text and self.classes else ((), ())
        if not len(features):
            return UND, 0.0
        p = _softmax((x @ self.weights[features]) / self.temperature)
        k = int(p.argmax())
        return self.classes[k], float(p[k])


def document_frequencies(texts: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """(documents, document frequency of each feature), over all rows of ``texts`` (text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, df = 0, np.zeros(dim, np.int64)
        for batch in batches:
            for text in batch["text"]:
                if text:
                    df[gram_counts(text, dim)[0]] += 1
                    rows += 1
        k = np.flatnonzero(df)
        yield pd.DataFrame({"k": np.append(k, -1), "n": np.append(df[k], rows)})
        release()

    df, rows = np.zeros(dim, np.int64), 0
    for r in texts.select("text").mapInPandas(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        if r["k"] < 0:
            rows = r["n"]
        else:
            df[r["k"]] = r["n"]
    return rows, df


def train(
    docs: DataFrame, dim: int = 1 << 15, per_class: int = 1200, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05, epochs: int = 3
) -> LanguageModel:
    """Learn from the rows of ``docs`` (doc_id, text, lang); ``per_class`` bounds the sample for the weights."""
    labelled = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel()
    rows, df = document_frequencies(labelled, dim)
    idf = np.log((1.0 + rows) / (1.0 + df)) + 1.0
    chance = (F.xxhash64("doc_id", "lang") + F.lit(0)) % 1_000_003
    rate = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, int(1_000_003 * min(1.0, per_class / n)))))
    sample = labelled.withColumn("u", F.abs(chance)).filter(F.col("u") <= rate[F.col("lang")]).orderBy("u", "doc_id").limit(2 * per_class * len(counts))
    classes = sorted(counts)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = [], []
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                row = tfidf(text, idf)
                if len(row[0]):
                    x.append(row)
                    y.append(classes.index(lang))
        held = np.arange(len(x)) % 5 == 4
        w = ftrl([r for r, h in zip(x, held, strict=True) if not h], [k for k, h in zip(y, held, strict=True) if not h], dim, len(classes), alpha, beta, l1, l2, epochs)
        t = temperature(np.array([x[k][1] @ w[x[k][0]] for k in np.flatnonzero(held)]), np.array(y)[held]) if held.any() else 1.0
        k = np.flatnonzero(np.any(w != 0, axis=1))
        yield pd.DataFrame({"k": np.append(k, -1), "w": [*map(list, w[k]), [t]]})
        x.clear()
        release()

    model = LanguageModel(classes, idf, np.zeros((dim, len(classes))))
    for r in sample.select("text", "lang").coalesce(1).mapInPandas(fit, "k int, w array<double>").collect():
        if r["k"] < 0:
            model.temperature = r["w"][0]
        else:
            model.weights[r["k"]] = r["w"]
    return model


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", into: str = "prediction") -> DataFrame:
    """``docs`` with the struct ``into`` (lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([model(t) for t in batch], columns=["lang_pred", "score"])
        release()

    return docs.withColumn(into, judge(F.col(text)))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document; learned from the folds 0, 1 and 3 of four."""
    held = fold(F.col("doc_id"), 4) == 2
    model = train(docs.filter(~held))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "prediction.lang_pred", "prediction.score")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with a score of ``least`` or more; the columns stay."""
    names = docs.columns
    out = predict(docs.select("text", F.struct(*names).alias("_row")), train(docs), into="_p")
    return out.filter((F.col("_p.lang_pred") != UND) & (F.col("_p.score") >= least)).select("_row.*")
