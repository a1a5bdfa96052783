"""Quality classification by a regularised quadratic discriminant of document statistics.

Statistics of the whole text (lengths, character classes, repetition, entropy) are
transformed to compact ranges. Class means and covariances come from moments summed
over all labelled training rows. A class's covariance is shrunk towards the pooled
one as if ``PRIOR`` further rows had the pooled covariance, whatever its number of
rows, and then by the share ``RIDGE`` towards a multiple of the identity. A score is
the logistic of the difference of the log densities, whose Mahalanobis terms use
Cholesky factors computed once. The statistics aren't normal, so the difference is
divided by a temperature: that of ``HEATS`` with the least log loss over all labelled
training rows.

Defined cases: a null or empty text has the statistics of an empty text; a text of
any length is measured whole; a null id is passed on and has no label; labels that
are null are ignored and a document's repeated labels count as their largest;
without two rows of each class every score is the share of label 1 (0.5 without
labels); of equally good temperatures the lower one is taken; repeated documents
each give a row and each count in training; an empty table gives an empty result;
only ``doc_id``, ``text`` and the label are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm._base import fold, materialize

STATISTICS = (
    "characters", "words", "word_length", "word_spread", "letters", "digits", "spaces", "stops", "symbols", "capitals",
    "wordless", "distinct_words", "top_word", "repeated_lines", "line_length", "stops_a_word", "long_words", "entropy",
    "repeated_pairs", "short_words", "foreign",
)
SPACE, LETTER, DIGIT, STOP, SYMBOL, FOREIGN = range(6)
_CLASS = np.full(128, SYMBOL, np.int64)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = STOP
#: Rows of the pooled covariance that each class's own is mixed with, and the identity's share.
PRIOR, RIDGE = 21, 0.05
HEATS = (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0)


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a text: logarithms of sizes, square roots of shares."""
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points) or 1
    low = points[points < 128]
    kinds = np.bincount(_CLASS[low], minlength=6)
    kinds[FOREIGN] = len(points) - len(low)
    words = text.split()
    m = len(words) or 1
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [line for line in text.split("\n") if line.strip()]
    p = np.unique(low, return_counts=True)[1] / max(1, len(low))
    wordless = sum(c for w, c in counts.items() if not any(map(str.isalpha, w)))
    shares = [
        kinds[LETTER] / n, kinds[DIGIT] / n, kinds[SPACE] / n, kinds[STOP] / n, kinds[SYMBOL] / n, float(np.count_nonzero((low >= 65) & (low < 91))) / n,
        wordless / m, len(counts) / m, max(counts.values(), default=0) / m, 1 - len(set(lines)) / max(1, len(lines)),
    ]
    rest = [
        np.log1p(len(text) / max(1, len(lines))), np.sqrt(min(1.0, kinds[STOP] / m)), np.sqrt(np.mean(sizes > 20)), float(-(p * np.log2(p)).sum()),
        np.sqrt(max(0.0, 1 - pairs / max(1, len(words) - 1))) if len(words) > 1 else 0.0, np.sqrt(np.mean(sizes <= 3)), np.sqrt(kinds[FOREIGN] / n),
    ]
    return np.array([np.log1p(len(text)), np.log1p(len(words)), np.log1p(sizes.mean()), np.log1p(sizes.std()), *np.sqrt(shares), *rest])


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every row."""

    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([statistics(t) for t in batch], dtype=object)

    return docs.select("doc_id", stats("text").alias("x"))


@dataclass
class Discriminant:
    """log prior odds; centre and scale; of each class the mean, the inverse of its Cholesky factor and its log determinant."""

    odds: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    means: tuple = ()
    factors: tuple = ()
    log_dets: tuple = ()
    heat: float = 1.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0, of the rows of ``x``."""
        if not self.means:
            return np.zeros(len(x))
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        zero, one = (((z - m) @ f.T) for m, f in zip(self.means, self.factors, strict=True))
        return 0.5 * ((zero**2).sum(axis=1) - (one**2).sum(axis=1) + self.log_dets[0] - self.log_dets[1])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Scores of the rows of ``x``."""
        return 1 / (1 + np.exp(-np.clip(self.odds + self.margins(x) / self.heat, -60, 60)))


def fit(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, prior: float = PRIOR, ridge: float = RIDGE) -> Discriminant:
    """From the number, sum and sum of outer products of the rows of class 0 and 1."""
    total = counts.sum()
    if counts.min() < 2:
        share = counts[1] / total if total else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Discriminant(float(np.log(share / (1 - share))))
    centre = sums.sum(axis=0) / total
    scale = np.sqrt(np.maximum(np.diagonal(squares.sum(axis=0)) / total - centre**2, 0))
    scale[scale < 1e-6] = 1.0
    means = [(sums[c] / counts[c] - centre) / scale for c in (0, 1)]
    covariances = []
    for c in (0, 1):
        mean = sums[c] / counts[c]
        covariances.append((squares[c] / counts[c] - np.outer(mean, mean)) / np.outer(scale, scale))
    within = sum(n * s for n, s in zip(counts, covariances, strict=True)) / total
    factors, dets = [], []
    for c in (0, 1):
        s = (counts[c] * covariances[c] + prior * within) / (counts[c] + prior)
        s = (1 - ridge) * s + ridge * max(np.trace(s) / len(s), 1e-3) * np.eye(len(s))
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        dets.append(2 * float(np.log(np.diagonal(low)).sum()))
    return Discriminant(float(np.log(counts[1] / counts[0])), centre, scale, tuple(means), tuple(factors), tuple(dets))


def losses(model: Discriminant, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The summed log loss of the rows for each of ``HEATS``."""
    sign, margin = np.where(y == 1, 1, -1), model.margins(x)
    return np.array([np.logaddexp(0, -sign * np.clip(model.odds + margin / heat, -60, 60)).sum() for heat in HEATS])


def train(measured: DataFrame, labels: DataFrame, column: str = "quality") -> Discriminant:
    """Moments, and then log losses, of all rows of ``measured`` (doc_id, x) that have a label, summed by the cluster."""
    known = labels.filter(F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    d = len(STATISTICS)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, d))
            for c in (0, 1):
                own = x[batch["y"].to_numpy() == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pd.DataFrame({"y": [0, 1], "m": list(total)})

    rows = materialize(measured.join(known, "doc_id").select("x", "y"), "labelled")
    sums = rows.mapInPandas(moments, "y int, m array<double>").select("y", F.posexplode("m")).groupBy("y", "pos").agg(F.sum("col").alias("s"))
    m = np.zeros((2, 1 + d + d * d))
    for r in sums.collect():
        m[r["y"], r["pos"]] = r["s"]
    model = fit(m[:, 0], m[:, 1 : 1 + d], m[:, 1 + d :].reshape(2, d, d))
    if not model.means:
        return model

    def loss(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(HEATS))
        for batch in batches:
            if len(batch):
                total += losses(model, np.stack(batch["x"].to_numpy()), batch["y"].to_numpy())
        yield pd.DataFrame({"pos": np.arange(len(HEATS)), "loss": total})

    found = rows.mapInPandas(loss, "pos int, loss double").groupBy("pos").agg(F.sum("loss").alias("s")).orderBy("s", "pos").first()
    model.heat = HEATS[found["pos"]]
    return model


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document; learned from the folds 0 and 2 of three."""
    measured = materialize(measure(docs), "statistics")
    held = fold(F.col("doc_id"), 3) == 1
    model = train(measured.filter(~held), labels)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model(np.stack(batch.to_numpy())) if len(batch) else [], dtype=float)

    out = measured.select("doc_id", held.alias("held_out"), score("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
