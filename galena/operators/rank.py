"""Ranking: top-k within groups, reciprocal rank fusion, dominance gaps, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def top(df: DataFrame, by: list[str], order: list[Column], k: int, into: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, with their rank from 1."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(into) <= k)


def fuse(lists: DataFrame, key: str, source: str = "source", rank: str = "rank", base: int = 1) -> DataFrame:
    """(key, score): the sum over sources of 1 / (60 + rank); ``base`` is the first rank that counts (0 or 1)."""
    return lists.groupBy(key).agg(F.sum(1.0 / (RRF_K + F.col(rank) - 1 + base)).alias("score"))


def transitions(history: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The rows at which ``value`` differs from the one before, and each key's first row."""
    w = Window.partitionBy(key).orderBy(order)
    return history.withColumn("_first", F.row_number().over(w) == 1).withColumn("_same", F.lag(value).over(w).eqNullSafe(F.col(value))).filter("_first or not _same").drop("_first", "_same")


def dominant(scored: DataFrame, by: str, score: str = "score", least: float = 0.95, gap: float = 0.09) -> DataFrame:
    """Each group's best row with ``accepted``: it reaches ``least`` and leads the second by more than ``gap``."""
    w = Window.partitionBy(by).orderBy(F.desc(score), "id")
    out = scored.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w)).filter("_k = 1")
    return out.withColumn("accepted", (F.col(score) >= least) & (F.coalesce(F.col(score) - F.col("_next"), F.lit(1.0)) > gap)).drop("_k", "_next")
