"""Statistics of benchmark runs: Wilson intervals, nearest-rank percentiles, skylines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.96


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """(low, high) of the 95 % interval of a share, within 0 and 1; both 0 without rows."""
    p = hits / n
    spread = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    low, high = ((p + Z * Z / (2 * n) + sign * spread) / (1 + Z * Z / n) for sign in (-1, 1))
    clamp = lambda c: F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))).otherwise(F.lit(0.0))
    return clamp(low), clamp(high)


def nearest_rank(df: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """(by, p<share>...): the value at place floor(share x n) of the sorted values.

    Equal values are counted before they are ordered, so that a group's window has its distinct values only.
    """
    from pyspark.sql import Window

    counted = df.groupBy(by, value).agg(F.count("*").alias("_c"))
    total = counted.groupBy(by).agg(F.sum("_c").alias("_n"))
    up_to = F.sum("_c").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("_end", up_to).join(total, by)
    place = lambda s: F.least(F.floor(F.lit(s) * F.col("_n")), F.col("_n") - 1)
    at = lambda s: F.max(F.when((F.col("_end") > place(s)) & (F.col("_end") - F.col("_c") <= place(s)), F.col(value)))
    return ranked.groupBy(by).agg(*(at(s).alias(f"p{round(100 * s)}") for s in shares))


def skyline(points: DataFrame, up: list[str], down: list[str], groups: int = 16, key: str = "id") -> DataFrame:
    """The points that no other dominates: as good in all columns and better in one."""
    if len(up) + len(down) == 2:
        return _skyline_of_two(points, *(F.col(c) for c in up), *(-F.col(c) for c in down))
    return _skyline_by_rounds(points, up, down, groups, key)


def _skyline_of_two(points: DataFrame, x: Column, y: Column) -> DataFrame:
    """Of each x the best y, if it is better than that of every greater x: running maxima within ranges of x, and over the ranges' maxima."""
    from pyspark.sql import Window

    from galena.operators.traverse import cut

    best = points.select(x.cast("double").alias("_x"), y.cast("double").alias("_y")).groupBy("_x").agg(F.max("_y").alias("_y"))
    ranged = cut(best.repartitionByRange(F.col("_x").desc()).withColumn("_part", F.spark_partition_id()))
    tops = ranged.groupBy("_part").agg(F.max("_y").alias("_top"))  # a row for each range
    before = F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    own = F.max("_y").over(Window.partitionBy("_part").orderBy(F.desc("_x")).rowsBetween(Window.unboundedPreceding, -1))
    front = ranged.withColumn("_own", own).join(F.broadcast(tops.select("_part", before.alias("_before"))), "_part")
    front = front.filter(F.col("_y") > F.coalesce(F.greatest("_own", "_before"), F.lit(float("-inf")))).select("_x", "_y")
    marked = points.withColumns({"_x": x.cast("double"), "_y": y.cast("double")})
    return marked.join(front, ["_x", "_y"], "left_semi").select(*points.columns)


def _skyline_by_rounds(points: DataFrame, up: list[str], down: list[str], groups: int, key: str) -> DataFrame:
    """Parts drop their dominated points, and meet in ever fewer parts; a task holds the points that are left of its part."""
    import numpy as np
    import pandas as pd

    from galena.operators.traverse import cut

    def keep(batches):
        kept, rows = np.empty((0, len(up) + len(down))), None
        for batch in batches:
            x = np.concatenate([batch[up].to_numpy(float), -batch[down].to_numpy(float)], axis=1)
            order = np.argsort(-x.sum(axis=1), kind="stable")
            alive = []
            for k in order:
                if not ((kept >= x[k]).all(axis=1) & (kept > x[k]).any(axis=1)).any():
                    alive.append(k)
            x, batch = x[alive], batch.iloc[alive]
            ok = np.array([not ((x >= v).all(axis=1) & (x > v).any(axis=1)).any() for v in x], bool)
            x, batch = x[ok], batch[ok]
            stays = np.array([not ((x >= v).all(axis=1) & (x > v).any(axis=1)).any() for v in kept], bool)
            rows = batch if rows is None else pd.concat([rows[stays], batch], ignore_index=True)
            kept = np.concatenate([kept[stays] if len(kept) else kept, x])
        if rows is not None and len(rows):
            yield rows

    out = points
    while True:
        out = cut(out.repartition(groups, key).mapInPandas(keep, points.schema))
        if groups == 1:
            return out
        groups = max(1, groups // 4)
