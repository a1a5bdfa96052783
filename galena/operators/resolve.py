"""Name resolution: linear orders of ancestors, inherited members, re-export chains, evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.operators.traverse import ancestors, cut


def merge_orders(lists: list[list[str]]) -> list[str] | None:
    """The C3 merge: heads that no list has later, in order; None if there is no consistent order."""
    out, rest = [], [list(x) for x in lists if x]
    while rest:
        head = next((x[0] for x in rest if not any(x[0] in y[1:] for y in rest)), None)
        if head is None:
            return None
        out.append(head)
        rest = [y for y in ([c for c in x if c != head] if x[0] == head else x for x in rest) if y]
    return out


def c3(name: str, parents: dict[str, list[str]], path: tuple[str, ...] = (), known: dict[str, list[str] | None] | None = None) -> list[str] | None:
    """The linear order of a class and its ancestors; None for a cycle or inconsistent parents.

    ``known`` keeps the orders of ancestors, which many classes share.
    """
    known = {} if known is None else known
    if name in path:
        return None
    if name not in known:
        own = parents.get(name, [])
        orders = [c3(p, parents, (*path, name), known) for p in own]
        merged = None if any(o is None for o in orders) else merge_orders([*orders, own])
        known[name] = None if merged is None else [name, *merged]
    return known[name]


def linearize(heritage: DataFrame, seeds: DataFrame, depth: int = 32) -> DataFrame:
    """(id, order) of every seed (id): the C3 order over ``heritage`` (child, parent, position); null if there is none.

    A class meets only the edges of its own ancestors, in one group.
    """
    up = ancestors(heritage.select("child", "parent"), seeds, depth).select(F.col("child").alias("id"), F.col("ancestor").alias("child"))
    own = up.join(heritage, "child", "left")

    def order(group: pd.DataFrame) -> pd.DataFrame:
        parents: dict[str, list[str]] = {}
        for r in group.dropna(subset=["parent"]).drop_duplicates().sort_values(["child", "position"]).itertuples():
            parents.setdefault(r.child, []).append(r.parent)
        name = group["id"].iloc[0]
        return pd.DataFrame({"id": [name], "order": [c3(name, parents)]})

    return own.groupBy("id").applyInPandas(order, "id string, order array<string>")


def inherited(order: DataFrame, members: DataFrame, key: str = "name") -> DataFrame:
    """(id, key, owner): for each class the first owner of each member in its order."""
    place = order.select("id", F.posexplode("order").alias("k", "owner"))
    return place.join(members, "owner").groupBy("id", key).agg(F.min_by("owner", "k").alias("owner"))


def follow(exports: DataFrame, start: DataFrame, hops: int = 5) -> DataFrame:
    """(file, name, to_file, to_name): re-exports followed up to ``hops`` times; a chain stops where it would repeat."""
    e = exports.select(F.col("file").alias("at_file"), F.col("name").alias("at_name"), F.col("to_file").alias("f"), F.col("to_name").alias("n"))
    now = start.select("file", "name", F.col("file").alias("to_file"), F.col("name").alias("to_name"), F.array(F.concat_ws("|", "file", "name")).alias("seen"))
    for _ in range(hops):
        step = now.join(e, (F.col("to_file") == F.col("at_file")) & (F.col("to_name") == F.col("at_name")), "left")
        go = F.col("f").isNotNull() & ~F.array_contains("seen", F.concat_ws("|", "f", "n"))
        now = cut(
            step.select(
                "file", "name", F.when(go, F.col("f")).otherwise(F.col("to_file")).alias("to_file"), F.when(go, F.col("n")).otherwise(F.col("to_name")).alias("to_name"),
                F.when(go, F.concat("seen", F.array(F.concat_ws("|", "f", "n")))).otherwise(F.col("seen")).alias("seen"),
            )
        )
    return now.drop("seen")


def confidence(weights: Column) -> Column:
    """The sum of an array of evidence weights, within 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)))


