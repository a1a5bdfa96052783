"""Graph traversal to a fixpoint: each level is one join, and lineage is cut between levels."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The edge types of an impact search and their confidence floors.
IMPACT_TYPES = ("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "METHOD_OVERRIDES", "OVERRIDES", "METHOD_IMPLEMENTS")
FLOORS = {
    "CALLS": 0.9, "IMPORTS": 0.9, "EXTENDS": 0.85, "IMPLEMENTS": 0.85, "METHOD_OVERRIDES": 0.85, "METHOD_IMPLEMENTS": 0.85,
    "HAS_METHOD": 0.95, "HAS_PROPERTY": 0.95, "ACCESSES": 0.8, "CONTAINS": 0.95,
}
# What marks the path of a test, in lower case.
TEST_PATH = r"(?i)\.test\.|\.spec\.|__tests__/|__mocks__/|/tests?/|/testing/|/fixtures/|_test\.(?:go|py)$|_(?:spec|test)\.rb$|/spec/|/test_|/conftest\."


#: Rows of a frontier or seed list up to which it is broadcast.
FEW = 100_000


def shared_base(spark) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one below the warehouse of a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (base or f"{spark.conf.get('spark.sql.warehouse.dir')}/shared").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a table written into the shared checkpoint folder."""
    spark = df.sparkSession
    path = f"{shared_base(spark)}/galena-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """``df``, a table that was written, as the broadcast side of a join if it has ``FEW`` rows at most."""
    return F.broadcast(df) if df.count() <= FEW else df


def floor_of(kind: Column) -> Column:
    """The confidence floor of an edge type; 0.5 if it is unknown."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in FLOORS.items() for x in pair))[kind], F.lit(0.5))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "downstream", blocked: DataFrame | None = None) -> DataFrame:
    """(id, depth) of the nodes within ``depth`` edges of ``seeds`` (id), each at its least depth; seeds have depth 0.

    ``blocked`` (id): nodes that are neither reached nor passed. The edges are joined
    as they are, once a level; only the nodes that are reached are made distinct.
    """
    hop = edges.select("src", "dst") if direction == "downstream" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    visited = frontier = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    for level in range(1, depth + 1):
        reached = hop.join(small(frontier.select(F.col("id").alias("src"))), "src").select(F.col("dst").alias("id")).distinct().join(visited, "id", "left_anti")
        if blocked is not None:
            reached = reached.join(blocked.select("id"), "id", "left_anti")
        frontier = cut(reached.withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def risk(direct: Column, processes: Column, modules: Column, total: Column) -> Column:
    """The bucket of an impact's size."""
    return (
        F.when((direct >= 30) | (processes >= 5) | (modules >= 5) | (total >= 200), "CRITICAL")
        .when((direct >= 15) | (processes >= 3) | (modules >= 3) | (total >= 100), "HIGH")
        .when((direct >= 5) | (total >= 30), "MEDIUM")
        .otherwise("LOW")
    )


def merged_risk(own: Column, crossings: Column, best: Column) -> Column:
    """A risk with the links to other repositories: three or more are critical, one of high confidence is high, any lifts a low one."""
    return (
        F.when((own == "CRITICAL") | (crossings >= 3), "CRITICAL").when((crossings > 0) & (best >= 0.85), "HIGH").when((crossings > 0) & (own == "LOW"), "MEDIUM").otherwise(own)
    )


def traces(edges: DataFrame, entries: DataFrame, branching: int = 4, depth: int = 10, least: int = 3, most: int = 12) -> DataFrame:
    """(entry, path): call paths from ``entries`` (id) that end at a leaf, at ``depth``, or where all callees repeat.

    Of a node's callees the first ``branching`` by id are followed; of an entry's
    paths the first ``most`` (shorter first, then by ids) of ``least`` steps or more stay.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("src").orderBy("dst")
    hop = cut(edges.select("src", "dst").distinct().withColumn("k", F.row_number().over(w)).filter(F.col("k") <= branching).groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("to")))
    now = entries.select(F.col("id").alias("entry"), F.array("id").alias("path")).distinct()
    done = full = None
    for _ in range(depth):
        ahead = now.join(hop, F.element_at("path", -1) == F.col("src"), "left")
        ahead = cut(ahead.select("entry", "path", F.array_except(F.coalesce("to", F.array().cast("array<string>")), "path").alias("next")))
        last = (F.size("next") == 0) | (F.size("path") >= depth)
        ends = ahead.filter(last & (F.size("path") >= least)).select("entry", "path")
        done = ends if done is None else done.unionByName(ends)
        live = ahead.filter(~last)
        if live.isEmpty():
            break
        # paths end in the order of their lengths: an entry with enough of them needs no longer ones
        full = cut(done.groupBy("entry").count().filter(F.col("count") >= most).select("entry"))
        now = live.join(full, "entry", "left_anti").select("entry", F.explode("next").alias("n"), "path").select("entry", F.concat("path", F.array("n")).alias("path"))
    order = Window.partitionBy("entry").orderBy(F.size("path"), "path")
    return done.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k")


def levels(edges: DataFrame) -> DataFrame:
    """(id, level) by Kahn's method: a node's level follows that of its last source; nodes on or behind a cycle have level -1."""
    rest = cut(edges.select("src", "dst").filter("src != dst").distinct())
    ids = cut(rest.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    out, level = None, 0
    while True:
        free = cut(ids.join(rest.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            last = ids.withColumn("level", F.lit(-1))
            return last if out is None else out.unionByName(last)
        out = free if out is None else out.unionByName(free)
        ids = cut(ids.join(free, "id", "left_anti"))
        rest = cut(rest.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        level += 1


def ancestors(parents: DataFrame, seeds: DataFrame, depth: int = 32) -> DataFrame:
    """(child, ancestor, depth) of every seed (id): the least distance over ``parents`` (child, parent)."""
    now = cut(seeds.select(F.col("id").alias("child"), F.col("id").alias("ancestor")).distinct().withColumn("depth", F.lit(0)))
    out = now
    for level in range(1, depth + 1):
        step = now.join(parents.select(F.col("child").alias("ancestor"), "parent"), "ancestor")
        step = step.select("child", F.col("parent").alias("ancestor")).distinct().join(out, ["child", "ancestor"], "left_anti")
        now = cut(step.withColumn("depth", F.lit(level)))
        if now.isEmpty():
            break
        out = out.unionByName(now)
    return out


def common_ancestor(parents: DataFrame, a: str, b: str, depth: int = 1000) -> DataFrame:
    """The ancestor of ``a`` that is nearest to ``b`` (ties: nearest to ``a``, then by id), one row at most."""
    spark = parents.sparkSession
    up = ancestors(parents, spark.createDataFrame([(a,), (b,)], "id string"), depth)
    left = up.filter(F.col("child") == a).select("ancestor", F.col("depth").alias("da"))
    right = up.filter(F.col("child") == b).select("ancestor", F.col("depth").alias("db"))
    return left.join(right, "ancestor").orderBy("db", "da", "ancestor").limit(1)


def propagate(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community) by label propagation: each round a node takes the most frequent label of its neighbours, ties by the least."""
    from pyspark.sql import Window

    pairs = cut(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a != b").distinct())
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")))
    w = Window.partitionBy("a").orderBy(F.desc("n"), "community")
    for _ in range(rounds):
        votes = both.join(labels, both["b"] == labels["id"]).groupBy("a", "community").agg(F.count("*").alias("n"))
        best = votes.withColumn("k", F.row_number().over(w)).filter("k = 1").select(F.col("a").alias("id"), "community")
        best = cut(best)
        if best.exceptAll(labels).isEmpty():
            return best
        labels = best
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the modularity of ``labels`` (id, community) over the undirected pairs of ``edges``."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a != b").distinct()
    named = pairs.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b")
    ends = named.select(F.explode(F.array("ca", "cb")).alias("c"), (F.col("ca") == F.col("cb")).cast("int").alias("inside"))
    parts = ends.groupBy("c").agg(F.count("*").alias("degree"), F.sum("inside").alias("twice"))
    total = parts.agg(F.sum("degree").alias("m2"))
    return parts.crossJoin(F.broadcast(total)).agg(F.round(F.sum(F.col("twice") / F.col("m2") - (F.col("degree") / F.col("m2")) ** 2), 6).alias("modularity"))
