"""Queries over the property graph: neighbourhoods, impact, traces, communities, ancestry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galena.model import GRAPH_CTE, edges, load, nodes, stored_edges
from galena.operators import traverse
from galena.registry import query

#: The rule for paths of tests, as SQL over ``file_path``.
TESTS_SQL = " OR ".join(
    [f"contains('/' || lower(file_path), '{x}')" for x in (".test.", ".spec.", "__tests__/", "__mocks__/")]
    + [f"contains(lower(file_path), '{x}')" for x in ("/test/", "/tests/", "/testing/", "/fixtures/", "/spec/", "/test_", "/conftest.")]
    + [f"ends_with(lower(file_path), '{x}')" for x in ("_test.go", "_test.py", "_spec.rb", "_test.rb")]
)


@query(
    f"""
WITH RECURSIVE {GRAPH_CTE}, walk(id, depth) AS (
  SELECT 'Nation:3', 0 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.id
  WHERE w.depth < 3 AND e.type IN ('CONTAINS', 'CALLS') AND e.dst NOT IN (SELECT id FROM nodes WHERE {TESTS_SQL})
), d AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)
SELECT depth, count(*) AS n FROM d WHERE depth > 0 GROUP BY depth
"""
)
def GR01_impact_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = nodes(spark, sf_dir).filter(F.col("file_path").rlike(traverse.TEST_PATH)).select("id")
    kinds = stored_edges(spark, sf_dir).filter(F.col("type").isin("CONTAINS", "CALLS"))
    found = traverse.bfs(kinds, spark.createDataFrame([("Nation:3",)], "id string"), 3, blocked=tests)
    return found.filter("depth > 0").groupBy("depth").agg(F.count("*").alias("n"))


def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: what depends on a supplier, by depth, with the risk of changing it."""
    e = stored_edges(spark, sf_dir)
    up = e.filter(F.col("type").isin(*traverse.IMPACT_TYPES))
    found = traverse.bfs(up, spark.createDataFrame([("Supplier:1",)], "id string"), 3, "upstream").filter("depth > 0")
    steps = e.filter("type = 'STEP_IN_PROCESS'").join(found, F.col("src") == F.col("id")).agg(F.countDistinct("dst").alias("processes"))
    total = found.agg(F.count("*").alias("total"), F.count(F.when(F.col("depth") == 1, 1)).alias("direct"))
    return total.crossJoin(F.broadcast(steps)).withColumn("risk", traverse.risk(F.col("direct"), F.col("processes"), F.lit(0), F.col("total")))


@query(
    f"""
WITH RECURSIVE {GRAPH_CTE}, up AS (SELECT DISTINCT src, dst FROM edges WHERE type IN ('CALLS', 'IMPORTS', 'EXTENDS')),
walk(id, depth) AS (SELECT 'Supplier:1', 0 UNION SELECT u.src, w.depth + 1 FROM walk w JOIN up u ON u.dst = w.id WHERE w.depth < 3),
d AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id HAVING min(depth) > 0),
t AS (SELECT count(*) AS total, count(*) FILTER (depth = 1) AS direct FROM d),
p AS (SELECT count(DISTINCT e.dst) AS processes FROM edges e JOIN d ON d.id = e.src WHERE e.type = 'STEP_IN_PROCESS')
SELECT total, direct, processes, CASE WHEN direct >= 30 OR processes >= 5 OR total >= 200 THEN 'CRITICAL'
  WHEN direct >= 15 OR processes >= 3 OR total >= 100 THEN 'HIGH' WHEN direct >= 5 OR total >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM t, p
"""
)
def TL06_impact_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact(spark, sf_dir)


@query(
    f"""
WITH {GRAPH_CTE} SELECT type, count(*) AS n, round(avg(CASE type WHEN 'CALLS' THEN .9 WHEN 'IMPORTS' THEN .9 WHEN 'EXTENDS' THEN .85 WHEN 'CONTAINS' THEN .95 ELSE .5 END), 4) AS floor,
  round(avg(greatest(confidence, CASE type WHEN 'CALLS' THEN .9 WHEN 'IMPORTS' THEN .9 WHEN 'EXTENDS' THEN .85 WHEN 'CONTAINS' THEN .95 ELSE .5 END)), 4) AS effective FROM edges GROUP BY type
"""
)
def GR03_confidence_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    floor = traverse.floor_of(F.col("type"))
    out = edges(spark, sf_dir).withColumn("f", floor).groupBy("type")
    return out.agg(F.count("*").alias("n"), F.round(F.avg("f"), 4).alias("floor"), F.round(F.avg(F.greatest("confidence", "f")), 4).alias("effective"))


@query(
    f"""
WITH {GRAPH_CTE}, hit AS (SELECT DISTINCT src AS id FROM edges WHERE type = 'CALLS' AND dst = 'Part:7')
SELECT e.dst AS process, count(DISTINCT e.src) AS hits, min(e.step) AS first_step FROM edges e JOIN hit h ON h.id = e.src WHERE e.type = 'STEP_IN_PROCESS' GROUP BY e.dst
"""
)
def GR04_impact_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    hit = e.filter("type = 'CALLS' and dst = 'Part:7'").select("src").distinct()
    rows = e.filter("type = 'STEP_IN_PROCESS'").join(hit, "src", "left_semi")
    return rows.groupBy(F.col("dst").alias("process")).agg(F.countDistinct("src").alias("hits"), F.min("step").alias("first_step"))


@query(
    f"""
WITH {GRAPH_CTE}, d AS (SELECT DISTINCT src AS id, 1 AS depth FROM edges WHERE type = 'CALLS' AND dst IN (SELECT 'Order:' || o_orderkey FROM orders WHERE o_orderkey % 50 = 0))
SELECT m.dst AS module, count(*) AS hits, max(CASE WHEN d.depth = 1 THEN 1 ELSE 0 END) AS direct FROM d JOIN edges m ON m.src = d.id AND m.type = 'MEMBER_OF' GROUP BY m.dst ORDER BY hits DESC, module LIMIT 20
"""
)
def GR05_impact_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    seeds = load(spark, sf_dir, "orders").filter("o_orderkey % 50 = 0").select(F.concat(F.lit("Order:"), "o_orderkey").alias("id"))
    near = traverse.bfs(e.filter("type = 'CALLS'"), seeds, 1, "upstream").filter("depth = 1")
    rows = near.join(e.filter("type = 'MEMBER_OF'"), F.col("id") == F.col("src"))
    out = rows.groupBy(F.col("dst").alias("module")).agg(F.count("*").alias("hits"), F.max((F.col("depth") == 1).cast("int")).alias("direct"))
    return out.orderBy(F.desc("hits"), "module").limit(20)


@query(
    f"""
WITH RECURSIVE {GRAPH_CTE}, call AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM (SELECT DISTINCT src, dst FROM edges WHERE type IN ('CALLS', 'IMPORTS'))),
hop AS (SELECT src, dst FROM call WHERE k <= 4),
t(entry, path, open) AS (
  SELECT id, [id], true FROM (SELECT 'Customer:' || c_custkey AS id FROM customer)
  UNION ALL SELECT t.entry, list_append(t.path, h.dst), true FROM t JOIN hop h ON h.src = t.path[-1] WHERE len(t.path) < 10 AND NOT list_contains(t.path, h.dst)
), done AS (
  SELECT t.entry, t.path FROM t WHERE len(t.path) >= 3 AND (len(t.path) >= 10 OR NOT EXISTS (SELECT 1 FROM hop h WHERE h.src = t.path[-1] AND NOT list_contains(t.path, h.dst)))
), ranked AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY len(path), path) AS k FROM done)
SELECT entry, array_to_string(path, '>') AS path FROM ranked WHERE k <= 12
"""
)
def GR10_process_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = load(spark, sf_dir, "customer").select(F.concat(F.lit("Customer:"), "c_custkey").alias("id"))
    calls = stored_edges(spark, sf_dir).filter(F.col("type").isin("CALLS", "IMPORTS"))
    return traverse.traces(calls, entries).select("entry", F.array_join("path", ">").alias("path"))


@query(
    f"""
WITH {GRAPH_CTE}, c AS (SELECT src, dst FROM edges WHERE type = 'CALLS'),
o AS (SELECT src AS id, count(*) AS callees FROM c GROUP BY src), i AS (SELECT dst AS id, count(*) AS callers FROM c GROUP BY dst)
SELECT n.id, o.callees, coalesce(i.callers, 0) AS callers, round(o.callees * 1.0 / (coalesce(i.callers, 0) + 1) * CASE WHEN n.is_exported THEN 2 ELSE 1 END, 4) AS score
FROM nodes n JOIN o USING (id) LEFT JOIN i USING (id) WHERE NOT ({TESTS_SQL}) ORDER BY score DESC, n.id LIMIT 200
"""
)
def GR11_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = edges(spark, sf_dir).filter("type = 'CALLS'")
    out = c.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees"))
    into = c.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    n = nodes(spark, sf_dir).filter(~F.col("file_path").rlike(traverse.TEST_PATH)).join(out, "id").join(into, "id", "left")
    score = F.col("callees") / (F.coalesce("callers", F.lit(0)) + 1) * F.when(F.col("is_exported"), 2).otherwise(1)
    return n.select("id", "callees", F.coalesce("callers", F.lit(0)).alias("callers"), F.round(score, 4).alias("score")).orderBy(F.desc("score"), "id").limit(200)


@query(f"WITH {GRAPH_CTE} SELECT src, string_agg(dst, ',' ORDER BY dst) AS callees FROM edges WHERE type = 'CALLS' AND confidence >= 0.95 GROUP BY src")
def GR12_trace_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).filter("type = 'CALLS' and confidence >= 0.95")
    return e.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("callees"))


@query(
    f"""
WITH {GRAPH_CTE}, p AS (SELECT o.o_custkey AS flow, string_agg(o.o_orderstatus, '' ORDER BY o.o_orderdate, o.o_orderkey) AS path, count(*) AS n FROM orders o GROUP BY o.o_custkey)
SELECT a.flow FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.flow <> a.flow AND (b.n > a.n OR (b.n = a.n AND b.flow < a.flow)) AND contains(b.path, a.path))
"""
)
def GR13_subset_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]), "")
    p = o.groupBy(F.col("o_custkey").alias("flow")).agg(path.alias("path"), F.count("*").alias("n"))
    # equal paths first: of each, the one that stays; it goes if it is a part of another path, whose parts are listed
    one = p.groupBy("path", "n").agg(F.min("flow").alias("flow"))
    n = F.length("path")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(F.col("path"), i, k))))
    shorter = one.select(F.explode(F.filter(F.array_distinct(parts), lambda x: F.length(x) < n)).alias("path")).distinct()
    return one.join(shorter, "path", "left_anti").select("flow")


@query(
    f"""
WITH {GRAPH_CTE}, t AS (SELECT c.src AS head, i.dst AS tail, c.dst AS via, i.src AS part FROM edges c JOIN edges i ON i.src = c.dst AND i.type = 'CALLS' WHERE c.type = 'CALLS' AND c.src LIKE 'Customer:%'),
r AS (SELECT *, row_number() OVER (PARTITION BY head, tail ORDER BY via) AS k FROM t) SELECT head, tail, via FROM r WHERE k = 1
"""
)
def GR14_endpoint_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).filter("type = 'CALLS'").select("src", "dst")
    t = e.filter("src like 'Customer:%'").select(F.col("src").alias("head"), F.col("dst").alias("via")).join(e.select(F.col("src").alias("via"), F.col("dst").alias("tail")), "via")
    return t.groupBy("head", "tail").agg(F.min("via").alias("via"))


@query()
def GR16_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).filter(F.col("type").isin("CALLS", "EXTENDS"))
    return traverse.propagate(e).groupBy("community").agg(F.count("*").alias("members"))


@query(f"WITH {GRAPH_CTE} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE type IN ('CALLS', 'EXTENDS', 'IMPORTS') AND src <> dst")
def GR17_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).filter(F.col("type").isin("CALLS", "EXTENDS", "IMPORTS") & (F.col("src") != F.col("dst")))
    return e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


@query(
    """
WITH m AS (SELECT c_custkey AS id, c_mktsegment AS community FROM customer), e AS (SELECT o_custkey AS a, (o_custkey * 7 + o_orderkey) % (SELECT count(*) FROM customer) + 1 AS b FROM orders)
SELECT x.community, round(avg(CASE WHEN x.community = y.community THEN 1.0 ELSE 0.0 END), 4) AS cohesion, count(*) AS visits FROM e JOIN m x ON x.id = e.a JOIN m y ON y.id = e.b GROUP BY x.community
"""
)
def GR18_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    n = c.count()
    e = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % n + 1).alias("b"))
    x, y = c.select(F.col("c_custkey").alias("a"), F.col("c_mktsegment").alias("community")), c.select(F.col("c_custkey").alias("b"), F.col("c_mktsegment").alias("other"))
    same = (F.col("community") == F.col("other")).cast("double")
    return e.join(x, "a").join(y, "b").groupBy("community").agg(F.round(F.avg(same), 4).alias("cohesion"), F.count("*").alias("visits"))


@query(
    """
WITH n AS (SELECT p_brand AS community, p_type AS folder, count(*) AS c FROM part GROUP BY p_brand, p_type), r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY c DESC, folder) AS k FROM n)
SELECT community, folder AS label FROM r WHERE k = 1
"""
)
def GR19_community_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("community"), F.col("p_type").alias("folder")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("community").orderBy(F.desc("c"), "folder")
    return n.withColumn("k", F.row_number().over(w)).filter("k = 1").select("community", F.col("folder").alias("label"))


@query(
    """
WITH RECURSIVE p AS (SELECT o_orderkey AS child, (o_orderkey * 3) // 4 AS parent FROM orders WHERE o_orderkey > 0 UNION ALL SELECT o_orderkey, o_orderkey // 2 FROM orders WHERE o_orderkey > 0),
w(child, ancestor, depth) AS (SELECT o_orderkey, o_orderkey, 0 FROM orders WHERE o_orderkey % 50 = 0 UNION SELECT w.child, p.parent, w.depth + 1 FROM w JOIN p ON p.child = w.ancestor)
SELECT child, ancestor, min(depth) AS depth FROM w GROUP BY child, ancestor
"""
)
def GR21_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("child"))
    p = o.withColumn("parent", F.expr("child * 3 div 4")).unionByName(o.withColumn("parent", F.expr("child div 2"))).filter("child > 0")
    return traverse.ancestors(p, o.filter("child % 50 = 0").select(F.col("child").alias("id")), 1000)


@query(
    """
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey % 12 AS src, l_partkey % 12 + 1 + l_suppkey % 3 AS dst FROM lineitem),
n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), w(id, level) AS (SELECT id, 0 FROM n UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON e.src = w.id)
SELECT id, max(level) AS level FROM w GROUP BY id
"""
)
def GR27_topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = load(spark, sf_dir, "lineitem")
    return traverse.levels(l.select(F.expr("l_partkey % 12").alias("src"), F.expr("l_partkey % 12 + 1 + l_suppkey % 3").alias("dst")))


COMMITS = """c AS (SELECT o_orderkey AS id, o_orderkey // 2 AS parent FROM orders WHERE o_orderkey > 0 UNION ALL SELECT o_orderkey, o_orderkey // 3 FROM orders WHERE o_orderkey > 0 AND o_orderkey % 5 = 0)"""


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a commit with the order of half its key as its parent; every fifth is a merge with a second one."""
    o = load(spark, sf_dir, "orders").filter("o_orderkey > 0").select(F.col("o_orderkey").cast("string").alias("child"), F.col("o_orderkey").alias("k"))
    both = o.select("child", F.expr("k div 2").cast("string").alias("parent"))
    return both.unionByName(o.filter("k % 5 = 0").select("child", F.expr("k div 3").cast("string").alias("parent")))


def _head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").agg(F.max("o_orderkey").cast("string").alias("id"))


@query(
    f"WITH RECURSIVE {COMMITS}, w(id, depth) AS (SELECT max(o_orderkey), 0 FROM orders UNION SELECT c.parent, w.depth + 1 FROM w JOIN c ON c.id = w.id) SELECT CAST(id AS VARCHAR) AS ancestor, min(depth) AS depth FROM w GROUP BY id"
)
def GR30_commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.ancestors(_commits(spark, sf_dir), _head(spark, sf_dir), 10_000).select("ancestor", "depth")


@query(
    f"""
WITH RECURSIVE {COMMITS}, w(child, id, depth) AS (SELECT * FROM (VALUES (60, 60, 0), (44, 44, 0)) UNION SELECT w.child, c.parent, w.depth + 1 FROM w JOIN c ON c.id = w.id),
m AS (SELECT child, id, min(depth) AS depth FROM w GROUP BY child, id)
SELECT CAST(a.id AS VARCHAR) AS ancestor, a.depth AS da, b.depth AS db FROM m a JOIN m b ON a.id = b.id WHERE a.child = 60 AND b.child = 44 ORDER BY db, da, ancestor LIMIT 1
"""
)
def GR31_common_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.common_ancestor(_commits(spark, sf_dir), "60", "44", 10_000).select("ancestor", "da", "db")


@query(
    f"""
WITH RECURSIVE {COMMITS}, w(id) AS (SELECT max(o_orderkey) FROM orders UNION SELECT c.parent FROM w JOIN c ON c.id = w.id)
SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey > 0 AND o_orderkey NOT IN (SELECT id FROM w)
"""
)
def GR32_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = traverse.cut(_commits(spark, sf_dir))
    live = traverse.bfs(p.select(F.col("child").alias("src"), F.col("parent").alias("dst")), _head(spark, sf_dir), 1 << 30).select("id")
    return p.select(F.col("child").alias("id")).distinct().join(live, "id", "left_anti")
