"""Scans, filters, joins, aggregates, windows and set operations of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galena.model import GRAPH_CTE, edges, load, nodes
from galena.operators import rank, stats, traverse, versioned
from galena.registry import query


@query(f"WITH {GRAPH_CTE} SELECT id, name, label FROM nodes WHERE label = 'Supplier' ORDER BY id LIMIT 25")
def SRC14_node_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).filter("label = 'Supplier'").select("id", "name", "label").orderBy("id").limit(25)


@query(f"WITH {GRAPH_CTE} SELECT label, count(*) AS n FROM nodes GROUP BY label")
def SRC15_labelless_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH_CTE} SELECT src, dst, type FROM edges WHERE type IN ('CALLS', 'IMPORTS') AND confidence >= 0.97")
def FLT01_type_and_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).filter(F.col("type").isin("CALLS", "IMPORTS") & (F.col("confidence") >= 0.97)).select("src", "dst", "type")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND starts_with(p_brand, 'Brand#1') AND p_type IS NOT NULL AND NOT ends_with(p_name, 'z')")
def FLT02_string_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    keep = F.lower("p_name").contains("a") & F.col("p_brand").startswith("Brand#1") & F.col("p_type").isNotNull() & ~F.col("p_name").endswith("z")
    return p.filter(keep).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE (o_orderkey <= 120 AND o_orderkey + o_custkey % 9 >= 100) OR (o_orderkey <= 420 AND o_orderkey + o_custkey % 9 >= 400)")
def FLT03_range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").withColumn("e", F.col("o_orderkey") + F.col("o_custkey") % 9)
    return o.filter("(o_orderkey <= 120 and e >= 100) or (o_orderkey <= 420 and e >= 400)").select("o_orderkey")


@query(f"WITH {GRAPH_CTE} SELECT regexp_matches(file_path, '(^|/)test/') AS is_test, count(*) AS n FROM nodes GROUP BY 1")
def FLT04_test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).groupBy(F.col("file_path").rlike(traverse.TEST_PATH).alias("is_test")).agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH_CTE} SELECT id FROM nodes WHERE file_path = 'src/geo' OR starts_with(file_path, 'src/geo/')")
def FLT08_service_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("file_path")
    return nodes(spark, sf_dir).filter((path == "src/geo") | path.startswith("src/geo/")).select("id")


@query(
    r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id, CAST(line AS INT) AS line, substr(content, 1, 200) AS content FROM l WHERE regexp_matches(lower(content), 'token\s*=')
"""
)
def FLT09_line_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").filter(F.lower("text").rlike(r"token\s*="))
    rows = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return rows.filter(F.lower("content").rlike(r"token\s*=")).select("doc_id", (F.col("line") + 1).alias("line"), F.substring("content", 1, 200).alias("content"))


@query("SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'steel') OR contains(lower(concat_ws(' ', p_name, p_brand, p_type)), '#2')")
def FLT10_keyword_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return load(spark, sf_dir, "part").filter(hay.contains("steel") | hay.contains("#2")).select("p_partkey")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12 12:00:00' GROUP BY 1, 2")
def FLT11_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").filter("ts >= timestamp'2024-01-05' and ts < timestamp'2024-01-12 12:00:00'")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH_CTE} SELECT a.name AS caller, e.type, b.name AS callee, e.confidence FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.type = 'IMPORTS' AND e.confidence > 0.96")
def JN01_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    e = edges(spark, sf_dir).filter("type = 'IMPORTS' and confidence > 0.96")
    a, b = n.select(F.col("id").alias("src"), F.col("name").alias("caller")), n.select(F.col("id").alias("dst"), F.col("name").alias("callee"))
    return e.join(a, "src").join(b, "dst").select("caller", "type", "callee", "confidence")


@query(
    f"""
WITH {GRAPH_CTE} SELECT DISTINCT a.src AS customer, b.dst AS part FROM edges a JOIN edges b ON b.src = a.dst WHERE a.type = 'CALLS' AND b.type = 'CALLS' AND a.src LIKE 'Customer:%'
UNION SELECT DISTINCT c.dst, 'Nation' FROM edges c WHERE c.type = 'CONTAINS' AND c.dst LIKE 'Customer:%'
"""
)
def JN02_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    calls = e.filter("type = 'CALLS'").select("src", "dst")
    far = calls.filter("src like 'Customer:%'").select(F.col("src").alias("customer"), F.col("dst").alias("mid")).join(calls.select(F.col("src").alias("mid"), F.col("dst").alias("part")), "mid").select("customer", "part")
    direct = e.filter("type = 'CONTAINS' and dst like 'Customer:%'").select(F.col("dst").alias("customer"), F.lit("Nation").alias("part"))
    return far.unionByName(direct).distinct()


@query(
    """
WITH s AS (SELECT DISTINCT l_partkey AS d, l_suppkey AS b FROM lineitem), n AS (SELECT s_suppkey AS b, s_nationkey AS a FROM supplier)
SELECT s1.d, n1.a, count(*) AS pairs FROM s s1 JOIN s s2 ON s1.d = s2.d AND s1.b < s2.b JOIN n n1 ON n1.b = s1.b JOIN n n2 ON n2.b = s2.b AND n2.a = n1.a GROUP BY s1.d, n1.a
"""
)
def JN03_diamond(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the two arms meet on (part, nation): one aggregate counts the pairs of distinct suppliers there
    s = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("d"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    arms = s.join(load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("a")), "s_suppkey").groupBy("d", "a").agg(F.count("*").alias("n"))
    return arms.filter("n > 1").select("d", "a", F.expr("n * (n - 1) div 2").alias("pairs"))


@query("SELECT c.c_custkey, count(o.o_orderkey) AS orders FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
def JN04_optional_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return load(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query(
    f"""
WITH {GRAPH_CTE}, o AS (SELECT src AS id, string_agg(DISTINCT dst, ',' ORDER BY dst) AS outgoing FROM edges WHERE type = 'IMPORTS' GROUP BY src), i AS (SELECT dst AS id, string_agg(DISTINCT src, ',' ORDER BY src) AS incoming FROM edges WHERE type = 'CALLS' GROUP BY dst)
SELECT n.id, coalesce(o.outgoing, '') AS outgoing, coalesce(i.incoming, '') AS incoming FROM nodes n LEFT JOIN o USING (id) LEFT JOIN i USING (id) WHERE n.label = 'Part'
"""
)
def JN05_both_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    side = lambda kind, key, other, name: e.filter(F.col("type") == kind).groupBy(F.col(key).alias("id")).agg(F.array_join(F.array_sort(F.collect_set(other)), ",").alias(name))
    n = nodes(spark, sf_dir).filter("label = 'Part'").select("id")
    return n.join(side("IMPORTS", "src", "dst", "outgoing"), "id", "left").join(side("CALLS", "dst", "src", "incoming"), "id", "left").fillna("", ["outgoing", "incoming"])


@query(f"WITH {GRAPH_CTE} SELECT DISTINCT m.dst AS cluster, o.o_orderstatus AS flow FROM edges m JOIN orders o ON 'Customer:' || o.o_custkey = m.src WHERE m.type = 'MEMBER_OF'")
def JN06_cluster_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = edges(spark, sf_dir).filter("type = 'MEMBER_OF'").select("src", F.col("dst").alias("cluster"))
    o = load(spark, sf_dir, "orders").select(F.concat(F.lit("Customer:"), "o_custkey").alias("src"), F.col("o_orderstatus").alias("flow")).distinct()
    return m.join(o, "src").select("cluster", "flow").distinct()


@query(
    """
SELECT c.c_mktsegment AS source, p.p_brand AS target, count(*) AS calls FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1, 2
"""
)
def JN07_cluster_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    rows = pairs.join(load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey")
    rows = rows.join(load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("source")), "c_custkey").join(load(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("target")), "p_partkey")
    return rows.groupBy("source", "target").agg(F.sum("n").alias("calls"))


@query(f"WITH {GRAPH_CTE} SELECT file_path, string_agg(name, ',' ORDER BY name) AS exported FROM (SELECT DISTINCT file_path, name FROM nodes WHERE is_exported AND label IN ('Nation', 'Supplier')) GROUP BY file_path")
def JN08_exported_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).filter(F.col("is_exported") & F.col("label").isin("Nation", "Supplier"))
    return n.groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("exported"))


@query(f"WITH {GRAPH_CTE} SELECT DISTINCT a.file_path AS source, b.file_path AS target FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.type IN ('CALLS', 'IMPORTS') AND a.file_path <> b.file_path")
def JN09_inter_file_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    e = edges(spark, sf_dir).filter(F.col("type").isin("CALLS", "IMPORTS")).select("src", "dst")
    e = e.join(n.select(F.col("id").alias("src"), F.col("file_path").alias("source")), "src").join(n.select(F.col("id").alias("dst"), F.col("file_path").alias("target")), "dst")
    return e.filter("source != target").select("source", "target").distinct()


@query(
    """
WITH m AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') SELECT 'inside' AS side, count(*) AS n FROM orders WHERE o_custkey IN (SELECT * FROM m) UNION ALL SELECT 'outside', count(*) FROM orders WHERE o_custkey NOT IN (SELECT * FROM m)
"""
)
def JN10_semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = load(spark, sf_dir, "orders").select("o_custkey")
    count = lambda kind, name: o.join(m, "o_custkey", kind).agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return count("left_semi", "inside").unionByName(count("left_anti", "outside"))


@query(
    """
WITH s AS (SELECT event_id, user_id, event_id % 97 AS a, event_id % 97 + event_id % 11 AS b FROM events), h AS (SELECT o_custkey % 15 AS user_id, o_orderkey % 89 AS c, o_orderkey % 89 + 5 AS d, count(*) AS n FROM orders GROUP BY 1, 2, 3)
SELECT s.event_id, CAST(sum(h.n) AS BIGINT) AS hunks FROM s JOIN h ON s.user_id = h.user_id AND s.a <= h.d AND s.b >= h.c GROUP BY 1
"""
)
def JN11_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols that hunks of their file touch, and how many do.

    A symbol meets all hunks that begin at its end or before, but those that end before it:
    two running counts over the places of a file, instead of pairs.
    """
    s = load(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 97).alias("a"), (F.col("event_id") % 97 + F.col("event_id") % 11).alias("b"))
    k = F.col("o_orderkey")
    h = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 15).alias("user_id"), (k % 89).alias("c"), (k % 89 + 5).alias("d"))
    return join_counts(s, h, "user_id").filter("hunks > 0").select("event_id", "hunks")


def join_counts(symbols: DataFrame, hunks: DataFrame, file: str) -> DataFrame:
    """``symbols`` (a, b) with ``hunks``: how many of ``hunks`` (c, d) overlap each."""
    places = [symbols.select(file, F.col(c).alias("at"), F.lit(0).alias("begin"), F.lit(0).alias("end")) for c in ("a", "b")]
    places += [hunks.select(file, F.col("c").alias("at"), F.lit(1), F.lit(0)), hunks.select(file, (F.col("d") + 1).alias("at"), F.lit(0), F.lit(1))]
    at = places[0].unionByName(places[1]).union(places[2]).union(places[3]).groupBy(file, "at").agg(F.sum("begin").alias("begin"), F.sum("end").alias("end"))
    up_to = Window.partitionBy(file).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = at.select(file, "at", F.sum("begin").over(up_to).alias("begun"), F.sum("end").over(up_to).alias("ended"))
    first = symbols.join(run.select(file, F.col("at").alias("a"), "ended"), [file, "a"])
    return first.join(run.select(file, F.col("at").alias("b"), "begun"), [file, "b"]).withColumn("hunks", F.col("begun") - F.col("ended"))


@query(
    """
WITH sc AS (SELECT o_orderkey AS scope, o_orderkey % 100 AS lo, o_orderkey % 100 + 3 + o_custkey % 40 AS hi FROM orders), pt AS (SELECT DISTINCT event_id % 140 AS line FROM events),
r AS (SELECT pt.line, sc.scope, row_number() OVER (PARTITION BY pt.line ORDER BY sc.hi - sc.lo, sc.scope) AS k FROM pt JOIN sc ON pt.line BETWEEN sc.lo AND sc.hi) SELECT event_id, scope FROM events JOIN r ON r.line = event_id % 140 WHERE k = 1
"""
)
def JN12_innermost_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    sc = load(spark, sf_dir, "orders").select(k.alias("scope"), (k % 100).alias("lo"), (k % 100 + 3 + F.col("o_custkey") % 40).alias("hi"))
    pt = load(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 140).alias("line"))
    # of equal intervals the first scope; then the innermost of each line once, and an equality join
    sc = sc.groupBy("lo", "hi").agg(F.min("scope").alias("scope"))
    lines = sc.select("scope", (F.col("hi") - F.col("lo")).alias("size"), F.explode(F.sequence("lo", "hi")).alias("line"))
    best = lines.groupBy("line").agg(F.min(F.struct("size", "scope")).alias("m")).select("line", "m.scope")
    return pt.join(best, "line").select("event_id", "scope")


@query("SELECT p_type AS cluster, sum(p_size) AS symbols, round(sum(p_retailprice * p_size) / sum(p_size), 4) AS cohesion, arg_max(p_partkey, (p_size, -p_partkey)) AS largest, count(*) AS n FROM part GROUP BY p_type HAVING sum(p_size) >= 5")
def AG01_cluster_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    out = p.groupBy(F.col("p_type").alias("cluster")).agg(
        F.sum("p_size").alias("symbols"),
        F.round(F.sum(F.col("p_retailprice") * F.col("p_size")) / F.sum("p_size"), 4).alias("cohesion"),
        F.max_by("p_partkey", F.struct("p_size", -F.col("p_partkey"))).alias("largest"),
        F.count("*").alias("n"),
    )
    return out.filter("symbols >= 5")


@query(f"WITH {GRAPH_CTE} SELECT 'nodes' AS what, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges")
def AG02_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda df, name: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    return count(nodes(spark, sf_dir), "nodes").unionByName(count(edges(spark, sf_dir), "edges"))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds, CAST(min(o_orderkey) AS BIGINT) AS first_order FROM orders GROUP BY o_custkey")
def AG03_distinct_and_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("kinds"), F.min("o_orderkey").alias("first_order"))


@query("SELECT o_orderpriority AS kind, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states, count(*) AS n FROM orders GROUP BY 1")
def AG05_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("states"), F.count("*").alias("n"))


@query(
    """
WITH e AS (SELECT c.c_mktsegment AS a, n.n_name AS b, 'CALLS' AS t, o.o_totalprice AS w FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey)
SELECT a, b, count(*) AS n, string_agg(DISTINCT t, ',') AS types, round(avg(w), 3) AS mean FROM e GROUP BY a, b
"""
)
def AG07_feature_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").join(F.broadcast(load(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    e = load(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("t", F.lit("CALLS"))
    return e.groupBy(F.col("c_mktsegment").alias("a"), F.col("n_name").alias("b")).agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("t")), ",").alias("types"), F.round(F.avg("o_totalprice"), 3).alias("mean")
    )


@query("SELECT c_mktsegment AS a, o_orderstatus AS b, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2")
def AG09_module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("a"), F.col("o_orderstatus").alias("b")).agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT unnest(['1-URGENT', '2-HIGH', 'NEVER']) AS family) SELECT f.family, count(o.o_orderkey) AS n FROM f LEFT JOIN orders o ON o.o_orderpriority = f.family GROUP BY f.family")
def AG11_family_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("NEVER",)], "family string")
    n = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("family")).agg(F.count("*").alias("n"))
    return families.join(n, "family", "left").fillna(0, ["n"])


@query(
    """
WITH r AS (SELECT d.lang, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id))
SELECT coalesce(lang, 'overall') AS lang, count(*) AS total, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS agree, round(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) * 1.0 / count(*), 4) AS parity FROM r GROUP BY ROLLUP (lang)
"""
)
def AG12_parity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    agree = F.sum(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0))
    return r.rollup("lang").agg(F.count("*").alias("total"), agree.alias("agree"), F.round(agree / F.count("*"), 4).alias("parity")).withColumn("lang", F.coalesce("lang", F.lit("overall")))


@query(
    """
WITH r AS (SELECT d.lang, l.quality, d.n_chars FROM labels l JOIN documents d USING (doc_id)), s AS (SELECT lang, list(n_chars ORDER BY n_chars) AS v, count(*) AS n, avg(quality) AS accuracy, sum(n_chars) AS cost FROM r GROUP BY lang)
SELECT lang, round(accuracy, 4) AS accuracy, v[CAST(floor(0.5 * n) AS INT) + 1] AS p50, v[CAST(floor(0.95 * n) AS INT) + 1] AS p95, CAST(cost AS BIGINT) AS cost,
  round((accuracy + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(accuracy * (1 - accuracy) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 4) AS low,
  round(least(1, (accuracy + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(accuracy * (1 - accuracy) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)), 4) AS high FROM s
"""
)
def AG13_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    low, high = stats.wilson(F.col("hits").cast("double"), F.col("n").cast("double"))
    s = r.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("hits"), F.sum("n_chars").alias("cost"))
    ranks = stats.nearest_rank(r, "lang", "n_chars", [0.5, 0.95])
    return s.join(ranks, "lang").select("lang", F.round(F.col("hits") / F.col("n"), 4).alias("accuracy"), "p50", "p95", "cost", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


@query("SELECT l_returnflag AS cell, round(avg(l_quantity), 4) AS mean, round(stddev_pop(l_quantity), 4) AS deviation, min(l_quantity) AS least, max(l_quantity) AS most, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def AG15_cell_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("cell")).agg(
        F.round(F.avg(q), 4).alias("mean"), F.round(F.stddev_pop(q), 4).alias("deviation"), F.min(q).alias("least"), F.max(q).alias("most"), F.round(F.sum(q), 2).alias("total")
    )


@query("SELECT round(avg(quality), 4) AS accuracy, round(avg(n_chars), 2) AS tokens FROM labels JOIN documents USING (doc_id)")
def AG16_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents"), "doc_id").agg(F.round(F.avg("quality"), 4).alias("accuracy"), F.round(F.avg("n_chars"), 2).alias("tokens"))


@query("SELECT page_id, count(*) OVER (PARTITION BY regexp_extract(url, '://([^/?#]*)', 1)) AS on_host FROM pages")
def AG19_host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # counted once a host and joined, so that a popular host isn't sorted in one task
    p = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"))
    return p.join(p.groupBy("host").agg(F.count("*").alias("on_host")), "host").select("page_id", "on_host")


@query(f"WITH {GRAPH_CTE}, c AS (SELECT src, dst FROM edges WHERE type IN ('CALLS', 'IMPORTS')), o AS (SELECT src AS id, count(*) AS callees FROM c GROUP BY src), i AS (SELECT dst AS id, count(*) AS callers FROM c GROUP BY dst) SELECT coalesce(o.id, i.id) AS id, coalesce(callees, 0) AS callees, coalesce(callers, 0) AS callers FROM o FULL OUTER JOIN i ON o.id = i.id")
def AG22_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = edges(spark, sf_dir).filter(F.col("type").isin("CALLS", "IMPORTS"))
    ends = c.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("callees"), F.sum("e.i").alias("callers"))


@query(
    """
WITH a AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), b AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part), u AS (SELECT * FROM a WHERE r <= 50 UNION ALL SELECT * FROM b WHERE r <= 50)
SELECT k, round(sum(1.0 / (60 + r)), 8) AS score FROM u GROUP BY k
"""
)
def WN01_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    # top 50 first (no global sort), then numbered
    one = lambda c, name: p.orderBy(F.desc(c), "p_partkey").limit(50).select(F.col("p_partkey").alias("k"), F.lit(name).alias("source"), F.row_number().over(Window.orderBy(F.desc(c), "p_partkey")).alias("rank"))
    return rank.fuse(one("p_retailprice", "a").unionByName(one("p_size", "b")), "k").withColumn("score", F.round("score", 8))


@query(
    """
WITH r AS (SELECT p_brand AS repo, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) SELECT repo, k, round(1.0 / (60 + r), 8) AS score FROM r WHERE r <= 5
"""
)
def WN03_fusion_across_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rank.top(load(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 5)
    return t.select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("k"), F.round(1.0 / (60 + F.col("rank")), 8).alias("score"))


@query(
    """
WITH s AS (SELECT o_custkey AS process, sum(o_totalprice) + 0.1 * max(o_totalprice) AS priority FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), r AS (SELECT o.o_custkey AS process, o.o_orderkey AS symbol, row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey) AS k FROM orders o JOIN s ON s.process = o.o_custkey)
SELECT process, symbol, k FROM r WHERE k <= 10
"""
)
def WN04_process_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    s = o.groupBy(F.col("o_custkey").alias("process")).agg((F.sum("o_totalprice") + 0.1 * F.max("o_totalprice")).alias("p")).orderBy(F.desc("p"), "process").limit(20)
    r = rank.top(o.join(F.broadcast(s), F.col("o_custkey") == F.col("process")), ["process"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 10, "k")  # twenty rows
    return r.select("process", F.col("o_orderkey").alias("symbol"), "k")


@query("SELECT label, arg_min(vec_id, (round(CAST(embedding[1] AS DOUBLE), 6), vec_id)) AS best FROM embeddings GROUP BY label")
def WN05_best_per_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("vec_id", F.struct(F.round(F.col("embedding")[0].cast("double"), 6), "vec_id")).alias("best"))


@query(
    """
WITH s AS (SELECT p_brand AS name, CAST(p_partkey AS VARCHAR) AS id, round(0.5 + p_size / 100.0, 4) AS score FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, id) AS k, lead(score) OVER (PARTITION BY name ORDER BY score DESC, id) AS nxt FROM s)
SELECT name, id, score, score >= 0.95 AND coalesce(score - nxt, 1) > 0.005 AS accepted FROM r WHERE k = 1
"""
)
def WN07_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").cast("string").alias("id"), F.round(0.5 + F.col("p_size") / 100.0, 4).alias("score"))
    return rank.dominant(s, "name", gap=0.005)


@query(
    """
WITH h AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT user_id, event_id, event_type FROM h WHERE k = 1 OR event_type IS DISTINCT FROM p
"""
)
def WN09_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.transitions(load(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events")
def WN12_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"))


@query("SELECT p_partkey, p_retailprice, p_size FROM part ORDER BY p_retailprice DESC, p_size, p_partkey LIMIT 15")
def WN13_recipe_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size").orderBy(F.desc("p_retailprice"), "p_size", "p_partkey").limit(15)


@query("SELECT c_mktsegment AS cluster, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, cluster LIMIT 3")
def SL01_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("cluster")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").limit(3)


@query("SELECT n_name AS name, 'Nation' AS label FROM nation UNION ALL SELECT r_name, 'Region' FROM region UNION ALL SELECT s_name, 'Supplier' FROM supplier")
def SET01_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, c, label: load(spark, sf_dir, t).select(F.col(c).alias("name"), F.lit(label).alias("label"))
    return one("nation", "n_name", "Nation").unionByName(one("region", "r_name", "Region")).unionByName(one("supplier", "s_name", "Supplier"))


VERSIONS = """base AS (SELECT o_orderkey AS id, o_orderstatus AS v FROM orders WHERE o_orderkey % 11 <> 0),
ours AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 13 <> 0),
theirs AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'Y' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 17 <> 0)"""


def _versions(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    o, k, v = load(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_orderstatus")
    rows = ((11, v), (13, F.when(k % 7 == 0, "X").otherwise(v)), (17, F.when(k % 5 == 0, "Y").otherwise(v)))
    return [o.filter(k % m != 0).select(k.alias("id"), value.alias("v")) for m, value in rows]


@query(
    f"""
WITH {VERSIONS} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM base a FULL OUTER JOIN ours b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.v IS DISTINCT FROM b.v
"""
)
def SET02_structural_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, ours, _ = _versions(spark, sf_dir)
    return versioned.diff(base, ours, "id", "v")


@query(
    """
WITH a AS (SELECT p_partkey AS id, p_name, p_size, p_type FROM part), b AS (SELECT p_partkey AS id, p_name, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_partkey % 4 = 0 THEN p_type || '!' ELSE p_type END AS p_type FROM part)
SELECT a.id, concat_ws(',', CASE WHEN a.p_size <> b.p_size THEN 'signature' END, CASE WHEN a.p_type <> b.p_type THEN 'body' END) AS classes FROM a JOIN b USING (id) WHERE a.p_size <> b.p_size OR a.p_type <> b.p_type
"""
)
def SET04_semantic_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_type")
    b = a.select("id", F.when(F.col("id") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size2"), F.when(F.col("id") % 4 == 0, F.concat("p_type", F.lit("!"))).otherwise(F.col("p_type")).alias("type2"))
    classes = F.concat_ws(",", F.when(~F.col("p_size").eqNullSafe(F.col("size2")), "signature"), F.when(~F.col("p_type").eqNullSafe(F.col("type2")), "body"))
    return a.join(b, "id").select("id", classes.alias("classes")).filter("classes != ''")


@query(
    f"""
WITH {VERSIONS}, j AS (SELECT coalesce(b.id, o.id, t.id) AS id, b.v AS b, o.v AS o, t.v AS t FROM base b FULL OUTER JOIN ours o ON o.id = b.id FULL OUTER JOIN theirs t ON t.id = coalesce(b.id, o.id)),
k AS (SELECT id, b, o, t, CASE WHEN o IS NOT DISTINCT FROM t THEN CASE WHEN o IS NULL THEN 'deleted' ELSE 'kept' END WHEN o IS NOT DISTINCT FROM b THEN 'theirs' WHEN t IS NOT DISTINCT FROM b THEN 'ours' WHEN b IS NULL THEN 'conflict:added-both' WHEN o IS NULL OR t IS NULL THEN 'conflict:modified-vs-deleted' ELSE 'conflict:modified-both' END AS outcome FROM j)
SELECT id, outcome, CASE WHEN outcome = 'theirs' THEN t WHEN outcome IN ('ours', 'kept') THEN o END AS v FROM k
"""
)
def SET06_three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, ours, theirs = _versions(spark, sf_dir)
    return versioned.merge(base, ours, theirs, "id", "v")


@query(f"WITH {VERSIONS} SELECT count(*) AS swept, sum(length(v)) AS bytes FROM base WHERE id NOT IN (SELECT id FROM ours)")
def SET08_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, ours, _ = _versions(spark, sf_dir)
    return versioned.sweep(base, ours, "id").agg(F.count("*").alias("swept"), F.sum(F.length("v")).alias("bytes"))


@query("WITH g AS (SELECT l_orderkey, l_partkey, max(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_partkey, q, n FROM g WHERE n > 1")
def SET09_dedupe_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q"), F.count("*").alias("n")).filter("n > 1")


@query(
    """
SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(string_split(lower(p_name), ' ')), lambda x: NOT list_contains(string_split(lower(p_type), ' '), x))), ',') AS missing FROM part
"""
)
def SET11_key_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.array_except(F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " "))), ",").alias("missing"))


@query(
    """
SELECT CAST(a.p_partkey AS BIGINT) AS id FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))
"""
)
def SET12_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice")
    return stats.skyline(p, ["p_size"], ["p_retailprice"]).select("id")


@query(f"WITH {VERSIONS} SELECT CASE WHEN o.v IS NULL AND t.v IS NULL THEN 'empty' WHEN t.v IS NULL THEN 'only-ours' WHEN o.v IS NULL THEN 'only-theirs' WHEN o.v = t.v THEN 'agree' ELSE 'disagree' END AS outcome, count(*) AS n FROM ours o FULL OUTER JOIN theirs t ON o.id = t.id GROUP BY 1")
def SET15_shadow_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ours, theirs = _versions(spark, sf_dir)
    both = ours.withColumnRenamed("v", "o").join(theirs.withColumnRenamed("v", "t"), "id", "full_outer")
    outcome = F.expr("case when o is null and t is null then 'empty' when t is null then 'only-ours' when o is null then 'only-theirs' when o = t then 'agree' else 'disagree' end")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
