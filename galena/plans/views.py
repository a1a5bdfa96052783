"""Tools' views, risks, matchers, history of rows and freshness of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galena.model import GRAPH_CTE, edges, load, nodes, stored_edges
from galena.operators import rank, traverse
from galena.registry import query
from galena.sources import extract

RISK_SQL = "CASE WHEN direct >= 30 OR processes >= 5 OR modules >= 5 OR total >= 200 THEN 'CRITICAL' WHEN direct >= 15 OR processes >= 3 OR modules >= 3 OR total >= 100 THEN 'HIGH' WHEN direct >= 5 OR total >= 30 THEN 'MEDIUM' ELSE 'LOW' END"


@query(f"WITH s AS (SELECT o_orderkey AS id, o_custkey % 33 AS direct, o_orderkey % 6 AS processes, o_orderkey % 7 AS modules, o_custkey % 220 AS total FROM orders) SELECT id, {RISK_SQL} AS risk FROM s")
def GR06_risk_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return load(spark, sf_dir, "orders").select(k.alias("id"), traverse.risk(c % 33, k % 6, k % 7, c % 220).alias("risk"))


@query("WITH s AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS own, o_custkey % 5 AS crossings, 0.7 + (o_custkey % 3) * 0.1 AS best FROM orders) SELECT id, CASE WHEN own = 'CRITICAL' OR crossings >= 3 THEN 'CRITICAL' WHEN crossings > 0 AND best >= 0.85 THEN 'HIGH' WHEN crossings > 0 AND own = 'LOW' THEN 'MEDIUM' ELSE own END AS risk FROM s")
def GR09_merged_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk in its own repository with what crosses to others."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    own = F.when(k == 0, "CRITICAL").when(k == 1, "HIGH").when(k == 2, "MEDIUM").otherwise("LOW")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), traverse.merged_risk(own, c % 5, F.lit(0.7) + (c % 3) * 0.1).alias("risk"))


@query(f"WITH {GRAPH_CTE}, one AS (SELECT DISTINCT src AS id FROM edges WHERE dst = 'Part:7' AND type IN ('CALLS', 'IMPORTS', 'EXTENDS')), two AS (SELECT DISTINCT e.src AS id FROM edges e JOIN one ON one.id = e.dst WHERE e.type IN ('CALLS', 'IMPORTS', 'EXTENDS')) SELECT id, 1 AS depth FROM one UNION ALL SELECT id, 2 FROM two WHERE id NOT IN (SELECT id FROM one) AND id <> 'Part:7'")
def GR07_impact_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stored_edges(spark, sf_dir).filter(F.col("type").isin(*traverse.IMPACT_TYPES))
    return traverse.bfs(e, spark.createDataFrame([("Part:7",)], "id string"), 2, "upstream").filter("depth > 0")


@query("SELECT o_orderkey AS id, unnest(['/api/:path*', '/api', '/(a|b)/[0-9]+']) AS matcher, unnest([o_orderkey % 4 IN (0, 1), o_orderkey % 4 = 0, o_orderkey % 4 = 2]) AS matches FROM orders")
def JN22_middleware_matchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes with a middleware's matchers: a prefix with :path*, a pattern with groups, else the route itself."""
    k = F.col("o_orderkey")
    route = F.when(k % 4 == 0, "/api").when(k % 4 == 1, F.concat(F.lit("/api/"), F.col("o_custkey"))).when(k % 4 == 2, F.concat(F.lit("/a/"), F.col("o_custkey"))).otherwise("/apix")
    rows = load(spark, sf_dir, "orders").select(k.alias("id"), route.alias("route"), F.explode(F.array(F.lit("/api/:path*"), F.lit("/api"), F.lit("/(a|b)/[0-9]+"))).alias("matcher"))
    return rows.select("id", "matcher", extract.matcher_fits(F.col("matcher"), F.col("route")).alias("matches"))


@query("SELECT o_custkey AS symbol, o_orderkey AS version, o_orderstatus AS state FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS newer, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1 OR newer IS DISTINCT FROM o_orderstatus")
def WN10_blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol's history from the newest version back: the first row, and each that differs from the one after it in time."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("state"))
    return rank.transitions(o.withColumn("_back", -F.col("version")), "symbol", "_back", "state").select("symbol", "version", "state")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'fresh' WHEN o_orderkey % 3 = 1 THEN 'stale' ELSE 'absent' END AS state FROM orders")
def ST03_fresh_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows against a cache by the hash of their content."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.sha2(F.concat_ws("|", "o_orderkey", "o_orderstatus"), 256).alias("hash"))
    cache = o.filter("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, F.col("hash")).otherwise("old").alias("cached"))
    return o.join(cache, "id", "left").select("id", F.when(F.col("cached").isNull(), "absent").when(F.col("cached") == F.col("hash"), "fresh").otherwise("stale").alias("state"))


@query("SELECT DISTINCT term, unnest([term, lower(term), upper(substr(lower(term), 1, 1)) || substr(lower(term), 2)]) AS variant FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS term FROM part)")
def TX02_term_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term as it is, in lower case, and with a capital; each once."""
    terms = load(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("term")).distinct()
    low = F.lower("term")
    return terms.select("term", F.explode(F.array_distinct(F.array("term", low, F.concat(F.upper(F.substring(low, 1, 1)), F.expr("substring(lower(term), 2)"))))).alias("variant"))


@query("WITH c AS (SELECT p_brand AS cluster, sum(p_size) AS symbols FROM part GROUP BY 1 HAVING sum(p_size) >= 5), p AS (SELECT o_custkey AS process, count(*) AS steps FROM orders GROUP BY 1) SELECT 'cluster' AS kind, cluster AS name, CAST(symbols AS BIGINT) AS size FROM (SELECT * FROM c ORDER BY symbols DESC, cluster LIMIT 20) UNION ALL SELECT 'process', CAST(process AS VARCHAR), steps FROM (SELECT * FROM p ORDER BY steps DESC, process LIMIT 20)")
def TL09_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest clusters and the longest processes."""
    c = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.sum("p_size").alias("size")).filter("size >= 5").orderBy(F.desc("size"), "name").limit(20)
    p = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "o_custkey").limit(20)
    return c.select(F.lit("cluster").alias("kind"), "name", "size").unionByName(p.select(F.lit("process").alias("kind"), F.col("o_custkey").cast("string").alias("name"), "size"))


@query("SELECT s_suppkey AS route, s_suppkey * 10 + 1 AS consumer, 'meta' AS missing, CASE WHEN s_suppkey % 3 > 0 THEN 'low' ELSE 'high' END AS confidence FROM supplier WHERE s_suppkey % 2 = 0")
def TL12_shape_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a consumer reads and its route doesn't answer with, errors included; low confidence where the consumer fetches more than once."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("route"))
    answers = s.withColumn("keys", F.array(F.lit("data"), F.lit("id"), F.lit("error")))
    reads = F.concat(F.lit("fetch-url-match|keys:data,error"), F.when(F.col("route") % 2 == 0, ",meta").otherwise(""), F.when(F.col("route") % 3 > 0, "|fetches:2").otherwise(""))
    c = s.select("route", (F.col("route") * 10 + 1).alias("consumer"), reads.alias("reason"))
    missing = F.explode(F.array_except(extract.reason_keys(F.col("reason")), F.col("keys"))).alias("missing")
    confidence = F.when(extract.reason_fetches(F.col("reason")) > 1, "low").otherwise("high")
    return c.join(answers, "route").select("route", "consumer", missing, confidence.alias("confidence"))


@query("SELECT o_custkey AS process, count(*) AS steps, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'cross' ELSE 'intra' END AS kind FROM orders GROUP BY 1 ORDER BY steps DESC, process LIMIT 75")
def GR15_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest processes, and whether their steps are of one community or several."""
    p = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("process")).agg(F.count("*").alias("steps"), F.countDistinct("o_orderstatus").alias("n"))
    return p.orderBy(F.desc("steps"), "process").limit(75).select("process", "steps", F.when(F.col("n") > 1, "cross").otherwise("intra").alias("kind"))


@query(f"WITH {GRAPH_CTE}, c AS (SELECT id, name, label, file_path, 0.5 + CASE WHEN contains(file_path, 'orders') THEN 0.4 ELSE 0 END + CASE WHEN label = 'Order' THEN 0.2 ELSE 0 END AS score FROM nodes WHERE name LIKE '1-%') SELECT id, CAST(round(score, 4) AS DOUBLE) AS score FROM c ORDER BY score DESC, length(file_path), id LIMIT 50")
def TL05_symbol_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of a name with the hint of a path and a kind: the better score first, then the shorter path."""
    score = F.lit(0.5) + F.when(F.col("file_path").contains("orders"), 0.4).otherwise(0.0) + F.when(F.col("label") == "Order", 0.2).otherwise(0.0)
    c = nodes(spark, sf_dir).filter("name like '1-%'").select("id", F.round(score, 4).alias("score"), F.length("file_path").alias("n"))
    return c.orderBy(F.desc("score"), "n", "id").limit(50).select("id", "score")


@query(f"WITH {GRAPH_CTE} SELECT dst AS process, count(*) AS steps, max(step) AS last_step FROM edges WHERE type = 'STEP_IN_PROCESS' GROUP BY 1 ORDER BY steps DESC, process LIMIT 100")
def TL18_process_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = edges(spark, sf_dir).filter("type = 'STEP_IN_PROCESS'").groupBy(F.col("dst").alias("process")).agg(F.count("*").alias("steps"), F.max("step").alias("last_step"))
    return p.orderBy(F.desc("steps"), "process").limit(100)


@query("WITH f AS (SELECT o_orderkey AS file, CASE o_orderkey % 3 WHEN 0 THEN '/api/users/5' WHEN 1 THEN '/api/none' ELSE '/api/a/b/c' END AS url FROM orders) SELECT file, CASE file % 3 WHEN 0 THEN '/api/users/[id]' ELSE '/api/a/[...rest]' END AS route, CAST(0.9 AS DOUBLE) AS confidence FROM f WHERE file % 3 <> 1")
def EX11_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched URLs and the first route that each fits; routes are few, and a segment in brackets fits any."""
    k = F.col("o_orderkey")
    url = F.when(k % 3 == 0, "/api/users/5").when(k % 3 == 1, "/api/none").otherwise("/api/a/b/c")
    f = load(spark, sf_dir, "orders").select(k.alias("file"), url.alias("url"))
    routes = spark.createDataFrame([(1, "/api/users/[id]"), (2, "/api/[x]/5"), (3, "/api/a/[...rest]"), (4, "/api/a/[y]/[z]")], "place int, route string")
    met = f.join(F.broadcast(routes), extract.route_fits(F.col("url"), F.col("route")))  # four routes
    return met.groupBy("file").agg(F.min_by("route", "place").alias("route")).withColumn("confidence", F.lit(0.9))
