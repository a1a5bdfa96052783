"""Composite tools and the rest of the catalogue's joins, roll-ups and extractors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galena.model import GRAPH_CTE, edges, load, nodes
from galena.operators import rank, resolve, search, traverse, versioned
from galena.registry import query
from galena.sources import extract


@query("WITH h AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level FROM conversations) SELECT a.conv_id, a.turn, a.level, coalesce(min(b.turn) - 1, (SELECT max(turn) FROM conversations c WHERE c.conv_id = a.conv_id)) AS end_turn FROM h a LEFT JOIN h b ON b.conv_id = a.conv_id AND b.turn > a.turn AND b.level <= a.level GROUP BY a.conv_id, a.turn, a.level")
def WN11_section_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.expr("case role when 'system' then 1 when 'user' then 2 else 3 end")
    h = load(spark, sf_dir, "conversations").select("conv_id", "turn", level.alias("level"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)  # a running minimum, from the end
    nexts = [F.min(F.when(F.col("level") <= k, F.col("turn"))).over(w) for k in (1, 2, 3)]
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    end = F.when(F.col("level") == 1, nexts[0]).when(F.col("level") == 2, nexts[1]).otherwise(nexts[2])
    return h.select("conv_id", "turn", "level", F.coalesce(end - 1, last).alias("end_turn"))


@query("WITH a AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS i FROM part) SELECT k, round(1.0 / (60 + i), 8) AS score FROM a WHERE i < 20")
def WN02_fusion_from_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)
    ranked = p.select(F.col("p_partkey").alias("k"), F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("rank"))
    return rank.fuse(ranked, "k", base=0).withColumn("score", F.round("score", 8))


@query("WITH r AS (SELECT p_brand, p_partkey, floor(p_retailprice) AS c, row_number() OVER (PARTITION BY p_brand ORDER BY floor(p_retailprice) DESC, p_size, p_partkey) AS k FROM part) SELECT p_brand, p_partkey FROM r WHERE k = 1")
def WN08_confidence_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc(F.floor("p_retailprice")), F.asc("p_size"), F.asc("p_partkey")]
    return rank.top(load(spark, sf_dir, "part"), ["p_brand"], order, 1).select("p_brand", "p_partkey")


@query("SELECT p_brand, string_agg(p_partkey, ',' ORDER BY p_type, p_name, p_partkey) AS pack FROM part WHERE p_size > 45 GROUP BY p_brand")
def WN14_context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").filter("p_size > 45")
    ordered = F.array_sort(F.collect_list(F.struct("p_type", "p_name", "p_partkey")))
    return p.groupBy("p_brand").agg(F.array_join(F.transform(ordered, lambda x: x["p_partkey"].cast("string")), ",").alias("pack"))


@query(f"WITH {GRAPH_CTE}, d AS (SELECT DISTINCT src AS id, 1 AS depth FROM edges WHERE dst = 'Supplier:2' AND type = 'IMPORTS') SELECT depth, string_agg(id, ',' ORDER BY id) AS ids FROM d GROUP BY depth")
def AG04_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = traverse.bfs(edges(spark, sf_dir).filter("type = 'IMPORTS'"), spark.createDataFrame([("Supplier:2",)], "id string"), 1, "upstream")
    return found.filter("depth = 1").groupBy("depth").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


@query("WITH m AS (SELECT p_brand AS slug, p_type AS signal, count(*) AS w FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY w DESC, signal) AS k FROM m) SELECT slug, CAST(sum(w) AS BIGINT) AS members, string_agg(signal, ',' ORDER BY k) FILTER (k <= 8) AS signals FROM r GROUP BY slug")
def AG06_feature_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("slug"), F.col("p_type").alias("signal")).agg(F.count("*").alias("w"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("n"), "signal"))), 1, 8)
    return m.groupBy("slug").agg(F.sum("w").alias("members"), F.array_join(F.transform(best, lambda s: s["signal"]), ",").alias("signals"))


@query("SELECT lower(p_type) AS slug, count(DISTINCT p_brand) AS repos, count(*) AS members, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part GROUP BY 1")
def AG10_across_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("slug"))
    return p.agg(F.countDistinct("p_brand").alias("repos"), F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))


@query("SELECT o_orderpriority AS phase, round(sum(o_totalprice), 1) AS total, count(*) AS runs FROM orders GROUP BY 1")
def AG17_phase_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("phase")).agg(F.round(F.sum("o_totalprice"), 1).alias("total"), F.count("*").alias("runs"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS route FROM pages) SELECT route, string_agg(DISTINCT page_id, ',' ORDER BY page_id) AS consumers, CASE WHEN count(DISTINCT page_id) >= 10 THEN 'HIGH' WHEN count(DISTINCT page_id) >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM l GROUP BY route""")
def TL14_api_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = extract.links(load(spark, sf_dir, "pages"), "page_id", "html").select(F.col("href").alias("route"), "page_id").distinct()
    n = F.size("ids")
    out = used.groupBy("route").agg(F.array_sort(F.collect_list("page_id")).alias("ids"))
    return out.select("route", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("consumers"), F.when(n >= 10, "HIGH").when(n >= 4, "MEDIUM").otherwise("LOW").alias("risk"))


STALE = "WITH s AS (SELECT 'orders' AS t, count(*) AS n FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT 'parts', count(*) FROM part WHERE p_partkey % 90 = 0) SELECT CAST(sum(n) AS BIGINT) AS changed, CASE WHEN sum(n) < 10 THEN 'low' WHEN sum(n) < 100 THEN 'medium' ELSE 'high' END AS staleness FROM s"


@query(STALE)
def AG20_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, k, m: load(spark, sf_dir, t).filter(F.col(k) % m == 0).agg(F.count("*").alias("n"))
    total = one("orders", "o_orderkey", 50).unionByName(one("part", "p_partkey", 90)).agg(F.sum("n").alias("changed"))
    return total.withColumn("staleness", F.when(F.col("changed") < 10, "low").when(F.col("changed") < 100, "medium").otherwise("high"))


@query(f"WITH {GRAPH_CTE} SELECT type AS tbl, count(*) AS n FROM edges GROUP BY 1 UNION ALL SELECT label, count(*) FROM nodes GROUP BY 1")
def AG21_snapshot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).groupBy(F.col("label").alias("tbl")).agg(F.count("*").alias("n"))
    return edges(spark, sf_dir).groupBy(F.col("type").alias("tbl")).agg(F.count("*").alias("n")).unionByName(n)


@query("WITH c AS (SELECT c_custkey AS id, 'grpc::svc' || c_nationkey AS svc, 0.8 AS w FROM customer), p AS (SELECT s_suppkey AS id, 'grpc::svc' || s_nationkey AS svc, CASE WHEN s_suppkey % 4 = 0 THEN 0.6 ELSE 0.9 END AS w FROM supplier) SELECT c.id AS consumer, count(*) AS providers, min(p.id) AS first_provider, CAST(max(least(c.w, p.w)) AS DOUBLE) AS confidence FROM c JOIN p USING (svc) GROUP BY 1")
def JN14_wildcard_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A consumer of ``service/*`` meets every method of the service: the methods are rolled up first, so that a row is a consumer."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("consumer"), F.concat(F.lit("grpc::Svc"), "c_nationkey", F.lit("/*")).alias("cid"), F.lit(0.8).alias("a"))
    p = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("provider"), F.concat(F.lit("grpc::Svc"), "s_nationkey", F.lit("/M"), F.col("s_suppkey") % 3).alias("cid"), F.when(F.col("s_suppkey") % 4 == 0, 0.6).otherwise(0.9).alias("b"))
    service = lambda cid: F.split_part(F.split_part(F.lower(cid), F.lit("::"), F.lit(2)), F.lit("/"), F.lit(1)).alias("svc")
    methods = p.groupBy(service("cid")).agg(F.count("*").alias("providers"), F.min("provider").alias("first_provider"), F.max("b").alias("b"))
    return c.select("consumer", service("cid"), "a").join(methods, "svc").select("consumer", "providers", "first_provider", F.least("a", "b").alias("confidence"))


@query("WITH d AS (SELECT p_brand AS f, p_name AS n, p_partkey AS id FROM part WHERE p_partkey % 2 = 0), one AS (SELECT f, n, min(id) AS id FROM d GROUP BY f, n), lone AS (SELECT f, min(id) AS id FROM d GROUP BY f HAVING count(*) = 1) SELECT p_partkey AS ref, coalesce(u.id, one.id, lone.id) AS target FROM part LEFT JOIN d u ON u.id = p_partkey LEFT JOIN one ON one.f = p_brand AND one.n = p_name LEFT JOIN lone ON lone.f = p_brand")
def JN17_three_level_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref"), F.col("p_brand").alias("f"), F.col("p_name").alias("n"))
    d = p.filter("ref % 2 = 0")
    uid = d.select("ref", F.col("ref").alias("a"))
    ref, lone = d.groupBy("f", "n").agg(F.min("ref").alias("b")), d.groupBy("f").agg(F.min("ref").alias("c"), F.count("*").alias("k")).filter("k = 1").drop("k")
    return p.join(uid, "ref", "left").join(ref, ["f", "n"], "left").join(lone, "f", "left").select("ref", F.coalesce("a", "b", "c").alias("target"))


@query("WITH RECURSIVE e AS (SELECT o_orderkey AS a, (o_orderkey * 7) % 1499 AS b FROM orders WHERE o_orderkey % 3 <> 0), w(s, t, seen, k) AS (SELECT o_orderkey, o_orderkey, [o_orderkey], 0 FROM orders UNION ALL SELECT w.s, e.b, list_append(w.seen, e.b), w.k + 1 FROM w JOIN e ON e.a = w.t WHERE w.k < 5 AND NOT list_contains(w.seen, e.b)) SELECT CAST(s AS VARCHAR) AS name, CAST(arg_max(t, k) AS VARCHAR) AS to_name FROM w GROUP BY s")
def JN20_binding_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-exports from every order, five hops at most; a chain stops where it would repeat."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    e = o.filter("k % 3 != 0").select(F.lit("f").alias("file"), F.col("k").cast("string").alias("name"), F.lit("f").alias("to_file"), ((F.col("k") * 7) % 1499).cast("string").alias("to_name"))
    return resolve.follow(e, o.select(F.lit("f").alias("file"), F.col("k").cast("string").alias("name"))).select("name", "to_name")


@query(f"WITH {GRAPH_CTE}, s AS (SELECT DISTINCT file_path FROM nodes) SELECT file_path, CASE WHEN starts_with(file_path, 'src/geo/nations/') THEN 'src/geo/nations' WHEN starts_with(file_path, 'src/geo/') THEN 'src/geo' WHEN starts_with(file_path, 'src/') THEN 'src' END AS service FROM s")
def EX39_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path's own prefixes, longest first, are the keys of an equality join."""
    files = nodes(spark, sf_dir).select("file_path").distinct()
    parts = F.split("file_path", "/")
    keys = files.select("file_path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k")).select("file_path", "k", F.array_join(F.slice(F.split("file_path", "/"), F.lit(1), F.col("k")), "/").alias("service"))
    services = spark.createDataFrame([("src",), ("src/geo",), ("src/geo/nations",)], "service string")
    best = keys.join(services, "service").groupBy("file_path").agg(F.max_by("service", "k").alias("service"))
    return files.join(best, "file_path", "left")


@query(f"WITH {GRAPH_CTE}, f AS (SELECT DISTINCT file_path AS p FROM nodes), s AS (SELECT p, string_split(p, '/') AS a FROM f), x AS (SELECT p, array_to_string(a[k:], '/') AS suffix FROM (SELECT p, a, unnest(generate_series(1, len(a))) AS k FROM s)) SELECT suffix, min(p) AS file FROM x GROUP BY suffix")
def LG09_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = nodes(spark, sf_dir).select("file_path").distinct()
    parts = F.split("file_path", "/")
    x = f.select("file_path", parts.alias("a"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"))
    return x.groupBy(F.array_join(F.slice("a", F.col("k"), F.size("a")), "/").alias("suffix")).agg(F.min("file_path").alias("file"))


@query("SELECT p_partkey, CAST(round(least(1, greatest(0, 0.4 * (p_size > 20)::INT + 0.5 * (p_retailprice > 1000)::INT + 0.3 * (p_brand = 'Brand#11')::INT - 0.1)), 4) AS DOUBLE) AS confidence FROM part")
def EX31_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c, w: F.when(c, w).otherwise(0.0)
    weights = F.array(flag(F.col("p_size") > 20, 0.4), flag(F.col("p_retailprice") > 1000, 0.5), flag(F.col("p_brand") == "Brand#11", 0.3), F.lit(-0.1))
    return load(spark, sf_dir, "part").select("p_partkey", F.round(resolve.confidence(weights), 4).alias("confidence"))


@query(f"WITH {GRAPH_CTE}, d AS (SELECT src AS id, count(*) AS callees FROM edges WHERE type = 'CALLS' GROUP BY src) SELECT n.label, CAST(round(sum(callees * CASE WHEN is_exported THEN 2.0 ELSE 1 END * CASE WHEN name LIKE '1-%' THEN 1.5 WHEN name LIKE '5-%' THEN 0.3 ELSE 1 END), 2) AS DOUBLE) AS score FROM nodes n JOIN d USING (id) GROUP BY n.label")
def EX23_entry_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = edges(spark, sf_dir).filter("type = 'CALLS'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callees"))
    by_name = F.when(F.col("name").startswith("1-"), 1.5).when(F.col("name").startswith("5-"), 0.3).otherwise(1.0)
    score = F.col("callees") * F.when(F.col("is_exported"), 2.0).otherwise(1.0) * by_name
    return nodes(spark, sf_dir).join(d, "id").groupBy("label").agg(F.round(F.sum(score), 2).alias("score"))


@query("SELECT kind, n FROM (SELECT CASE WHEN regexp_matches(url, '\\.html?$') THEN 'global' WHEN regexp_matches(url, '[?]') THEN 'eligible' WHEN regexp_matches(url, '#') THEN 'topology' ELSE 'ignored' END AS kind, count(*) AS n FROM pages GROUP BY 1)")
def SET13_changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    kind = F.when(u.rlike(r"\.html?$"), "global").when(u.contains("?"), "eligible").when(u.contains("#"), "topology").otherwise("ignored")
    return load(spark, sf_dir, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH_CTE} SELECT e.src, e.dst FROM edges e WHERE e.type = 'CALLS' AND e.dst IN (SELECT 'Part:' || p_partkey FROM part WHERE p_brand = 'Brand#11') AND e.src NOT IN (SELECT 'Order:' || o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def SET14_edges_to_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = load(spark, sf_dir, "part").filter("p_brand = 'Brand#11'").select(F.concat(F.lit("Part:"), "p_partkey").alias("dst"))
    replaced = load(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.concat(F.lit("Order:"), "o_orderkey").alias("src"))
    calls = edges(spark, sf_dir).filter("type = 'CALLS'")
    return calls.join(targets, "dst", "left_semi").join(replaced, "src", "left_anti").select("src", "dst")


@query("WITH s AS (SELECT p_type AS kind, p_brand AS slug, p_size AS w FROM part) SELECT kind, slug, max(w) AS w FROM s GROUP BY 1, 2")
def SET10_best_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("kind"), F.col("p_brand").alias("slug")).agg(F.max("p_size").alias("w"))


@query("WITH a AS (SELECT page_id AS path, md5(html) AS d FROM pages), b AS (SELECT page_id + (page_id % 10 = 0)::INT * 1000000 AS path, CASE WHEN page_id % 7 = 0 THEN 'x' ELSE md5(html) END AS d FROM pages) SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'unknown' ELSE 'altered' END AS problem FROM a FULL OUTER JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.d <> b.d")
def SET16_bundle_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.sources.sinks import verify

    a = load(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.md5("html").alias("digest"))
    b = a.select((F.col("path") + F.when(F.col("path") % 10 == 0, 1000000).otherwise(0)).alias("path"), F.when(F.col("path") % 7 == 0, "x").otherwise(F.col("digest")).alias("digest"))
    return verify(a, b)


@query(f"WITH {GRAPH_CTE} SELECT family, count(*) AS n FROM (SELECT CASE WHEN type = 'CONTAINS' THEN 'COMPOSES' WHEN type IN ('CALLS', 'IMPORTS') THEN 'DEPENDS' WHEN type = 'EXTENDS' THEN 'INHERITS' WHEN type = 'STEP_IN_PROCESS' THEN 'FLOWS' ELSE 'COMPOSES' END AS family FROM edges) GROUP BY family")
def TL27_edge_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("type")
    family = F.when(kind == "CONTAINS", "COMPOSES").when(kind.isin("CALLS", "IMPORTS"), "DEPENDS").when(kind == "EXTENDS", "INHERITS").when(kind == "STEP_IN_PROCESS", "FLOWS").otherwise("COMPOSES")
    return edges(spark, sf_dir).groupBy(family.alias("family")).agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH_CTE}, i AS (SELECT 'in' AS side, type, src AS other, row_number() OVER (PARTITION BY type ORDER BY src) AS k FROM edges WHERE dst = 'Part:3'), o AS (SELECT 'out' AS side, type, dst AS other, row_number() OVER (PARTITION BY type ORDER BY dst) AS k FROM edges WHERE src = 'Part:3') SELECT side, type, other FROM i WHERE k <= 30 UNION ALL SELECT side, type, other FROM o WHERE k <= 30")
def TL04_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    side = lambda name, key, other: rank.top(e.filter(F.col(key) == "Part:3").select(F.lit(name).alias("side"), "type", F.col(other).alias("other")), ["type"], [F.asc("other")], 30).drop("rank")
    return side("in", "dst", "src").unionByName(side("out", "src", "dst"))


@query(f"WITH {GRAPH_CTE}, h AS (SELECT 'src/orders/f.ts' AS f), s AS (SELECT DISTINCT n.id FROM nodes n JOIN h ON h.f = n.file_path), p AS (SELECT DISTINCT e.dst FROM edges e JOIN s ON s.id = e.src WHERE e.type = 'STEP_IN_PROCESS') SELECT (SELECT count(*) FROM s) AS symbols, (SELECT count(*) FROM p) AS processes, CASE WHEN (SELECT count(*) FROM p) = 0 THEN 'low' WHEN (SELECT count(*) FROM p) <= 5 THEN 'medium' WHEN (SELECT count(*) FROM p) <= 15 THEN 'high' ELSE 'critical' END AS risk")
def TL07_detect_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = spark.createDataFrame([(1, "--- a/src/orders/f.ts\n+++ b/src/orders/f.ts\n@@ -1 +1,3 @@\n")], "k long, t string")
    files = extract.hunks(diff, "k", "t").select(F.col("path").alias("file_path")).distinct()
    s = nodes(spark, sf_dir).join(files, "file_path", "left_semi").select("id").distinct()
    steps = edges(spark, sf_dir).filter("type = 'STEP_IN_PROCESS'").join(s.withColumnRenamed("id", "src"), "src", "left_semi")
    both = s.select(F.lit(1).alias("s"), F.lit(None).cast("string").alias("p")).unionByName(steps.select(F.lit(None).cast("int").alias("s"), F.col("dst").alias("p")))
    n = both.agg(F.count("s").alias("symbols"), F.countDistinct("p").alias("processes"))
    return n.withColumn("risk", F.when(F.col("processes") == 0, "low").when(F.col("processes") <= 5, "medium").when(F.col("processes") <= 15, "high").otherwise("critical"))


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, event_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts, event_id LIMIT 40")
def TL43_audit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").filter("event_type = 'error' and ts >= timestamp'2024-01-10'")
    return e.orderBy("ts", "event_id").limit(40).select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id")


@query("WITH v AS (SELECT l_orderkey AS id, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT CASE WHEN n > 6 THEN 'signature' WHEN q > 150 THEN 'body' ELSE 'metadata' END AS class, count(*) AS rows_n FROM v GROUP BY 1")
def SET05_modification_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return v.groupBy(F.when(F.col("n") > 6, "signature").when(F.col("q") > 150, "body").otherwise("metadata").alias("class")).agg(F.count("*").alias("rows_n"))


@query()
def GR20_class_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 orders of the heritage over all parts: each inherits from those of its half and its third that are parts."""
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    up = p.select(F.col("k").cast("string").alias("child"), F.expr("array_distinct(array(k div 2, k div 3))").alias("ps")).select("child", F.posexplode("ps").alias("position", "p"))
    heritage = up.join(p.withColumnRenamed("k", "p"), "p", "left_semi").select("child", F.col("p").cast("string").alias("parent"), "position")
    return resolve.linearize(heritage, p.select(F.col("k").cast("string").alias("id"))).select("id", F.array_join("order", ">").alias("order"))


@query("SELECT doc_id, md5(text) AS content FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY md5(text))")
def ST07_idempotent_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy(F.md5("text").alias("content")).agg(F.min("doc_id").alias("doc_id"))


@query(
    """
WITH q AS (SELECT doc_id, source, (CASE WHEN contains(lower(text), 'token') THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(text), 'the') THEN 2 ELSE 0 END) AS s FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY s DESC, doc_id) AS k FROM q WHERE s > 0) SELECT source, doc_id, k FROM r WHERE k <= 20
"""
)
def TL02_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = search.keyword_score({"text": 2.0}, ["token", "the"])
    phrase = F.when(F.lower("text").contains("token the"), 6.0).otherwise(0.0)
    top = load(spark, sf_dir, "documents").withColumn("s", score - phrase).filter("s > 0").orderBy(F.desc("s"), "doc_id").limit(20)
    return top.select("source", "doc_id", F.row_number().over(Window.orderBy(F.desc("s"), "doc_id")).alias("k"))


@query("SELECT CAST(count(*) AS BIGINT) AS behind FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) - 25 FROM orders)")
def TL45_staleness_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    head = o.agg(F.max("o_orderkey")).first()[0] or 0
    return o.filter(F.col("o_orderkey") > head - 25).agg(F.count("*").alias("behind"))


@query("SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS kind, nullif(regexp_extract(url, '[?&]([a-z_]+)=', 1), '') AS first_key FROM pages")
def EX34_http_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.regexp_extract("url", "[?&]([a-z_]+)=", 1)
    return load(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "^([a-zA-Z]+)://", 1)).alias("kind"), F.when(first != "", first).alias("first_key"))


@query("SELECT o_orderkey AS id, 'A' AS change FROM orders WHERE o_orderkey % 19 = 0 UNION ALL SELECT o_orderkey, 'D' FROM orders WHERE o_orderkey % 23 = 0")
def SET03_table_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v"))
    old, new = o.filter("id % 19 != 0"), o.filter("id % 23 != 0")
    both = versioned.diff(old, new, "id", "v")
    # a key that is in neither has no change
    lost = o.filter("id % 19 = 0 and id % 23 = 0").select("id", F.explode(F.array(F.lit("A"), F.lit("D"))).alias("change"))
    return both.select("id", F.when(F.col("change") == "added", "A").otherwise("D").alias("change")).unionByName(lost)
