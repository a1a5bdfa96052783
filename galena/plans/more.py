"""Further queries of the catalogue: endpoint resolution, method tables, routes, cluster tools, group queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.functions import text as tf
from galena.model import GRAPH_CTE, edges, load, nodes
from galena.operators import rank, resolve, search
from galena.registry import query
from galena.sources import extract


@query("WITH e AS (SELECT s_suppkey AS id, s_nationkey % 5 AS repo, s_name AS name FROM supplier), c AS (SELECT p_brand AS slug, p_partkey % 5 AS repo FROM part WHERE p_size > 40), r AS (SELECT e.id, c.slug, row_number() OVER (PARTITION BY e.id ORDER BY c.slug) AS k FROM e LEFT JOIN (SELECT DISTINCT slug, repo FROM c) c ON c.repo = e.repo) SELECT id, slug FROM r WHERE k = 1")
def JN18_endpoint_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = load(spark, sf_dir, "part").filter("p_size > 40").groupBy((F.col("p_partkey") % 5).alias("repo")).agg(F.min("p_brand").alias("slug"))
    return load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).alias("repo")).join(first, "repo", "left").select("id", "slug")


@query("WITH q AS (SELECT o_orderkey AS call, 'm' || o_custkey % 40 AS model FROM orders), n AS (SELECT 'm' || n_nationkey AS model, n_nationkey AS id FROM nation) SELECT DISTINCT q.call, coalesce(CAST(n.id AS VARCHAR), 'synthetic:' || q.model) AS target FROM q LEFT JOIN n USING (model)")
def JN23_orm_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call"), F.concat(F.lit("m"), F.col("o_custkey") % 40).alias("model"))
    n = load(spark, sf_dir, "nation").select(F.concat(F.lit("m"), "n_nationkey").alias("model"), F.col("n_nationkey").cast("string").alias("id"))
    return q.join(n, "model", "left").select("call", F.coalesce("id", F.concat(F.lit("synthetic:"), "model")).alias("target")).distinct()


@query(f"WITH {GRAPH_CTE}, r AS (SELECT DISTINCT 'src/orders/' || lower(o_orderstatus) || '.ts' AS file_path, o_orderstatus AS route FROM orders) SELECT r.route, count(DISTINCT e.dst) AS processes FROM r JOIN nodes n USING (file_path) JOIN edges e ON e.src = n.id AND e.type = 'STEP_IN_PROCESS' GROUP BY r.route")
def JN24_routes_and_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "orders").select(F.concat(F.lit("src/orders/"), F.lower("o_orderstatus"), F.lit(".ts")).alias("file_path"), F.col("o_orderstatus").alias("route")).distinct()
    steps = edges(spark, sf_dir).filter("type = 'STEP_IN_PROCESS'").select(F.col("src").alias("id"), "dst")
    return nodes(spark, sf_dir).select("id", "file_path").join(r, "file_path").join(steps, "id").groupBy("route").agg(F.countDistinct("dst").alias("processes"))


@query("WITH h AS (SELECT event_id, event_type AS label, user_id FROM events) SELECT h.label, count(c.c_custkey) AS found, count(*) AS hits FROM h LEFT JOIN customer c ON c.c_custkey = h.user_id GROUP BY h.label")
def JN27_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = load(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("c_custkey"))
    c = load(spark, sf_dir, "customer").select("c_custkey", F.lit(1).alias("one"))
    return h.join(c, "c_custkey", "left").groupBy(F.col("event_type").alias("label")).agg(F.count("one").alias("found"), F.count("*").alias("hits"))


@query("SELECT a.s_suppkey AS id, count(*) AS clones, min(b.s_name) AS first_clone FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_name <> b.s_name GROUP BY 1")
def JN28_clone_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows share a row's remote but not its path, and the first such path; by counts, not by pairs."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey", "s_name")
    paths = s.groupBy("s_nationkey", "s_name").agg(F.count("*").alias("same"))
    remote = paths.groupBy("s_nationkey").agg(F.sum("same").alias("all"), F.min("s_name").alias("low"))
    second = paths.join(remote.select("s_nationkey", "low"), "s_nationkey").filter("s_name != low").groupBy("s_nationkey").agg(F.min("s_name").alias("next"))
    out = s.join(paths, ["s_nationkey", "s_name"]).join(remote, "s_nationkey").join(second, "s_nationkey", "left")
    return out.filter("all > same").select("id", (F.col("all") - F.col("same")).alias("clones"), F.when(F.col("low") != F.col("s_name"), F.col("low")).otherwise(F.col("next")).alias("first_clone"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '/api/' || lower(o_orderpriority) || '/[id]' WHEN o_orderkey % 5 = 2 THEN '/api/' || lower(o_orderstatus) WHEN o_orderkey % 5 = 3 THEN '/api/' || lower(o_orderstatus) || '/' || o_custkey ELSE NULL END AS route FROM orders")
def EX17_file_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers below app and pages: groups are no segments, pages and files outside api have no route."""
    low, kind = F.lower("o_orderpriority"), F.col("o_orderkey") % 5
    path = (
        F.when(kind == 0, F.concat(F.lit("src/app/"), low, F.lit("/[id]/page.tsx")))
        .when(kind == 1, F.concat(F.lit("src/app/(admin)/api/"), low, F.lit("/[id]/route.ts")))
        .when(kind == 2, F.concat(F.lit("pages/api/"), F.lower("o_orderstatus"), F.lit("/index.js")))
        .when(kind == 3, F.concat(F.lit("web/pages/api/"), F.lower("o_orderstatus"), F.lit("/"), "o_custkey", F.lit(".tsx")))
        .otherwise(F.concat(F.lit("app/"), low, F.lit("/route.ts")))
    )
    return load(spark, sf_dir, "orders").select("o_orderkey", tf.route_of_file(path).alias("route"))


@query("WITH r AS (SELECT o_custkey AS f, o_orderkey AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) SELECT f, count(*) AS bindings FROM r WHERE k <= 5 GROUP BY f")
def EX14_wildcard_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = rank.top(load(spark, sf_dir, "orders"), ["o_custkey"], [F.asc("o_orderkey")], 5)
    return capped.groupBy(F.col("o_custkey").alias("f")).agg(F.count("*").alias("bindings"))


@query("WITH o AS (SELECT p_partkey AS id, unnest([p_partkey, p_partkey // 2, p_partkey // 3]) AS owner, unnest([0, 1, 2]) AS k FROM part), m AS (SELECT p_partkey AS owner, p_type AS name FROM part WHERE p_partkey % 4 <> 0), r AS (SELECT o.id, m.name, o.owner, row_number() OVER (PARTITION BY o.id, m.name ORDER BY o.k) AS n FROM o JOIN m USING (owner)) SELECT id, name, owner FROM r WHERE n = 1")
def GR26_inherited_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    order = p.select(F.col("p_partkey").alias("id"), F.expr("array(p_partkey, p_partkey div 2, p_partkey div 3)").alias("order"))
    members = p.filter("p_partkey % 4 != 0").select(F.col("p_partkey").alias("owner"), F.col("p_type").alias("name"))
    return resolve.inherited(order, members)


@query("WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages), h AS (SELECT href, count(DISTINCT page_id) AS n FROM l GROUP BY href) SELECT href AS route, n AS consumers FROM h ORDER BY n DESC, href LIMIT 50")
def TL11_route_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = extract.links(load(spark, sf_dir, "pages"), "page_id", "html").groupBy(F.col("href").alias("route")).agg(F.countDistinct("page_id").alias("consumers"))
    return used.orderBy(F.desc("consumers"), "route").limit(50)


@query("SELECT p_brand AS cluster, count(*) AS members FROM part WHERE contains(lower(concat_ws(' ', p_brand, p_type)), 'brand#1') GROUP BY 1 ORDER BY members DESC, cluster LIMIT 10")
def TL15_feature_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").filter(F.lower(F.concat_ws(" ", "p_brand", "p_type")).contains("brand#1"))
    return p.groupBy(F.col("p_brand").alias("cluster")).agg(F.count("*").alias("members")).orderBy(F.desc("members"), "cluster").limit(10)


@query("WITH d AS (SELECT c_mktsegment AS a, o_orderpriority AS b FROM orders JOIN customer ON c_custkey = o_custkey), x AS (SELECT a AS c, b AS o FROM d UNION SELECT b, a FROM d) SELECT c AS cluster, count(*) AS related, CASE WHEN count(*) >= 15 THEN 'HIGH' WHEN count(*) >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM x GROUP BY c")
def TL17_cluster_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("a"), F.col("o_orderpriority").alias("b")).distinct()
    x = d.select(F.col("a").alias("c"), F.col("b").alias("o")).unionByName(d.select(F.col("b").alias("c"), F.col("a").alias("o"))).distinct()
    n = F.count("*")
    return x.groupBy(F.col("c").alias("cluster")).agg(n.alias("related")).withColumn("risk", F.when(F.col("related") >= 15, "HIGH").when(F.col("related") >= 5, "MEDIUM").otherwise("LOW"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 4) AS norm, len(embedding) AS size FROM embeddings")
def VC02_vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(search.dot(v, v)), 4).alias("norm"), F.size(v).alias("size"))


@query("SELECT vec_id, 'label: ' || label || chr(10) || 'id: ' || vec_id AS content FROM embeddings")
def VC07_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("label: "), "label", F.lit("\nid: "), "vec_id").alias("content"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents")
def VC06_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("lines"))
