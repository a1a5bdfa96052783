"""Sources read from text, sinks read back, projections, limits and orders of the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galena.functions import text as tf
from galena.model import GRAPH_CTE, edges, load, nodes
from galena.operators import scans, stats, traverse, versioned
from galena.registry import query
from galena.sources import extract, sinks


def _folder(spark: SparkSession) -> str:
    return f"{traverse.shared_base(spark)}/galena-{uuid.uuid4().hex}"


def _say(*parts) -> F.Column:
    """The parts put together: names of columns as ``{name}``, anything else as it is."""
    return F.concat(*(F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p) for p in parts))


@query("SELECT 'src/' || p_brand || '/' || p_partkey || '.md' AS path, CAST(length(p_name || p_type) AS BIGINT) AS size FROM part WHERE length(p_name || p_type) <= 30 AND p_partkey % 5 <> 0")
def SRC01_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are written, listed without their contents, and left out if they are ignored or too large."""
    folder = _folder(spark)
    part = load(spark, sf_dir, "part")
    top = F.when(F.col("p_partkey") % 5 == 0, "node_modules/").otherwise("src/")
    part.select(F.concat(top, "p_brand", F.lit("/"), "p_partkey", F.lit(".md")).alias("path"), F.concat("p_name", "p_type").alias("content")).write.parquet(f"{folder}/files")
    files = spark.read.parquet(f"{folder}/files").select("path", F.octet_length("content").cast("long").alias("size"))
    return files.filter(~extract.ignored(F.col("path")) & (F.col("size") <= scans.file_limit(None, 30)))


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN true ELSE false END AS ignored FROM part")
def SRC03_ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 8
    path = (
        F.when(k == 0, _say("a/node_modules/{x}/", "{p_partkey}", ".ts")).when(k == 1, _say("dist/", "{p_partkey}", ".js")).when(k == 2, _say("src/", "{p_partkey}", ".min.js"))
        .when(k == 3, _say("types/", "{p_partkey}", ".d.ts")).when(k == 4, _say("img/", "{p_partkey}", ".png")).when(k == 5, _say("src/distance/", "{p_partkey}", ".ts"))
        .when(k == 6, _say("src/", "{p_partkey}", ".ts")).otherwise(_say("lib/builder/", "{p_partkey}", ".py"))
    )
    return load(spark, sf_dir, "part").select("p_partkey", extract.ignored(path).alias("ignored"))


@query("SELECT * FROM (VALUES (NULL, 524288), ('', 524288), ('64', 65536), ('0', 524288), ('-3', 524288), ('1.5', 524288), ('x', 524288), ('99999999', 33554432), ('32768', 33554432)) t(setting, bytes)")
def SRC04_size_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = [None, "", "64", "0", "-3", "1.5", "x", "99999999", "32768"]
    return spark.createDataFrame([(s, scans.file_limit(s)) for s in settings], "setting string, bytes long")


@query("SELECT p_partkey, unnest([1, 3, 4, 6]) AS line, unnest([1, 2, 3, 1]) AS level, unnest([p_name, p_brand, p_type, 'End']) AS title, unnest([5, 5, 5, 6]) AS end_line, unnest([NULL, 1, 3, NULL]) AS parent FROM part")
def SRC06_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = _say("# ", "{p_name}", "\ntext # no\n##  ", "{p_brand}", " \n### ", "{p_type}", "\n#no heading\n# End")
    return extract.sections(load(spark, sf_dir, "part").select("p_partkey", md.alias("t")), "p_partkey", "t")


@query("SELECT o_orderkey AS k, unnest(['a/' || o_orderkey || '.py', 'a/' || o_orderkey || '.py', 'b.py']) AS path, unnest([1 + o_custkey, 90, 7]) AS start, unnest([o_custkey + 1 + o_orderkey % 5, 90, 8]) AS \"end\" FROM orders")
def SRC07_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").withColumns({"from": F.col("o_custkey") + 1, "n": F.col("o_orderkey") % 5 + 1})
    diff = _say("--- a/x\n+++ b/a/", "{o_orderkey}", ".py\n@@ -1,2 +", "{from}", ",", "{n}", " @@ def f\n+y\n@@ -9 +90 @@\n-z\n@@ -20,2 +30,0 @@\n+++ b/b.py\n@@ -1 +7,2 @@\n")
    return extract.hunks(o.select(F.col("o_orderkey").alias("k"), diff.alias("t")), "k", "t")


@query("SELECT o_orderkey AS k, unnest(['M', 'R', 'C', 'D']) AS status, unnest(['a' || o_orderkey, 'new' || o_custkey, 'copy', 'gone']) AS path, unnest([NULL, 'old' || o_orderkey, 'from', NULL]) AS previous FROM orders")
def SRC08_name_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _say("M\0a", "{o_orderkey}", "\0R100\0old", "{o_orderkey}", "\0new", "{o_custkey}", "\0C75\0from\0copy\0D\0gone\0")
    return extract.name_status(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), raw.alias("t")), "k", "t")


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'const size = ' || p_size || ';' END AS script, CASE WHEN p_partkey % 2 = 0 THEN 'BaseButton,UserCard' ELSE 'UserCard' END AS components FROM part")
def SRC12_component_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-file components: the script block, and the components that the template uses."""
    script = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(_say("<script setup lang=\"ts\">\nconst size = ", "{p_size}", ";\n</script>"))
    inner = F.when(F.col("p_partkey") % 2 == 0, "<div><base-button/><p>x</p></div>").otherwise("<div>y</div>")
    file = F.concat(F.lit("<template>\n<UserCard :a=\"1\">"), inner, F.lit("</UserCard>\n</template>\n"), script)
    files = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), file.alias("t"))
    return files.select("k", extract.component_script(F.col("t")).alias("script"), F.array_join(F.array_sort(extract.components_used(F.col("t"))), ",").alias("components"))


@query(f"WITH {GRAPH_CTE}, r AS (SELECT label, id, name, row_number() OVER (PARTITION BY label ORDER BY id) AS k FROM nodes) SELECT label, id, name FROM r WHERE k <= 3")
def SRC16_labelled_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan without a label: a few rows of each, with the label beside them."""
    w = Window.partitionBy("label").orderBy("id")
    return nodes(spark, sf_dir).withColumn("k", F.row_number().over(w)).filter("k <= 3").select("label", "id", "name")


@query(f"WITH {GRAPH_CTE}, l AS (SELECT id, label FROM nodes) SELECT a.label AS src_label, b.label AS dst_label, count(*) AS n FROM edges e JOIN l a ON a.id = e.src JOIN l b ON b.id = e.dst GROUP BY 1, 2")
def SRC17_graph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph is written, nodes by label and edges by the labels of their ends, and read back; edges with an unknown end are left out."""
    folder = _folder(spark)
    sinks.write_graph(nodes(spark, sf_dir), edges(spark, sf_dir), folder)
    return sinks.read_graph(spark, folder)[1].groupBy("src_label", "dst_label").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS k, 'Svc' || p_size AS service, unnest(['Get' || p_partkey, 'Put']) AS method FROM part")
def SRC21_rpcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    proto = _say("// service No { rpc X (A) returns (B); }\n/* service Old { rpc Y } */\nservice Svc", "{p_size}", " {\n rpc Get", "{p_partkey}", "(A) returns (B) { option o = 1; }\n rpc Put (A) returns (stream B);\n}\n")
    return extract.rpcs(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), proto.alias("t")), "k", "t")


@query(f"WITH {GRAPH_CTE} SELECT label, id, 'say \"' || name || '\", ' || chr(10) || 'x' AS name FROM nodes")
def SNK01_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes as quoted CSV, one set of files for each label, read back with their quotes, commas and line ends."""
    folder = _folder(spark)
    sinks.write_csv(nodes(spark, sf_dir).select("label", "id", F.concat(F.lit('say "'), "name", F.lit('", \nx')).alias("name")), folder)
    return spark.read.schema("id string, name string, label string").option("header", "true").option("escape", '"').option("multiLine", "true").csv(folder).select("label", "id", "name")


@query(f"WITH {GRAPH_CTE}, kept AS (SELECT 'Community' AS label, 'Community:' || c_mktsegment AS id, count(*) AS size FROM customer GROUP BY 2) SELECT label, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM kept GROUP BY label UNION ALL SELECT label, count(*), NULL FROM nodes WHERE label IN ('Customer', 'Nation') GROUP BY label")
def SNK07_replace_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived labels are dropped and made anew; the others stay."""
    n = nodes(spark, sf_dir).filter("label in ('Customer', 'Nation')").select("label", "id", F.lit(None).cast("long").alias("size"))
    old = n.unionByName(spark.createDataFrame([("Community", "Community:stale", 9), ("Process", "Process:stale", 9)], "label string, id string, size long"))
    new = edges(spark, sf_dir).filter("type = 'MEMBER_OF'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("size")).withColumn("label", F.lit("Community"))
    return versioned.replace_layers(old, new, "label", ["Community", "Process"]).groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query("WITH f AS (SELECT DISTINCT 'd' || p_size AS folder FROM part UNION SELECT 'd' || p_size || '/' || p_brand FROM part), files AS (SELECT 'd' || p_size || '/' || p_brand || '/' || p_partkey AS path FROM part WHERE p_size > 10) SELECT folder FROM f WHERE EXISTS (SELECT 1 FROM files WHERE starts_with(path, folder || '/'))")
def SNK08_prune_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders without a file below them go: the files' own folders are the keys, not pairs of paths."""
    p = load(spark, sf_dir, "part")
    folders = p.select(_say("d", "{p_size}").alias("folder")).unionByName(p.select(_say("d", "{p_size}", "/", "{p_brand}").alias("folder"))).distinct()
    files = p.filter("p_size > 10").select(_say("d", "{p_size}", "/", "{p_brand}", "/", "{p_partkey}").alias("path"))
    return folders.join(extract.folders(files).select("folder").distinct(), "folder", "left_semi")


@query("SELECT o_orderkey AS id, o_orderstatus AS v FROM orders ORDER BY o_orderkey")
def SNK10_materialize_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of ids and addresses joined to the objects that it names, among others; rows in the order of their ids."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v"))
    manifest, other = o.select("id", versioned.row_hash(["id", "v"]).alias("address")), o.withColumn("v", F.lit("?"))
    objects = o.unionByName(other).withColumn("address", versioned.row_hash(["id", "v"]))
    return versioned.materialize_snapshot(manifest, objects).select("id", "v")


@query(f"WITH {GRAPH_CTE} SELECT 'node' AS kind, count(*) AS n FROM nodes UNION ALL SELECT 'edge', count(*) FROM edges")
def SNK11_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    sinks.write_ndjson(nodes(spark, sf_dir), edges(spark, sf_dir), folder)
    return spark.read.text(folder).groupBy(F.get_json_object("value", "$.kind").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT 'unchanged' AS state, 0 AS problems UNION ALL SELECT 'a digest replaced', 1 UNION ALL SELECT 'a file missing', 1")
def SNK13_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle is written and sealed by digests; what is pulled is checked against the seal."""
    folder = _folder(spark)
    load(spark, sf_dir, "supplier").coalesce(1).write.parquet(folder)
    sealed = traverse.cut(sinks.seal(spark, folder).filter("path like '%.parquet'"))
    other = sealed.withColumn("digest", F.lit("0"))
    rows = [("unchanged", sealed), ("a digest replaced", other), ("a file missing", sealed.limit(0))]
    count = lambda name, found: sinks.verify(sealed, found).agg(F.lit(name).alias("state"), F.count("*").cast("int").alias("problems"))
    return count(*rows[0]).unionByName(count(*rows[1])).unionByName(count(*rows[2]))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT event_id) AS events FROM events GROUP BY 1")
def SNK15_audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream appends each event once to its day's partition, though all are delivered twice."""
    from galena.streaming import audit

    folder = _folder(spark)
    e = load(spark, sf_dir, "events")
    e.unionByName(e).write.parquet(f"{folder}/in")
    audit.follow(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state").awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))


@query("SELECT p_partkey, p_name || ' ' || p_type AS content, sha256(p_name || ' ' || p_type) AS hash, 'none' AS stored FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_name || ' ' || p_type, sha256(p_name || ' ' || p_type), 'base64' FROM part WHERE p_partkey % 2 = 1")
def SNK16_content_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents stored plain or encoded are read back alike, and their hash is that of the plain text."""
    text = F.concat("p_name", F.lit(" "), "p_type")
    p = load(spark, sf_dir, "part").select("p_partkey", text.alias("plain"), F.when(F.col("p_partkey") % 2 == 0, "none").otherwise("base64").alias("stored"))
    kept = p.select("p_partkey", "stored", F.when(F.col("stored") == "none", F.col("plain")).otherwise(F.base64(F.encode("plain", "UTF-8"))).alias("body"))
    content = F.when(F.col("stored") == "none", F.col("body")).otherwise(F.decode(F.unbase64("body"), "UTF-8"))
    return kept.select("p_partkey", content.alias("content"), F.sha2(content, 256).alias("hash"), "stored")


@query("SELECT p_brand, '## ' || p_brand || chr(10) || string_agg('- ' || p_name || ' (' || p_partkey || ')', chr(10) ORDER BY p_retailprice DESC, p_partkey) FILTER (k <= 3) AS text FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) GROUP BY p_brand")
def SNK17_skill_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators import rank

    best = rank.top(load(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "p_name", "p_partkey"))), lambda x: F.concat(F.lit("- "), x["p_name"], F.lit(" ("), x["p_partkey"].cast("string"), F.lit(")")))
    return best.groupBy("p_brand").agg(F.concat(F.lit("## "), F.first("p_brand"), F.lit("\n"), F.array_join(lines, "\n")).alias("text"))


@query(f"WITH {GRAPH_CTE} SELECT 'Supplier' AS kind, name AS title, id FROM nodes WHERE label = 'Supplier' ORDER BY id LIMIT 25")
def PRJ01_node_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a simple scan becomes a plan: label, projections and a limit; rows in the order of their ids."""
    return scans.node_scan(nodes(spark, sf_dir), "MATCH (n:`Supplier`) RETURN labels(n)[0] AS kind, n.name AS title, n.id AS id LIMIT 25;")


@query("SELECT p_partkey AS id, coalesce(nullif(p_name, ''), 'x') AS name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS summary, CASE WHEN p_partkey % 2 = 0 THEN 'a,b' ELSE '' END AS signals, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END AS members, CASE WHEN p_partkey % 5 = 0 THEN 'heuristic' ELSE 'llm' END AS source FROM part")
def PRJ02_cluster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of clusters with defaults for what is missing and lists written as text."""
    k = F.col("p_partkey")
    raw = load(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_name").alias("name"), F.when(k % 3 != 0, F.col("p_type")).alias("summary"), F.when(k % 2 == 0, "['a', \"b\"]").alias("signals"),
        F.when(k % 4 != 0, F.col("p_size")).alias("members"), F.when(k % 5 != 0, "llm").otherwise("").alias("source"),
    )
    return scans.cluster_rows(raw).withColumn("signals", F.array_join("signals", ","))


@query("SELECT o_orderkey AS id, '{\"id\":' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ',\"status\":\"' || o_orderstatus || '\"' ELSE '' END || '}' AS row_json FROM orders")
def PRJ03_normal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before they are hashed: internal and null columns left out, the others in the order of their names."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("status"), F.lit(1).alias("_label"))
    return o.select("id", versioned.normal_row(o.columns).alias("row_json"))


@query("SELECT p_partkey, p_partkey % 6 < 4 AS utility FROM part")
def FLT05_utility_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    path = (
        F.when(k == 0, _say("src/Utils/", "{p_partkey}", ".ts")).when(k == 1, _say("a\\lib\\", "{p_partkey}", ".py")).when(k == 2, F.lit("x/helpers.js")).when(k == 3, F.lit("core/string_utils.py"))
        .when(k == 4, _say("utils/", "{p_partkey}", ".ts")).otherwise(_say("src/library/", "{p_partkey}", ".ts"))
    )
    return load(spark, sf_dir, "part").select("p_partkey", scans.is_utility(path).alias("utility"))


@query("SELECT * FROM (VALUES ('MATCH (n) RETURN n', false), ('match (n) set n.x = 1', true), ('MATCH (n:Set) RETURN n', false), ('CREATE (n)', true), ('MATCH (n) RETURN n.created', false), ('CALL QUERY_FTS_INDEX(1)', false), ('MATCH (n) DETACH DELETE n', true), ('LOAD FROM x', true)) t(query, writes)")
def FLT06_write_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["MATCH (n) RETURN n", "match (n) set n.x = 1", "MATCH (n:Set) RETURN n", "CREATE (n)", "MATCH (n) RETURN n.created", "CALL QUERY_FTS_INDEX(1)", "MATCH (n) DETACH DELETE n", "LOAD FROM x"]
    return spark.createDataFrame([(t,) for t in texts], "query string").withColumn("writes", scans.is_write(F.col("query")))


@query("SELECT * FROM (VALUES ('MATCH (n) RETURN n LIMIT 9', 'MATCH (n) RETURN n LIMIT 5'), ('MATCH (n) RETURN n ; ', 'MATCH (n) RETURN n  LIMIT 5'), ('RETURN 1 limit 700', 'RETURN 1 LIMIT 5')) t(query, limited)")
def LIM01_limited_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["MATCH (n) RETURN n LIMIT 9", "MATCH (n) RETURN n ; ", "RETURN 1 limit 700"]
    return spark.createDataFrame([(t,) for t in texts], "query string").withColumn("limited", scans.with_limit(F.col("query"), 5))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN least(500, greatest(1, p_partkey)) WHEN 1 THEN 20 WHEN 2 THEN 1 ELSE least(500, p_size) END AS k FROM part")
def LIM02_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.col("p_partkey").cast("string")).when(k == 1, "many").when(k == 2, "-7").otherwise(_say("{p_size}", ".9 rows"))
    return load(spark, sf_dir, "part").select("p_partkey", scans.clamp(raw, 1, 500, 20).alias("k"))


@query(f"WITH {GRAPH_CTE} SELECT e.dst AS module, count(*) AS hits FROM edges e WHERE e.type IN ('MEMBER_OF', 'STEP_IN_PROCESS') GROUP BY 1 ORDER BY hits DESC, module LIMIT 20")
def SL02_top_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).filter(F.col("type").isin("MEMBER_OF", "STEP_IN_PROCESS"))
    return e.groupBy(F.col("dst").alias("module")).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "module").limit(20)


@query(f"WITH {GRAPH_CTE}, r AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY id) AS k FROM nodes) SELECT label, id FROM r WHERE k <= 5 ORDER BY label, id LIMIT 12")
def SL03_limit_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit of each label first, then one over all."""
    w = Window.partitionBy("label").orderBy("id")
    return nodes(spark, sf_dir).select("label", "id").withColumn("k", F.row_number().over(w)).filter("k <= 5").orderBy("label", "id").limit(12).drop("k")


@query("SELECT s_suppkey, 'acctbal=' || CAST(floor(s_acctbal) AS BIGINT) || ';name=' || s_name || ';nation=' || s_nationkey AS entries FROM supplier")
def SL04_sorted_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map's entries in the order of their keys, whatever the order in which they were put."""
    m = F.create_map(F.lit("name"), F.col("s_name"), F.lit("acctbal"), F.floor("s_acctbal").cast("string"), F.lit("nation"), F.col("s_nationkey").cast("string"))
    entries = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(entries, ";").alias("entries"))


@query(f"WITH {GRAPH_CTE} SELECT family, src, dst FROM (SELECT CASE WHEN type = 'CALLS' THEN 'DEPENDS' WHEN type = 'EXTENDS' THEN 'INHERITS' ELSE 'COMPOSES' END AS family, src, dst, confidence, CASE WHEN type = 'EXTENDS' THEN 0 WHEN type = 'CALLS' THEN 1 ELSE 2 END AS p FROM edges) ORDER BY p, confidence DESC, src, dst LIMIT 300")
def SL05_semantic_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families in their order of priority, then by confidence."""
    family = F.when(F.col("type") == "CALLS", "DEPENDS").when(F.col("type") == "EXTENDS", "INHERITS").otherwise("COMPOSES")
    priority = F.create_map(*(F.lit(x) for x in ("INHERITS", 0, "DEPENDS", 1, "COMPOSES", 2)))
    e = edges(spark, sf_dir).withColumn("family", family)
    return e.orderBy(priority[F.col("family")], F.desc("confidence"), "src", "dst").limit(300).select("family", "src", "dst")


@query("WITH s AS (SELECT p_brand AS file, p_partkey AS node, p_size * 1.5 AS score FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, node) AS k FROM s) SELECT file, CAST(sum(score) AS DOUBLE) AS score, string_agg(node, ',' ORDER BY k) AS nodes FROM r WHERE k <= 3 GROUP BY file")
def AG08_best_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators import rank

    best = rank.top(load(spark, sf_dir, "part").withColumn("score", F.col("p_size") * 1.5), ["p_brand"], [F.desc("score"), F.asc("p_partkey")], 3)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "p_partkey"))), lambda x: x["p_partkey"].cast("string"))
    return best.groupBy(F.col("p_brand").alias("file")).agg(F.sum("score").alias("score"), F.array_join(ids, ",").alias("nodes"))


@query("WITH b AS (SELECT p_brand, count(*) AS n, sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS k FROM part GROUP BY 1 UNION ALL SELECT 'none', 0, 0), q AS (SELECT p_brand, n, k / n AS p FROM b) SELECT p_brand, round(CASE WHEN n = 0 THEN 0 ELSE greatest(0, (p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)) END, 6) AS low, round(CASE WHEN n = 0 THEN 0 ELSE least(1, (p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)) END, 6) AS high FROM q")
def AG14_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").cast("double").alias("n"), F.sum((F.col("p_size") > 25).cast("double")).alias("k"))
    b = b.unionByName(spark.createDataFrame([("none", 0.0, 0.0)], b.schema))
    low, high = stats.wilson(F.col("k"), F.expr("nullif(n, 0)"))
    return b.select("p_brand", F.round(F.coalesce(low, F.lit(0.0)), 6).alias("low"), F.round(F.coalesce(high, F.lit(0.0)), 6).alias("high"))


@query("SELECT s_nationkey AS route, count(c_custkey) AS consumers, string_agg(DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'id' END, ',') AS has_id, max(CASE WHEN c_custkey IS NOT NULL THEN 1 + c_custkey % 3 END) AS fetches FROM (SELECT DISTINCT s_nationkey FROM supplier) LEFT JOIN customer ON c_nationkey = s_nationkey GROUP BY 1")
def AG18_route_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes with what their consumers' reasons say: the keys they read and how many fetches they make; routes without consumers stay."""
    routes = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("route")).distinct()
    k = F.col("c_custkey")
    keys = F.when(k % 2 == 0, "|keys:id,name").otherwise("")
    fetches = F.when(k % 3 > 0, F.concat(F.lit("|fetches:"), k % 3 + 1)).otherwise("")
    c = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("route"), "c_custkey", F.concat(F.lit("fetch-url-match"), keys, fetches).alias("reason"))
    c = c.select("route", "c_custkey", extract.reason_keys(F.col("reason")).alias("keys"), extract.reason_fetches(F.col("reason")).alias("n"))
    out = routes.join(c, "route", "left").groupBy("route")
    return out.agg(F.count("c_custkey").alias("consumers"), F.max(F.when(F.array_contains("keys", "id"), "id")).alias("has_id"), F.max("n").alias("fetches"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '/users' WHEN 1 THEN '/' WHEN 2 THEN '/users/[id]' END AS screen, CASE o_orderkey % 3 WHEN 0 THEN '/api/upload' || o_custkey END AS php FROM orders")
def EX18_screen_and_php_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    screen = F.when(k % 4 == 0, "app/(tabs)/users/index.tsx").when(k % 4 == 1, "src/app/index.js").when(k % 4 == 2, "app/users/[id].tsx").otherwise("app/_layout.tsx")
    php = F.when(k % 3 == 0, _say("api/upload", "{o_custkey}", ".php")).when(k % 3 == 1, F.lit("api/db_helper.php")).otherwise("src/api/x.php")
    return load(spark, sf_dir, "orders").select(k.alias("k"), tf.route_of_screen(screen).alias("screen"), tf.route_of_php(php).alias("php"))


@query("SELECT o_orderkey AS k, unnest(['prisma', 'supabase']) AS orm, unnest(['user', 'jobs' || o_custkey % 3]) AS model, unnest([CASE WHEN o_orderkey % 2 = 0 THEN 'findMany' ELSE 'upsert' END, 'insert']) AS method FROM orders")
def EX15_orm_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").withColumns({"m": F.when(F.col("o_orderkey") % 2 == 0, "findMany").otherwise("upsert"), "t": F.concat(F.lit("jobs"), F.col("o_custkey") % 3)})
    code = _say("await prisma.user.", "{m}", " ({});\nprisma.user.findRaw({});\nsupabase.from( 'x').then();\nsupabase.from(\"", "{t}", "\").insert(rows)")
    return extract.orm_calls(o.select(F.col("o_orderkey").alias("k"), code.alias("c")), "k", "c")


@query("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'http::GET::/a/' || o_custkey WHEN 1 THEN 'grpc::svc/get' WHEN 2 THEN 'topic::orders.' || o_custkey ELSE 'http::*::/x' END AS cid FROM orders")
def EX38_contract_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, _say("HTTP::get::/A/", "{o_custkey}", "//")).when(k == 1, F.lit("GRPC::Svc/Get")).when(k == 2, _say("topic::Orders.", "{o_custkey}")).otherwise("http::*::/X/")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), tf.contract_id(raw).alias("cid"))
