"""Search, vectors, text functions, extractors, contracts, routes, audit and versioned storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galena.functions import text as tf
from galena.model import GRAPH_CTE, edges, load, nodes
from galena.operators import rank, search, traverse, versioned
from galena.registry import query
from galena.sources import extract


@query("SELECT item_id, string_agg(t, ',' ORDER BY t) AS terms FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM benchmark) WHERE length(t) > 1 AND t NOT IN ('and', 'or', 'not') GROUP BY item_id")
def TX01_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(search.terms(F.col("text"))), ",").alias("terms"))


@query(
    """
SELECT p_partkey, CAST(4.0 * ((CASE WHEN contains(lower(p_name), 'steel red') THEN 3 ELSE 0 END) + (CASE WHEN contains(lower(p_name), 'steel') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(p_name), 'red') THEN 1 ELSE 0 END))
 + 1.0 * ((CASE WHEN contains(lower(p_type), 'steel red') THEN 3 ELSE 0 END) + (CASE WHEN contains(lower(p_type), 'steel') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(p_type), 'red') THEN 1 ELSE 0 END)) AS DOUBLE) AS score FROM part
"""
)
def TX03_keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", search.keyword_score({"p_name": 4.0, "p_type": 1.0}, ["steel", "red"]).alias("score"))


BM25_SQL = """WITH tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents), l AS (SELECT doc_id, len(w) AS size, w FROM tok), g AS (SELECT count(*) AS n, avg(size) AS mean FROM l),
t AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, size, unnest(w) AS term FROM l) WHERE term IN ('the', 'idiot', 'token') GROUP BY 1, 2, 3), d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
s AS (SELECT doc_id, sum(ln(1 + (g.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.size / g.mean))) AS score FROM t JOIN d USING (term), g GROUP BY doc_id)"""


@query(BM25_SQL + " SELECT doc_id, round(score, 4) AS score FROM s")
def TX05_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(load(spark, sf_dir, "documents"), "doc_id", "text", ["the", "idiot", "token"]).withColumn("score", F.round("score", 4))


@query(BM25_SQL + ", r AS (SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS k FROM s JOIN documents USING (doc_id)) SELECT source, round(sum(score), 4) AS score, count(*) AS n FROM r WHERE k <= 3 GROUP BY source")
def TX07_bm25_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    hits = search.bm25(docs, "doc_id", "text", ["the", "idiot", "token"]).join(docs.select("doc_id", "source"), "doc_id")
    return rank.top(hits, ["source"], [F.desc("score"), F.asc("doc_id")], 3).groupBy("source").agg(F.round(F.sum("score"), 4).alias("score"), F.count("*").alias("n"))


@query(
    """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(distance, 5) AS distance FROM (SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v), 6) AS distance FROM embeddings, q) WHERE distance < 0.9 ORDER BY distance, vec_id LIMIT 10
"""
)
def VC01_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    wanted = [float(x) for x in vectors.filter("vec_id = 7").first()["embedding"]]
    return search.nearest(vectors, wanted, 10, 0.9).withColumn("distance", F.round("distance", 5))


@query("SELECT a.label, round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 4) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY a.label")
def VC03_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").groupBy("label").agg(F.round(F.avg(search.cosine(F.col("embedding"), F.col("other"))), 4).alias("similarity"))


@query(
    """
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, text, unnest(generate_series(0, CAST(greatest(0, ceil((n - 1200) / 1080.0)) AS INT))) AS chunk FROM d)
SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(chunk * 1080 AS INT) AS start, md5(substr(text, CAST(chunk * 1080 + 1 AS INT), 1200)) AS content FROM c
"""
)
def VC04_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.chunks(load(spark, sf_dir, "documents"), "doc_id", "text").withColumn("content", F.md5("content"))


@query("SELECT vec_id, sha1('v2' || chr(10) || label || ':' || vec_id) AS content_hash, CASE WHEN vec_id % 3 = 1 THEN 'absent' ELSE 'differs' END AS why FROM embeddings WHERE vec_id % 3 <> 0")
def VC08_stale_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose stored hash is absent or not that of their text: of three, one is fresh, one absent, one of another text."""
    hashed = lambda label: F.sha1(F.concat(F.lit("v2\n"), label, F.lit(":"), "vec_id"))
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    stored = e.filter("vec_id % 3 != 1").select("vec_id", F.when(F.col("vec_id") % 3 == 2, hashed(F.col("label") + 1)).otherwise(hashed(F.col("label"))).alias("old"))
    both = e.select("vec_id", hashed(F.col("label")).alias("content_hash")).join(stored, "vec_id", "left").filter(~F.col("content_hash").eqNullSafe(F.col("old")))
    return both.select("vec_id", "content_hash", F.when(F.col("old").isNull(), "absent").otherwise("differs").alias("why"))


@query("SELECT doc_id, CAST(floor(length(trim(text)) / 4) AS BIGINT) AS tokens FROM documents")
def CP01_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", tf.estimate_tokens(F.col("text")).alias("tokens"))


@query(r"""SELECT doc_id, len(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ([A-Z"''`(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS sentences FROM documents""")
def CP02_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.size(tf.sentences(F.col("text"))).alias("sentences"))


PROSE_SQL = (
    "WITH d AS (SELECT item, kind, text, "
    + " + ".join(f"CAST(contains(text, '{x}') AS INT)" for x in tf.CODE_SIGNS)
    + r""" AS signs, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words, len(regexp_extract_all(text, '[{}\[\]]')) AS brackets FROM (
SELECT doc_id AS item, 'document' AS kind, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT page_id, 'page', html FROM pages WHERE html IS NOT NULL
UNION ALL SELECT p_partkey, 'code', CASE p_partkey % 6 WHEN 0 THEN 'import x; const ' || p_name || ' = 1 done here' WHEN 1 THEN 'a {b} [c] ' || p_name || ' end of it all' WHEN 2 THEN 'one == two' WHEN 3 THEN 'const only one sign in ' || p_name || ' so prose' WHEN 4 THEN 'if (a && b || c) then ' || p_type ELSE '{} {} [] ' || p_name || ' x y' END FROM part))
SELECT kind, item, words < 5 OR (signs < 2 AND brackets <= words * 0.2) AS prose FROM d"""
)


@query(PROSE_SQL)
def CP03_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, pages and made-up code; the last has a row for each branch of the rule."""
    say = lambda *parts: F.concat(*(F.lit(p) if not p.startswith("p_") else F.col(p) for p in parts))
    k = F.col("p_partkey") % 6
    made = (
        F.when(k == 0, say("import x; const ", "p_name", " = 1 done here")).when(k == 1, say("a {b} [c] ", "p_name", " end of it all")).when(k == 2, F.lit("one == two"))
        .when(k == 3, say("const only one sign in ", "p_name", " so prose")).when(k == 4, say("if (a && b || c) then ", "p_type")).otherwise(say("{} {} [] ", "p_name", " x y"))
    )
    one = lambda df, kind, key, text: df.filter(text.isNotNull()).select(F.lit(kind).alias("kind"), F.col(key).alias("item"), tf.is_prose(text).alias("prose"))
    docs, pages, part = (load(spark, sf_dir, t) for t in ("documents", "pages", "part"))
    return one(docs, "document", "doc_id", F.col("text")).unionByName(one(pages, "page", "page_id", F.col("html"))).unionByName(one(part, "code", "p_partkey", made))


@query(
    r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', '') AS path FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 1 THEN regexp_replace(split_part(path, '?', 1), '\.(php|asp|aspx|jsp|cgi)$', '') || '/[param]' WHEN 2 THEN split_part(path, '?', 1) WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE regexp_replace(split_part(path, '?', 1), '\.(php|asp|aspx|jsp|cgi)$', '') END AS path
FROM p WHERE starts_with(path, '/') AND NOT contains(split_part(path, '?', 1), '+') AND NOT contains(split_part(path, '?', 1), '(') AND (page_id % 5 <> 1 OR NOT contains(path, '?'))
"""
)
def EX19_fetch_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of pages as arguments of fetch calls: as they are, with an expression, with a script's extension, with code, and relative."""
    path = F.regexp_replace("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    first, k = F.split_part("path", F.lit("?"), F.lit(1)), F.col("page_id") % 5
    p = load(spark, sf_dir, "pages").select("page_id", path.alias("path")).filter(F.col("path").startswith("/") & ~first.contains("+") & ~first.contains("(") & ((k != 1) | ~F.col("path").contains("?")))
    raw = (
        F.when(k == 1, F.concat(F.lit("`"), F.regexp_replace("path", r"\.(php|asp|aspx|jsp|cgi)$", ""), F.lit("/${item.id}`")))
        .when(k == 2, F.concat(first, F.lit(".php?page=1"))).when(k == 3, F.concat(first, F.lit("+x"))).when(k == 4, F.expr("substring(path, 2)")).otherwise(F.col("path"))
    )
    return p.select("page_id", tf.fetch_url(raw).alias("path"))


@query(
    """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
SELECT k, CASE WHEN k % 4 = 3 THEN 0 WHEN k % 4 = 2 THEN 2 ELSE 1 END AS fetches, CASE k % 4 WHEN 0 THEN 'id,name' || c || ',total' WHEN 1 THEN 'items,error' WHEN 2 THEN 'a,b,k' || c % 7 ELSE '' END AS keys,
CASE WHEN k % 4 = 0 THEN '/api/c/' || c WHEN k % 4 = 1 THEN '/api/list?x=' || k WHEN k % 4 = 2 THEN '/api/one' END AS first_url FROM o
"""
)
def EX10_fetch_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code written from orders: how many calls it has, the first one's URL, and the keys it reads of the responses."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    code = (
        F.when(k % 4 == 0, say("const { id, name", c, ": alias } = await fetch('/api/c/", c, "').json();\nshow(data?.total, data.map(f));"))
        .when(k % 4 == 1, say("let { items } = result;\nconst r = await axios.get(\"/api/list?x=", k, "\");\nif (res.error) response.json();"))
        .when(k % 4 == 2, say("var {a, b} = await got(`/api/one`);\nfetch('/api/two');\nuse(body.k", c % 7, ", body.k", c % 7, ", result.length);"))
        .otherwise(say("prefetch(x); database.total = ", k))
    )
    files = load(spark, sf_dir, "orders").select(k.alias("k"), code.alias("code"))
    calls = extract.fetch_calls(files, "k", "code").groupBy("k").agg(F.count("*").alias("fetches"))
    first = F.get(F.regexp_extract_all("code", F.lit("['\"`](/[^'\"`]*)['\"`]"), F.lit(1)), F.lit(0))
    return files.select("k", F.array_join(extract.accessed_keys(F.col("code")), ",").alias("keys"), first.alias("first_url")).join(calls, "k", "left").fillna(0, ["fetches"])


@query(
    r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '(.)/+$', '\1') AS path FROM pages), r AS (SELECT * FROM (VALUES ('/en/:id', '^/en/[^/]+/?$'), ('/de/[...rest]', '^/de/.+/?$'), ('/fr/{id}', '^/fr/[^/]+/?$')) t(route, pattern))
SELECT p.page_id, r.route FROM p JOIN r ON regexp_matches(p.path, r.pattern)
"""
)
def JN21_route_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = spark.createDataFrame([("/en/:id",), ("/de/[...rest]",), ("/fr/{id}",)], "route string")
    patterns = routes.withColumn("pattern", tf.route_pattern(F.col("route")))
    p = load(spark, sf_dir, "pages").select("page_id", tf.normal_url(F.col("url")).alias("path"))
    return p.join(F.broadcast(patterns), F.expr("path rlike pattern")).select("page_id", "route")  # three routes


CONTRACTS = """pr AS (SELECT s_suppkey AS id, s_nationkey % 5 AS repo, 'http::get::/Nation/' || s_nationkey || '/' AS raw FROM supplier), co AS (SELECT c_custkey AS id, c_custkey % 5 AS repo, CASE WHEN c_custkey % 4 = 0 THEN 'HTTP::*::/nation/' ELSE 'http::GET::/nation/' END || c_nationkey AS raw FROM customer),
p AS (SELECT id, repo, upper(split_part(raw, '::', 2)) AS method, regexp_replace(lower(split_part(raw, '::', 3)), '(.)/+$', '\\1') AS path FROM pr), c AS (SELECT id, repo, upper(split_part(raw, '::', 2)) AS method, regexp_replace(lower(split_part(raw, '::', 3)), '(.)/+$', '\\1') AS path FROM co)"""


def _contracts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    split = lambda df: df.withColumn("cid", tf.contract_id(F.col("raw"))).select("id", "repo", F.split_part("cid", F.lit("::"), F.lit(2)).alias("method"), F.split_part("cid", F.lit("::"), F.lit(3)).alias("path"))
    pr = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).alias("repo"), F.concat(F.lit("http::get::/Nation/"), "s_nationkey", F.lit("/")).alias("raw"))
    start = F.when(F.col("c_custkey") % 4 == 0, "HTTP::*::/nation/").otherwise("http::GET::/nation/")
    co = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5).alias("repo"), F.concat(start, "c_nationkey").alias("raw"))
    return split(pr), split(co)


def _met(c: str = "m2", p: str = "method") -> str:
    return f"({p} = {c} or {c} = '*' or {p} = '*')"


@query(f"WITH {CONTRACTS} SELECT c.id AS consumer, count(*) AS providers, min(p.id) AS first_provider, CAST(1.0 AS DOUBLE) AS confidence FROM c JOIN p ON p.path = c.path AND p.repo <> c.repo AND (p.method = c.method OR c.method = '*' OR p.method = '*') GROUP BY 1")
def JN13_contract_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers are rolled up by path, method and repository first, so that a row is a consumer, not a pair."""
    p, c = _contracts(spark, sf_dir)
    rolled = p.groupBy("path", "method", "repo").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    c = c.select(F.col("id").alias("consumer"), F.col("repo").alias("r2"), F.col("method").alias("m2"), "path")
    met = rolled.join(c, "path").filter(f"repo != r2 and {_met()}").groupBy("consumer")
    return met.agg(F.sum("n").alias("providers"), F.min("low").alias("first_provider")).withColumn("confidence", F.lit(1.0))


@query(f"WITH {CONTRACTS}, l AS (SELECT c.id FROM c JOIN p ON p.path = c.path AND p.repo <> c.repo AND (p.method = c.method OR c.method = '*' OR p.method = '*')) SELECT id FROM c WHERE id NOT IN (SELECT id FROM l)")
def JN15_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a path and method only the least and the greatest repository count: one of them is another than the consumer's, if any is."""
    p, c = _contracts(spark, sf_dir)
    ends = p.groupBy("path", "method").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi"))
    c = c.select("id", "repo", F.col("method").alias("m2"), "path").alias("c")
    return c.join(ends.alias("e"), F.expr(f"c.path = e.path and {_met('c.m2', 'e.method')} and (e.lo != c.repo or e.hi != c.repo)"), "left_anti").select("id")


@query(
    f"WITH {CONTRACTS} SELECT p.repo AS source, c.repo AS target, count(*) AS links FROM c JOIN p ON p.path = c.path AND p.repo <> c.repo AND (p.method = c.method OR c.method = '*' OR p.method = '*') GROUP BY 1, 2"
)
def JN16_bridge_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = _contracts(spark, sf_dir)
    providers = p.groupBy("path", "method", "repo").agg(F.count("*").alias("np"))
    consumers = c.groupBy("path", F.col("method").alias("m2"), F.col("repo").alias("r2")).agg(F.count("*").alias("nc"))
    links = providers.join(consumers, "path").filter(f"repo != r2 and {_met()}")
    return links.groupBy(F.col("repo").alias("source"), F.col("r2").alias("target")).agg(F.sum(F.col("np") * F.col("nc")).alias("links"))


@query(
    """
WITH r AS (SELECT p_partkey AS ref, p_name AS name, p_brand AS brand FROM part), d AS (SELECT p_name AS name, p_brand AS brand, p_partkey AS def FROM part WHERE p_partkey % 3 = 0), a AS (SELECT name, brand, min(def) AS def FROM d GROUP BY 1, 2), b AS (SELECT brand, min(def) AS def FROM d GROUP BY 1)
SELECT r.ref, coalesce(a.def, b.def) AS def, CAST(CASE WHEN a.def IS NOT NULL THEN 0.95 WHEN b.def IS NOT NULL THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence FROM r LEFT JOIN a ON a.name = r.name AND a.brand = r.brand LEFT JOIN b ON b.brand = r.brand
"""
)
def JN19_tiered_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    d = p.filter("ref % 3 = 0")
    a, b = d.groupBy("name", "brand").agg(F.min("ref").alias("a")), d.groupBy("brand").agg(F.min("ref").alias("b"))
    found = p.join(a, ["name", "brand"], "left").join(b, "brand", "left")
    return found.select("ref", F.coalesce("a", "b").alias("def"), F.when(F.col("a").isNotNull(), 0.95).when(F.col("b").isNotNull(), 0.9).otherwise(0.5).alias("confidence"))


@query(
    f"""
WITH {GRAPH_CTE}, s AS (SELECT DISTINCT string_split(file_path, '/') AS p FROM nodes), k AS (SELECT p, unnest(generate_series(1, len(p) - 1)) AS k FROM s) SELECT DISTINCT array_to_string(p[1:k], '/') AS folder, array_to_string(p[1:k+1], '/') AS child FROM k
"""
)
def EX01_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.folders(nodes(spark, sf_dir).select("file_path").distinct(), "file_path")


@query(f"WITH {GRAPH_CTE} SELECT CASE WHEN file_path LIKE '%.ts' THEN 'typescript' END AS language, count(*) AS n FROM nodes GROUP BY 1")
def SRC05_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).groupBy(extract.language(F.col("file_path")).alias("language")).agg(F.count("*").alias("n"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(regexp_replace(p_type, '([a-z0-9])([A-Z])', '\1-\2', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def EX27_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", tf.slug(F.col("p_type")).alias("slug"))


@query(
    """
WITH s AS (SELECT p_brand AS item, lower(p_type) AS slug, 2 AS w FROM part UNION ALL SELECT p_brand, lower(split_part(p_name, ' ', 1)), 3 FROM part), t AS (SELECT item, slug, sum(w) AS weight FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY weight DESC, slug) AS k FROM t)
SELECT item, slug, CAST(weight AS BIGINT) AS weight FROM r WHERE k = 1
"""
)
def EX26_best_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    signals = F.explode(F.array(F.struct(F.lower("p_type").alias("slug"), F.lit(2).alias("w")), F.struct(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("slug"), F.lit(3).alias("w"))))
    t = p.select(F.col("p_brand").alias("item"), signals.alias("s")).groupBy("item", "s.slug").agg(F.sum("s.w").alias("weight"))
    return rank.top(t, ["item"], [F.desc("weight"), F.asc("slug")], 1).drop("rank")


@query("SELECT o_orderkey, 'sha256:' || sha256('{\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS address FROM orders")
def SNK09_snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", versioned.row_hash(["o_orderkey", "o_custkey", "o_orderstatus"]).alias("address"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'new' ELSE o_orderstatus END AS v FROM orders")
def SNK04_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    return versioned.upsert(o, o.filter("o_orderkey % 6 = 0").withColumn("v", F.lit("new")), "o_orderkey")


@query(f"WITH {GRAPH_CTE}, gone AS (SELECT id FROM nodes WHERE file_path = 'src/orders/f.ts'), left_nodes AS (SELECT label, count(*) AS n FROM nodes WHERE file_path <> 'src/orders/f.ts' GROUP BY label), left_edges AS (SELECT type, count(*) AS n FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY type) SELECT 'node' AS kind, label AS name, n FROM left_nodes UNION ALL SELECT 'edge', type, n FROM left_edges UNION ALL SELECT 'embedding', 'chunks', count(*) FROM (SELECT 'Order:' || o_orderkey AS node FROM orders WHERE o_orderkey % 3 = 0) WHERE node NOT IN (SELECT id FROM gone)")
def SNK05_delete_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's nodes go with their edges on either side and the chunks of their embeddings; what is left, by kind."""
    chunks = load(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.concat(F.lit("Order:"), "o_orderkey", F.lit(":0")).alias("chunk"))
    n, e, c = versioned.delete_file(nodes(spark, sf_dir), edges(spark, sf_dir), chunks, "src/orders/f.ts")
    count = lambda df, kind, name: df.groupBy(F.lit(kind).alias("kind"), name.alias("name")).agg(F.count("*").alias("n"))
    return count(n, "node", F.col("label")).unionByName(count(e, "edge", F.col("type"))).unionByName(c.agg(F.lit("embedding").alias("kind"), F.lit("chunks").alias("name"), F.count("*").alias("n")))


@query("SELECT '| ' || s_suppkey || ' | ' || s_name || ' |' AS line FROM supplier")
def SNK12_markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").select(F.concat(F.lit("| "), F.concat_ws(" | ", F.col("s_suppkey").cast("string"), "s_name"), F.lit(" |")).alias("line"))


@query("WITH r AS (SELECT * FROM (VALUES ('viewer', 1), ('member', 2), ('admin', 3), ('owner', 4)) t(role, level)), u AS (SELECT DISTINCT user_id, CASE user_id % 5 WHEN 0 THEN 'viewer' WHEN 1 THEN 'member' WHEN 2 THEN 'admin' WHEN 3 THEN 'owner' END AS role FROM events) SELECT user_id, coalesce(r.level, 4) >= 3 AS allowed FROM u LEFT JOIN r USING (role)")
def TL42_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ladder = F.create_map(*(F.lit(x) for pair in (("viewer", 1), ("member", 2), ("admin", 3), ("owner", 4)) for x in pair))
    u = load(spark, sf_dir, "events").select("user_id").distinct()
    role = F.expr("case user_id % 5 when 0 then 'viewer' when 1 then 'member' when 2 then 'admin' when 3 then 'owner' end")
    return u.select("user_id", (F.coalesce(ladder[role], F.lit(4)) >= 3).alias("allowed"))


@query("""SELECT event_id, 'sha256:' || sha256('{"action":"' || event_type || '","actor":"u' || user_id || '","schemaVersion":1,"target":"' || event_id || '","type":"audit-event"}') AS id, event_id % 7 <> 0 AS valid FROM events WHERE event_type = 'error'""")
def TL44_audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of audit events, and whether a stored event, of which one in seven was changed after it was written, still has the id of its body."""
    e = load(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", F.col("event_type").alias("action"), F.concat(F.lit("u"), "user_id").alias("actor"), F.col("event_id").cast("string").alias("target"))
    written = versioned.audit_events(e, ["action", "actor", "target"])
    stored = written.withColumn("actor", F.when(F.col("event_id") % 7 == 0, F.concat("actor", F.lit("x"))).otherwise(F.col("actor")))
    return stored.select("event_id", "id", versioned.audit_valid(["action", "actor", "target"]).alias("valid"))


@query("WITH c AS (SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) SELECT user_id, min(event_id) AS stop FROM c WHERE spent > 1000 GROUP BY user_id")
def TL36_budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, sf_dir, "events").withColumn("spent", F.sum("value").over(w)).filter("spent > 1000").groupBy("user_id").agg(F.min("event_id").alias("stop"))


@query("SELECT item_id, regexp_replace(text, '\\bthe\\b', 'THE', 'g') AS text FROM benchmark WHERE regexp_matches(text, '\\bthe\\b')")
def TL08_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = load(spark, sf_dir, "benchmark").filter(F.col("text").rlike(r"\bthe\b"))
    return b.select("item_id", F.regexp_replace("text", r"\bthe\b", "THE").alias("text"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS flow FROM conversations GROUP BY conv_id")
def TL10_flow_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(steps, lambda s: s["role"]), ">").alias("flow"))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def EX20_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def ST04_daily_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming roll-up in ``galena.streaming.audit``."""
    from galena.streaming.audit import daily

    return daily(load(spark, sf_dir, "events")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query()
def GR28_traverse_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on or behind a cycle of a small import graph."""
    l = load(spark, sf_dir, "lineitem")
    return traverse.levels(l.select((F.col("l_partkey") % 40).alias("src"), (F.col("l_suppkey") % 40).alias("dst"))).filter("level = -1")
