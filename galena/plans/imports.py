"""Import resolution, type names and name look-ups of the catalogue, over files and imports made from parts and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.functions import types as ty
from galena.model import load
from galena.operators import imports as im
from galena.registry import query

#: Files of several languages, and what orders import; the same for both engines.
FILES_SQL = """SELECT DISTINCT CASE p_partkey % 8 WHEN 0 THEN 'src/m' || p_size || '/c' || p_partkey % 40 || '.ts' WHEN 1 THEN 'app/p' || p_size || '/mod' || p_partkey % 40 || '.py' WHEN 2 THEN 'app/p' || p_size || '/pk' || p_partkey % 40 || '/__init__.py'
 WHEN 3 THEN 'internal/g' || p_size || '/s' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '_test.go' ELSE '.go' END WHEN 4 THEN 'java/com/j' || p_size || '/K' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.kt' ELSE '.java' END
 WHEN 5 THEN 'src/r' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '.rs' ELSE '/mod.rs' END WHEN 6 THEN 'app/Http/H' || p_size || '/C' || p_partkey % 40 || '.php' ELSE 'proj/Models/M' || p_size || '/E' || p_partkey % 40 || '.cs' END AS path FROM part"""
ENDINGS_SQL = "e AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in im.ENDINGS) + f"]) AS ending, unnest(generate_series(1, {len(im.ENDINGS)})) AS e)"
FIRST_SQL = "SELECT r.key, (SELECT arg_min(f.path, c.rank) FROM c JOIN f ON f.path = c.path WHERE c.key = r.key) AS file FROM r"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.model import _over

    return _over(spark, sf_dir, FILES_SQL)


def _requests(spark: SparkSession, sf_dir: str, current: str, name: str) -> DataFrame:
    from galena.model import _over

    return _over(spark, sf_dir, f"SELECT o_orderkey AS key, {current} AS current, {name} AS name FROM orders")


def _sql(current: str, name: str) -> str:
    return f"f AS ({FILES_SQL}), r AS (SELECT o_orderkey AS key, {current} AS current, {name} AS name FROM orders)"


TS = ("'src/m' || o_custkey % 50 || '/x.ts'", "CASE WHEN o_orderkey % 2 = 0 THEN './c' ELSE '../m' || o_orderkey % 50 || '/c' END || o_orderkey % 40")


@query(f"WITH {_sql(*TS)}, {ENDINGS_SQL}, b AS (SELECT key, CASE WHEN key % 2 = 0 THEN regexp_replace(current, '/[^/]*$', '') || substr(name, 2) ELSE 'src' || substr(name, 3) END AS base FROM r), c AS (SELECT key, base || ending AS path, e AS rank FROM b, e) {FIRST_SQL}")
def LG11_relative_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _requests(spark, sf_dir, *TS)
    return im.chain(r, im.relative(r, _files(spark, sf_dir)))


SUFFIX = ("'x'", "CASE o_orderkey % 3 WHEN 0 THEN 'lib.m' || o_custkey % 50 || '.c' || o_orderkey % 40 WHEN 1 THEN 'M' || o_custkey % 50 || '/C' || o_orderkey % 40 ELSE 'nothing.here' END")
SUFFIX_SQL = f"""WITH {_sql(*SUFFIX)}, {ENDINGS_SQL}, x AS (SELECT path, unnest(generate_series(1, len(string_split(path, '/')))) AS k FROM f), i AS (SELECT array_to_string(string_split(path, '/')[k:], '/') AS suffix, min(path) AS file FROM x GROUP BY 1), l AS (SELECT lower(suffix) AS suffix, min(file) AS file FROM i GROUP BY 1),
p AS (SELECT key, string_split(replace(name, '.', '/'), '/') AS p FROM r), t AS (SELECT key, k, array_to_string(p[k:], '/') AS s FROM (SELECT key, p, unnest(generate_series(1, len(p))) AS k FROM p)), c AS (SELECT key, k, e, s || ending AS suffix FROM t, e),
h AS (SELECT c.key, (k * 100 + e) * 2 AS rank, i.file FROM c JOIN i ON i.suffix = c.suffix UNION ALL SELECT c.key, (k * 100 + e) * 2 + 1, l.file FROM c JOIN l ON l.suffix = lower(c.suffix))
SELECT r.key, b.file FROM r LEFT JOIN (SELECT key, arg_min(file, rank) AS file FROM h GROUP BY key) b ON b.key = r.key"""


@query(SUFFIX_SQL)
def LG10_suffix_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _requests(spark, sf_dir, *SUFFIX)
    return im.chain(r, im.by_suffix(r, im.dotted(F.col("name")), _files(spark, sf_dir)))


def _suffix_sql(parts: str) -> str:
    """Common table expressions that end in ``sfx`` (key, file): the longest suffix of each request's parts."""
    inner = SUFFIX_SQL[SUFFIX_SQL.index(f"{ENDINGS_SQL},") : SUFFIX_SQL.index("SELECT r.key, b.file")].replace("string_split(replace(name, '.', '/'), '/')", parts)
    return inner.rstrip() + ", sfx AS (SELECT key, arg_min(file, rank) AS file FROM h GROUP BY key)"


RUBY = ("'x'", "'m' || o_custkey % 50 || '/c' || o_orderkey % 40")


@query(SUFFIX_SQL.replace(_sql(*SUFFIX), _sql(*RUBY)))
def LG18_required_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A required path, with or without ./ before it, is the longest suffix of a file."""
    r = _requests(spark, sf_dir, *RUBY).withColumn("name", F.when(F.col("key") % 2 == 0, F.concat(F.lit("./"), "name")).otherwise(F.col("name")))
    parts = F.filter(F.split(F.regexp_replace("name", r"^\./", ""), "/"), lambda x: x != "")
    return im.chain(r, im.by_suffix(r, parts, _files(spark, sf_dir)))


ALIAS = ("'src/m' || o_custkey % 50 || '/x.ts'", "CASE o_orderkey % 4 WHEN 0 THEN '@/m' || o_orderkey % 50 || '/c' || o_custkey % 40 WHEN 1 THEN './c' || o_orderkey % 40 WHEN 2 THEN 'm' || o_orderkey % 50 || '.*' ELSE '~deep/none' END")


ALIAS_SQL = f"""WITH {_sql(*ALIAS)}, {_suffix_sql("string_split(name, '/')")}, b AS (SELECT key, CASE key % 4 WHEN 0 THEN 'src/' || substr(name, 3) WHEN 1 THEN regexp_replace(current, '/[^/]*$', '') || substr(name, 2) END AS base FROM r),
d AS (SELECT key, base || ending AS path, e AS rank FROM b, e WHERE base IS NOT NULL), g AS (SELECT d.key, arg_min(f.path, d.rank) AS file FROM d JOIN f ON f.path = d.path GROUP BY 1)
SELECT r.key, coalesce(g.file, CASE WHEN r.key % 4 = 0 THEN sfx.file END) AS file FROM r LEFT JOIN g ON g.key = r.key LEFT JOIN sfx ON sfx.key = r.key"""


@query(ALIAS_SQL)
def JN26_import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases, relative names, wildcards and unknown names by the whole chain."""
    return im.resolve(_requests(spark, sf_dir, *ALIAS), _files(spark, sf_dir), [("@/", "src/")])


@query(ALIAS_SQL + " WHERE r.key % 4 IN (0, 3)")
def LG08_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _requests(spark, sf_dir, *ALIAS).filter("key % 4 in (0, 3)")
    return im.chain(r, *im.aliased(r, [("@/", "src/"), ("~deep/", "no/")], _files(spark, sf_dir)))


PY = ("'app/p' || o_custkey % 50 || '/x.py'", "CASE o_orderkey % 5 WHEN 0 THEN '.mod' || o_orderkey % 40 WHEN 1 THEN '..p' || o_orderkey % 50 || '.pk' || o_custkey % 40 WHEN 2 THEN 'mod' || o_orderkey % 40 WHEN 3 THEN 'pk' || o_orderkey % 40 ELSE '....far' END")


@query(
    f"""WITH {_sql(*PY)}, {ENDINGS_SQL}, b AS (SELECT key, CASE key % 5 WHEN 0 THEN regexp_replace(current, '/[^/]*$', '') || '/' || substr(name, 2) WHEN 1 THEN 'app/' || replace(substr(name, 3), '.', '/') END AS base FROM r),
c AS (SELECT key, base || ending AS path, e AS rank FROM b, e WHERE base IS NOT NULL UNION ALL SELECT key, unnest([regexp_replace(current, '/[^/]*$', '') || '/' || name || '/__init__.py', regexp_replace(current, '/[^/]*$', '') || '/' || name || '.py', 'app/' || name || '/__init__.py', 'app/' || name || '.py', name || '/__init__.py', name || '.py']), unnest([1, 2, 3, 4, 5, 6]) FROM r WHERE key % 5 IN (2, 3)) {FIRST_SQL}"""
)
def LG12_python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.python(_requests(spark, sf_dir, *PY), _files(spark, sf_dir))


GO = ("'main.go'", "CASE WHEN o_orderkey % 3 = 0 THEN 'other.org/g' ELSE 'example.com/app/internal/g' || o_custkey % 50 END")


@query(f"WITH {_sql(*GO)} SELECT r.key, f.path FROM r JOIN f ON starts_with(f.path, substr(name, 17) || '/') AND NOT contains(substr(f.path, length(name) - 14), '/') WHERE key % 3 <> 0 AND ends_with(f.path, '.go') AND NOT ends_with(f.path, '_test.go')")
def LG13_go_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.go_package(_requests(spark, sf_dir, *GO), "example.com/app", _files(spark, sf_dir))


JVM = ("'A.java'", "'com.j' || o_custkey % 50 || CASE WHEN o_orderkey % 2 = 0 THEN '.*' ELSE '.K' END")


@query(f"WITH {_sql(*JVM)} SELECT r.key, f.path FROM r JOIN f ON regexp_replace(f.path, '/[^/]*$', '') = 'java/com/j' || regexp_extract(name, 'j([0-9]+)', 1) WHERE key % 2 = 0 AND (ends_with(f.path, '.java') OR ends_with(f.path, '.kt'))")
def LG14_jvm_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.jvm_package(_requests(spark, sf_dir, *JVM), [".java", ".kt", ".kts"], _files(spark, sf_dir))


CS = ("'x.cs'", "CASE o_orderkey % 3 WHEN 0 THEN 'Acme.Models.M' || o_custkey % 50 || '.E' || o_orderkey % 40 WHEN 1 THEN 'Acme.Models.M' || o_custkey % 50 ELSE 'System.Text' END")


@query(
    f"""WITH {_sql(*CS)}, {_suffix_sql("string_split(replace(name, '.', '/'), '/')")}, one AS (SELECT r.key, f.path FROM r JOIN f ON f.path = 'proj/' || replace(substr(name, 6), '.', '/') || '.cs' WHERE key % 3 = 0),
many AS (SELECT r.key, f.path FROM r JOIN f ON regexp_replace(f.path, '/[^/]*$', '') = 'proj/' || replace(substr(name, 6), '.', '/') WHERE key % 3 < 2 AND key NOT IN (SELECT key FROM one) AND ends_with(f.path, '.cs'))
SELECT * FROM one UNION ALL SELECT * FROM many UNION ALL SELECT key, file FROM sfx WHERE key NOT IN (SELECT key FROM one UNION ALL SELECT key FROM many)"""
)
def LG15_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.namespace(_requests(spark, sf_dir, *CS), [("Acme", "proj")], _files(spark, sf_dir))


RUST = ("'src/a/b.rs'", "CASE o_orderkey % 4 WHEN 0 THEN 'crate::r' || o_custkey % 50 WHEN 1 THEN 'crate::r' || o_custkey % 50 || '::Item' WHEN 2 THEN 'super::r' || o_custkey % 50 || '::x' ELSE 'src::r' || o_custkey % 50 END")


@query(f"WITH {_sql(*RUST)}, c AS (SELECT key, unnest(['src/r' || regexp_extract(name, 'r([0-9]+)', 1) || '.rs', 'src/r' || regexp_extract(name, 'r([0-9]+)', 1) || '/mod.rs']) AS path, unnest([1, 2]) AS rank FROM r) {FIRST_SQL}")
def LG16_rust_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.rust(_requests(spark, sf_dir, *RUST), _files(spark, sf_dir))


PHP = ("'x.php'", "CASE o_orderkey % 3 WHEN 0 THEN 'App\\Http\\H' || o_custkey % 50 || '\\C' || o_orderkey % 40 WHEN 1 THEN 'App\\Http\\H' || o_custkey % 50 || '\\helper' ELSE 'App\\..\\x' END")
PHP_SPARK = (PHP[0], PHP[1].replace("\\", "\\\\"))


@query(
    f"""WITH {_sql(*PHP)}, {_suffix_sql("string_split(replace(name, chr(92), '/'), '/')")}, own AS (SELECT key, 'app/' || replace(substr(name, 5), chr(92), '/') || '.php' AS path FROM r WHERE key % 3 <> 2),
d AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, min(path) AS file FROM f WHERE ends_with(path, '.php') GROUP BY 1)
SELECT r.key, coalesce(f.path, d.file, CASE WHEN r.key % 3 <> 2 THEN sfx.file END) AS file FROM r LEFT JOIN own ON own.key = r.key LEFT JOIN f ON f.path = own.path LEFT JOIN d ON d.folder = regexp_replace(own.path, '/[^/]*$', '') LEFT JOIN sfx ON sfx.key = r.key"""
)
def LG17_php_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.psr4(_requests(spark, sf_dir, *PHP_SPARK), [("App", "app")], _files(spark, sf_dir))


@query(f"WITH {_sql(*TS)}, {ENDINGS_SQL}, b AS (SELECT key, CASE WHEN key % 2 = 0 THEN regexp_replace(current, '/[^/]*$', '') || substr(name, 2) ELSE 'src' || substr(name, 3) END AS base FROM r), c AS (SELECT key, base || ending AS path, e AS rank FROM b, e), z AS ({FIRST_SQL}) SELECT key, coalesce(file, CASE WHEN key % 3 = 0 THEN 'fallback' END) AS file FROM z")
def LG07_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategies in their order; the first that finds a file decides."""
    r = _requests(spark, sf_dir, *TS)
    return im.chain(r, im.relative(r, _files(spark, sf_dir)), r.filter("key % 3 = 0").select("key", F.lit("fallback").alias("file")))


TYPES = ("Promise<User>", "Result<User, Error>", "Option<Vec<Item>>", "Map<K, V>", "User | null", "A | B", "&mut User", "*User", "models.User", "App\\Models\\User", "User?", "string", "Task", "Arc<'a, User>", "List<User>", "user", "", "Promise<Promise<string>>", "Box_1", "std::Thing")
RETURNS = ("User", "User", "Vec", "Map", "User", None, "User", "User", "User", "User", "User", None, None, "User", "List", None, None, None, "Box_1", "Thing")
ELEMENTS = ("User", "Error", None, "V", None, None, None, None, None, None, None, None, None, "User", "User", None, None, None, None, None)
NAMES = ("Promise", "Result", "Vec", "Map", "User", None, "User", "User", "User", "User", "User", "string", "Task", "Arc", "List", "user", None, "Promise", "Box_1", "Thing")


def _typed(values: tuple) -> str:
    item = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return "WITH t AS (SELECT unnest([" + ", ".join(map(item, TYPES)) + "]) AS type, unnest([" + ", ".join(map(item, values)) + "]) AS name) SELECT o_orderkey AS key, type, name FROM orders JOIN (SELECT *, row_number() OVER () - 1 AS k FROM t) ON k = o_orderkey % 20"


def _of_types(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    kinds = F.array(*map(F.lit, TYPES))
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.get(kinds, (F.col("o_orderkey") % 20).cast("int")).alias("type"))
    return rows.withColumn("name", f(F.col("type")))


@query(_typed(NAMES))
def LG20_simple_type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_types(spark, sf_dir, ty.simple_name)


@query(_typed(ELEMENTS))
def LG21_element_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_types(spark, sf_dir, ty.element_type)


@query(_typed(RETURNS))
def LG22_return_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_types(spark, sf_dir, ty.return_type)


@query("SELECT * FROM (VALUES ('Map', 'keys', 'first'), ('Map', 'values', 'last'), ('HashMap', 'keySet', 'first'), ('Dictionary', 'Keys', 'first'), ('Vec', 'iter', 'last'), ('List', 'keys', 'last'), ('Own', 'keys', 'first'), ('Own', 'get', 'last')) t(container, method, position)")
def LG23_type_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("Map", "keys"), ("Map", "values"), ("HashMap", "keySet"), ("Dictionary", "Keys"), ("Vec", "iter"), ("List", "keys"), ("Own", "keys"), ("Own", "get")]
    return spark.createDataFrame(rows, "container string, method string").withColumn("position", ty.argument_position(F.col("container"), F.col("method")))


@query("WITH c AS (SELECT o_orderkey AS call, o_custkey % 4 AS n, o_custkey AS c FROM orders), d AS (SELECT c_custkey AS c, unnest([0, 1, 2]) AS k FROM customer), x AS (SELECT call, n, k, k + 1 AS least, CASE WHEN k = 2 THEN 99 ELSE k + 1 END AS most FROM c JOIN d USING (c)), a AS (SELECT *, n BETWEEN least AND most AS fits FROM x), b AS (SELECT *, bool_or(fits) OVER (PARTITION BY call) AS any_fits FROM a) SELECT call, k FROM b WHERE fits OR NOT any_fits")
def LG25_overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overloads of a callee by the number of arguments: of no fitting arity all stay."""
    c = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call"), (F.col("o_custkey") % 4).alias("n"), F.col("o_custkey").alias("c"))
    d = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    arity = (F.col("n") >= F.col("k") + 1) & (F.col("n") <= F.when(F.col("k") == 2, 99).otherwise(F.col("k") + 1))
    return im.narrow(c.join(d, "c"), "call", arity, F.lit(False), F.lit(False)).select("call", "k")


@query("WITH c AS (SELECT o_orderkey AS call, o_custkey AS caller, o_orderkey % 7 AS n FROM orders), ctor AS (SELECT p_size AS n, min(p_partkey) AS id FROM part WHERE p_size < 3 GROUP BY 1), own AS (SELECT c_custkey AS caller, c_custkey % 7 AS n, 1000000 + c_custkey AS id FROM customer), sc AS (SELECT p_size AS n, min(p_partkey) AS id FROM part WHERE p_size < 6 GROUP BY 1) SELECT DISTINCT c.caller, coalesce(ctor.id, own.id, sc.id) AS target, CAST(0.85 AS DOUBLE) AS confidence FROM c LEFT JOIN ctor USING (n) LEFT JOIN own ON own.caller = c.caller AND own.n = c.n LEFT JOIN sc ON sc.n = c.n WHERE coalesce(ctor.id, own.id, sc.id) IS NOT NULL")
def LG27_free_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls without a receiver: a constructor of that name, else a method of the caller's own class, else what is in scope; one edge for a caller and target."""
    c = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("caller"), (F.col("o_orderkey") % 7).alias("n")).distinct()
    part = load(spark, sf_dir, "part")
    named = lambda most, name: part.filter(F.col("p_size") < most).groupBy(F.col("p_size").cast("long").alias("n")).agg(F.min("p_partkey").alias(name))
    own = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("caller"), (F.col("c_custkey") % 7).alias("n"), (F.col("c_custkey") + 1000000).alias("b"))
    met = c.join(named(3, "a"), "n", "left").join(own, ["caller", "n"], "left").join(named(6, "d"), "n", "left")
    return met.select("caller", F.coalesce("a", "b", "d").alias("target")).filter("target is not null").distinct().withColumn("confidence", F.lit(0.85))


@query("SELECT p_brand || '.' || p_type AS qualified, count(*) AS defs, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS only_def FROM part GROUP BY 1")
def LG31_qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions by qualified name; a name of several definitions resolves to none."""
    n = F.count("*")
    return load(spark, sf_dir, "part").groupBy(F.concat_ws(".", "p_brand", "p_type").alias("qualified")).agg(n.alias("defs"), F.when(n == 1, F.min("p_partkey")).alias("only_def"))


@query("WITH q AS (SELECT p_brand || '.' || p_type AS qualified, p_partkey AS def, p_size AS kind FROM part) SELECT r.ref, q.def FROM (SELECT p_partkey AS ref, p_brand || '.' || p_type AS qualified FROM part WHERE p_size < 10) r JOIN q USING (qualified) WHERE q.kind > 40")
def LG33_qualified_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").withColumn("qualified", F.concat_ws(".", "p_brand", "p_type"))
    defs = p.filter("p_size > 40").select("qualified", F.col("p_partkey").alias("def"))
    return p.filter("p_size < 10").select(F.col("p_partkey").alias("ref"), "qualified").join(defs, "qualified").select("ref", "def")


@query("WITH reg AS (SELECT p_partkey AS id, p_brand AS owner FROM part WHERE p_partkey % 3 = 0), own AS (SELECT p_partkey AS id, p_brand AS owner FROM part WHERE p_partkey % 2 = 0) SELECT id, owner, 'registered' AS origin FROM reg UNION ALL SELECT id, owner, 'added' FROM own WHERE id NOT IN (SELECT id FROM reg)")
def LG34_reconciled_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owned members that the registry lacks are added to it."""
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("owner"))
    registered = p.filter("id % 3 = 0")
    missing = p.filter("id % 2 = 0").join(registered.select("id"), "id", "left_anti")
    return registered.withColumn("origin", F.lit("registered")).unionByName(missing.withColumn("origin", F.lit("added")))


@query("WITH m AS (SELECT p_partkey AS id, unnest([p_partkey, p_partkey // 2, p_partkey // 3]) AS owner, unnest([0, 1, 2]) AS place FROM part) SELECT owner, count(*) AS classes, max(place) AS deepest FROM m GROUP BY owner")
def LG30_dispatch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every owner the classes whose linear order it is in, and the place that is deepest."""
    order = load(spark, sf_dir, "part").select(F.posexplode(F.expr("array(p_partkey, p_partkey div 2, p_partkey div 3)")).alias("place", "owner"))
    return order.groupBy("owner").agg(F.count("*").alias("classes"), F.max("place").alias("deepest"))


@query("SELECT c.o_orderkey AS binding, coalesce(f.id, v.id) AS node FROM (SELECT o_orderkey, o_custkey % 100 AS name FROM orders) c LEFT JOIN (SELECT p_size AS name, min(p_partkey) AS id FROM part WHERE p_size > 10 GROUP BY 1) f ON f.name = c.name LEFT JOIN (SELECT s_suppkey AS name, 1000000 + s_suppkey AS id FROM supplier) v ON v.name = c.name WHERE coalesce(f.id, v.id) IS NOT NULL")
def LG35_exported_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings of exported functions, else of exported variables; others are left out."""
    c = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("binding"), (F.col("o_custkey") % 100).alias("name"))
    f = load(spark, sf_dir, "part").filter("p_size > 10").groupBy(F.col("p_size").cast("long").alias("name")).agg(F.min("p_partkey").alias("f"))
    v = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), (F.col("s_suppkey") + 1000000).alias("v"))
    return c.join(f, "name", "left").join(v, "name", "left").select("binding", F.coalesce("f", "v").alias("node")).filter("node is not null")
