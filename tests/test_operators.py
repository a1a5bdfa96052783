"""Operators on small fixtures."""

import itertools
import random

from pyspark.sql import functions as F

from galena.functions import text as tf
from galena.operators import search, stats, traverse, versioned
from galena.sources import extract, sinks
from galena.streaming import audit


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_bfs_blocks_and_keeps_least_depth(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "a"), ("b", "t"), ("t", "x")])
    seeds, blocked = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("t",)], "id string")
    assert {tuple(r) for r in traverse.bfs(e, seeds, 5, blocked=blocked).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {r["id"] for r in traverse.bfs(e, seeds, 1, "upstream").collect()} == {"a", "d"}


def test_traces_end_at_leaves_and_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")])
    got = {tuple(r["path"]) for r in traverse.traces(e, spark.createDataFrame([("a",)], "id string"), least=2).collect()}
    assert got == {("a", "b", "c"), ("a", "b", "d")}


def test_levels_and_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")])
    got = {r["id"]: r["level"] for r in traverse.levels(e).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "x": -1, "y": -1, "z": -1}


def test_label_propagation_parts(spark):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "pq" for i, j in itertools.combinations(range(4), 2)] + [("p0", "q0")]
    labels = traverse.propagate(edges(spark, pairs))
    groups = {r["id"]: r["community"] for r in labels.collect()}
    assert len({groups[f"p{i}"] for i in range(1, 4)}) == 1 and len({groups[f"q{i}"] for i in range(1, 4)}) == 1
    assert traverse.modularity(edges(spark, pairs), labels).first()[0] >= 0


def test_skyline_brute_force(spark):
    random.seed(2)
    points = [(k, random.randint(0, 9), random.randint(0, 9), float(random.randint(0, 5))) for k in range(200)]
    df = spark.createDataFrame(points, "id long, a long, b long, c double")
    worse = lambda p, q: q[1] >= p[1] and q[2] <= p[2] and q[3] <= p[3] and (q[1:] != p[1:])
    want = {p[0] for p in points if not any(worse(p, q) for q in points)}
    assert {r["id"] for r in stats.skyline(df, ["a"], ["b", "c"], groups=3).collect()} == want


def test_skyline_of_two_brute_force(spark):
    random.seed(3)
    points = [(k, random.randint(0, 30), float(random.randint(0, 40))) for k in range(400)]
    df = spark.createDataFrame(points, "id long, a long, b double").repartition(5)
    worse = lambda p, q: q[1] >= p[1] and q[2] <= p[2] and q[1:] != p[1:]
    want = {p[0] for p in points if not any(worse(p, q) for q in points)}
    assert {r["id"] for r in stats.skyline(df, ["a"], ["b"]).collect()} == want


def test_nearest_rank_with_ties(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 1, 1, 9)] + [("b", 7)], "g string, v long")
    got = {r["g"]: (r["p0"], r["p50"], r["p95"], r["p100"]) for r in stats.nearest_rank(df, "g", "v", [0, 0.5, 0.95, 1]).collect()}
    assert got == {"a": (1, 1, 9, 9), "b": (7, 7, 7, 7)}


def test_traces_stop_with_enough_paths(spark):
    """The same rows as of all paths, an entry with enough short ones being left alone."""
    e = edges(spark, [(f"n{i}", f"n{j}") for i in range(6) for j in range(6) if i != j] + [("n0", "leaf"), ("n1", "leaf")])
    seeds = spark.createDataFrame([("n0",), ("n5",)], "id string")
    every = [r for r in traverse.traces(e, seeds, branching=9, depth=5, most=10_000).collect()]
    few = traverse.traces(e, seeds, branching=9, depth=5, most=12).collect()
    want = {entry: sorted((tuple(r["path"]) for r in every if r["entry"] == entry), key=lambda p: (len(p), p))[:12] for entry in ("n0", "n5")}
    assert {entry: sorted((tuple(r["path"]) for r in few if r["entry"] == entry), key=lambda p: (len(p), p)) for entry in want} == want


def test_three_way_merge_outcomes(spark):
    def version(**rows):
        return spark.createDataFrame(list(rows.items()), "id string, v string")

    base = version(same="1", ours="1", theirs="1", both="1", gone="1", mod_del="1")
    ours = version(same="1", ours="2", theirs="1", both="2", mod_del="2", new="a", added="x")
    theirs = version(same="1", ours="1", theirs="3", both="3", new="a", added="y")
    got = {r["id"]: (r["outcome"], r["v"]) for r in versioned.merge(base, ours, theirs, "id", "v").collect()}
    assert got["same"] == ("kept", "1") and got["ours"] == ("ours", "2") and got["theirs"] == ("theirs", "3")
    assert got["gone"] == ("deleted", None) and got["new"] == ("kept", "a")
    assert got["both"][0] == "conflict:modified-both" and got["mod_del"][0] == "conflict:modified-vs-deleted" and got["added"][0] == "conflict:added-both"


def test_extractors(spark):
    md = spark.createDataFrame([(1, "# A\nx\n## B\ny\n# C\nz")], "k long, t string")
    assert [tuple(r)[1:] for r in extract.sections(md, "k", "t").orderBy("line").collect()] == [(1, 1, "A", 4, None), (3, 2, "B", 4, 1), (5, 1, "C", 6, None)]
    links = spark.createDataFrame([("docs/a/x.md", "[t](../b.md#s) [u](http://x) [v](#a) [w](./c.md) [w](c.md)")], "k string, t string")
    assert {r["target"] for r in extract.local_links(links, "k", "t").collect()} == {"docs/b.md", "docs/a/c.md"}
    diff = "--- a/f.py\n+++ b/f.py\n@@ -1,2 +3,4 @@ x\n@@ -9 +12 @@\n@@ -5,2 +7,0 @@\n+++ b/g.py\n@@ -1 +1,2 @@"
    got = extract.hunks(spark.createDataFrame([(1, diff)], "k long, t string"), "k", "t").collect()
    assert {tuple(r)[1:] for r in got} == {("f.py", 3, 6), ("f.py", 12, 12), ("g.py", 1, 2)}
    status = "M\0a.py\0R100\0old.py\0new.py\0D\0gone.py\0"
    got = extract.name_status(spark.createDataFrame([(1, status)], "k long, t string"), "k", "t").collect()
    assert [tuple(r)[1:] for r in got] == [("M", "a.py", None), ("R", "new.py", "old.py"), ("D", "gone.py", None)]
    proto = "// service No { rpc x }\nservice S { rpc Get(A) returns (B) { option x = 1; } rpc Put(A) returns (B); }"
    got = extract.rpcs(spark.createDataFrame([(1, proto)], "k long, t string"), "k", "t").collect()
    assert [tuple(r)[1:] for r in got] == [("S", "Get"), ("S", "Put")]
    code = "await prisma.user.findMany({}); supabase.from('jobs').select('*'); prisma.user.findRaw({}); prisma.user.count"
    got = extract.orm_calls(spark.createDataFrame([(1, code)], "k long, t string"), "k", "t").collect()
    assert {tuple(r)[1:] for r in got} == {("prisma", "user", "findMany"), ("supabase", "jobs", "select")}
    paths = spark.createDataFrame([("node_modules/x.js",), ("src/a.min.js",), ("src/a.ts",), ("x.d.ts",)], "p string")
    assert [r[0] for r in paths.select(extract.ignored(F.col("p"))).collect()] == [True, True, False, True]


def test_routes_and_contracts(spark):
    df = spark.createDataFrame([("app/api/users/[id]/route.ts",), ("src/app/(shop)/page.tsx",), ("pages/blog/index.tsx",), ("lib/x.ts",)], "p string")
    assert [r[0] for r in df.select(tf.route_of_file(F.col("p"))).collect()] == ["/api/users/[id]", None, None, None]
    screens = {"app/(tabs)/index.tsx": "/", "app/users/index.ts": "/users", "app/users/[id].tsx": "/users/[id]", "app/_layout.tsx": None, "app/+html.tsx": None, "app/users+api.ts": "/users", "app/x.d.ts": None, "lib/x.ts": None}
    df = spark.createDataFrame([(p,) for p in screens], "p string")
    assert {r["p"]: r["r"] for r in df.select("p", tf.route_of_screen(F.col("p")).alias("r")).collect()} == screens
    php = {"api/upload.php": "/api/upload", "api/db_helper.php": None, "api/contest.php": "/api/contest", "api/_x.php": None, "src/api/x.php": None}
    df = spark.createDataFrame([(p,) for p in php], "p string")
    assert {r["p"]: r["r"] for r in df.select("p", tf.route_of_php(F.col("p")).alias("r")).collect()} == php
    ids = spark.createDataFrame([("http::get::/Users/",), ("GRPC::Svc/Get",)], "c string")
    assert [r[0] for r in ids.select(tf.contract_id(F.col("c"))).collect()] == ["http::GET::/users", "grpc::svc/get"]


def test_chunks_cover_texts(spark):
    docs = spark.createDataFrame([(1, "x" * 3000), (2, "short"), (3, ""), (4, None)], "k long, t string")
    got = search.chunks(docs, "k", "t").collect()
    assert [(r["start"], len(r["content"])) for r in got if r["k"] == 1] == [(0, 1200), (1080, 1200), (2160, 840)]
    assert {r["k"] for r in got} == {1, 2}


def test_sinks_and_seal(spark, tmp_path):
    n = spark.createDataFrame([("A:1", "A", 'say "x"'), ("B:1", "B", "y")], "id string, label string, name string")
    e = spark.createDataFrame([("A:1", "B:1", "CALLS"), ("A:1", "Z:9", "CALLS")], "src string, dst string, type string")
    sinks.write_graph(n, e, f"{tmp_path}/g")
    assert [x.count() for x in sinks.read_graph(spark, f"{tmp_path}/g")] == [2, 1]
    sinks.write_ndjson(n, e, f"{tmp_path}/n")
    assert spark.read.text(f"{tmp_path}/n").count() == 4
    sinks.write_csv(n, f"{tmp_path}/c")
    assert {r["name"] for r in spark.read.option("header", "true").option("escape", '"').csv(f"{tmp_path}/c").collect()} == {'say "x"', "y"}
    sealed = sinks.seal(spark, f"{tmp_path}/n")
    assert sinks.verify(sealed, sealed).isEmpty()
    assert [r["problem"] for r in sinks.verify(sealed, sealed.limit(0)).collect()] == ["missing"] * sealed.count()


def test_audit_stream_appends_once(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", "a", 1.0), (1, "2024-01-01 10:00:00", "a", 1.0), (2, "2024-01-02 11:00:00", "b", 2.0)]
    df = spark.createDataFrame(rows, "event_id long, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        audit.follow(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
    assert {(r["event_type"], r["n"]) for r in audit.daily(df).collect()} == {("a", 2), ("b", 1)}
