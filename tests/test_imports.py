"""Import operators on small fixtures: rows and the shape of plans."""

import random
import re

from galena.operators import imports as im

REQUEST = "key long, current string, name string"


def class_file(name, prefixes, paths):
    """The file of one class name, by looking through all paths."""
    n = name.replace("\\", "/")
    if ".." in n:
        return None
    for prefix, folder in sorted(prefixes, key=lambda p: -len(p[0])):
        top = prefix.replace("\\", "/")
        if n == top or n.startswith(top + "/"):
            rest = n[len(top) + 1 :]
            own = folder + ("/" + rest if rest else "") + ".php"
            inner = folder + ("/" + rest.rpartition("/")[0] if "/" in rest and rest.rpartition("/")[0] else "")
            within = [p for p in paths if p.endswith(".php") and ("/" + p.rpartition("/")[0]).endswith("/" + inner) and "/" in p]
            if own in paths or within:
                return own if own in paths else min(within)
    parts = [x for x in n.split("/") if x]
    for k in range(len(parts)):
        for ending in im.ENDINGS:
            s = "/".join(parts[k:]) + ending
            for same in (lambda p, s=s: ("/" + p).endswith("/" + s), lambda p, s=s: ("/" + p.lower()).endswith("/" + s.lower())):
                if hit := [p for p in paths if same(p)]:
                    return min(hit)
    return None


def test_php_classes_brute_force(spark):
    random.seed(4)
    names = ["\\".join(random.choices(["App", "Http", "H1", "C2", "User", "user"], k=random.randint(1, 4))) for _ in range(80)] + ["App", "App\\..\\x", "App\\Http\\", "", "\\"]
    paths = sorted({"/".join(random.choices(["app", "Http", "H1", "C2", "User", "src"], k=random.randint(1, 4))) + random.choice([".php", ".php", ".phtml", ".ts"]) for _ in range(60)})
    prefixes = [("App", "app"), ("App\\Http", "src")]
    requests = spark.createDataFrame([*((k, "x.php", n) for k, n in enumerate(names)), (-1, "x.php", None)], REQUEST)
    got = {r["key"]: r["file"] for r in im.psr4(requests, prefixes, spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {k: class_file(n, prefixes, paths) for k, n in enumerate(names)} | {-1: None}


def test_php_classes_join_twice(spark):
    """However many strategies there are: each join's table may be broadcast through the driver."""
    requests, files = spark.createDataFrame([(1, "x.php", "App\\A")], REQUEST), spark.createDataFrame([("app/A.php",)], "path string")
    plan = im.psr4(requests, [("App", "app"), ("Lib", "lib"), ("Test", "tests")], files)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin \w", plan)) == 2


def check_pairs(spark, pairs, want):
    """Right pairs; each task's lie folder by folder, and a single folder's requests are dealt over several tasks."""
    from pyspark.sql import functions as F

    got = pairs.select("key", "path", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("place")).collect()
    assert sorted((r["key"], r["path"]) for r in got) == sorted(want)
    got.sort(key=lambda r: r["place"])
    runs = [(r["task"], r["path"].rpartition("/")[0]) for r in got]
    runs = [x for x, before in zip(runs, [None, *runs]) if x != before]
    assert len(runs) == len(set(runs))
    assert len({r["task"] for r in got if r["path"].startswith(got[0]["path"].rpartition("/")[0] + "/")}) >= 4


def test_go_packages_by_folder(spark):
    files = [f"internal/g{k}/s{j}{end}" for k in range(5) for j in range(7) for end in (".go", "_test.go", ".md")] + ["internal/g1/deep/s1.go", "g2/other.go"]
    requests = [(k, "main.go", f"example.com/app/internal/g{k % 6}" if k % 4 else "other.org/g1") for k in range(400)]
    want = [(k, f"internal/g{k % 6}/s{j}.go") for k, _, name in requests if name.startswith("example.com/") and k % 6 < 5 for j in range(7)]
    check_pairs(spark, im.go_package(spark.createDataFrame(requests, REQUEST).repartition(1), "example.com/app", spark.createDataFrame([(f,) for f in files], "path string")), want)


def test_jvm_packages_by_folder(spark):
    files = [f"java/com/j{k}/K{j}{end}" for k in range(5) for j in range(7) for end in (".java", ".kt", ".md")] + ["java/com/j1/deep/K1.java"]
    requests = [(k, "A.java", f"com.j{k % 6}" + (".*" if k % 4 else ".K")) for k in range(400)]
    want = [(k, f"java/com/j{k % 6}/K{j}{end}") for k, _, name in requests if name.endswith(".*") and k % 6 < 5 for j in range(7) for end in (".java", ".kt")]
    check_pairs(spark, im.jvm_package(spark.createDataFrame(requests, REQUEST).repartition(1), [".java", ".kt", ".kts"], spark.createDataFrame([(f,) for f in files], "path string")), want)
