"""Imports resolved to files: ordered candidates joined with the list of files, path suffixes, and folders of packages.

A request is a row (key, current, name): the importing file and what it names. A
resolver turns requests into candidates in their order of preference, and one
equality join with the files decides; nothing is compared pair by pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Endings of files in the order in which they are tried.
ENDINGS = (
    "", ".tsx", ".ts", ".jsx", ".js", ".vue", "/index.tsx", "/index.ts", "/index.jsx", "/index.js", ".py", "/__init__.py", ".java", ".kt", ".kts",
    ".c", ".h", ".cpp", ".hpp", ".cc", ".cxx", ".hxx", ".hh", ".cs", ".go", ".rs", "/mod.rs", ".php", ".phtml", ".swift", ".rb",
)
#: Over how many tasks the requests of one folder are dealt.
SHARES = 16


def folder_parts(current: Column) -> Column:
    parts = F.split(current, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def climb(parts: Column, names: Column) -> Column:
    """Folder ``parts`` followed along ``names``; . stays, .. goes up and ends at the top."""
    none = F.array().cast("array<string>")
    step = lambda acc, n: F.when(n == ".", acc).when(n == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(none)).otherwise(F.concat(acc, F.array(n)))
    return F.aggregate(names, parts, step)


def first_of(requests: DataFrame, candidates: Column, files: DataFrame) -> DataFrame:
    """(key, file): of each request the first candidate that is one of ``files`` (path)."""
    tried = requests.select("key", F.posexplode(candidates).alias("rank", "path"))
    return tried.join(files.select("path").distinct(), "path").groupBy("key").agg(F.min_by("path", "rank").alias("file"))


def first_ending(requests: DataFrame, base: Column, files: DataFrame) -> DataFrame:
    """(key, file): of each request the first of ``files`` that is ``base`` with an ending."""
    tried = requests.select("key", base.alias("base")).select("key", "base", F.posexplode(F.array(*map(F.lit, ENDINGS))).alias("rank", "ending"))
    tried = tried.select("key", "rank", F.concat("base", "ending").alias("path"))
    return tried.join(files.select("path").distinct(), "path").groupBy("key").agg(F.min_by("path", "rank").alias("file"))


def chain(requests: DataFrame, *found: DataFrame) -> DataFrame:
    """(key, file): strategies in their order, the first that has a row decides; null if none has."""
    out = requests.select("key")
    for k, f in enumerate(found):
        out = out.join(f.select("key", F.col("file").alias(f"_{k}")), "key", "left")
    return out.select("key", F.coalesce(*(F.col(f"_{k}") for k in range(len(found)))).alias("file"))


def relative(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Names that begin with a dot, from the importing file's folder."""
    base = F.array_join(climb(folder_parts(F.col("current")), F.split("name", "/")), "/")
    return first_ending(requests.filter(F.col("name").startswith(".")), base, files)


def suffixes(files: DataFrame) -> DataFrame:
    """(suffix, file): every suffix of a path, with the first file that has it."""
    parts = F.split("path", "/")
    each = files.select("path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k")).select("path", F.array_join(F.slice(parts, F.col("k"), F.size(parts)), "/").alias("suffix"))
    return each.groupBy("suffix").agg(F.min("path").alias("file"))


def by_suffix(requests: DataFrame, parts: Column, files: DataFrame) -> DataFrame:
    """The longest suffix of ``parts`` that, with an ending, is that of a file; exact before another case."""
    index = suffixes(files)
    lower = index.groupBy(F.lower("suffix").alias("suffix")).agg(F.min("file").alias("file"))
    longest = requests.select("key", parts.alias("p")).select("key", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"))
    longest = longest.select("key", "k", F.array_join(F.slice("p", F.col("k"), F.size("p")), "/").alias("s"))
    tried = longest.select("key", "k", "s", F.posexplode(F.array(*map(F.lit, ENDINGS))).alias("e", "ending")).select("key", "k", "e", F.concat("s", "ending").alias("suffix"))
    exact = tried.join(index, "suffix").select("key", F.struct("k", "e", F.lit(0).alias("x")).alias("rank"), "file")
    loose = tried.withColumn("suffix", F.lower("suffix")).join(lower, "suffix").select("key", F.struct("k", "e", F.lit(1).alias("x")).alias("rank"), "file")
    return exact.unionByName(loose).groupBy("key").agg(F.min_by("file", "rank").alias("file"))


def dotted(name: Column) -> Column:
    """The parts of a dotted or slashed name."""
    path = F.when(name.contains("/"), name).otherwise(F.replace(name, F.lit("."), F.lit("/")))
    return F.filter(F.split(path, "/"), lambda p: p != "")


def aliased(requests: DataFrame, aliases: list[tuple[str, str]], files: DataFrame) -> list[DataFrame]:
    """Names behind an alias's prefix: for each alias the file of the rewritten path, then the longest suffix."""
    out = []
    for prefix, target in aliases:
        own = requests.filter(F.col("name").startswith(prefix) & ~F.col("name").startswith("."))
        path = F.concat(F.lit(target), F.expr(f"substring(name, {len(prefix) + 1})"))
        out += [first_ending(own, path, files), by_suffix(own, F.filter(F.split(path, "/"), lambda p: p != ""), files)]
    return out


def resolve(requests: DataFrame, files: DataFrame, aliases: list[tuple[str, str]] = ()) -> DataFrame:
    """Aliases, then relative names, then suffixes of absolute ones; a name that ends with .* has no single file."""
    absolute = requests.filter(~F.col("name").startswith(".") & ~F.col("name").endswith(".*"))
    return chain(requests, *aliased(requests, list(aliases), files), relative(requests, files), by_suffix(absolute, dotted(F.col("name")), files))


def python(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Leading dots climb packages, too many find nothing; a plain name is looked for from the importing file's folder upwards, packages first."""
    dots = F.length(F.regexp_extract("name", r"^(\.*)", 1))
    rest = F.regexp_replace("name", r"^\.+", "")
    folder = folder_parts(F.col("current"))
    base = F.concat(F.slice(folder, 1, F.greatest(F.lit(0), F.size(folder) - (dots - 1))), F.when(rest != "", F.split(F.replace(rest, F.lit("."), F.lit("/")), "/")).otherwise(F.array().cast("array<string>")))
    dotted_ones = first_ending(requests.filter((dots > 0) & (dots - 1 <= F.size(folder))), F.array_join(base, "/"), files)
    levels = F.transform(F.reverse(F.sequence(F.lit(0), F.size(folder))), lambda n: F.concat(F.array_join(F.slice(folder, F.lit(1), n), "/"), F.when(n > 0, "/").otherwise(""), F.col("name")))
    tried = F.flatten(F.transform(levels, lambda p: F.array(F.concat(p, F.lit("/__init__.py")), F.concat(p, F.lit(".py")))))
    plain = first_of(requests.filter((dots == 0) & ~F.col("name").contains(".") & ~F.col("name").contains("/")), tried, files)
    return chain(requests, dotted_ones, plain)


def rust(requests: DataFrame, files: DataFrame) -> DataFrame:
    """crate:: from src and then the top, super:: and self:: from the folder, a::b from the top; the last part may be a symbol of its module."""
    name, folder = F.col("name"), folder_parts(F.col("current"))
    tail = lambda n: F.replace(F.expr(f"substring(name, {n + 1})"), F.lit("::"), F.lit("/"))
    under = lambda parts, path: F.array_join(F.concat(parts, F.array(path)), "/")

    def probes(path: Column) -> Column:
        parent = F.regexp_extract(path, r"^(.+)/[^/]*$", 1)
        own = F.array(F.concat(path, F.lit(".rs")), F.concat(path, F.lit("/mod.rs")), F.concat(path, F.lit("/lib.rs")))
        return F.when(parent != "", F.concat(own, F.array(F.concat(parent, F.lit(".rs")), F.concat(parent, F.lit("/mod.rs"))))).otherwise(own)

    above = F.slice(folder, 1, F.greatest(F.lit(0), F.size(folder) - 1))
    tried = (
        F.when(name.startswith("crate::"), F.concat(probes(F.concat(F.lit("src/"), tail(7))), probes(tail(7))))
        .when(name.startswith("super::"), probes(under(above, tail(7))))
        .when(name.startswith("self::"), probes(under(folder, tail(6))))
        .when(name.contains("::"), probes(F.replace(name, F.lit("::"), F.lit("/"))))
        .otherwise(F.array().cast("array<string>"))
    )
    return chain(requests, first_of(requests, tried, files))


def folder_files(files: DataFrame) -> DataFrame:
    """(folder, path, ending): each file under every suffix of its folder."""
    parts = folder_parts(F.col("path"))
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    return files.filter(F.size(parts) > 0).select("path", F.regexp_extract("path", r"(\.[^./]*)$", 1).alias("ending"), F.explode(every).alias("folder"))


def in_folders(own: DataFrame, files: DataFrame) -> DataFrame:
    """(key, path) of requests (key, folder): the files of each folder.

    Pairs are many times the requests: a folder's requests are dealt over ``SHARES`` tasks, which
    adaptive plans must not join into few, and each task's pairs lie folder by folder, a request's
    files always in the same order, so that a written table holds them as few bytes.
    """
    n = max(SHARES, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = own.select("key", "folder", F.pmod(F.hash("key"), F.lit(SHARES)).alias("share")).repartition(n, "folder", "share")
    each = files.select("folder", "path", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    return dealt.join(each.hint("merge"), ["folder", "share"]).select("key", "path")


def go_package(requests: DataFrame, module: str, files: DataFrame) -> DataFrame:
    """(key, path): the files, tests left out, directly in the package folder of names below the module."""
    own = requests.filter(F.col("name").startswith(f"{module}/")).select("key", F.expr(f"substring(name, {len(module) + 2})").alias("folder")).filter("folder != ''")
    return in_folders(own, folder_files(files).filter("ending = '.go' and path not like '%\\\\_test.go'"))


def jvm_package(requests: DataFrame, kinds: list[str], files: DataFrame) -> DataFrame:
    """(key, path): the files directly in the package folder of names that end with .*"""
    own = requests.filter(F.col("name").endswith(".*")).select("key", F.replace(F.expr("substring(name, 1, length(name) - 2)"), F.lit("."), F.lit("/")).alias("folder"))
    return in_folders(own, folder_files(files).filter(F.col("ending").isin(*kinds)))


def namespace(requests: DataFrame, roots: list[tuple[str, str]], files: DataFrame) -> DataFrame:
    """(key, path) of names below root namespaces (namespace, folder): one file, else the files of the namespace's folder, else the longest suffix."""
    path = F.replace("name", F.lit("."), F.lit("/"))
    found, left = [], requests.select("key", "name", path.alias("p"))
    for name, folder in roots:
        top = name.replace(".", "/")
        own = left.filter((F.col("p") == top) | F.col("p").startswith(f"{top}/")).select("key", F.expr(f"substring(p, {len(top) + 2})").alias("rest"))
        place = F.concat_ws("/", *([F.lit(folder)] if folder else []), F.when(F.col("rest") != "", F.col("rest")))
        own = own.select("key", "rest", place.alias("place"))
        index = suffixes(files)
        one = own.filter("rest != ''").select("key", F.posexplode(F.array(F.concat("place", F.lit(".cs")), F.concat("rest", F.lit(".cs")))).alias("rank", "suffix")).join(index, "suffix")
        one = one.groupBy("key").agg(F.min_by("file", "rank").alias("path"))
        many = own.join(one, "key", "left_anti").select("key", F.col("place").alias("folder")).join(folder_files(files).filter("ending = '.cs'"), "folder").select("key", "path")
        found += [one, many]
        left = left.join(one.select("key"), "key", "left_anti").join(many.select("key").distinct(), "key", "left_anti")
    rest = by_suffix(left, F.filter(F.split("p", "/"), lambda x: x != ""), files).select("key", F.col("file").alias("path"))
    return reduce(DataFrame.unionByName, [*found, rest])


def psr4(requests: DataFrame, prefixes: list[tuple[str, str]], files: DataFrame) -> DataFrame:
    """Names below prefixes (prefix, folder), longer ones first: the class's file, else the first file of its namespace's folder; then the longest suffix.

    Each distinct name is resolved once, by one join of its candidates in their order with one index of the files.
    """
    n, parts = F.col("n"), F.col("p")
    probe = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    tried = []
    for prefix, folder in sorted(prefixes, key=lambda p: -len(p[0])):
        top = prefix.replace("\\", "/")
        below = lambda rest: F.concat(F.lit(folder), F.when(rest != "", F.concat(F.lit("/"), rest)).otherwise(""))  # noqa: B023, E731
        rest = F.expr(f"substring(n, {len(top) + 2})")
        own = (n == top) | n.startswith(f"{top}/")
        tried += [probe("path", F.when(own, F.concat(below(rest), F.lit(".php")))), probe("folder", F.when(own, below(F.regexp_extract(rest, r"^(.*)/[^/]*$", 1))))]
    tails = F.transform(parts, lambda _, k: F.array_join(F.slice(parts, k + 1, F.size(parts)), "/"))
    named = F.flatten(F.transform(tails, lambda s: F.transform(F.array(*map(F.lit, ENDINGS)), lambda e: F.concat(s, e))))
    last = F.flatten(F.transform(named, lambda s: F.array(probe("suffix", s), probe("lower", F.lower(s)))))
    rows = requests.select("name").filter(~F.col("name").contains("..")).distinct().select("name", F.replace("name", F.lit("\\"), F.lit("/")).alias("n"))
    rows = rows.select("name", "n", F.filter(F.split("n", "/"), lambda x: x != "").alias("p"))
    rows = rows.select("name", F.posexplode(F.concat(F.array(*tried), last)).alias("rank", "probe")).select("name", "rank", "probe.*")

    path = F.split("path", "/")
    ends = lambda of, most: F.transform(F.sequence(F.lit(1), most), lambda k: F.array_join(F.slice(of, k, F.size(of)), "/"))
    above = F.when((F.size(path) > 1) & F.col("path").endswith(".php"), ends(folder_parts(F.col("path")), F.greatest(F.lit(1), F.size(path) - 1))).otherwise(F.array().cast("array<string>"))
    every = ends(path, F.size(path))
    kinds = [F.array(probe("path", F.col("path"))), F.transform(above, lambda s: probe("folder", s)), F.transform(every, lambda s: probe("suffix", s)), F.transform(every, lambda s: probe("lower", F.lower(s)))]
    index = files.select("path", F.explode(F.concat(*kinds)).alias("probe")).groupBy("probe.kind", "probe.text").agg(F.min("path").alias("file"))
    found = rows.join(index, ["kind", "text"]).groupBy("name").agg(F.min_by("file", "rank").alias("file"))
    return requests.select("key", "name").join(found, "name", "left").select("key", "file")


def narrow(candidates: DataFrame, call: str, arity: Column, fits: Column, certain: Column) -> DataFrame:
    """Overloads of each ``call``: those of its arity if there are any, else all; of these the ones with equal types if there are any."""
    w = Window.partitionBy(call)
    by_arity = candidates.withColumn("_a", arity).withColumn("_any", F.max(F.col("_a").cast("int")).over(w) == 1).filter("_a or not _any")
    by_type = by_arity.withColumn("_t", fits & F.col("_a") & certain).withColumn("_some", F.max(F.col("_t").cast("int")).over(w) == 1).filter("_t or not _some")
    return by_type.drop("_a", "_any", "_t", "_some")
