"""Row producers for text inputs: Markdown, unified diffs, name-status lists, proto services, ORM calls, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts of paths that are left out, and languages by extension.
IGNORED = "node_modules|\\.git|dist|build|out|target|vendor|coverage|\\.next|\\.cache|__pycache__|\\.venv|venv"
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "java": "java", "go": "go",
    "rs": "rust", "rb": "ruby", "php": "php", "cs": "csharp", "cpp": "cpp", "c": "c", "kt": "kotlin", "swift": "swift", "sql": "sql",
}


def ignored(path: Column) -> Column:
    """Whether a path has an ignored segment, a generated name or a declaration's extension."""
    return path.rlike(rf"(^|/)({IGNORED})(/|$)") | path.rlike(r"\.(bundle|chunk|generated)\.[^/]*$|\.d\.ts$|\.min\.(js|css)$|\.(png|jpg|gif|ico|zip|gz|lock|map)$")


def language(path: Column) -> Column:
    """The language of a file name; null if unknown."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))[extension]


def folders(files: DataFrame, path: str = "path") -> DataFrame:
    """(folder, child) of every path's prefixes, distinct."""
    parts = F.split(F.col(path), "/")
    level = F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k")
    rows = files.filter(F.size(parts) > 1).select(parts.alias("p"), level)
    join = lambda k: F.array_join(F.slice("p", F.lit(1), k), "/")
    return rows.select(join(F.col("k")).alias("folder"), join(F.col("k") + 1).alias("child")).distinct()


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, content): lines from 1."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "content")).withColumn("line", F.col("line") + 1)


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, level, title, end_line, parent): headings; a section ends before the next of its level or a higher one.

    ``parent`` is the line of the nearest heading above it of a higher level, null for a file's top.
    """
    rows = lines(docs, key, text)
    total = docs.select(key, F.size(F.split(text, "\n")).alias("total"))
    heading = rows.filter(F.col("content").rlike(r"^#{1,6}\s+.+$")).select(
        key, "line", F.length(F.regexp_extract("content", r"^(#{1,6})\s", 1)).alias("level"), F.trim(F.regexp_extract("content", r"^#{1,6}\s+(.+)$", 1)).alias("title")
    )
    # running minima from the last line upwards, and maxima downwards, one for each level
    below = Window.partitionBy(key).orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.array(*(F.min(F.when(F.col("level") <= k, F.col("line"))).over(below) for k in range(1, 7)))
    parents = F.array(F.lit(None).cast("int"), *(F.max(F.when(F.col("level") < k, F.col("line"))).over(above) for k in range(2, 7)))
    found = heading.withColumns({"_end": F.get(ends, F.col("level") - 1), "_parent": F.get(parents, F.col("level") - 1)})
    return found.join(total, key).select(key, "line", "level", "title", F.coalesce(F.col("_end") - 1, F.col("total")).alias("end_line"), F.col("_parent").alias("parent"))


def local_links(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, target): the distinct paths that Markdown links name, without addresses, anchors and fragments, from the folder of ``key``."""
    found = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"\[([^\]]*)\]\(([^)]+)\)"), F.lit(2))).alias("href"))
    found = found.filter(~F.col("href").rlike(r"^(https?://|#|mailto:)")).withColumn("href", F.split_part("href", F.lit("#"), F.lit(1))).filter("href != ''")
    folder = F.regexp_replace(F.col(key), r"[^/]*$", "")
    return found.select(key, normal_path(F.concat(folder, "href")).alias("target")).distinct()


def normal_path(path: Column) -> Column:
    """A relative path without empty parts, . and ..; .. above the top stay."""
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when(
        (p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)
    ).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def hunks(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, start, end) of a unified diff's new side; pure deletions are dropped."""
    rows = lines(diffs, key, text)
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    path = F.last(F.when(F.col("content").startswith("+++ "), F.regexp_replace("content", r"^\+\+\+ (b/)?", "")), ignorenulls=True).over(w)
    pattern = r"^@@ -[0-9,]+ \+([0-9]+)(?:,([0-9]+))? @@"
    count = F.regexp_extract("content", pattern, 2)
    found = rows.withColumn("path", path).filter(F.col("content").rlike(pattern))
    found = found.select(key, "path", F.regexp_extract("content", pattern, 1).cast("int").alias("start"), F.when(count == "", F.lit(1)).otherwise(F.expr("try_cast(regexp_extract(content, '^@@ -[0-9,]+ [+]([0-9]+)(?:,([0-9]+))? @@', 2) as int)")).alias("n"))
    return found.filter("n > 0").select(key, "path", "start", (F.col("start") + F.col("n") - 1).alias("end"))


def name_status(raw: DataFrame, key: str, text: str) -> DataFrame:
    """(key, status, path, previous) of NUL-separated name-status output; R and C take two paths."""
    start = F.struct(F.lit("").alias("s"), F.lit(None).cast("string").alias("p"), F.array().cast("array<struct<status:string,path:string,previous:string>>").alias("out"))

    def step(acc, t):
        emit = lambda path, previous: F.struct(F.lit("").alias("s"), F.lit(None).cast("string").alias("p"), F.concat(acc["out"], F.array(F.struct(F.substring(acc["s"], 1, 1).alias("status"), path.alias("path"), previous.alias("previous")))).alias("out"))
        two = acc["s"].rlike("^[RC]")
        return (
            F.when(acc["s"] == "", F.struct(t.alias("s"), F.lit(None).cast("string").alias("p"), acc["out"].alias("out")))
            .when(two & acc["p"].isNull(), F.struct(acc["s"].alias("s"), t.alias("p"), acc["out"].alias("out")))
            .otherwise(emit(t, F.when(two, acc["p"])))
        )

    tokens = F.filter(F.split(text, "\u0000"), lambda t: t != "")
    return raw.select(key, F.explode(F.aggregate(tokens, start, step, lambda acc: acc["out"])).alias("x")).select(key, "x.*")


def rpcs(protos: DataFrame, key: str, text: str) -> DataFrame:
    """(key, service, method) of proto files, comments left out."""
    clean = F.regexp_replace(F.col(text), r"//[^\n]*|(?s)/\*.*?\*/", " ")
    blocks = F.explode(F.regexp_extract_all(clean, F.lit(r"(?s)\bservice\s+\w+\s*\{(?:[^{}]|\{[^{}]*\})*\}"), F.lit(0))).alias("block")
    services = protos.select(key, blocks).select(key, F.regexp_extract("block", r"service\s+(\w+)", 1).alias("service"), "block")
    return services.select(key, "service", F.explode(F.regexp_extract_all("block", F.lit(r"\brpc\s+(\w+)"), F.lit(1))).alias("method"))


# The calls of two query builders.
PRISMA = r"\bprisma\.(\w+)\.(findMany|findFirst|findUnique|findUniqueOrThrow|findFirstOrThrow|create|createMany|update|updateMany|delete|deleteMany|upsert|count|aggregate|groupBy)\s*\("
SUPABASE = r"\bsupabase\.from\s*\(\s*['\"](\w+)['\"]\s*\)\s*\.(select|insert|update|delete|upsert)\s*\("


def orm_calls(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, orm, model, method) of query-builder calls."""
    out = []
    for orm, pattern in (("prisma", PRISMA), ("supabase", SUPABASE)):
        calls = files.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("c"))
        out.append(calls.select(key, F.lit(orm).alias("orm"), F.regexp_extract("c", pattern, 1).alias("model"), F.regexp_extract("c", pattern, 2).alias("method")))
    return out[0].unionByName(out[1])


# Members of a response variable that are no keys of a response.
NO_KEYS = (
    "json text blob arrayBuffer formData ok status headers clone then catch finally map filter forEach reduce find some every push pop shift unshift splice slice "
    "concat join sort reverse includes indexOf length toString valueOf keys values entries appendChild removeChild insertBefore replaceChild replaceChildren "
    "createElement getElementById querySelector querySelectorAll setAttribute getAttribute removeAttribute hasAttribute addEventListener removeEventListener "
    "dispatchEvent classList className parentNode parentElement childNodes children nextSibling previousSibling firstChild lastChild click focus blur submit reset "
    "innerHTML outerHTML textContent innerText"
).split()
FROM_CALL = r"(?:const|let|var)\s+\{([^}]+)\}\s*=\s*(?:await\s+)?(?:\w+\.json\s*\(\)|(?:await\s+)?(?:fetch|axios|got)\s*\([^)]*\)(?:\.then\s*\([^)]*\))?(?:\.json\s*\(\))?)"
FROM_NAME = r"(?:const|let|var)\s+\{([^}]+)\}\s*=\s*(?:data|result|response|json|body|res)\b"
MEMBER = r"\b(?:data|response|result|json|body|res)\s*(?:\?\.|\.)(\w+)"


def accessed_keys(text: Column) -> Column:
    """The distinct keys of a response that a text takes apart or reads, in the order of the three patterns."""
    bodies = F.concat(F.regexp_extract_all(text, F.lit(FROM_CALL), F.lit(1)), F.regexp_extract_all(text, F.lit(FROM_NAME), F.lit(1)))
    taken = F.flatten(F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit(r"(\w+)\s*(?::\s*\w+)?"), F.lit(1))))
    members = F.filter(F.regexp_extract_all(text, F.lit(MEMBER), F.lit(1)), lambda k: ~k.isin(*NO_KEYS))
    return F.array_distinct(F.concat(taken, members))


def fetch_calls(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, url) of the literal arguments of fetch, axios and got calls."""
    pattern = r"\b(?:fetch|got|axios(?:\.(?:get|post|put|patch|delete))?)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
    return files.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("url"))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, href) of a page's anchors."""
    return pages.select(key, F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""<a\s[^>]*href="([^"]*)\""""), F.lit(1))).alias("href"))


def component_script(text: Column) -> Column:
    """The script of a single-file component, that of ``script setup`` first; null without one."""
    setup = F.regexp_extract(text, r"(?is)<script\b[^>]*\bsetup\b[^>]*>(.*?)</script>", 1)
    plain = F.regexp_extract(text, r"(?is)<script\b[^>]*>(.*?)</script>", 1)
    body = F.trim(F.when(setup != "", setup).otherwise(plain), F.lit("\n "))
    return F.when(body != "", body)


def components_used(text: Column) -> Column:
    """The distinct components of a template: tags in Pascal case, and hyphenated ones as such."""
    template = F.regexp_extract(text, r"(?is)<template[^>]*>(.*)</template>", 1)
    tags = F.regexp_extract_all(template, F.lit(r"<([A-Z][A-Za-z0-9]*|[a-z][a-z0-9]*(?:-[a-z0-9]+)+)"), F.lit(1))
    return F.array_distinct(F.transform(tags, lambda t: F.when(t.contains("-"), F.replace(F.initcap(F.replace(t, F.lit("-"), F.lit(" "))), F.lit(" "), F.lit(""))).otherwise(t)))


def reason_keys(reason: Column) -> Column:
    """The keys that an edge's reason names (``|keys:a,b``); an empty list without them."""
    keys = F.regexp_extract(reason, r"\|keys:([^|]+)", 1)
    return F.filter(F.split(keys, ","), lambda k: k != "")


def reason_fetches(reason: Column) -> Column:
    """How many fetches an edge's reason stands for (``|fetches:n``); 1 without it."""
    n = F.regexp_extract(reason, r"\|fetches:(\d+)", 1)
    return F.when(n == "", F.lit(1)).otherwise(F.concat(F.lit("0"), n).cast("int"))


def matcher_fits(matcher: Column, route: Column) -> Column:
    """Whether a middleware's matcher fits a route: a prefix of whole segments (``:path*``), a pattern (with groups), or the route itself."""
    prefix = F.regexp_replace(matcher, r"/:path\*$", "")
    return F.when(prefix != matcher, (route == prefix) | F.startswith(route, F.concat(prefix, F.lit("/")))).when(
        matcher.contains("("), F.call_function("rlike", route, F.concat(F.lit("^"), matcher, F.lit("$")))
    ).otherwise(route == matcher)


def route_fits(url: Column, route: Column) -> Column:
    """Whether a URL fits a route, segment by segment; one in brackets fits any on either side, a last ``[...x]`` fits the rest."""
    segments = lambda c: F.filter(F.split(c, "/"), lambda s: s != "")
    u, r = segments(url), segments(route)
    rest = F.element_at(r, -1).rlike(r"^\[\[?\.\.\.")
    n = F.when(rest, F.size(r) - 1).otherwise(F.size(r))
    pairs = F.zip_with(F.slice(u, F.lit(1), n), F.slice(r, F.lit(1), n), lambda a, b: a.startswith("[") | b.startswith("[") | (a == b))
    return F.when(rest, F.size(u) >= n).otherwise(F.size(u) == n) & F.forall(pairs, lambda x: F.coalesce(x, F.lit(False)))
