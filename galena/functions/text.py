"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(F.trim(text)) / 4)


def sentences(text: Column) -> Column:
    """Sentences: white space collapsed; split after . ! ? before a capital, quote, back-tick or bracket."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.split(F.regexp_replace(flat, r"([.!?]) ([A-Z\"'`(\[])", "$1\u0001$2"), "\u0001")


def slug(text: Column) -> Column:
    """Camel case split, lower case, runs of other characters as one hyphen."""
    split = F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1-$2"), r"([A-Z]+)([A-Z][a-z])", "$1-$2")
    return F.regexp_replace(F.regexp_replace(F.lower(split), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def normal_url(url: Column) -> Column:
    """The path of a fetched URL: without scheme and host, query, fragment and a closing slash; null if nothing is left."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", ""), r"(.)/+$", "$1")
    return F.when(path != "", path)


def route_pattern(path: Column) -> Column:
    """A regular expression for a route: :name, {name} and [name] fit a segment, [...name] and * the rest."""
    any_rest = F.regexp_replace(path, r"\[\.\.\.[^\]/]+\]|\*", "\u0001")
    segment = F.regexp_replace(any_rest, r":[^/]+|\{[^}/]+\}|\[[^\]/]+\]", "\u0002")
    escaped = F.regexp_replace(segment, r"([.+?^$()|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(escaped, "\u0001", ".+"), "\u0002", "[^/]+"), F.lit("/?$"))


def route_of_file(path: Column) -> Column:
    """The URL of an API handler below app/ or pages/; null for other files. Groups in parentheses are no segments."""
    app = F.regexp_replace(F.regexp_extract(path, r"app/(.+?)/route\.(?:ts|js|tsx|jsx)$", 1), r"\([^)]+\)/?", "")
    pages = F.regexp_extract(path, r"pages/(api/.+?)\.(?:ts|js|tsx|jsx)$", 1)
    is_app = path.rlike(r"app/(.+?)/route\.(ts|js|tsx|jsx)$")
    return F.when(is_app & (app.startswith("api/") | (app == "api")), F.concat(F.lit("/"), app)).when(~is_app & (pages != ""), F.concat(F.lit("/"), F.regexp_replace(pages, r"/index$", "")))


def route_of_screen(path: Column) -> Column:
    """The URL of a file-routed screen or its API file (name+api) below app/; null for layouts, special and other files."""
    inner = F.regexp_extract(path, r"app/(.+)\.(?:tsx?|jsx?)$", 1)
    name = F.element_at(F.split(inner, "/"), -1)
    plain = F.regexp_replace(F.regexp_replace(inner, r"\+api$", ""), r"\([^)]+\)/?", "")
    route = F.regexp_replace(F.concat(F.lit("/"), plain), r"^/index$", "/")
    cut = F.regexp_replace(route, r"(.)/index$", "$1")
    special = path.rlike(r"\.d\.tsx?$") | (inner == "") | name.startswith("_") | (name.startswith("+") & ~name.startswith("+api"))
    return F.when(~special, F.when(cut == "", "/").otherwise(cut))


def route_of_php(path: Column) -> Column:
    """The URL of a PHP file below api/; null for helpers and other files."""
    inner = F.regexp_extract(path, r"^(api/.+?)\.php$", 1)
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.php", "")
    helper = name.startswith("_") | name.rlike(r"(?:^|_)(helper|config|test|fixture|mock|setup|bootstrap)(?:_|$)")
    return F.when((inner != "") & ~helper, F.concat(F.lit("/"), inner))


def fetch_url(raw: Column) -> Column:
    """A fetched URL as a route: no query, expressions as [param], no script extension; null unless it is an absolute path without code."""
    url = F.split_part(raw, F.lit("?"), F.lit(1))
    url = F.regexp_replace(F.regexp_replace(url, r"\$\{[^}]+\}", "[param]"), r"^`|`$", "")
    url = F.regexp_replace(url, r"\.(php|asp|aspx|jsp|cgi)$", "")
    return F.when(~url.contains("+") & ~url.contains("(") & url.startswith("/"), url)


# What marks a text as code.
CODE_SIGNS = (
    "def ", "class ", "function ", "import ", "const ", "let ", "var ", "public ", "private ", "protected ", "#include",
    "package ", "=>", "->", "::", "!=", "==", "<=", ">=", "&&", "||",
)


def is_prose(text: Column) -> Column:
    """Whether a text is prose: under five words, or less than two signs of code and at most one bracket for five words."""
    signs = sum((text.contains(s).cast("int") for s in CODE_SIGNS), F.lit(0))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return (words < 5) | ((signs < 2) & (F.length(text) - F.length(F.translate(text, "{}[]", "")) <= words * 0.2))


def contract_id(raw: Column) -> Column:
    """The canonical id of a contract: http methods in upper case and paths without a closing slash, the rest in lower case."""
    kind = F.lower(F.split_part(raw, F.lit("::"), F.lit(1)))
    method, path = F.upper(F.split_part(raw, F.lit("::"), F.lit(2))), F.regexp_replace(F.lower(F.split_part(raw, F.lit("::"), F.lit(3))), r"(.)/+$", "$1")
    rest = F.lower(F.regexp_replace(raw, r"^[^:]*::", ""))
    return F.when(kind == "http", F.concat(F.lit("http::"), method, F.lit("::"), path)).otherwise(F.concat(kind, F.lit("::"), rest))
