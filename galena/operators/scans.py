"""Small queries over nodes: their texts, limits and guards, and rows in a normal form."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sizes of files in bytes, words of writing queries, parts of utility paths.
DEFAULT_LIMIT, TOP_LIMIT = 512 * 1024, 32 * 1024 * 1024
WRITES = r"(?i)(?<!:)\b(CREATE|DELETE|SET|MERGE|REMOVE|DROP|ALTER|COPY|DETACH|FOREACH|INSTALL|LOAD)\b"
UTILITY = r"/utils?/|/helpers?/|/common/|/shared/|/lib/|/utils\.[tj]s$|/helpers\.[tj]s$|_utils\.py$|_helpers\.py$"
SCAN = re.compile(r"MATCH\s*\(\s*([A-Za-z_]\w*)(?:\s*:\s*`?([A-Za-z_]\w*)`?)?\s*\)\s*RETURN\s+(.+?)\s+LIMIT\s+(\d+)\s*;?\s*$", re.I | re.S)


def file_limit(setting: str | None, default: int = DEFAULT_LIMIT) -> int:
    """The largest file in bytes, from a setting in KB: a whole number above 0, or the default; never above ``TOP_LIMIT``."""
    try:
        kb = float(setting) if setting else 0.0
    except ValueError:
        kb = 0.0
    return min(TOP_LIMIT, int(kb) * 1024) if kb > 0 and kb == int(kb) else default


def is_write(query: Column) -> Column:
    """Whether a query has a word that writes; a label after a colon is none."""
    return query.rlike(WRITES)


def is_utility(path: Column) -> Column:
    """Whether a path is that of a helper."""
    return F.replace(F.lower(path), F.lit("\\"), F.lit("/")).rlike(UTILITY)


def with_limit(query: Column, k: int) -> Column:
    """A query with the limit ``k`` in place of its own, or at its end."""
    own = r"(?i)\bLIMIT\s+\d+"
    return F.when(query.rlike(own), F.regexp_replace(query, own, f"LIMIT {max(1, k)}")).otherwise(F.concat(F.regexp_replace(query, r";\s*$", ""), F.lit(f" LIMIT {max(1, k)}")))


def clamp(raw: Column, low: int, high: int, default: int) -> Column:
    """The whole number at the beginning of a text, within bounds; the default if there is none."""
    number = F.regexp_extract(raw, r"^\s*([+-]?\d+)", 1)
    return F.when(number == "", F.lit(default)).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), F.expr("1L") * F.concat(F.when(number == "", "0").otherwise(""), number).cast("long")))).cast("long")


def node_scan(nodes: DataFrame, query: str, most: int = 1000) -> DataFrame:
    """The rows of a text ``MATCH (a:Label) RETURN a.x AS y, ... LIMIT k``, in the order of the nodes' ids."""
    if not (m := SCAN.match(query.strip())):
        raise ValueError("not a simple scan")
    alias, label, items, limit = m.groups()
    columns = []
    for item in re.split(r"\s*,\s*", items.strip()):
        named = re.fullmatch(r"(.+?)\s+AS\s+([A-Za-z_]\w*)", item, re.I)
        expression, name = (named[1], named[2]) if named else (item, item)
        if re.fullmatch(rf"labels\(\s*{alias}\s*\)\[0\]", expression, re.I):
            columns.append(F.col("label").alias(name))
        elif expression == alias:
            columns.append(F.struct(*nodes.columns).alias(name))
        elif prop := re.fullmatch(rf"{alias}\.([A-Za-z_]\w*)", expression):
            columns.append((F.col(prop[1]) if prop[1] in nodes.columns else F.lit(None).cast("string")).alias(name))
        else:
            raise ValueError(f"not a projection: {item}")
    rows = nodes.filter(F.col("label") == label) if label else nodes
    return rows.orderBy("id").limit(min(int(limit), most)).select(*columns)


def string_list(raw: Column) -> Column:
    """A list that was written as text, with or without brackets and quotes."""
    items = F.transform(F.split(F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\[|\]$", ""), ","), lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", ""))
    return F.filter(items, lambda x: x != "")


def cluster_rows(raw: DataFrame) -> DataFrame:
    """Rows of clusters (id, name, summary, signals, members, source) with their defaults."""
    source = F.when(F.coalesce("source", F.lit("")) == "", "heuristic").otherwise(F.col("source"))
    return raw.select("id", "name", F.coalesce("summary", F.lit("")).alias("summary"), string_list(F.col("signals")).alias("signals"), F.coalesce("members", F.lit(0)).alias("members"), source.alias("source"))
