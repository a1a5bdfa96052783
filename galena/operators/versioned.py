"""Versioned rows: content hashes, structural diff, three-way merge, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    """A content address: sha256 of the canonical JSON of the named columns, in order of their names, nulls left out."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*sorted(columns))), 256))


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change) of the rows that were added, removed or modified."""
    a, b = old.select(key, F.col(value).alias("_a"), F.lit(1).alias("_o")), new.select(key, F.col(value).alias("_b"), F.lit(1).alias("_n"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return both.select(key, change.alias("change")).filter("change is not null")


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, outcome, value) of a three-way merge; a missing row has the value null.

    Outcomes: kept, deleted, ours, theirs, or a conflict with its reason.
    """
    rows = None
    for k, df in enumerate((base, ours, theirs)):
        one = df.select(key, F.col(value).alias(f"_{k}"))
        rows = one if rows is None else rows.join(one, key, "full_outer")
    b, o, t = (F.col(f"_{k}") for k in range(3))
    outcome = (
        F.when(o.eqNullSafe(t), F.when(o.isNull(), "deleted").otherwise("kept"))
        .when(o.eqNullSafe(b), "theirs")
        .when(t.eqNullSafe(b), "ours")
        .when(b.isNull(), "conflict:added-both")
        .when(o.isNull() | t.isNull(), "conflict:modified-vs-deleted")
        .otherwise("conflict:modified-both")
    )
    merged = rows.withColumn("outcome", outcome)
    taken = F.when(F.col("outcome") == "theirs", t).when(F.col("outcome").isin("ours", "kept"), o)
    return merged.select(key, "outcome", taken.alias(value))


def sweep(objects: DataFrame, reachable: DataFrame, key: str) -> DataFrame:
    """The objects that nothing reaches."""
    return objects.join(reachable.select(key).distinct(), key, "left_anti")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those of the same key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete_file(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, chunks) without the nodes of the file ``path``, the edges that touch them, and their embeddings' chunks (chunk: id, then :number)."""
    gone = nodes.filter(F.col("file_path") == path).select("id")
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    owner = F.regexp_replace("chunk", r":[0-9]+$", "")
    return nodes.filter(F.col("file_path") != path), kept, chunks.withColumn("id", owner).join(gone, "id", "left_anti").drop("id")


def audit_id(columns: list[str]) -> Column:
    """The id of an audit event: the sha256 of the canonical JSON of its body, with the schema's version and type."""
    fields = sorted([*columns, "schemaVersion", "type"])
    fixed = {"schemaVersion": F.lit(1), "type": F.lit("audit-event")}
    body = F.struct(*(fixed[c].alias(c) if c in fixed else F.col(c) for c in fields))
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(body), 256))


def audit_events(events: DataFrame, columns: list[str]) -> DataFrame:
    """``events`` with their ids."""
    return events.withColumn("id", audit_id(columns))


def audit_valid(columns: list[str]) -> Column:
    """Whether an event's id is that of its body."""
    return F.col("id") == audit_id(columns)


def normal_row(columns: list[str]) -> Column:
    """A row as canonical JSON: columns with a leading underscore and nulls left out, the others by name."""
    return F.to_json(F.struct(*sorted(c for c in columns if not c.startswith("_"))))


def replace_layers(rows: DataFrame, new: DataFrame, by: str, layers: list[str]) -> DataFrame:
    """``rows`` with those whose ``by`` is one of ``layers`` in favour of ``new``."""
    return rows.filter(~F.col(by).isin(*layers)).unionByName(new)


def materialize_snapshot(manifest: DataFrame, objects: DataFrame) -> DataFrame:
    """The objects that a manifest (id, address) names, once each, in the order of the ids."""
    return manifest.join(objects.drop("id").dropDuplicates(["address"]), "address").orderBy("id")
