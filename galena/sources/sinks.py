"""Sinks: partitioned graph tables, label-pair edge files, line-delimited JSON, and sealed bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes by label and edges by the labels of their ends; edges with an unknown end are left out."""
    nodes.dropDuplicates(["id"]).write.mode("overwrite").partitionBy("label").parquet(f"{folder}/nodes")
    known = nodes.select("id", "label").dropDuplicates(["id"])
    pairs = edges.join(known.select(F.col("id").alias("src"), F.col("label").alias("src_label")), "src").join(known.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")), "dst")
    pairs.write.mode("overwrite").partitionBy("src_label", "dst_label").parquet(f"{folder}/edges")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def write_csv(nodes: DataFrame, folder: str) -> None:
    """One set of CSV files for each label, quoted as RFC 4180 has it."""
    nodes.write.mode("overwrite").partitionBy("label").option("header", "true").option("escape", '"').csv(folder)


def write_ndjson(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    line = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct(*sorted(df.columns)).alias("row"))).alias("value"))
    line(nodes, "node").unionByName(line(edges, "edge")).write.mode("overwrite").text(folder)


def seal(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, digest) of the files of a bundle."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", r"^.*/", "").alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def verify(sealed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem) of the files that are missing, unknown or altered."""
    both = sealed.select("path", F.col("digest").alias("a")).join(found.select("path", F.col("digest").alias("b")), "path", "full_outer")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unknown").when(F.col("a") != F.col("b"), "altered")
    return both.select("path", problem.alias("problem")).filter("problem is not null")
