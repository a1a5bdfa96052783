"""The property graph that the tables stand for.

Nodes and edges are plain SQL over the base tables, so that Spark and any other
engine derive the same graph. Node: id, label, name, file_path, is_exported,
weight. Edge: src, dst, type, confidence, reason, step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

NODES_SQL = """
SELECT concat('Region:', r_regionkey) AS id, 'Region' AS label, r_name AS name, concat('src/geo/', lower(r_name), '.ts') AS file_path, true AS is_exported, CAST(0 AS DOUBLE) AS weight FROM region
UNION ALL SELECT concat('Nation:', n_nationkey), 'Nation', n_name, concat('src/geo/nations/', lower(n_name), '.ts'), true, CAST(n_regionkey AS DOUBLE) FROM nation
UNION ALL SELECT concat('Customer:', c_custkey), 'Customer', c_name, concat('src/', lower(c_mktsegment), '/customer.ts'), c_acctbal > 0, c_acctbal FROM customer
UNION ALL SELECT concat('Supplier:', s_suppkey), 'Supplier', s_name, concat('src/supply/n', s_nationkey, '.ts'), true, s_acctbal FROM supplier
UNION ALL SELECT concat('Part:', p_partkey), 'Part', p_name, concat('lib/', lower(p_brand), '/part.ts'), p_size > 10, p_retailprice FROM part
UNION ALL SELECT concat('Order:', o_orderkey), 'Order', o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN 'test/orders/pending.test.ts' ELSE concat('src/orders/', lower(o_orderstatus), '.ts') END, o_orderstatus <> 'O', o_totalprice FROM orders
"""

EDGES_SQL = """
SELECT concat('Region:', n_regionkey) AS src, concat('Nation:', n_nationkey) AS dst, 'CONTAINS' AS type, CAST(1 AS DOUBLE) AS confidence, 'fk' AS reason, CAST(NULL AS INT) AS step FROM nation
UNION ALL SELECT concat('Nation:', c_nationkey), concat('Customer:', c_custkey), 'CONTAINS', CAST(1 AS DOUBLE), 'fk', CAST(NULL AS INT) FROM customer
UNION ALL SELECT concat('Nation:', s_nationkey), concat('Supplier:', s_suppkey), 'CONTAINS', CAST(1 AS DOUBLE), 'fk', CAST(NULL AS INT) FROM supplier
UNION ALL SELECT concat('Customer:', o_custkey), concat('Order:', o_orderkey), 'CALLS', CAST(1 AS DOUBLE), 'direct', CAST(NULL AS INT) FROM orders
UNION ALL SELECT concat('Order:', l_orderkey), concat('Part:', l_partkey), 'CALLS', round(1 - avg(l_discount), 4), 'import-resolved', CAST(NULL AS INT) FROM lineitem GROUP BY l_orderkey, l_partkey
UNION ALL SELECT concat('Part:', l_partkey), concat('Supplier:', l_suppkey), 'IMPORTS', round(1 - avg(l_tax), 4), 'import', CAST(NULL AS INT) FROM lineitem GROUP BY l_partkey, l_suppkey
UNION ALL SELECT concat('Part:', p_partkey), concat('Brand:', p_brand), 'EXTENDS', CAST(0.9 AS DOUBLE), 'heritage', CAST(NULL AS INT) FROM part
UNION ALL SELECT concat('Customer:', c_custkey), concat('Community:', c_mktsegment), 'MEMBER_OF', CAST(1 AS DOUBLE), 'segment', CAST(NULL AS INT) FROM customer
UNION ALL SELECT concat('Order:', o_orderkey), concat('Process:', o_custkey), 'STEP_IN_PROCESS', CAST(1 AS DOUBLE), 'flow', CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) FROM orders
"""

#: Common table expressions for SQL over the graph.
GRAPH_CTE = f"nodes AS ({NODES_SQL}), edges AS ({EDGES_SQL})"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _over(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` with the tables that it names bound as arguments, not as session-wide views."""
    import re

    used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in used})


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, NODES_SQL)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, EDGES_SQL)


_STORED: dict[tuple[str, str], str] = {}


def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges as a table by type, written once for a session and folder of base tables; loops read it level by level.

    The base tables must not change meanwhile.
    """
    import uuid

    from galena.operators.traverse import shared_base

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = f"{shared_base(spark)}/galena-{uuid.uuid4().hex}/edges"
        edges(spark, sf_dir).write.partitionBy("type").parquet(path)
        _STORED[key] = path
    return spark.read.schema("src string, dst string, confidence double, reason string, step int, type string").parquet(_STORED[key])
