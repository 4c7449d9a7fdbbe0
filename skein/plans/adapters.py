"""The star-schema tables as a graph: one SQL text that both Spark and DuckDB run, so that queries and their oracles read the same rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_NODE = "CAST({id} AS STRING) AS id, '{kind}' AS kind, {name} AS name, {path} AS file_path, {language} AS language, CAST({line} AS BIGINT) AS start_line, {signature} AS signature, {exported} AS is_exported"
_NONE = "CAST(NULL AS STRING)"


def _node(source: str, id: str, kind: str, name: str, path: str, line: str, language: str = "'sql'", signature: str = _NONE, exported: str = "false") -> str:
    return "SELECT " + _NODE.format(id=id, kind=kind, name=name, path=path, language=language, line=line, signature=signature, exported=exported) + f" FROM {source}"


_GEO = "nation JOIN region ON n_regionkey = r_regionkey"
_FILE = "concat('part/', p_type, '/', p_brand, '.x')"
NODES = " UNION ALL ".join([
    _node("region", "concat('r:', r_regionkey)", "namespace", "r_name", "concat('geo/', r_name)", "r_regionkey"),
    _node(_GEO, "concat('n:', n_nationkey)", "module", "n_name", "concat('geo/', r_name, '/', n_name)", "n_nationkey", "'markdown'"),
    _node("supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "concat('s:', s_suppkey)", "class", "s_name", "concat('geo/', r_name, '/', n_name, '/supplier')", "s_suppkey", "'java'", exported="s_acctbal > 5000"),
    _node("customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "concat('c:', c_custkey)", "class", "c_name", "concat('geo/', r_name, '/', n_name, '/customer')", "c_custkey", "'java'"),
    _node("part", "concat('p:', p_partkey)", "function", "p_name", _FILE, "p_partkey", "'type_script'", exported="p_size % 2 = 0"),
    _node("part WHERE p_size >= 45", "concat('x:', p_partkey)", "export", "p_name", _FILE, "p_partkey", "'type_script'", "concat('part/', p_type, '/', p_brand)", "true"),
    _node("part WHERE p_size <= 4", "concat('i:', p_partkey)", "import", "p_name", _FILE, "p_partkey", "'type_script'", "CASE WHEN p_size <= 2 THEN concat('part/', p_type, '/', p_brand, '|export=', p_name) ELSE concat('part/', p_type, '/Brand#', p_size) END"),
    _node("orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "concat('o:', o_orderkey)", "method", "concat('order', o_orderkey)", "concat('geo/', r_name, '/', n_name, '/customer/', o_custkey)", "o_orderkey", "CASE WHEN o_orderpriority = '5-LOW' THEN 'markdown' ELSE 'rust' END", exported="o_orderstatus = 'F'"),
])
_PAIRS = """SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey AS a,
  lead(l_partkey) OVER w AS b, row_number() OVER w AS nth FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)"""
_NOWHERE = "CAST(NULL AS BIGINT) AS line, CAST(NULL AS BIGINT) AS col"
EDGES = f"""
SELECT concat('r:', n_regionkey) AS source, concat('n:', n_nationkey) AS target, 'contains' AS kind, {_NOWHERE} FROM nation
UNION ALL SELECT concat('n:', s_nationkey), concat('s:', s_suppkey), 'contains', {_NOWHERE} FROM supplier
UNION ALL SELECT concat('n:', c_nationkey), concat('c:', c_custkey), 'contains', {_NOWHERE} FROM customer
UNION ALL SELECT concat('c:', o_custkey), concat('o:', o_orderkey), 'contains', {_NOWHERE} FROM orders
UNION ALL SELECT concat('p:', a), concat('p:', b), 'calls', CAST(l_linenumber AS BIGINT), l_orderkey FROM pairs WHERE b IS NOT NULL
UNION ALL SELECT concat('o:', l_orderkey), concat('p:', l_partkey), 'references', CAST(l_linenumber AS BIGINT), l_suppkey FROM lineitem
UNION ALL SELECT DISTINCT concat('p:', l_partkey), concat('s:', l_suppkey), 'references', {_NOWHERE} FROM lineitem"""
_LINES = f"SELECT DISTINCT concat('p:', l_partkey), concat('s:', l_suppkey), 'references', {_NOWHERE} FROM lineitem"
#: For Spark: the same edges, with pairs of keys made distinct as numbers before they become ids.
SPARK_EDGES = EDGES.replace(_LINES, _LINES.replace("DISTINCT ", "").replace("FROM lineitem", "FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"))
REFS = """
SELECT CAST(l_orderkey * 1000 + nth AS BIGINT) AS id, concat('p:', a) AS from_node_id, p_name AS reference_name,
  CASE WHEN l_returnflag = 'R' THEN 'calls' ELSE 'references' END AS reference_kind, CAST(l_linenumber AS BIGINT) AS line, l_orderkey AS col
FROM pairs JOIN part ON p_partkey = b"""
#: For DuckDB: the same tables as common table expressions, to put before a SELECT.
WITH = f"WITH RECURSIVE nodes AS ({NODES}), pairs AS ({_PAIRS}), edges AS ({EDGES}), refs AS ({REFS})"
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    refs: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nodes, edges and unresolved references. References are numbered within their order, so that no sort is global."""
    tables = {t: table(spark, sf_dir, t) for t in _TABLES}

    def run(sql: str) -> DataFrame:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return spark.sql(sql)

    return Graph(run(NODES), run(f"WITH pairs AS ({_PAIRS}) {SPARK_EDGES}"), run(f"WITH pairs AS ({_PAIRS}) {REFS}").selectExpr("*", "CAST(NULL AS array<string>) AS candidates"))
