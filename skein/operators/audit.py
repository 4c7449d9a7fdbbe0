"""Statistics and documentation audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.schema import AUDITED


def totals(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, t in tables.items()]
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    return every.agg(*[F.max(F.when(F.col("what") == name, F.col("n"))).alias(name) for name in tables])


def count_by(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def overview(nodes: DataFrame, file: str) -> DataFrame:
    """kind, n, symbols of a file's nodes, the symbols in order of their lines."""
    found = nodes.filter(F.col("file_path") == file)
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("start_line", "name", "id"))).alias("symbols"))


def stale_references(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Unresolved references from markdown nodes, by file and line."""
    docs = nodes.filter("language = 'markdown'").select(F.col("id").alias("from_node_id"), "file_path", F.col("name").alias("section"))
    return refs.join(docs, "from_node_id").select(F.col("id").alias("ref"), "reference_name", "file_path", "section", "line", "col").orderBy("file_path", "line", "ref")


def undocumented_exports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Exported nodes of the audited kinds, not in markdown, that no markdown node references."""
    docs = nodes.filter("language = 'markdown'").select(F.col("id").alias("source"))
    documented = edges.filter("kind = 'references'").join(docs, "source", "left_semi").select(F.col("target").alias("id"))
    open_to_all = nodes.filter(F.col("is_exported") & (F.col("language") != "markdown") & F.col("kind").isin(*AUDITED))
    return open_to_all.join(documented, "id", "left_anti").orderBy("file_path", "start_line", "id")


def coverage(nodes: DataFrame) -> DataFrame:
    """Files and sections of markdown."""
    return nodes.filter("language = 'markdown' and kind = 'module'").agg(F.countDistinct("file_path").alias("files"), F.count("id").alias("sections"))
