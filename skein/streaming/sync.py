"""Snapshot differences and synchronisation, as a batch job and as a stream that runs it again and again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.scratch import saved
from skein.store import without_files, without_refused

#: Kinds of edges that parsing alone makes.
STRUCTURAL = ("contains", "imports", "exports")


def difference(scanned: DataFrame, tracked: DataFrame, by_hash_only: bool = False) -> DataFrame:
    """path, change (added, removed, modified) of files (path, content_hash, size, modified_at) now and as tracked.

    A file is modified if its hash differs and, unless by_hash_only, its size or time does too.
    """
    now = scanned.select("path", F.col("content_hash").alias("h"), F.col("size").alias("s"), F.col("modified_at").alias("m"), F.lit(True).alias("there"))
    both = tracked.select("path", "content_hash", "size", "modified_at", F.lit(True).alias("known")).join(now, "path", "full_outer")
    touched = F.lit(True) if by_hash_only else (F.col("s") != F.col("size")) | (F.col("m") != F.col("modified_at"))
    change = F.when(F.col("known").isNull(), "added").when(F.col("there").isNull(), "removed").when((F.col("h") != F.col("content_hash")) & touched, "modified")
    return both.select("path", change.alias("change")).filter("change is not null")


def again_unresolved(tables: dict[str, DataFrame], gone: DataFrame) -> DataFrame:
    """The references that edges from other files into nodes of some files (path) were made of."""
    ends = tables["nodes"].select("id", "name", F.col("file_path").alias("path"))
    inside = ends.join(gone.select("path"), "path", "left_semi").select("id", "name")
    into = tables["edges"].filter(~F.col("kind").isin(*STRUCTURAL)).join(inside.select(F.col("id").alias("target"), F.col("name").alias("reference_name")), "target")
    into = into.join(inside.select(F.col("id").alias("source")), "source", "left_anti")
    found = into.select(F.xxhash64("source", "reference_name", "line", "col").alias("id"), F.col("source").alias("from_node_id"), "reference_name", F.col("kind").alias("reference_kind"), "line", "col", F.lit(None).cast("array<string>").alias("candidates"))
    return found.dropDuplicates(["id"]).join(tables["unresolved_refs"].select("id"), "id", "left_anti")


def synchronised(tables: dict[str, DataFrame], scanned: DataFrame, parse: Callable[[DataFrame], dict[str, DataFrame]], compat: bool = False) -> dict[str, DataFrame]:
    """The graph tables after removing what is gone and parsing what is new or has another hash. parse maps files to the tables' rows,
    which it writes down, as ingest does, so that no plan parses again.

    Edges from other files into files that changed become unresolved references again; with compat they are lost until the other
    files change. New files in which an id occurs twice are refused as a whole.
    """
    changes = saved(difference(scanned, tables["files"], by_hash_only=True))  # which all tables are made of
    gone = changes.filter("change <> 'added'")
    left = without_files(tables, gone)
    if not compat:
        left["unresolved_refs"] = left["unresolved_refs"].unionByName(again_unresolved(tables, gone).join(left["nodes"].select(F.col("id").alias("from_node_id")), "from_node_id", "left_semi"))
    parsed = parse(scanned.join(changes.filter("change <> 'removed'"), "path", "left_semi"))
    fresh = without_refused(parsed)
    return {name: left[name].unionByName(fresh[name], allowMissingColumns=True) if name in fresh else left[name] for name in left}


def auto_sync(spark, tick: Callable[[int], None], interval: str = "120 seconds", checkpoint: str | None = None):
    """A stream that calls tick with the batch's number at each interval."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = clock.writeStream.foreachBatch(lambda _, n: tick(n)).trigger(processingTime=interval)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def stream_changes(spark, folder: str, schema: str, on_batch: Callable[[DataFrame, int], None], once: bool = True, checkpoint: str | None = None):
    """Parquet files that arrive in a folder, handed to on_batch once each; exactly once with a checkpoint folder and idempotent batches."""
    writer = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(on_batch)
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    return (writer.trigger(availableNow=True) if once else writer).start()
