"""A source tree as a DataFrame of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import is_supported, language
from skein.operators.graph import checkpoints
from skein.sources.globs import included

MAX_FILE_BYTES = 1 << 20


def listed(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """full, path, length, modificationTime of the files of a tree that a scan takes, without reading any."""
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("full"), "length", "modificationTime")
    rows = files.withColumn("path", F.substring(F.regexp_replace("full", "^[a-z]+:/*", "/"), len(root) + 2, 1 << 20))
    checkpoints(spark)
    rows = rows.checkpoint()
    venvs = rows.filter(F.col("path").rlike("(^|/)pyvenv[.]cfg$")).select(F.regexp_replace("path", "/?pyvenv[.]cfg$", "").alias("folder"))
    fit = rows.filter(included(F.col("path"), include, exclude) & (F.col("length") <= max_bytes) & is_supported(language(F.col("path")))).checkpoint()  # so that no constraint of these long expressions is carried on
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    inside = fit.select("path", F.explode(above).alias("folder")).join(venvs, "folder").select("path").distinct()
    return fit.join(inside, "path", "left_anti")


def read(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """path (relative), content, content_hash, language, size, modified_at of the files of a tree that a scan takes.

    Paths are listed and filtered first, and only the contents of those that stay are read, on executors; the driver holds the list of
    paths, as it does for any scan. Files that are too large, not UTF-8, or in a language that is not supported are left out, and so
    is everything under a folder with a pyvenv.cfg.
    """
    kept = listed(spark, root, include, exclude, max_bytes)
    paths = [r.full for r in kept.select("full").collect()]
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.format("binaryFile").option("__globPaths__", "false").load(paths) if paths else spark.createDataFrame([], schema)
    rows = files.withColumn("path", F.substring(F.regexp_replace("path", "^[a-z]+:/*", "/"), len(root.rstrip("/")) + 2, 1 << 20)).filter(F.is_valid_utf8(F.col("content").cast("string")))
    return rows.select("path", F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("content_hash"), language(F.col("path")).alias("language"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"))
