"""The mutable store on immutable files: snapshots of the graph tables behind a pointer, upserts, cascades, memories."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schema
from skein.operators import search

TABLES = {"nodes": schema.NODES, "edges": schema.EDGES, "files": schema.FILES, "unresolved_refs": schema.REFS, "vectors": schema.VECTORS}


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new does not have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def without_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """The tables without some files (path), their nodes, and edges and references of these. Vectors stay."""
    gone = tables["nodes"].join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    out = dict(tables)
    out["files"] = tables["files"].join(paths.select("path"), "path", "left_anti")
    out["nodes"] = tables["nodes"].join(gone, "id", "left_anti")
    out["edges"] = tables["edges"].join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti").select(tables["edges"].columns)
    out["unresolved_refs"] = tables["unresolved_refs"].join(gone.withColumnRenamed("id", "from_node_id"), "from_node_id", "left_anti").select(tables["unresolved_refs"].columns)
    return out


def valid_batches(nodes: DataFrame) -> DataFrame:
    """Nodes without those of files in which an id occurs twice: such a file is refused as a whole."""
    twice = nodes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    bad = nodes.join(twice, "id", "left_semi").select("file_path").distinct()
    return nodes.join(bad, "file_path", "left_anti").select(nodes.columns)


def without_refused(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """New rows without those of files in which an id occurs twice."""
    nodes = valid_batches(tables["nodes"])
    refused = tables["nodes"].select(F.col("file_path").alias("path")).distinct().join(nodes.select(F.col("file_path").alias("path")).distinct(), "path", "left_anti")
    return {n: t for n, t in without_files(tables, refused).items() if n in tables}


class Store:
    """Snapshots under a root that Spark can write, numbered in the names of their folders. An empty file of the same number, made
    when all tables are written, puts a snapshot in force; the highest such number counts. The newest two snapshots are kept."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    @property
    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """Snapshots that are whole, in order."""
        if not self._files.exists(self._path()):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(self._path())]
        return sorted(int(n.removeprefix("DONE-")) for n in names if re.fullmatch(r"DONE-\d+", n))

    def _pointer(self) -> str | None:
        numbers = self._numbers()
        return f"snapshot-{numbers[-1]:010}" if numbers else None

    def tables(self) -> dict[str, DataFrame]:
        now = self._pointer()
        if now is None:
            return {n: self.spark.createDataFrame([], s) for n, s in TABLES.items()}
        return {n: self.spark.read.schema(s).parquet(f"{self.root}/{now}/{n}") for n, s in TABLES.items()}

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Writes all tables and the search index to a new snapshot, then puts it in force: readers see the old or the new one, never a
        part, and a writer that is stopped leaves the old one. Of two writers at once, the later fails."""
        numbers = self._numbers()
        number = (numbers[-1] if numbers else 0) + 1
        at = f"{self.root}/snapshot-{number:010}"
        if self._files.exists(self._path(f"snapshot-{number:010}")):
            self._files.delete(self._path(f"snapshot-{number:010}"), True)  # of a writer that was stopped
        for n in TABLES:
            tables[n].write.parquet(f"{at}/{n}")
        nodes = self.spark.read.schema(schema.NODES).parquet(f"{at}/nodes")
        search.postings(nodes).repartitionByRange("term", "id").sortWithinPartitions("term").write.parquet(f"{at}/postings")
        search.lengths(nodes).write.parquet(f"{at}/lengths")
        self._files.create(self._path(f"DONE-{number}"), False).close()
        for old in numbers[:-1]:
            self._files.delete(self._path(f"DONE-{old}"), False)
            self._files.delete(self._path(f"snapshot-{old:010}"), True)

    def index(self) -> search.Index:
        """The search index of the nodes in force: a query reads the row groups of postings that hold its terms."""
        now = self._pointer()
        nodes = self.tables()["nodes"]
        if now is None:
            return search.Index.of(nodes)
        return search.Index(nodes, self.spark.read.parquet(f"{self.root}/{now}/postings"), self.spark.read.parquet(f"{self.root}/{now}/lengths"))

    def clear(self) -> None:
        self.commit({n: self.spark.createDataFrame([], s) for n, s in TABLES.items()})


class Memories:
    """Named texts in a folder."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def _at(self, name: str) -> Path:
        if not re.fullmatch(r"[\w.-]+", name):
            raise ValueError(f"not a name: {name}")
        return self.folder / f"{name}.md"

    def write(self, name: str, content: str) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        self._at(name).write_text(content)

    def read(self, name: str) -> str:
        at = self._at(name)
        return at.read_text() if at.exists() else f"Memory '{name}' not found."

    def names(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.md"))

    def delete(self, name: str) -> None:
        self._at(name).unlink()

    def edit(self, name: str, pattern: str, replacement: str, mode: str = "literal") -> str:
        """Replaces all matches; refuses texts that say "not found". In regex mode $1 and ${1} stand for groups."""
        text = self.read(name)
        if "not found" in text:
            raise KeyError(name)
        if mode == "regex":
            new = re.sub(pattern, re.sub(r"\$\{?(\w+)\}?", r"\\g<\1>", replacement), text)
        else:
            new = text.replace(pattern, replacement)
        self.write(name, new)
        return new
