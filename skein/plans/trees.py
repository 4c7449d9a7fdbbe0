"""Named queries that take files through parsing, linking, synchronisation and a stream. The files are built of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import resolve
from skein.plans.adapters import table
from skein.plans.queries import QUERIES, SQL, on_tables
from skein.scratch import folder, saved
from skein.sources import ingest
from skein.store import TABLES, upserted
from skein.streaming.sync import difference, stream_changes, synchronised

#: A Rust file for each part, whose function calls one of its own file and one of the file that all parts of a brand and size share.
_BRAND = "replace(p_brand, '#', '')"
_PART = f"concat('src/', {_BRAND}, '/p', p_partkey, '.rs')"
_SHARED = f"concat('src/', {_BRAND}, '/g', p_size, '.rs')"
_PART_TEXT = r"concat('use std::fmt;\npub fn f', p_partkey, '() {\n    g', p_size, '();\n    own', p_partkey, '(\"no()\");\n}\n\nfn own', p_partkey, '() {}\n\nstruct S', p_partkey, ' { x: u8 }\n\nmod g', p_size, ';\n')"
_SHARED_TEXT = r"concat('// not()\npub fn g', p_size, '() {}\n')"
_DOC_TEXT = rf"concat('# ', {_BRAND}, '\nCalls `f', p_partkey, '()` and `missing', p_partkey, '`.\n')"
_DOC = f"concat('docs/', {_BRAND}, '/', p_partkey, '.md')"


def _files(part: DataFrame, shared_where: str = "p_size <= 25", doc_where: str = "p_partkey % 10 = 0") -> DataFrame:
    parts = part.select(F.expr(_PART).alias("path"), F.expr(_PART_TEXT).alias("content"), F.lit("rust").alias("language"))
    shared = part.filter(shared_where).select(F.expr(_SHARED).alias("path"), F.expr(_SHARED_TEXT).alias("content"), F.lit("rust").alias("language")).distinct()
    docs = part.filter(doc_where).select(F.expr(_DOC).alias("path"), F.expr(_DOC_TEXT).alias("content"), F.lit("markdown").alias("language"))
    every = parts.unionByName(shared).unionByName(docs)
    return every.withColumns({"content_hash": F.sha2(F.col("content").cast("binary"), 256), "size": F.octet_length("content").cast("long"), "modified_at": F.lit(0).cast("long")})


_NODES = f"""
SELECT {_PART} AS file_path, 'file' AS kind, concat('p', p_partkey, '.rs') AS name, 1 AS start_line, 1 AS end_line, CAST(NULL AS VARCHAR) AS signature FROM part
UNION ALL SELECT {_PART}, 'import', 'fmt', 1, 1, 'std::fmt' FROM part
UNION ALL SELECT {_PART}, 'function', concat('f', p_partkey), 2, 5, NULL FROM part
UNION ALL SELECT {_PART}, 'function', concat('own', p_partkey), 7, 7, NULL FROM part
UNION ALL SELECT {_PART}, 'struct', concat('S', p_partkey), 9, 9, NULL FROM part
UNION ALL SELECT {_PART}, 'module', concat('g', p_size), 11, 11, CASE WHEN p_size <= 25 THEN {_SHARED} END FROM part
UNION ALL SELECT DISTINCT {_SHARED}, 'file', concat('g', p_size, '.rs'), 1, 1, NULL FROM part WHERE p_size <= 25
UNION ALL SELECT DISTINCT {_SHARED}, 'function', concat('g', p_size), 2, 2, NULL FROM part WHERE p_size <= 25
UNION ALL SELECT {_DOC}, 'file', concat(p_partkey, '.md'), 1, 1, NULL FROM part WHERE p_partkey % 10 = 0
UNION ALL SELECT {_DOC}, 'module', {_BRAND}, 1, 1, 'h1' FROM part WHERE p_partkey % 10 = 0"""


@on_tables("ingest_nodes", "part", f"SELECT file_path, kind, name, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, signature FROM ({_NODES})")
def _(part):
    return ingest.ingest(_files(part), once=False)["nodes"].select("file_path", "kind", "name", "start_line", "end_line", "signature")


def _named(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """kind, source and target of edges by name, and line."""
    ends = nodes.select("id", "name")
    found = edges.select("kind", "line", F.col("source").alias("s"), F.col("target").alias("t"))
    found = found.join(ends.select(F.col("id").alias("s"), F.col("name").alias("source")), "s").join(ends.select(F.col("id").alias("t"), F.col("name").alias("target")), "t")
    return found.select("kind", "source", "target", "line")


@on_tables("ingest_edges", "part", f"""
SELECT 'contains' AS kind, f.name AS source, n.name AS target, CAST(n.start_line AS BIGINT) AS line FROM ({_NODES}) n JOIN ({_NODES}) f ON f.file_path = n.file_path AND f.kind = 'file' WHERE n.kind <> 'file'
UNION ALL SELECT 'imports', concat('p', p_partkey, '.rs'), 'fmt', 1 FROM part
UNION ALL SELECT 'calls', concat('f', p_partkey), concat('own', p_partkey), 4 FROM part""")
def _(part):
    rows = ingest.ingest(_files(part))
    return _named(rows["edges"], rows["nodes"])


@on_tables("ingest_refs", "part", f"""
SELECT concat('f', p_partkey) AS source, concat('g', p_size) AS reference_name, 'calls' AS reference_kind, CAST(3 AS BIGINT) AS line FROM part
UNION ALL SELECT {_BRAND}, unnest([concat('f', p_partkey), concat('missing', p_partkey)]), 'references', 2 FROM part WHERE p_partkey % 10 = 0""")
def _(part):
    rows = ingest.ingest(_files(part))
    return rows["unresolved_refs"].join(rows["nodes"].select(F.col("id").alias("from_node_id"), F.col("name").alias("source")), "from_node_id").select("source", "reference_name", "reference_kind", "line")


def linked(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after their references were resolved: those that were are edges."""
    found = saved(resolve.resolve(tables["unresolved_refs"], tables["nodes"], files=tables["files"].select("path")))
    out = dict(tables)
    out["edges"] = tables["edges"].unionByName(found.select("source", "target", "kind", "line", "col"), allowMissingColumns=True)
    out["unresolved_refs"] = tables["unresolved_refs"].join(found.select(F.col("ref").alias("id")), "id", "left_anti").select(tables["unresolved_refs"].columns)
    return out


_LINKED = f"""SELECT 'calls' AS kind, concat('f', p_partkey) AS source, concat('g', p_size) AS target, CAST(3 AS BIGINT) AS line FROM part WHERE p_size <= 25
UNION ALL SELECT 'references', {_BRAND}, concat('f', p_partkey), 2 FROM part WHERE p_partkey % 10 = 0"""


@on_tables("link_files", "part", _LINKED)
def _(part):
    rows = ingest.ingest(_files(part))
    found = resolve.resolve(rows["unresolved_refs"], rows["nodes"], files=rows["files"].select("path"))
    return _named(found, rows["nodes"])


def _sync_files(spark, sf_dir):
    """All files indexed and linked, then half of the shared files gone and some documents new: calls of what is gone wait again."""
    part = table(spark, sf_dir, "part")
    now = linked(ingest.ingest(_files(part)) | {"vectors": spark.createDataFrame([], TABLES["vectors"])})
    after = synchronised(now, _files(part, "p_size <= 25 and p_size % 2 = 0", "p_partkey % 10 = 0 or p_partkey % 10 = 5"), ingest.ingest)
    nodes = after["nodes"].groupBy(F.lit("node").alias("what"), "kind").agg(F.count("*").alias("n"))
    edges = after["edges"].groupBy(F.lit("edge").alias("what"), "kind").agg(F.count("*").alias("n"))
    refs = after["unresolved_refs"].groupBy(F.lit("ref").alias("what"), F.col("reference_kind").alias("kind")).agg(F.count("*").alias("n"))
    return nodes.unionByName(edges).unionByName(refs)


_DOCS = "(SELECT count(*) FROM part WHERE p_partkey % 10 IN (0, 5))"
_OLD_DOCS, _NEW_DOCS = "(SELECT count(*) FROM part WHERE p_partkey % 10 = 0)", "(SELECT count(*) FROM part WHERE p_partkey % 10 = 5)"
_PARTS = "(SELECT count(*) FROM part)"
_LEFT = f"(SELECT count(DISTINCT {_SHARED}) FROM part WHERE p_size <= 25 AND p_size % 2 = 0)"
QUERIES["sync_files"] = _sync_files
SQL["sync_files"] = f"""
SELECT 'node' AS what, 'file' AS kind, CAST({_PARTS} + {_LEFT} + {_DOCS} AS BIGINT) AS n
UNION ALL SELECT 'node', 'import', {_PARTS} UNION ALL SELECT 'node', 'function', 2 * {_PARTS} + {_LEFT} UNION ALL SELECT 'node', 'struct', {_PARTS} UNION ALL SELECT 'node', 'module', {_PARTS} + {_DOCS}
UNION ALL SELECT 'edge', 'contains', 5 * {_PARTS} + {_LEFT} + {_DOCS} UNION ALL SELECT 'edge', 'imports', {_PARTS}
UNION ALL SELECT 'edge', 'calls', {_PARTS} + (SELECT count(*) FROM part WHERE p_size <= 25 AND p_size % 2 = 0) UNION ALL SELECT 'edge', 'references', {_OLD_DOCS}
UNION ALL SELECT 'ref', 'calls', (SELECT count(*) FROM part WHERE p_size > 25 OR p_size % 2 = 1) UNION ALL SELECT 'ref', 'references', {_OLD_DOCS} + 2 * {_NEW_DOCS}"""


def _stream_sync(spark, sf_dir):
    """Versions of files that arrive in a folder, taken up by a stream: new or changed ones replace what is tracked."""
    docs, at = table(spark, sf_dir, "documents"), folder(spark)
    version = lambda df, text: df.select(F.concat(F.lit("f"), "doc_id").alias("path"), F.sha2(text.cast("binary"), 256).alias("content_hash"), F.octet_length(text).cast("long").alias("size"), F.lit(0).cast("long").alias("modified_at"))
    version(docs.filter("doc_id % 10 <> 0"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).write.parquet(f"{at}/1")
    version(docs.filter("doc_id % 11 <> 0"), F.col("text")).write.parquet(f"{at}/2")
    schema, turns = "path string, content_hash string, size long, modified_at long", iter(range(1, 99))
    tracked = {"now": spark.createDataFrame([], schema)}

    def taken_up(arrived: DataFrame, _: int) -> None:
        changed = difference(arrived, tracked["now"], True).filter("change <> 'removed'")
        path = f"{at}/tracked/{next(turns)}"
        upserted(tracked["now"], arrived.join(changed, "path", "left_semi"), ["path"]).write.parquet(path)
        tracked["now"] = spark.read.schema(schema).parquet(path)

    for n in (1, 2):  # each arrives in a folder of its own, whose stream starts where the last has stopped
        stream_changes(spark, f"{at}/{n}", schema, taken_up, True, f"{at}/checkpoint-{n}").awaitTermination()
    return tracked["now"].select("path", "content_hash")


QUERIES["stream_sync"] = _stream_sync
SQL["stream_sync"] = SQL["upsert_files"]
