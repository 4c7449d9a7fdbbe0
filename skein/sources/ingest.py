"""Files to graph rows: nodes, contains, imports, exports and calls edges, and references left to resolve."""

from __future__ import annotations

import hashlib
import time
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein import schema
from skein.functions.text import parent
from skein.operators.outline import code_spans, headings
from skein.scratch import saved
from skein.sources.parsers import parse
from skein.sources.parsers.braces import module_names

_ROW = "path string, what string, id string, kind string, name string, qualified_name string, language string, start_line long, end_line long, start_column long, end_column long, signature string, is_exported boolean, source string, target string, line long, col long, candidates array<string>"
_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in _ROW.split(", "))])


def node_id(path: str, kind: str, qualified: str, line: int, column: int) -> str:
    return hashlib.sha256(f"{path}|{kind.replace('_', '')}|{qualified}|{line}|{column}".encode()).hexdigest()


def file_rows(path: str, language: str, text: str, targets: dict[str, str] | None = None) -> list[dict]:
    """All rows of one file. A call with one callable of its name in the file is an edge; with more, a reference with candidates.

    targets are the files that Rust's modules stand for, by the modules' names; they are the signatures of these.
    """
    out, ids, by_name, by_scope = [], [], defaultdict(list), {}
    file_id = node_id(path, "file", path, 1, 0)
    base = {"path": path, "language": language}
    out.append({**base, "what": "node", "id": file_id, "kind": "file", "name": path.rsplit("/", 1)[-1], "qualified_name": path, "start_line": 1, "end_line": 1, "start_column": 0, "end_column": 0, "is_exported": False})
    symbols, calls = parse(language, text)
    seen: set[str] = set()
    for kind, name, scope, start, end, column, signature in symbols:
        qualified = "::".join([path, *([] if kind == "module" else scope), name])
        own = node_id(path, kind, qualified, start, column)
        ids.append(own)
        if own in seen:
            continue
        seen.add(own)
        if kind == "module" and language == "rust" and targets:
            signature = targets.get(name, signature)
        by_scope[(*scope, name)] = own
        if kind in schema.CALLABLE:
            by_name[name].append(own)
        out.append({**base, "what": "node", "id": own, "kind": kind, "name": name, "qualified_name": qualified, "start_line": start, "end_line": end, "start_column": column, "end_column": column, "signature": signature, "is_exported": kind == "export"})
        edge = {**base, "what": "edge", "source": by_scope.get(scope, file_id), "target": own, "line": start, "col": column}
        out.append({**edge, "kind": "contains"})
        if kind in ("import", "export"):
            out.append({**edge, "kind": f"{kind}s"})
    for caller, name, line, column in calls:
        found = by_name.get(name, [])
        if len(found) == 1:
            out.append({**base, "what": "edge", "kind": "calls", "source": ids[caller], "target": found[0], "line": line, "col": column})
        else:
            out.append({**base, "what": "ref", "kind": "calls", "source": ids[caller], "name": name, "line": line, "col": column, "candidates": found or None})
    return out


#: So many rows make a batch that goes back to Spark, or those of one file if these are more.
_BATCH = 4096


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _ARROW], schema=_ARROW)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for batch in batches:
        for path, language, text, tried in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content", "tried"))):
            # of two files that a module may stand for, the first in turn
            rows += file_rows(path, language, text, {t["name"]: t["guess"] for t in sorted(tried or (), key=lambda t: -t["turn"])})
            if len(rows) >= _BATCH:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)


def ingest(files: DataFrame, paths: DataFrame | None = None, once: bool = True) -> dict[str, DataFrame]:
    """The rows that files (as tree.read gives them) add to the graph tables; each file is parsed by itself, in parallel.

    paths (path) are all files of the tree, which Rust's modules may name; those of files if it is not given. The rows are written
    down, so that no table parses the files again; without once they are not, which is less where one table is read once.
    """
    # dealt anew, since the texts may be computed of few and small files of rows
    dealt = files.select("path", "language", "content").repartition("path").join(_module_targets(files, files if paths is None else paths), "path", "left")
    rows = dealt.mapInArrow(_parse, _ROW)
    now = int(time.time() * 1000)
    every = rows.unionByName(markdown(files), allowMissingColumns=True)
    if once:
        every = saved(every)
    empty = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in ("docstring string", "visibility string", "decorators array<string>", "type_parameters array<string>")}
    flags = {c: F.lit(False) for c in ("is_async", "is_static", "is_abstract")}
    nodes = every.filter("what = 'node'").withColumnRenamed("path", "file_path").withColumns({**empty, **flags, "updated_at": F.lit(now)})
    edges = every.filter("what = 'edge'").withColumn("metadata", F.lit(None).cast("map<string,string>"))
    refs = every.filter("what = 'ref'").select(F.xxhash64("source", "name", "line", "col").alias("id"), F.col("source").alias("from_node_id"), F.col("name").alias("reference_name"), F.col("kind").alias("reference_kind"), "line", "col", "candidates")
    counts = every.filter("what = 'node'").groupBy("path").agg(F.count("*").alias("node_count"))
    listed = files.drop("content").withColumns({"indexed_at": F.lit(now)}).join(counts.hint("merge"), "path", "left")
    return {
        "nodes": nodes.select([c.split()[0] for c in schema.NODES.split(", ")]), "edges": edges.select("source", "target", "kind", "metadata", "line", "col"), "unresolved_refs": refs,
        "files": listed.select("path", "content_hash", "language", "size", "modified_at", "indexed_at", "node_count", F.lit(None).cast(schema.FILES.split("errors ")[1]).alias("errors")),
    }


def _modules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(path, name) for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()) for name in module_names(text)]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.string())], ["path", "name"])


def _module_targets(files: DataFrame, paths: DataFrame) -> DataFrame:
    """path and tried (name, guess, turn): the files that Rust modules of a file may stand for and that are there, name.rs before
    name/mod.rs beside the file. Only names and paths meet, before files are parsed, so that parsed rows need no join."""
    rust = files.filter("language = 'rust'").select("path", "content").repartition("path").mapInArrow(_modules, "path string, name string")
    base = F.concat(parent(F.col("path")), F.when(F.contains("path", F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.col("name"))
    guesses = F.array(F.struct(F.concat(base, F.lit(".rs")).alias("guess"), F.lit(0).alias("turn")), F.struct(F.concat(base, F.lit("/mod.rs")).alias("guess"), F.lit(1).alias("turn")))
    tried = rust.select("path", "name", F.explode(guesses).alias("g")).select("path", "name", "g.*")
    # merge: Spark takes the sizes of computed paths for those of the table that they are computed of, and would broadcast them
    there = tried.join(paths.select(F.col("path").alias("guess")).hint("merge"), "guess", "left_semi")
    return there.groupBy("path").agg(F.collect_list(F.struct("name", "guess", "turn")).alias("tried")).hint("merge")


def markdown(files: DataFrame) -> DataFrame:
    """Rows of markdown files: headings as modules of the file, and code spans as references of the heading above them, or of the file."""
    docs = files.filter("language = 'markdown'")
    file_id = schema.node_id(F.col("path"), F.lit("file"), F.col("path"), F.lit(1), F.lit(0))
    section = lambda title, line: schema.node_id(F.col("path"), F.lit("module"), F.concat_ws("::", "path", title), F.col(line), F.lit(0))
    found = headings(docs).withColumn("own", section("title", "line"))
    nodes = found.select(
        "path", F.lit("node").alias("what"), F.col("own").alias("id"), F.lit("module").alias("kind"), F.col("title").alias("name"), F.concat_ws("::", "path", "title").alias("qualified_name"), F.lit("markdown").alias("language"),
        F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit(0).cast("long").alias("start_column"), F.lit(0).cast("long").alias("end_column"), F.concat(F.lit("h"), F.col("level")).alias("signature"), F.lit(False).alias("is_exported"),
    )
    edges = found.select("path", F.lit("edge").alias("what"), F.lit("contains").alias("kind"), file_id.alias("source"), F.col("own").alias("target"), "line", F.lit(0).cast("long").alias("col"))
    source = F.when(F.col("section_line").isNull(), file_id).otherwise(section("section", "section_line"))
    refs = code_spans(docs).select("path", F.lit("ref").alias("what"), F.lit("references").alias("kind"), source.alias("source"), "name", "line", "col")
    return nodes.unionByName(edges, allowMissingColumns=True).unionByName(refs, allowMissingColumns=True)
