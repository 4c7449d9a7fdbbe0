"""Context for a task: entry points by search, their surroundings, code of the best, related files and a summary."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import lines
from skein.operators.graph import Traversal, subgraph
from skein.operators.search import Index


@dataclass
class Context:
    task: str
    nodes: list[dict]
    edges: list[dict]
    blocks: list[dict]
    files: list[str]

    def stats(self) -> dict:
        return {"nodes": len(self.nodes), "edges": len(self.edges), "files": len(self.files), "code_blocks": len(self.blocks), "code_bytes": sum(len(b["code"].encode()) for b in self.blocks)}

    def json(self) -> str:
        return json.dumps({"task": self.task, "nodes": self.nodes, "edges": self.edges, "code_blocks": self.blocks, "related_files": self.files, "stats": self.stats()}, indent=2)

    def markdown(self) -> str:
        out = [f"# Context: {self.task}", "", "## Entry points", *(f"- `{n['name']}` ({n['kind']}) {n['file_path']}:{n['start_line']}" for n in self.nodes)]
        for b in self.blocks:
            out += ["", f"### {b['name']}", "", f"```{b['language']}", b["code"], "```"]
        return "\n".join([*out, "", "## Files", *(f"- {f}" for f in self.files)])


def cut(code: str, most: int) -> str:
    """Code of at most so many bytes, marked as cut; whole, but marked, if the cut would split a character."""
    data = code.encode()
    if len(data) <= most:
        return code
    try:
        code = data[:most].decode()
    except UnicodeDecodeError:
        pass
    return code + "\n... (truncated) ..."


def slices(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """id and code (lines start_line to end_line) of nodes whose file is in sources(path, content)."""
    found = nodes.join(sources.select(F.col("path").alias("file_path"), "content"), "file_path")
    return found.select("id", F.array_join(F.slice(lines(F.col("content")), F.greatest(F.col("start_line"), F.lit(1)).cast("int"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)).cast("int")), "\n").alias("code"))


def build(task: str, nodes: DataFrame | Index, edges: DataFrame, sources: DataFrame | None = None, max_nodes: int = 20, max_blocks: int = 5, max_block_bytes: int = 1500, depth: int = 1) -> Context:
    """A context of at most max_nodes entry points; only these bounded rows come to the driver. nodes may be their search index."""
    index = nodes if isinstance(nodes, Index) else Index.of(nodes)
    nodes = index.docs
    entries = [r.asDict() for r in index.search(task, None, max_nodes).collect()]
    near, between = subgraph(nodes, edges, [e["id"] for e in entries], Traversal(depth, ("contains", "calls"), None, "both", 4 * max_nodes)) if entries else (nodes.limit(0), edges.limit(0))
    blocks = []
    if sources is not None and entries:
        best = entries[:max_blocks]
        code = {r.id: r.code for r in slices(nodes.filter(F.col("id").isin([e["id"] for e in best])), sources).collect()}
        blocks = [{"name": e["name"], "language": e["language"], "file_path": e["file_path"], "code": cut(code[e["id"]], max_block_bytes)} for e in best if code.get(e["id"])]
    around = [r.asDict() for r in near.collect()]
    return Context(task, entries, [r.asDict() for r in between.collect()], blocks, sorted({n["file_path"] for n in [*around, *entries]}))
