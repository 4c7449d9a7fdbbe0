"""The query catalogue by tool name: parameters in, a plain dict out. Results are bounded by each tool's limit before they are collected."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.config import Config
from skein.functions import text
from skein.operators import audit, context, graph, guard, resolve, vectors
from skein.sources import globs, ingest, tree
from skein.store import Memories, Store, upserted
from skein.streaming.sync import difference, synchronised

TOOLS: dict[str, Callable] = {}
SEARCH_KINDS = ("function", "method", "class", "struct", "interface", "trait", "module")
EDGE_KINDS = ("calls", "imports", "extends", "implements", "references")
PAGE = 100
_ONE = "node_id name file"
_NUMBERS = frozenset("limit max_depth depth max_nodes start_line max_code_blocks max_code_block_size traversal_depth".split())
_FLAGS = frozenset("include_body include_edges include_code show_stale show_undocumented".split())
#: What each tool does, its parameters, and those it cannot do without.
SCHEMAS: dict[str, tuple[str, str, str]] = {
    "search": ("Search symbols by name, qualified name and documentation", "query kind file limit", "query"),
    "find_symbol": ("Find symbols by words of their names, with their code if wanted", "name_pattern kind file limit include_body", "name_pattern"),
    "callers": ("What calls a function or method", f"{_ONE} limit", ""), "callees": ("What a function or method calls", f"{_ONE} limit", ""),
    "find_references": ("What refers to a symbol", f"{_ONE} edge_kind limit", ""), "impact": ("What a change of a symbol reaches", f"{_ONE} max_depth max_nodes", ""),
    "dependencies": ("What a symbol depends on", f"{_ONE} depth limit", ""), "dependents": ("What depends on a symbol", f"{_ONE} depth limit", ""),
    "path": ("The shortest path from one symbol to another", "from_id from_name from_file to_id to_name to_file max_depth", ""), "node": ("All that is known of a symbol, with its code", f"{_ONE} include_edges", ""),
    "get_symbols_overview": ("The symbols of a file by kind", "file_path", "file_path"), "get_file_nodes": ("The symbols of a file", "file_path kind", "file_path"),
    "stats": ("Counts by language and kind", "", ""), "status": ("Counts of all tables", "", ""), "session_status": ("What this session has called and what guards have found", "", ""),
    "read_file": ("Lines of a file", "path start_line limit", "path"), "list_dir": ("The entries of a folder", "path", ""), "find_file": ("Files by name", "pattern limit", "pattern"),
    "get_config": ("The settings, or one section of them", "section", ""), "update_config": ("Change a setting", "section key value", "section key value"), "sync": ("Take up what has changed", "", ""),
    "semantic_search": ("Search symbols by meaning", "query limit min_similarity", "query"), "context": ("Entry points, code and files for a task", "task max_nodes max_code_blocks max_code_block_size traversal_depth include_code format", "task"),
    "audit_docs": ("Stale references and undocumented exports", "limit show_stale show_undocumented", ""), "write_memory": ("Keep a text under a name", "name content", "name content"),
    "read_memory": ("Read a kept text", "name", "name"), "list_memories": ("Names of kept texts", "", ""), "delete_memory": ("Delete a kept text", "name", "name"),
    "edit_memory": ("Replace in a kept text", "name pattern replacement mode", "name pattern replacement"),
}
_BRIEF = ("id", "kind", "name", "qualified_name", "file_path", "start_line")


def input_schema(name: str) -> dict:
    """The JSON schema of a tool's parameters."""
    _, parameters, needed = SCHEMAS[name]
    kind = lambda p: {} if p == "value" else {"type": "integer" if p in _NUMBERS else "boolean" if p in _FLAGS else "number" if p == "min_similarity" else "string"}
    return {"type": "object", "properties": {p: kind(p) for p in parameters.split()}, "required": needed.split()}


class ToolError(Exception):
    """code is invalid_params, not_found or internal_error."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def tool(f: Callable) -> Callable:
    TOOLS[f.__name__] = f
    return f


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Project:
    """A source tree with its store, settings and memories under .skein."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.store = Store(spark, f"{self.root}/.skein/store")
        self.config = Config(f"{self.root}/.skein/config.toml")
        self.memories = Memories(f"{self.root}/.skein/memories")
        self.calls: list[tuple[str, str, int, int]] = []  # tool, risk, hits, blocked
        self._checked = 0.0

    @property
    def nodes(self) -> DataFrame:
        return self.store.tables()["nodes"]

    @property
    def edges(self) -> DataFrame:
        return self.store.tables()["edges"]

    def scanned(self) -> DataFrame:
        s = self.config.indexing
        return tree.read(self.spark, self.root, s.include_patterns, [*s.exclude_patterns, "**/.skein/**"], s.max_file_size)

    def index(self, force: bool = False) -> dict:
        """Parses what is new or changed, removes what is gone, links references."""
        if force:
            self.store.clear()
        before = self.store.tables()
        files = self.scanned()
        changes = {r["change"]: r["count"] for r in difference(files, before["files"], True).groupBy("change").count().collect()}
        if changes:
            paths = tree.listed(self.spark, self.root, self.config.indexing.include_patterns, [*self.config.indexing.exclude_patterns, "**/.skein/**"], self.config.indexing.max_file_size).select("path")
            self.store.commit(synchronised(before, files, lambda fresh: ingest.ingest(fresh, paths)))
            self.link()
        return {"added": changes.get("added", 0), "modified": changes.get("modified", 0), "removed": changes.get("removed", 0)}

    def link(self) -> int:
        """Turns the references that resolve into edges."""
        now = self.store.tables()
        found = resolve.resolve(now["unresolved_refs"], now["nodes"], files=now["files"].select("path")).cache()
        n = found.count()
        if n:
            now["edges"] = now["edges"].unionByName(found.select("source", "target", "kind", "line", "col"), allowMissingColumns=True)
            now["unresolved_refs"] = now["unresolved_refs"].join(found.select(F.col("ref").alias("id")), "id", "left_anti").select(now["unresolved_refs"].columns)
            self.store.commit(now)
        found.unpersist()
        return n

    def embed(self, only_stale: bool = True) -> int:
        now = self.store.tables()
        wanted = vectors.stale(now["nodes"], now["vectors"]) if only_stale else now["nodes"]
        n = wanted.count()
        if n:
            now["vectors"] = upserted(now["vectors"], vectors.embedded(wanted, self.config.vectors.model), ["node_id"])
            self.store.commit(now)
        return n

    def node_id(self, p: dict, key: str = "node_id", name: str = "name", file: str = "file") -> str:
        """An id as given, or the one node of a name in a file."""
        if p.get(key):
            return p[key]
        if not p.get(name):
            raise ToolError("invalid_params", f"{key} or {name} is needed")
        found = _rows(graph.resolve_name(self.nodes, p[name], p.get(file)).select("id", "kind", "file_path", "start_line").limit(20))
        if not found:
            raise ToolError("not_found", f"no symbol {p[name]}")
        if len(found) > 1:
            raise ToolError("invalid_params", f"{p[name]} is ambiguous: {json.dumps(found)}")
        return found[0]["id"]

    def call(self, name: str, params: dict | None = None) -> dict:
        """Runs a tool by its name, with session limits, flow policy and guardrails as the settings say."""
        name = name.removeprefix("skein_")
        if name == "session_status":
            return {"calls": len(self.calls), "hits": sum(c[2] for c in self.calls), "blocked": sum(c[3] for c in self.calls), "transitions": self._transitions()}
        if name not in TOOLS:
            raise ToolError("not_found", f"no tool {name}")
        s, risk = self.config.security, "write_like" if name in guard.WRITES else "read_like"
        if s.enabled and s.enforce:
            over = len(self.calls) > s.max_tool_calls_per_session or sum(c[2] for c in self.calls) > s.max_guardrail_hits_per_session or sum(c[3] for c in self.calls) > s.max_blocked_calls_per_session
            if over or self._transitions() > s.max_read_then_write_events_per_session:
                self._ended(name, risk, 0, 1, params)
                raise ToolError("internal_error", "a session limit is passed")
        hits = 0
        if s.enabled:
            given = self.spark.createDataFrame([(json.dumps(params or {}, ensure_ascii=False, default=str),)], "text string")
            hits = guard.input_hits(given).first()["input_hits"]
            if hits and s.enforce:
                self._ended(name, risk, hits, 1, params)
                raise ToolError("invalid_params", "the arguments are denied")
        try:
            out = TOOLS[name](self, params or {})
        except ToolError:
            self._ended(name, risk, hits, 0, params)
            raise
        if s.enabled:
            row = guard.decided(self.spark.createDataFrame([(json.dumps(out, ensure_ascii=False, default=str),)], "text string"), policy=guard.Policy(s.enforce, max_chars=s.max_output_chars)).first()
            hits += row["hits"]
            if row["decision"] == "deny":
                self._ended(name, risk, hits, 1, params)
                raise ToolError("internal_error", "the output is denied")
            if row["decision"] == "redact":
                try:
                    out = json.loads(row["text"])
                except ValueError:
                    out = {"text": row["text"]}
        self._ended(name, risk, hits, 0, params)
        return out

    def _ended(self, name: str, risk: str, hits: int, blocked: int, params: dict | None) -> None:
        """Counts a call and adds it to the day's audit log, by the hash of its arguments."""
        self.calls.append((name, risk, hits, blocked))
        if self.config.security.audit_log:
            folder = f"{self.root}/.skein/logs"
            os.makedirs(folder, exist_ok=True)
            event = {"at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "tool": name, "risk": risk, "hits": hits, "blocked": blocked, "arguments": self.argument_hash(params or {})}
            with open(f"{folder}/audit-{time.strftime('%Y-%m-%d', time.gmtime())}.jsonl", "a") as file:
                file.write(json.dumps(event) + "\n")

    def list_tools(self, cursor: str | None = None) -> dict:
        """Name, description and input schema of up to 100 tools from a cursor on, by name, and the cursor of what follows."""
        if cursor is not None and not (cursor.isdigit() and int(cursor) <= len(SCHEMAS)):
            raise ToolError("invalid_params", "no such cursor")
        start = int(cursor or 0)
        names = sorted(SCHEMAS)
        page = [{"name": n, "description": SCHEMAS[n][0], "inputSchema": input_schema(n)} for n in names[start : start + PAGE]]
        return {"tools": page} | ({"nextCursor": str(start + PAGE)} if start + PAGE < len(names) else {})

    def _transitions(self) -> int:
        return sum(a[1] == "read_like" and b[1] == "write_like" for a, b in zip(self.calls, self.calls[1:]))

    def argument_hash(self, params: dict) -> str:
        return hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()


def _found(p: Project, q: dict, key: str) -> DataFrame:
    if not q.get(key):
        raise ToolError("invalid_params", f"{key} is needed")
    kind = q.get("kind") if q.get("kind") in SEARCH_KINDS else None
    limit, index = int(q.get("limit", 10)), p.store.index()
    return index.search_in_file(q[key], q["file"], kind, limit) if q.get("file") else index.search(q[key], kind, limit)


@tool
def search_(p: Project, q: dict) -> dict:
    rows = _rows(_found(p, q, "query").select(*_BRIEF, "score"))
    return {"results": [{"node": {k: r[k] for k in _BRIEF}, "score": r["score"]} for r in rows], "count": len(rows)}


TOOLS["search"] = TOOLS.pop("search_")


def _sources(p: Project) -> DataFrame:
    return p.scanned().select("path", "content")


@tool
def find_symbol(p: Project, q: dict) -> dict:
    rows = _rows(_found(p, q, "name_pattern"))
    if q.get("include_body") and rows:
        code = {r["id"]: r["code"] for r in _rows(context.slices(p.nodes.filter(F.col("id").isin([r["id"] for r in rows])), _sources(p)))}
        rows = [r | {"body": code.get(r["id"])} for r in rows]
    return {"symbols": rows, "count": len(rows)}


@tool
def callers(p: Project, q: dict) -> dict:
    rows = _rows(graph.callers(p.nodes, p.edges, p.node_id(q), int(q.get("limit", 20))))
    return {"callers": rows, "count": len(rows)}


@tool
def callees(p: Project, q: dict) -> dict:
    rows = _rows(graph.callees(p.nodes, p.edges, p.node_id(q), int(q.get("limit", 20))))
    return {"callees": rows, "count": len(rows)}


@tool
def find_references(p: Project, q: dict) -> dict:
    kind = q.get("edge_kind") if q.get("edge_kind") in EDGE_KINDS else None
    rows = _rows(graph.references(p.nodes, p.edges, p.node_id(q), kind, int(q.get("limit", 50))))
    return {"references": rows, "count": len(rows)}


def _sub(found: tuple[DataFrame, DataFrame]) -> dict:
    nodes, edges = (_rows(x) for x in found)
    brief = [{k: n[k] for k in _BRIEF} for n in nodes]
    return {"nodes": brief, "edges": [{k: e[k] for k in ("source", "target", "kind", "line")} for e in edges], "count": len(brief)}


@tool
def impact(p: Project, q: dict) -> dict:
    out = _sub(graph.impact(p.nodes, p.edges, p.node_id(q), int(q.get("max_depth", 1)), int(q.get("max_nodes", 200))))
    return out | {"stats": {"max_depth": q.get("max_depth", 2), "files": len({n["file_path"] for n in out["nodes"]})}}


@tool
def dependencies(p: Project, q: dict) -> dict:
    return _sub(graph.dependencies(p.nodes, p.edges, p.node_id(q), int(q.get("depth", 2)), int(q.get("limit", 50))))


@tool
def dependents(p: Project, q: dict) -> dict:
    return _sub(graph.dependents(p.nodes, p.edges, p.node_id(q), int(q.get("depth", 2)), int(q.get("limit", 50))))


@tool
def path(p: Project, q: dict) -> dict:
    a, b = p.node_id(q, "from_id", "from_name", "from_file"), p.node_id(q, "to_id", "to_name", "to_file")
    found = graph.shortest_path(p.nodes, p.edges, a, b, int(q.get("max_depth", 6)))
    rows = {r["id"]: r for r in _rows(p.nodes.filter(F.col("id").isin(found)).select(*_BRIEF))} if found else {}
    return {"from_id": a, "to_id": b, "path_found": bool(found), "path": [rows[i] for i in found if i in rows], "length": len(found)}


@tool
def node(p: Project, q: dict) -> dict:
    own = p.node_id(q)
    rows = _rows(p.nodes.filter(F.col("id") == own))
    if not rows:
        raise ToolError("not_found", f"no node {own}")
    code = _rows(context.slices(p.nodes.filter(F.col("id") == own), _sources(p)))
    out = rows[0] | {"body": code[0]["code"] if code else None}
    if q.get("include_edges"):
        ends = _rows(graph.degrees(p.edges.filter((F.col("source") == own) | (F.col("target") == own))).filter(F.col("id") == own))
        out |= {"outgoing": ends[0]["n_out"] if ends else 0, "incoming": ends[0]["n_in"] if ends else 0}
    return out


@tool
def get_symbols_overview(p: Project, q: dict) -> dict:
    rows = _rows(audit.overview(p.nodes, q["file_path"]))
    return {"symbol_count": sum(r["n"] for r in rows), "by_kind": {r["kind"]: r["symbols"] for r in rows}, "symbols": sorted((s for r in rows for s in r["symbols"]), key=lambda s: s["start_line"])}


@tool
def get_file_nodes(p: Project, q: dict) -> dict:
    rows = _rows(graph.by_file(p.nodes, q["file_path"], q.get("kind")))
    return {"nodes": rows, "count": len(rows)}


@tool
def stats(p: Project, q: dict) -> dict:
    t = p.store.tables()
    by = lambda df, c: {r[c]: r["n"] for r in audit.count_by(df, c).collect()}
    return {"totals": status(p, q)["stats"], "files_by_language": by(t["files"], "language"), "nodes_by_kind": by(t["nodes"], "kind"), "edges_by_kind": by(t["edges"], "kind")}


@tool
def status(p: Project, q: dict) -> dict:
    t = p.store.tables()
    return {"stats": _rows(audit.totals(nodes=t["nodes"], edges=t["edges"], files=t["files"], unresolved=t["unresolved_refs"], vectors=t["vectors"]))[0]}


@tool
def read_file(p: Project, q: dict) -> dict:
    rows = p.spark.read.option("wholetext", True).text(f"{p.root}/{q['path']}")
    return rows.select(text.line_range(F.col("value"), int(q.get("start_line", 1)), int(q.get("limit", 200))).alias("r")).first()["r"].asDict()


@tool
def list_dir(p: Project, q: dict) -> dict:
    with os.scandir(os.path.join(p.root, q.get("path", "."))) as found:
        entries = sorted((not e.is_dir(), e.name + "/" * e.is_dir()) for e in found if not e.name.startswith("."))
    return {"entries": [n for _, n in entries], "count": len(entries)}


@tool
def find_file(p: Project, q: dict) -> dict:
    limit = int(q.get("limit", 50))
    files = p.store.tables()["files"].select("path")
    rows = [r["path"] for r in files.filter(globs.found_by_name(text.base_name(F.col("path")), q["pattern"])).orderBy("path").limit(limit).collect()]
    return {"matches": rows, "count": len(rows), "truncated": len(rows) >= limit}


@tool
def get_config(p: Project, q: dict) -> dict:
    return {"config": p.config.show(q.get("section"))}


@tool
def update_config(p: Project, q: dict) -> dict:
    try:
        p.config.update(q["section"], q["key"], q["value"])
    except (KeyError, TypeError) as e:
        raise ToolError("invalid_params", str(e)) from e
    return {"updated": True}


@tool
def sync(p: Project, q: dict) -> dict:
    began = time.time()
    return p.index() | {"duration_ms": int((time.time() - began) * 1000)}


@tool
def semantic_search(p: Project, q: dict) -> dict:
    """Looks for changes at most every 30 seconds, embeds what is stale, then searches."""
    if time.time() - p._checked > 30:
        p._checked = time.time()
        p.index()
    refreshed = p.embed()
    wanted = p.spark.createDataFrame([(q["query"],)], "t string").select(vectors.hashed_embedding("t").alias("v")).first()["v"]
    t = p.store.tables()
    best = vectors.top_similar(t["vectors"].join(t["nodes"].select(F.col("id").alias("node_id"), "kind", "name", "file_path", "start_line"), "node_id"), wanted, int(q.get("limit", 10)), float(q.get("min_similarity", 0.3)))
    rows = _rows(best.drop("embedding", "model", "created_at"))
    return {"freshness": {"embedded": refreshed}, "results": rows, "count": len(rows)}


@tool
def context_(p: Project, q: dict) -> dict:
    c = p.config.context
    code = _sources(p) if q.get("include_code", True) else None
    found = context.build(q["task"], p.store.index(), p.edges, code, int(q.get("max_nodes", c.max_nodes)), int(q.get("max_code_blocks", c.max_code_blocks)), int(q.get("max_code_block_size", c.max_code_block_size)), int(q.get("traversal_depth", c.traversal_depth)))
    return json.loads(found.json()) if q.get("format") == "json" else {"text": found.markdown()}


TOOLS["context"] = TOOLS.pop("context_")


@tool
def audit_docs(p: Project, q: dict) -> dict:
    t = p.store.tables()
    limit = int(q.get("limit", 50))
    refs, exports = audit.stale_references(t["unresolved_refs"], t["nodes"]), audit.undocumented_exports(t["nodes"], t["edges"])
    out = {"summary": _rows(audit.coverage(t["nodes"]))[0] | {"stale": refs.count(), "undocumented": exports.count()}}
    if q.get("show_stale", True):
        out["stale_refs"] = _rows(refs.limit(limit))
    if q.get("show_undocumented", True):
        out["undocumented_exports"] = _rows(exports.select(*_BRIEF).limit(limit))
    return out


@tool
def write_memory(p: Project, q: dict) -> dict:
    p.memories.write(q["name"], q["content"])
    return {"message": f"Memory '{q['name']}' is written."}


@tool
def read_memory(p: Project, q: dict) -> dict:
    return {"content": p.memories.read(q["name"])}


@tool
def list_memories(p: Project, q: dict) -> dict:
    return {"memories": p.memories.names()}


@tool
def delete_memory(p: Project, q: dict) -> dict:
    try:
        p.memories.delete(q["name"])
    except FileNotFoundError as e:
        raise ToolError("not_found", q["name"]) from e
    return {"message": f"Memory '{q['name']}' is deleted."}


@tool
def edit_memory(p: Project, q: dict) -> dict:
    return {"content": p.memories.edit(q["name"], q["pattern"], q["replacement"], q.get("mode", "literal"))}
