"""Named queries over the star-schema tables, each with the SQL that gives the same rows in DuckDB where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schema
from skein.functions import text
from skein.operators import audit, graph, guard, outline, resolve, search, vectors
from skein.plans.adapters import WITH, Graph, table
from skein.plans.adapters import graph as adapted
from skein.scratch import saved
from skein.sources import globs
from skein.store import upserted, without_files
from skein.streaming.sync import difference

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def on_tables(name: str, tables: str, sql: str | None = None):
    """Registers a query of tables by their names."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(table(spark, sf_dir, t) for t in tables.split()))
        if sql:
            SQL[name] = sql
        return f

    return put


def on_graph(name: str, sql: str | None = None):
    """Registers a query of the adapted graph; its SQL follows the graph's common table expressions."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(adapted(spark, sf_dir))
        if sql:
            SQL[name] = f"{WITH}{sql}" if sql.lstrip().startswith(",") else f"{WITH} {sql}"
        return f

    return put


_EXT = "CASE doc_id % 6 WHEN 0 THEN '.rs' WHEN 1 THEN '.TS' WHEN 2 THEN '.md' WHEN 3 THEN '' WHEN 4 THEN '.min.js' ELSE '.py' END"
_DIR = "CASE doc_id % 4 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'build/x/' ELSE '' END"
PATHS = f"concat(source, '/', {_DIR}, 'f', doc_id, {_EXT})"
NODE_LIST = "id, kind, name, file_path, start_line"

# Sources, paths and texts


@on_tables("scan_filter_files", "documents", f"""
SELECT path FROM (SELECT {PATHS} AS path FROM documents)
WHERE regexp_matches(path, '[.](ts|js|py|rs)$') AND NOT regexp_matches(path, '(^|/)(node_modules|build)/') AND NOT regexp_matches(path, '[.]min[.]js$')""")
def _(docs):
    return docs.select(F.expr(PATHS).alias("path")).filter(globs.included(F.col("path")))


@on_tables("glob_match_paths", "documents", f"SELECT path, regexp_matches(path, '^src[0-9]/(.*/)?f[^/]*[.]rs$') AS matched FROM (SELECT {PATHS} AS path FROM documents)")
def _(docs):
    return docs.select(F.expr(PATHS).alias("path")).withColumn("matched", globs.matches(F.col("path"), "src?/**/f*.rs"))


@on_tables("language_detect", "documents", f"""
SELECT path, CASE regexp_extract(lower(path), '[.]([^./]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'type_script' WHEN 'md' THEN 'markdown' WHEN 'js' THEN 'java_script' WHEN 'py' THEN 'python' ELSE 'unknown' END AS language
FROM (SELECT {PATHS} AS path FROM documents)""")
def _(docs):
    return docs.select(F.expr(PATHS).alias("path")).withColumn("language", text.language(F.col("path")))


@on_tables("content_hash", "documents", "SELECT doc_id, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def _(docs):
    return docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size"))


@on_graph("node_id_hash", "SELECT id, sha256(concat(file_path, '|', replace(kind, '_', ''), '|', concat(file_path, '::', name), '|', start_line, '|', 0)) AS hash FROM nodes")
def _(g: Graph):
    return g.nodes.select("id", schema.node_id(F.col("file_path"), F.col("kind"), F.concat_ws("::", "file_path", "name"), F.col("start_line"), F.lit(0)).alias("hash"))


@on_graph("find_by_name", f"SELECT {NODE_LIST} FROM nodes WHERE name = 'red widget'")
def _(g):
    return graph.by_name(g.nodes, "red widget").select(*NODE_LIST.split(", "))


@on_graph("nodes_by_file", f"SELECT {NODE_LIST} FROM nodes WHERE file_path = 'part/ECONOMY/Brand#2.x' AND kind = 'function' ORDER BY start_line, id")
def _(g):
    return graph.by_file(g.nodes, "part/ECONOMY/Brand#2.x", "function").select(*NODE_LIST.split(", "))


@on_tables("find_file", "documents", f"SELECT path FROM (SELECT {PATHS} AS path FROM documents) WHERE regexp_matches(path, '/f[^/]*1[^/][.]rs$') AND NOT regexp_matches(path, '(^|/)(node_modules|target|[.])') ORDER BY path LIMIT 50")
def _(docs):
    paths = docs.select(F.expr(PATHS).alias("path"))
    return paths.filter(globs.found_by_name(text.base_name(F.col("path")), "f*1?.rs") & ~F.col("path").rlike("(^|/)(node_modules|target|[.])")).orderBy("path").limit(50)


@on_tables("list_dir", "documents", f"SELECT DISTINCT split_part(path, '/', 2) || CASE WHEN len(string_split(path, '/')) > 2 THEN '/' ELSE '' END AS entry FROM (SELECT {PATHS} AS path FROM documents) WHERE split_part(path, '/', 1) = 'src1'")
def _(docs):
    return globs.entries(docs.select(F.expr(PATHS).alias("path")), "src1")


@on_tables("read_range", "documents", """
SELECT doc_id, array_to_string(l[2:4], chr(10)) AS content, CAST(least(4, len(l)) AS BIGINT) AS end_line, CAST(len(l) AS BIGINT) AS total_lines, len(l) > 4 AS truncated
FROM (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END AS l FROM documents)""")
def _(docs):
    return docs.select("doc_id", text.line_range(F.col("text"), 2, 3).alias("r")).select("doc_id", "r.*")


_REFS = "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]+)\"', 1)) AS name FROM pages"
_KEYWORDS = ", ".join(f"'{w}'" for w in text.NOT_SYMBOLS)


#: Markdown built of documents: headings of both forms, fences, code spans, and the document's own lines.
_MARKDOWN = r"""concat('Intro `', lang, '_zero`\n# ', source, ' ', doc_id, ' ##\nSee `', source, '::item', doc_id % 5, '()()` and `if`, `', n_chars, '` or `two words`.\n```\n# no\n`no_ref`\n```\n',
  CASE WHEN doc_id % 3 = 0 THEN 'Under\n=====\n' WHEN doc_id % 3 = 1 THEN 'Less\n---\n' ELSE '   ###### Deep\n' END, text, '\nThen `', lang, '_name` and `', lang, '_name`.\n####### none\n')"""
_MARKDOWN_SQL = _MARKDOWN.replace("'", "\x00").replace("\\n", "' || chr(10) || '").replace("\x00", "'")
_TICKS = "`([^`]+)`"
_OUTLINE = rf"""WITH f AS (SELECT concat('d', doc_id, '.md') AS path, {_MARKDOWN_SQL} AS content FROM documents),
s AS (SELECT path, string_split(regexp_replace(content, '\n$', ''), chr(10)) AS parts FROM f),
l AS (SELECT path, unnest(parts) AS text, unnest(range(1, len(parts) + 1)) AS line FROM s),
m AS (SELECT *, CASE WHEN regexp_matches(text, '^ {{0,3}}(```|~~~)') THEN 1 ELSE 0 END AS mark FROM l),
n AS (SELECT *, sum(mark) OVER w % 2 = 1 OR mark = 1 AS fenced, lead(text) OVER w AS under, regexp_extract(text, '^ {{0,3}}(#{{1,6}})([ \t]+|$)', 1) AS signs,
  regexp_matches(text, '^ {{0,3}}[^\s#>|*+-]') AND NOT regexp_matches(text, '^ {{0,3}}\d+[.)] ') AS plain FROM m WINDOW w AS (PARTITION BY path ORDER BY line)),
o AS (SELECT *, CASE WHEN fenced THEN NULL WHEN signs <> '' THEN length(signs) WHEN plain AND regexp_matches(under, '^ {{0,3}}=+[ \t]*$') THEN 1 WHEN plain AND regexp_matches(under, '^ {{0,3}}-+[ \t]*$') THEN 2 END AS level FROM n),
h AS (SELECT *, CASE WHEN level IS NOT NULL THEN trim(regexp_replace(regexp_replace(text, '^ {{0,3}}#{{1,6}}([ \t]|$)', ''), '[ \t]+#+[ \t]*$', '')) END AS title FROM o)"""


def _markdown_files(docs):
    return docs.select(F.concat(F.lit("d"), "doc_id", F.lit(".md")).alias("path"), F.expr(_MARKDOWN).alias("content"))


@on_tables("outline_headings", "documents", f"{_OUTLINE} SELECT path, line, CAST(level AS BIGINT) AS level, title FROM h WHERE level IS NOT NULL")
def _(docs):
    return outline.headings(_markdown_files(docs))


@on_tables("codespan_refs", "documents", rf"""{_OUTLINE}, a AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY path ORDER BY line) AS section FROM h),
c AS (SELECT path, line, section, unnest(list_distinct(regexp_extract_all(text, '{_TICKS}', 1))) AS span FROM a WHERE NOT fenced AND level IS NULL),
r AS (SELECT path, line, section, trim(regexp_replace(span, '(\(\))+$', '')) AS name FROM c)
SELECT path, line, name, section FROM r WHERE strlen(name) >= 2 AND NOT contains(name, ' ') AND NOT regexp_matches(name, '^[0-9._]+$') AND regexp_matches(name, '^[\p{{L}}_]') AND name NOT IN ({_KEYWORDS})""")
def _(docs):
    return outline.code_spans(_markdown_files(docs)).select("path", "line", "name", "section")


@on_tables("symbol_like", "pages", f"SELECT DISTINCT name FROM ({_REFS}) WHERE strlen(name) >= 2 AND NOT contains(name, ' ') AND NOT regexp_matches(name, '^[0-9._]+$') AND regexp_matches(name, '^[\\p{{L}}_]') AND name NOT IN ({_KEYWORDS})")
def _(pages):
    names = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("name")).distinct()
    return names.filter(text.looks_like_symbol(F.col("name")))


@on_graph("call_text_segments", "SELECT id, regexp_replace(regexp_replace(concat(file_path, '::', name), '^.*::', '', 'g'), '^.*[.]', '') AS segment FROM nodes")
def _(g):
    return g.nodes.select("id", text.last_segment(F.concat_ws("::", "file_path", "name")).alias("segment"))


# Search


def _bm25(docs: str, terms: list[str], extra: str = "") -> str:
    """BM25 in SQL: docs gives id and body; a term of several words is a phrase."""
    counts = [f"len(regexp_extract_all(padded, ' {t.replace(' ', '(?: )')}(?: )')) AS f{i}" if " " not in t else f"CAST((length(padded) - length(replace(padded, ' {t} ', ''))) / {len(t) + 2} AS BIGINT) AS f{i}" for i, t in enumerate(terms)]
    n = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS n{i}" for i in range(len(terms)))
    idf = lambda i: f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END"
    score = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * words / mean))" for i in range(len(terms)))
    return f"""t AS (SELECT *, list_filter(regexp_split_to_array(lower(strip_accents(body)), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda x: x <> '') AS w FROM ({docs})),
p AS (SELECT *, ' ' || array_to_string(w, '  ') || ' ' AS padded, len(w) AS words FROM t),
c AS (SELECT * EXCLUDE (w, padded, body), {', '.join(counts)} FROM p),
s AS (SELECT count(*) AS n, avg(words) AS mean, {n} FROM c),
r AS (SELECT c.*, round({score}, 6) AS score FROM c, s WHERE {' OR '.join(f'f{i} > 0' for i in range(len(terms)))})"""


_DOCS = "SELECT doc_id, text AS body, n_chars FROM documents"


def _documents(docs):
    return docs.select(F.col("doc_id").alias("id"), "text", "n_chars", F.lit("").alias("name"))


@on_tables("fts_bm25_or", "documents", f"WITH {_bm25(_DOCS, ['apache', 'license', 'idiot'])} SELECT doc_id, score FROM r ORDER BY score DESC, doc_id LIMIT 20")
def _(docs):
    return search.search(_documents(docs), "Apache license idiot", None, 20, ("text",)).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@on_tables("fts_accents", "documents", f"WITH {_bm25(_DOCS, ['etre', 'ecole', 'uber'])} SELECT doc_id, score FROM r")
def _(docs):
    return search.scored(_documents(docs), "être école über", ("text",)).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


_NODE_DOCS = "SELECT id, kind, name, file_path, concat(id, ' ', name, ' ', file_path, '::', name) AS body FROM nodes"


def _indexed(g):
    return g.nodes.withColumns({"qualified_name": F.concat_ws("::", "file_path", "name"), "docstring": F.lit(None).cast("string")})


@on_graph("fts_kind_filter", f", {_bm25(_NODE_DOCS, ['widget', 'economy'])} SELECT id, score FROM r WHERE kind = 'export' ORDER BY score DESC, length(name), id LIMIT 15")
def _(g):
    return search.search(_indexed(g), "widget economy", "export", 15).select("id", F.round("score", 6).alias("score"))


@on_graph("fts_file_overfetch", f", {_bm25(_NODE_DOCS, ['widget', 'economy'])}, b AS (SELECT * FROM r ORDER BY score DESC, length(name), id LIMIT 50) SELECT id, score FROM b WHERE file_path = 'part/ECONOMY/Brand#17.x' ORDER BY score DESC, length(name), id LIMIT 10")
def _(g):
    return search.search_in_file(_indexed(g), "widget economy", "part/ECONOMY/Brand#17.x").select("id", F.round("score", 6).alias("score"))


@on_graph("fts_phrase", """, w AS (SELECT id, concat(' ', array_to_string(list_filter(regexp_split_to_array(lower(concat(file_path, ' ', name)), '[^a-z0-9]+'), lambda x: x <> ''), ' '), ' ') AS body FROM nodes WHERE kind = 'function')
SELECT id FROM w WHERE contains(body, ' red widget ')""")
def _(g):
    return search.scored(g.nodes.filter("kind = 'function'"), "red_widget", ("file_path", "name")).select("id")


# Adjacency and graphs


@on_graph("adjacency_topk", "SELECT source, target, kind, line, col, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coalesce(line, 0), coalesce(col, 0), target, kind) AS rank FROM edges) WHERE rank <= 3")
def _(g):
    return graph.first_edges(g.edges, 3).withColumn("rank", F.col("rank").cast("long"))


_VALID = """parent_a = parent_b OR EXISTS (SELECT 1 FROM nodes i WHERE i.kind = 'import' AND i.file_path = {a} AND (contains({b}, i.name) OR contains({b}, replace(i.name, '::', '/')) OR contains({b}, coalesce(i.signature, chr(0)))))"""


def _calls_sql(node: str, incoming: bool, limit: int = 20) -> str:
    mine, other = ("target", "source") if incoming else ("source", "target")
    a, b = ("e.file_path", "o.file_path") if incoming else ("o.file_path", "e.file_path")
    par = "regexp_replace({}, '/?[^/]*$', '')"
    return f""", top AS (SELECT {other} AS id, line, col FROM edges WHERE {mine} = '{node}' AND kind = 'calls' ORDER BY coalesce(line, 0), coalesce(col, 0), {other} LIMIT {2 * limit}),
o AS (SELECT file_path FROM nodes WHERE id = '{node}'),
v AS (SELECT e.*, top.line, top.col, {par.format('e.file_path')} AS parent_a, {par.format('o.file_path')} AS parent_b FROM top JOIN nodes e ON e.id = top.id, o
  WHERE {_VALID.format(a=a, b=b).replace('parent_a', par.format('e.file_path')).replace('parent_b', par.format('o.file_path'))})
SELECT {NODE_LIST}, line, col FROM v ORDER BY coalesce(line, 0), coalesce(col, 0), id LIMIT {limit}"""


@on_graph("callers", _calls_sql("p:17", True))
def _(g):
    return graph.callers(g.nodes, g.edges, "p:17")


@on_graph("callees", _calls_sql("p:17", False))
def _(g):
    return graph.callees(g.nodes, g.edges, "p:17")


@on_graph("call_boundary_theta", f""", q AS (SELECT s.id AS source, t.id AS target, s.file_path AS fa, t.file_path AS fb, count(*) AS n FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE edges.kind = 'calls' GROUP BY ALL)
SELECT source, target, n FROM q WHERE {_VALID.format(a='fa', b='fb').replace('parent_a', "regexp_replace(fa, '/?[^/]*$', '')").replace('parent_b', "regexp_replace(fb, '/?[^/]*$', '')")}""")
def _(g):
    calls = g.edges.filter("kind = 'calls'").groupBy("source", "target").agg(F.count("*").alias("n"))
    paths = g.nodes.select("id", "file_path")
    both = calls.join(paths.select(F.col("id").alias("source"), F.col("file_path").alias("from_path")), "source").join(paths.select(F.col("id").alias("target"), F.col("file_path").alias("to_path")), "target")
    return graph.valid_calls(saved(both), g.nodes).select("source", "target", "n")


@on_graph("references", ", top AS (SELECT source, kind AS edge_kind, line AS edge_line FROM edges WHERE target = 's:7' ORDER BY coalesce(line, 0), coalesce(col, 0), source, kind LIMIT 50) SELECT id, kind, name, file_path, edge_kind, edge_line FROM top JOIN nodes ON id = source")
def _(g):
    return graph.references(g.nodes, g.edges, "s:7")


def _reach(root: str, incoming: bool, depth: int, kinds: str = "") -> str:
    a, b = ("target", "source") if incoming else ("source", "target")
    where = f"WHERE kind IN ({kinds})" if kinds else ""
    return f", k AS (SELECT * FROM edges {where}), walk(id, d) AS (SELECT '{root}', 0 UNION SELECT k.{b}, d + 1 FROM walk JOIN k ON k.{a} = walk.id WHERE d < {depth}), seen AS (SELECT id, min(d) AS d FROM walk GROUP BY id)"


def _nodes_and_edges(found):
    nodes, edges = found
    return nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.lit("").alias("b"), "kind", F.lit(1).cast("long").alias("n")).unionByName(edges.groupBy("source", "target", "kind").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), F.col("source").alias("a"), F.col("target").alias("b"), "kind", "n"))


def _subgraph_sql(root: str, incoming: bool, depth: int, kinds: str = "", start: bool = False) -> str:
    a = "target" if incoming else "source"
    return f"""{_reach(root, incoming, depth, kinds)}
SELECT 'node' AS what, nodes.id AS a, '' AS b, kind, 1 AS n FROM seen JOIN nodes USING (id) {'' if start else 'WHERE d > 0'}
UNION ALL SELECT 'edge', source, target, k.kind, count(*) FROM k JOIN seen ON seen.id = k.{a} GROUP BY ALL"""


@on_graph("bfs_impact", _subgraph_sql("p:5", True, 1, "'calls', 'references'", True))
def _(g):
    return _nodes_and_edges(graph.impact(g.nodes, g.edges, "p:5", 1, None))


@on_graph("bfs_dependencies", _subgraph_sql("p:9", False, 2))
def _(g):
    return _nodes_and_edges(graph.dependencies(g.nodes, g.edges, "p:9", 2, None))


@on_graph("bfs_dependents", _subgraph_sql("s:3", True, 1))
def _(g):
    return _nodes_and_edges(graph.dependents(g.nodes, g.edges, "s:3", 1, None))


def _limited_sql(root: str, limit: int, depth: int, directions: tuple[int, ...], kinds: tuple[str, ...] = ()) -> str:
    """Edges of a first-in, first-out search up to a limit: all of a level before the next, nodes in the order in which they are found."""
    place = f"list_position([{', '.join(map(repr, kinds))}], kind)" if kinds else "0"
    sides = " UNION ALL ".join(f"SELECT {'source AS here, target' if d == 0 else 'target AS here, source'} AS other, {d} AS dir, {place} AS kind_at, * FROM edges" for d in directions)
    out = [f", st AS (SELECT * FROM ({sides}) WHERE kind_at IS NOT NULL)", f"f0 AS (SELECT '{root}' AS here, 1 AS ord)"]
    for d in range(depth + 1):
        seen = " UNION ALL ".join(f"SELECT here FROM f{i}" for i in range(d + 1))
        out.append(f"e{d} AS (SELECT st.*, ord, row_number() OVER (PARTITION BY st.here, dir, kind_at ORDER BY coalesce(line, 0), coalesce(col, 0), other, kind) AS nth FROM st JOIN f{d} ON f{d}.here = st.here)")
        out.append(f"r{d} AS (SELECT *, row_number() OVER (ORDER BY ord, dir, kind_at, nth) AS turn FROM e{d})")
        out.append(f"f{d + 1} AS (SELECT other AS here, row_number() OVER (ORDER BY min(turn)) AS ord FROM r{d} WHERE other NOT IN ({seen}) GROUP BY other)")
    every = " UNION ALL ".join(f"SELECT {d} AS level, turn, source, target, kind, line, col FROM r{d}" for d in range(depth + 1))
    return f"{', '.join(out)} SELECT source, target, kind, line, col FROM ({every}) ORDER BY level, turn LIMIT {limit}"


@on_graph("bfs_both_limit", _limited_sql("p:5", 150, 1, (0, 1)))
def _(g):
    return graph.subgraph(g.nodes, g.edges, ["p:5"], graph.Traversal(max_depth=1, limit=150))[1]


@on_graph("bfs_impact_limit", _limited_sql("p:5", 200, 2, (1,), ("calls", "references")))
def _(g):
    return graph.impact(g.nodes, g.edges, "p:5", 2)[1]


@on_graph("bfs_dependencies_limit", _limited_sql("p:9", 50, 2, (0,)))
def _(g):
    return graph.dependencies(g.nodes, g.edges, "p:9")[1]


@on_graph("bfs_dependents_limit", _limited_sql("r:1", 50, 2, (1,)))
def _(g):
    return graph.dependents(g.nodes, g.edges, "r:1")[1]


@on_graph("impact_levelsync", """, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY coalesce(line, 0), coalesce(col, 0), source, kind) AS nth FROM edges),
c AS (SELECT source, target FROM r WHERE nth <= 100), a AS (SELECT DISTINCT source AS id FROM c WHERE target = 's:3'), b AS (SELECT DISTINCT source AS id FROM c JOIN a ON target = a.id)
SELECT id, kind FROM nodes WHERE id IN (SELECT id FROM a UNION SELECT id FROM b) AND id <> 's:3'""")
def _(g):
    return graph.impact_by_level(g.nodes, g.edges, "s:3", 2).select("id", "kind")


def _path_query(spark, sf_dir):
    g = adapted(spark, sf_dir)
    path = graph.shortest_path(g.nodes, g.edges, "p:5", "s:3")
    return spark.createDataFrame([(i, x) for i, x in enumerate(path, 1)], "step long, id string")


def _path_sql(start: str, end: str, depth: int, cap: int = 500) -> str:
    """Of each level, the nodes in the order in which they are found, each with the path over the parent that found it first."""
    out = [f"k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coalesce(line, 0), coalesce(col, 0), target, kind) AS nth FROM edges)", f"p0 AS (SELECT '{start}' AS id, 1 AS ord, ['{start}'] AS path)"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM p{i}" for i in range(d))
        out.append(f"c{d} AS (SELECT target AS id, ord, nth, list_append(path, target) AS path FROM k JOIN p{d - 1} ON source = p{d - 1}.id WHERE nth <= {cap} AND target NOT IN ({seen}))")
        out.append(f"b{d} AS (SELECT * FROM c{d} QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord, nth) = 1)")
        out.append(f"p{d} AS (SELECT id, row_number() OVER (ORDER BY ord, nth) AS ord, path FROM b{d})")
    every = " UNION ALL ".join(f"SELECT path FROM p{d} WHERE id = '{end}'" for d in range(1, depth + 1))
    return f", {', '.join(out)}, one AS (SELECT path FROM ({every}) ORDER BY len(path) LIMIT 1) SELECT unnest(range(1, len(path) + 1)) AS step, unnest(path) AS id FROM one"


QUERIES["shortest_path"] = _path_query
SQL["shortest_path"] = WITH + _path_sql("p:5", "s:3", 4)


@on_graph("resolve_name_ambiguity", "SELECT id, name, count(*) OVER (PARTITION BY name) AS n FROM nodes WHERE name = 'red widget' AND file_path = 'part/ECONOMY/Brand#17.x'")
def _(g):
    return graph.resolve_name(g.nodes, "red widget", "part/ECONOMY/Brand#17.x").select("id", "name", "n")


@on_graph("node_degrees", ", e AS (SELECT source AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, 0, 1 FROM edges) SELECT id, CAST(least(sum(o), 200) AS BIGINT) AS n_out, CAST(least(sum(i), 200) AS BIGINT) AS n_in FROM e GROUP BY id")
def _(g):
    return graph.degrees(g.edges)


@on_graph("dangling_edges", "SELECT count(*) AS n FROM edges WHERE source NOT IN (SELECT id FROM nodes WHERE kind <> 'export' AND name <> 'red widget') OR target NOT IN (SELECT id FROM nodes WHERE kind <> 'export' AND name <> 'red widget')")
def _(g):
    return graph.dangling(g.nodes.filter("kind <> 'export' and name <> 'red widget'"), g.edges).agg(F.count("*").alias("n"))


# Statistics and audit


@on_graph("symbols_overview", "SELECT kind, count(*) AS n, min(start_line) AS first_line FROM nodes WHERE file_path = 'part/ECONOMY/Brand#2.x' GROUP BY kind")
def _(g):
    return audit.overview(g.nodes, "part/ECONOMY/Brand#2.x").select("kind", "n", F.col("symbols")[0]["start_line"].alias("first_line"))


@on_graph("stats_totals", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT file_path) FROM nodes) AS files, (SELECT count(*) FROM refs) AS unresolved")
def _(g):
    return audit.totals(nodes=g.nodes, edges=g.edges, files=g.nodes.select("file_path").distinct(), unresolved=g.refs)


@on_graph("stats_by_kind", "SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def _(g):
    return audit.count_by(g.nodes, "kind")


@on_graph("stats_by_language", "SELECT language, count(*) AS n FROM (SELECT DISTINCT file_path, language FROM nodes) GROUP BY language")
def _(g):
    return audit.count_by(g.nodes.select("file_path", "language").distinct(), "language")


@on_graph("stats_edges_by_kind", "SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def _(g):
    return audit.count_by(g.edges, "kind")


@on_graph("doc_stale_refs", "SELECT refs.id AS ref, reference_name, file_path, name AS section, line, col FROM (SELECT id, replace(from_node_id, 'p:', 'o:') AS from_node_id, reference_name, line, col FROM refs) refs JOIN nodes ON nodes.id = from_node_id WHERE language = 'markdown'")
def _(g):
    return audit.stale_references(g.refs.withColumn("from_node_id", F.replace("from_node_id", F.lit("p:"), F.lit("o:"))), g.nodes)


@on_graph("undocumented_exports", """SELECT id, file_path, start_line FROM nodes n WHERE is_exported AND language <> 'markdown' AND kind IN ('function', 'method', 'struct', 'class', 'interface', 'trait', 'enum', 'type_alias', 'constant')
AND NOT EXISTS (SELECT 1 FROM edges e JOIN nodes s ON s.id = e.source WHERE e.kind = 'references' AND s.language = 'markdown' AND e.target = n.id)""")
def _(g):
    return audit.undocumented_exports(g.nodes, g.edges).select("id", "file_path", "start_line")


@on_graph("doc_coverage", "SELECT count(DISTINCT file_path) AS files, count(id) AS sections FROM nodes WHERE language = 'markdown' AND kind = 'module'")
def _(g):
    return audit.coverage(g.nodes)


# Resolution


def _hint(path: str) -> str:
    clean = "regexp_replace(regexp_replace(module, '^.*::', ''), '(\\.ts)*(\\.tsx)*(\\.rs)*$', '')"
    return f"(ends_with(regexp_replace({path}, '(\\.ts)*(\\.tsx)*(\\.rs)*$', ''), {clean}) OR regexp_replace(regexp_replace({path}, '^.*/', ''), '[.][^.]*$', '') = {clean})"


_RESOLVED = f""", own AS (SELECT refs.*, file_path AS from_path FROM refs JOIN nodes ON nodes.id = from_node_id),
imports AS (SELECT file_path, name, split_part(signature, '|export=', 1) AS module, CASE WHEN contains(signature, '|export=') THEN split_part(signature, '|export=', 2) ELSE name END AS export,
  row_number() OVER (PARTITION BY file_path, name ORDER BY start_line, id) AS nth FROM nodes WHERE kind = 'import'),
hinted AS (SELECT own.*, module, export FROM own LEFT JOIN imports ON imports.file_path = from_path AND imports.name = reference_name AND nth = 1),
counted AS (SELECT name, file_path, count(*) AS n, count(*) FILTER (kind IN ('function', 'method')) AS callables, min(id) AS node, min(id) FILTER (kind IN ('function', 'method')) AS callable FROM nodes GROUP BY name, file_path),
tiers AS (
  SELECT h.id, 0 AS tier, count(*) AS n, min(x.id) AS node FROM hinted h JOIN nodes x ON x.kind = 'export' AND x.signature = module AND x.name = export GROUP BY h.id
  UNION ALL
  SELECT h.id, CASE WHEN module IS NOT NULL AND {_hint('c.file_path')} THEN 1 WHEN c.file_path = from_path THEN 2
      WHEN regexp_replace(c.file_path, '/?[^/]*$', '') = regexp_replace(from_path, '/?[^/]*$', '') THEN 3 WHEN reference_kind <> 'calls' THEN 4 END AS tier,
    sum(CASE WHEN reference_kind = 'calls' THEN callables ELSE c.n END) AS n, min(CASE WHEN reference_kind = 'calls' THEN callable ELSE c.node END) AS node
  FROM hinted h JOIN counted c ON c.name = reference_name WHERE reference_kind <> 'calls' OR callables > 0 GROUP BY ALL),
best AS (SELECT id, min(tier) AS tier FROM tiers WHERE tier IS NOT NULL GROUP BY id)
SELECT ref.id AS ref, ref.from_node_id AS source, t.node AS target, reference_kind AS kind, line, col, t.tier
FROM best JOIN tiers t ON t.id = best.id AND t.tier = best.tier JOIN own ref ON ref.id = best.id WHERE t.n = 1"""


@on_graph("resolve_refs_tiers", _RESOLVED)
def _(g):
    return resolve.resolve(g.refs, g.nodes)


_HINTED = (
    # a name, the file that uses it, the framework and the path that it stands for, by p_type and p_size
    ("concat('crate::', p_type, '::m', p_size)", "'src/main.rs'", "rust", "concat('src/', p_type, '/m', p_size, '.rs')"),
    ("concat('super::m', p_size)", "'src/a/b/c.rs'", "rust", "concat('src/a/m', p_size, '/mod.rs')"),
    ("concat('./', p_type, p_size)", "'web/app/main.tsx'", "react", "concat('web/app/', p_type, p_size, '/index.tsx')"),
    ("concat('@/', p_type, p_size)", "'web/app/main.tsx'", "react", "concat('src/', p_type, p_size, '.jsx')"),
    ("concat('Shop', p_size, '.Order')", "'Pages/Index.razor'", "blazor", "concat('Services/Shop', p_size, '/Order.cs')"),
    (r"concat('App\\Models\\M', p_size)", "'app/Http/C.php'", "laravel", "concat('app/Models/M', p_size, '.php')"),
    ("concat('mail.m', p_size)", "'app/Http/C.php'", "laravel", "concat('resources/views/mail/m', p_size, '.blade.php')"),
)
_HINTS_SQL = " UNION ".join(f"SELECT {n} AS name, {f} AS from_path, '{k}' AS framework, {p} AS path FROM part WHERE p_size % 3 = 0" for n, f, k, p in _HINTED)


@on_tables("framework_hints", "part", _HINTS_SQL.replace("\\\\", "\\"))
def _(part):
    union = lambda frames: reduce(lambda a, b: a.unionByName(b), frames).distinct()
    names = union([part.select(F.expr(n).alias("name"), F.expr(f).alias("from_path")) for n, f, _, _ in _HINTED])
    files = union([part.filter("p_size % 3 = 0").select(F.expr(p).alias("path")) for *_, p in _HINTED])
    return resolve.framework_hints(names, files)


# Vectors


@on_tables("cosine_topk", "embeddings", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), 4) AS score FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)) >= 0.3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)) DESC, vec_id LIMIT 10")
def _(embeddings):
    query = embeddings.filter("vec_id = 3").first()["embedding"]
    return vectors.top_similar(embeddings, query, key="vec_id").select("vec_id", F.round("score", 4).alias("score"))


@on_tables("l2_normalize", "embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 3)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 3 * x::DOUBLE * 3))), 4) AS total FROM embeddings")
def _(embeddings):
    scaled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return embeddings.select("vec_id", F.round(F.aggregate(vectors.normalised(scaled), F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@on_graph("embed_text", "SELECT id, concat_ws(' | ', name, CASE WHEN concat(file_path, '::', name) <> name THEN concat(file_path, '::', name) END, signature) AS body FROM nodes")
def _(g):
    return g.nodes.select("id", text.embed_text(F.col("name"), F.concat_ws("::", "file_path", "name"), F.lit(None).cast("string"), F.col("signature")).alias("body"))


@on_tables("unembedded_anti", "documents embeddings", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(docs, embeddings):
    return vectors.unembedded(docs.select(F.col("doc_id").alias("id")), embeddings.select(F.col("vec_id").alias("node_id"))).select(F.col("id").alias("doc_id"))


@on_tables("stale_embeddings", "documents embeddings", "SELECT doc_id FROM documents LEFT JOIN embeddings ON doc_id = vec_id WHERE vec_id IS NULL OR n_chars > label * 500")
def _(docs, embeddings):
    made = embeddings.select(F.col("vec_id").alias("node_id"), (F.col("label") * 500).alias("created_at"))
    return vectors.stale(docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("updated_at")), made).select(F.col("id").alias("doc_id"))


# Store and synchronisation

_OLD = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN concat(text, '!') ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0"
_NEW = "SELECT doc_id, text FROM documents WHERE doc_id % 11 <> 0"


def _snapshots(docs):
    files = lambda df: df.select(F.concat(F.lit("f"), "doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("modified_at"))
    old = docs.filter("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return files(docs.filter("doc_id % 11 <> 0")), files(old)


@on_tables("snapshot_diff", "documents", f"""SELECT concat('f', coalesce(n.doc_id, o.doc_id)) AS path, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM ({_NEW}) n FULL JOIN ({_OLD}) o ON n.doc_id = o.doc_id WHERE n.doc_id IS NULL OR o.doc_id IS NULL OR n.text <> o.text""")
def _(docs):
    return difference(*_snapshots(docs))


@on_tables("upsert_files", "documents", f"SELECT concat('f', doc_id) AS path, sha256(text) AS content_hash FROM ({_NEW} UNION ALL SELECT * FROM ({_OLD}) WHERE doc_id % 11 = 0)")
def _(docs):
    new, old = _snapshots(docs)
    return upserted(old, new, ["path"]).select("path", "content_hash")


@on_graph("cascade_delete", ", gone AS (SELECT id FROM nodes WHERE file_path LIKE 'part/ECONOMY/%') SELECT (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT id FROM gone)) AS nodes, (SELECT count(*) FROM edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)) AS edges, (SELECT count(*) FROM refs WHERE from_node_id NOT IN (SELECT id FROM gone)) AS unresolved_refs")
def _(g):
    files = g.nodes.select(F.col("file_path").alias("path")).distinct()
    left = without_files({"nodes": g.nodes, "edges": g.edges, "unresolved_refs": g.refs, "files": files}, files.filter("path like 'part/ECONOMY/%'"))
    return audit.totals(nodes=left["nodes"], edges=left["edges"], unresolved_refs=left["unresolved_refs"])


# Guardrails


def _redact_sql(source: str = "SELECT conv_id, turn, text FROM conversations") -> tuple[str, str]:
    """The last table's name and the common table expressions that lead to it."""
    out, last = [f"g0 AS (SELECT *, 0 AS hits FROM ({source}))"], "g0"
    for i, (_, pattern, mark) in enumerate(guard.REDACTIONS, 1):
        p = pattern.replace("'", "''")
        out.append(f"g{i} AS (SELECT conv_id, turn, regexp_replace(text, '{p}', '{mark}', 'g') AS text, hits + len(regexp_extract_all(text, '{p}')) AS hits FROM {last})")
        last = f"g{i}"
    return last, "WITH " + ", ".join(out)


_LAST, _REDACTED = _redact_sql()
_DENIED = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in guard.DENIED_OUTPUT)


@on_tables("redact_text", "conversations", f"{_REDACTED} SELECT conv_id, turn, sha256(text) AS digest, CAST(hits AS BIGINT) AS hits FROM {_LAST}")
def _(c):
    return guard.redacted(c).select("conv_id", "turn", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.col("hits").cast("long").alias("hits"))


@on_tables("deny_hits", "documents", f"SELECT doc_id, CAST({_DENIED} AS BIGINT) AS hits FROM documents")
def _(docs):
    return docs.select("doc_id", guard._hits(F.col("text"), guard.DENIED_OUTPUT).cast("long").alias("hits"))


@on_tables("guard_decision", "conversations", f"{_REDACTED} SELECT conv_id, turn, CASE WHEN {_DENIED} > 0 OR length(text) > 400 THEN 'deny' WHEN hits > 0 THEN 'redact' ELSE 'allow' END AS decision FROM {_LAST}")
def _(c):
    return guard.decided(c, policy=guard.Policy(enforce=True, max_chars=400)).select("conv_id", "turn", "decision")


@on_tables("session_limits", "events", """WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS hits, CASE WHEN value > 90 THEN 1 ELSE 0 END AS blocked FROM events),
r AS (SELECT event_id, count(*) OVER w AS n_calls, CAST(sum(hits) OVER w AS BIGINT) AS n_hits, CAST(sum(blocked) OVER w AS BIGINT) AS n_blocked FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT *, n_calls > 150 OR n_hits > 30 OR n_blocked > 10 AS over_limit FROM r""")
def _(events):
    calls = events.select("event_id", "user_id", "ts", (F.col("event_type") == "error").cast("long").alias("hits"), (F.col("value") > 90).cast("long").alias("blocked"))
    return guard.session_limits(calls, "user_id", ["ts", "event_id"], 150, 30, 10).select("event_id", "n_calls", "n_hits", "n_blocked", "over_limit")


@on_tables("flow_transitions", "events", """WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 'write_like' ELSE 'read_like' END AS risk FROM events),
s AS (SELECT *, CASE WHEN risk = 'write_like' AND lag(risk) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'read_like' THEN 1 ELSE 0 END AS step FROM e),
r AS (SELECT event_id, CAST(sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS transitions FROM s) SELECT *, transitions > 10 AS over_flow FROM r""")
def _(events):
    calls = events.select("event_id", "user_id", "ts", F.when(F.col("event_type").isin("purchase", "signup"), "write_like").otherwise("read_like").alias("risk"))
    return guard.flow_transitions(calls, "user_id", ["ts", "event_id"]).select("event_id", "transitions", "over_flow")


def _context_pack(spark, sf_dir):
    from skein.operators.context import build

    g = adapted(spark, sf_dir)
    found = build("red widget economy", _indexed(g).withColumn("end_line", F.col("start_line")), g.edges, None, 10)
    return spark.createDataFrame([(n["id"], n["kind"], n["file_path"], round(n["score"], 6)) for n in found.nodes], "id string, kind string, file_path string, score double")


QUERIES["context_pack"] = _context_pack
