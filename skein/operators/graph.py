"""Adjacency, callers and callees with the boundary check, bounded breadth-first subgraphs, impact, shortest paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import parent
from skein.scratch import saved

OUT, IN, BOTH = "outgoing", "incoming", "both"


def _order(other: str) -> list[Column]:
    return [F.coalesce("line", F.lit(0)), F.coalesce("col", F.lit(0)), F.col(other)]


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(F.col("name") == name)


def by_file(nodes: DataFrame, file: str, kind: str | None = None) -> DataFrame:
    """A file's nodes (of a kind) in order of their lines."""
    found = nodes.filter(F.col("file_path") == file)
    return (found.filter(F.col("kind") == kind) if kind else found).orderBy("start_line", "id")


def adjacent(edges: DataFrame, node: str, direction: str = OUT, kind: str | None = None, limit: int = 50) -> DataFrame:
    """A node's edges of one direction in order of line, column and other end, up to the limit."""
    mine, other = ("source", "target") if direction == OUT else ("target", "source")
    found = edges.filter(F.col(mine) == node)
    return (found.filter(F.col("kind") == kind) if kind else found).orderBy(*_order(other), "kind").limit(limit)


def first_edges(edges: DataFrame, k: int, direction: str = OUT) -> DataFrame:
    """The first k edges of every node; Spark keeps k rows of a node before it shuffles."""
    mine, other = ("source", "target") if direction == OUT else ("target", "source")
    ranked = edges.withColumn("rank", F.row_number().over(Window.partitionBy(mine).orderBy(*_order(other), "kind")))
    return ranked.filter(F.col("rank") <= k)


def valid_calls(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows with from_path and to_path for which a call is valid: same file, same folder, or an import in the caller's file.

    An import counts if the callee's path contains its name or signature, or these with :: as slashes. Rows that pass by path
    alone skip the semi-join, which takes each pair of files and each import of a file once, however many rows and imports there are.
    """
    near = (F.col("from_path") == F.col("to_path")) | (parent(F.col("from_path")) == parent(F.col("to_path")))
    imports = nodes.filter("kind = 'import'").select(F.col("file_path").alias("in_file"), F.col("name").alias("i_name"), F.col("signature").alias("i_signature")).distinct()
    holds = lambda c: F.col("to_path").contains(c) | F.col("to_path").contains(F.replace(c, F.lit("::"), F.lit("/")))
    far = pairs.filter(~near)
    ways = far.select("from_path", "to_path").distinct()
    allowed = ways.join(imports, (F.col("from_path") == F.col("in_file")) & (holds(F.col("i_name")) | F.coalesce(holds(F.col("i_signature")), F.lit(False))), "left_semi")
    return pairs.filter(near).unionByName(far.join(allowed, ["from_path", "to_path"], "left_semi"))


def _calls(nodes: DataFrame, edges: DataFrame, node: str, incoming: bool, limit: int) -> DataFrame:
    other = "source" if incoming else "target"
    ends = adjacent(edges, node, IN if incoming else OUT, "calls", 2 * limit).select(F.col(other).alias("id"), "line", "col")
    plain = nodes.select("id", "kind", "name", "file_path", "start_line")
    own = nodes.filter(F.col("id") == node).select(F.col("file_path").alias("own_path"))
    found = plain.join(F.broadcast(ends), "id").crossJoin(F.broadcast(own))  # own is one node
    a, b = ("file_path", "own_path") if incoming else ("own_path", "file_path")
    valid = valid_calls(found.withColumns({"from_path": F.col(a), "to_path": F.col(b)}), nodes)
    return valid.orderBy(*_order("id")).limit(limit).drop("own_path", "from_path", "to_path")


def callers(nodes: DataFrame, edges: DataFrame, node: str, limit: int = 20) -> DataFrame:
    """Twice the limit of incoming calls, their sources, those that may call, up to the limit."""
    return _calls(nodes, edges, node, True, limit)


def callees(nodes: DataFrame, edges: DataFrame, node: str, limit: int = 20) -> DataFrame:
    return _calls(nodes, edges, node, False, limit)


def references(nodes: DataFrame, edges: DataFrame, node: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Incoming edges of one or all kinds with their sources; edges from nodes that are not there drop out."""
    ends = adjacent(edges, node, IN, kind, limit).select(F.col("source").alias("id"), F.col("kind").alias("edge_kind"), F.col("line").alias("edge_line"))
    return nodes.select("id", "kind", "name", "file_path").join(F.broadcast(ends), "id")


@dataclass(frozen=True)
class Traversal:
    """What a subgraph search follows. limit bounds edges; None is no bound."""

    max_depth: int = 1
    edge_kinds: tuple[str, ...] | None = None
    node_kinds: tuple[str, ...] | None = None
    direction: str = BOTH
    limit: int | None = 200
    include_start: bool = True


def _steps(edges: DataFrame, spec: Traversal) -> DataFrame:
    """Edges as steps: at, other, dir (0 out, 1 in), kind_at, and the edge."""
    sides = []
    if spec.direction != IN:
        sides.append(edges.select(F.col("source").alias("at"), F.col("target").alias("other"), F.lit(0).alias("dir"), "*"))
    if spec.direction != OUT:
        sides.append(edges.select(F.col("target").alias("at"), F.when(F.col("source") == F.col("target"), F.col("target")).otherwise(F.col("source")).alias("other"), F.lit(1).alias("dir"), "*"))
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    if spec.edge_kinds is None:
        return both.withColumn("kind_at", F.lit(0))
    place = F.array_position(F.array(*map(F.lit, spec.edge_kinds)), F.col("kind"))
    return both.withColumn("kind_at", place.cast("int")).filter("kind_at > 0")


def _kept(edges: DataFrame, spec: Traversal) -> DataFrame:
    """The edges that a search may follow, written down: each level reads them again, and they may be costly to compute."""
    found = edges if spec.edge_kinds is None else edges.filter(F.col("kind").isin(*spec.edge_kinds))
    return saved(found)


def subgraph(nodes: DataFrame, edges: DataFrame, roots: list[str], spec: Traversal) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within reach of the roots.

    Nodes are taken first in, first out; each gives its outgoing, then its incoming edges, kind by kind as listed, in order, until
    the limit is met; the node taken next is still returned. Edges that leave nodes at the greatest depth are returned, their
    ends are not. With a limit the driver holds at most limit edges, which executors select; without, levels stay distributed.
    """
    if spec.limit is None:
        return _unbounded(nodes, edges, roots, spec)
    spark = nodes.sparkSession
    steps = _steps(_kept(edges, spec), spec)
    queue, seen, taken, kept = [(r, 0) for r in roots], set(), [], []
    full = False
    while queue and not full:
        depth = queue[0][1]
        level, rest = [], []
        for n, d in queue:
            (level if d == depth else rest).append(n if d == depth else (n, d))
        fresh = [n for n in dict.fromkeys(level) if n not in seen]
        seen.update(fresh)
        if depth > spec.max_depth or not fresh:
            queue = rest
            continue
        left = spec.limit - len(kept)
        frontier = F.broadcast(spark.createDataFrame([(n, i) for i, n in enumerate(fresh)], "at string, ord int"))  # at most limit rows and the roots
        found = steps.join(frontier, "at").withColumn("nth", F.row_number().over(Window.partitionBy("at", "dir", "kind_at").orderBy(*_order("other"), "kind"))).filter(F.col("nth") <= spec.limit)
        rows = found.orderBy("ord", "dir", "kind_at", "nth").limit(left).collect() if left > 0 else []
        kept += rows
        if len(kept) >= spec.limit:
            last = rows[-1]["ord"] if rows else -1
            taken += [(n, depth) for n in fresh[: last + 1]]
            after = [(n, depth) for n in fresh[last + 1 :]] + [(n, d) for n, d in rest if n not in seen]
            after += [(r["other"], depth + 1) for r in rows if depth + 1 <= spec.max_depth and r["other"] not in seen]
            taken += after[:1]
            full = True
        else:
            taken += [(n, depth) for n in fresh]
            queue = rest + [(r["other"], depth + 1) for r in rows if depth + 1 <= spec.max_depth]
    ids = [(n,) for n, d in taken if spec.include_start or d > 0]
    out = nodes.join(F.broadcast(spark.createDataFrame(ids, "id string")), "id", "left_semi")
    if spec.node_kinds is not None:
        out = out.filter(F.col("kind").isin(list(spec.node_kinds)))
    return out, spark.createDataFrame([tuple(r[c] for c in edges.columns) for r in kept], edges.schema)


def _unbounded(nodes: DataFrame, edges: DataFrame, roots: list[str], spec: Traversal) -> tuple[DataFrame, DataFrame]:
    """All that is within reach, level by level as DataFrames; each level's nodes are written down to end their lineage."""
    spark = nodes.sparkSession
    steps = _steps(_kept(edges, spec), spec)
    level = spark.createDataFrame([(r,) for r in dict.fromkeys(roots)], "id string")
    seen = level.withColumn("depth", F.lit(0))
    for depth in range(1, spec.max_depth + 1):
        level = saved(steps.join(level.withColumnRenamed("id", "at"), "at", "left_semi").select(F.col("other").alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = seen.unionByName(level.withColumn("depth", F.lit(depth)))
    out = nodes.join(seen if spec.include_start else seen.filter("depth > 0"), "id", "left_semi")
    if spec.node_kinds is not None:
        out = out.filter(F.col("kind").isin(list(spec.node_kinds)))
    return out, steps.join(seen.select(F.col("id").alias("at")), "at", "left_semi").select(*edges.columns)


def checkpoints(spark) -> None:
    """Checkpoints go where spark.checkpoint.dir says; where it is unset, to a temporary folder if all runs on one machine."""
    import tempfile

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp())


def impact(nodes: DataFrame, edges: DataFrame, node: str, max_depth: int = 1, limit: int | None = 200) -> tuple[DataFrame, DataFrame]:
    """What calls or references a node, directly or not."""
    return subgraph(nodes, edges, [node], Traversal(max_depth, ("calls", "references"), None, IN, limit))


def dependencies(nodes: DataFrame, edges: DataFrame, node: str, max_depth: int = 2, limit: int | None = 50) -> tuple[DataFrame, DataFrame]:
    return subgraph(nodes, edges, [node], Traversal(max_depth, None, None, OUT, limit, False))


def dependents(nodes: DataFrame, edges: DataFrame, node: str, max_depth: int = 2, limit: int | None = 50) -> tuple[DataFrame, DataFrame]:
    return subgraph(nodes, edges, [node], Traversal(max_depth, None, None, IN, limit, False))


def impact_by_level(nodes: DataFrame, edges: DataFrame, node: str, max_depth: int = 3, cap: int = 100) -> DataFrame:
    """Nodes that reach a node over any kind within max_depth levels, the first cap incoming edges of each followed; without the node."""
    checkpoints(nodes.sparkSession)
    level = nodes.sparkSession.createDataFrame([(node,)], "id string")
    seen = level
    for _ in range(max_depth):
        into = edges.join(level, edges.target == level.id, "left_semi")
        level = first_edges(into, cap, IN).select(F.col("source").alias("id")).distinct().join(seen, "id", "left_anti").checkpoint()
        seen = seen.unionByName(level)
    return nodes.join(seen.filter(F.col("id") != node), "id", "left_semi")


def _numbered(level: DataFrame) -> DataFrame:
    """id and ord, the rank of place among a level's nodes: ranks within ranges of places, after the numbers of rows of earlier ranges."""
    spread = level.repartitionByRange("place").withColumn("part", F.spark_partition_id()).checkpoint()
    sizes = spread.groupBy("part").agg(F.count("*").alias("n"))
    ahead = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row a part
    own = F.row_number().over(Window.partitionBy("part").orderBy("place", "id"))
    return spread.withColumn("own", own).join(F.broadcast(ahead), "part").select("id", (F.col("ahead") + F.col("own")).cast("long").alias("ord"))


def shortest_path(nodes: DataFrame, edges: DataFrame, start: str, end: str, max_depth: int = 6, cap: int = 500) -> list[str]:
    """Ids from start to end over outgoing edges, the parent found first winning; empty if there is none, and from a node to itself.

    Parents of each level are chosen on executors; the driver takes the path only, one row a level.
    """
    spark = nodes.sparkSession
    checkpoints(spark)
    edges = saved(edges.select("source", "target", "kind", "line", "col"))  # each level reads them
    level = spark.createDataFrame([(start, 0)], "id string, ord long")
    seen, levels = level.select("id"), []
    for _ in range(max_depth):
        out = edges.join(F.broadcast(level) if level.limit(100_001).count() <= 100_000 else level, edges.source == level.id).withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(*_order("target"), "kind"))).filter(F.col("rank") <= cap)
        first = out.groupBy("target").agg(F.min(F.struct("ord", "rank", "source")).alias("by")).join(seen.withColumnRenamed("id", "target"), "target", "left_anti")
        found = first.select(F.col("target").alias("id"), F.col("by.source").alias("parent"), (F.col("by.ord") * (cap + 1) + F.col("by.rank")).alias("place")).checkpoint()
        levels.append(found)
        if not found.filter(F.col("id") == end).isEmpty():
            path = [end]
            for step in reversed(levels):
                path.append(step.filter(F.col("id") == path[-1]).first()["parent"])
            return path[::-1]
        if found.isEmpty():
            break
        level = _numbered(found.select("id", "place")).checkpoint()
        seen = seen.unionByName(found.select("id"))
    return []


def resolve_name(nodes: DataFrame, name: str, file: str | None = None) -> DataFrame:
    """Nodes of a name (in a file), with how many there are: one resolves, none is not found, more are ambiguous."""
    found = by_name(nodes, name)
    found = found.filter(F.col("file_path") == file) if file else found
    return found.withColumn("n", F.count("*").over(Window.partitionBy("name")))


def degrees(edges: DataFrame, cap: int = 200) -> DataFrame:
    """id, n_out and n_in of every node of an edge, each at most cap."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("target", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.least(F.sum("o"), F.lit(cap)).alias("n_out"), F.least(F.sum("i"), F.lit(cap)).alias("n_in"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node. Each edge meets the ids once for each end; an end that is null is not missed."""
    ids = nodes.select("id").distinct()
    known = lambda end: ids.select(F.col("id").alias(f"{end}_id"))
    both = edges.join(known("source"), F.col("source") == F.col("source_id"), "left").join(known("target"), F.col("target") == F.col("target_id"), "left")
    missing = lambda end: F.col(end).isNotNull() & F.col(f"{end}_id").isNull()
    return both.filter(missing("source") | missing("target")).select(*edges.columns)
