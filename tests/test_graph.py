"""Graph operators against plain Python models of first-in, first-out search."""

import random
from collections import deque

import pytest

from skein.operators import graph
from skein.operators.graph import Traversal


def made(seed):
    rng = random.Random(seed)
    ids = [f"n{i:02}" for i in range(rng.randrange(3, 16))]
    nodes = [(i, rng.choice(["function", "class", "import"]), f"name{i}", f"d{rng.randrange(3)}/f{rng.randrange(4)}", None, 1) for i in ids[: len(ids) - 1]]
    edges = [(rng.choice(ids), rng.choice(ids), rng.choice(["calls", "contains", "references"]), rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2])) for _ in range(rng.randrange(0, 50))]
    return nodes, edges, ids


def ordered(edges, node, out, kind):
    mine, other = (0, 1) if out else (1, 0)
    return sorted((e for e in edges if e[mine] == node and kind in (None, e[2])), key=lambda e: (e[3] or 0, e[4] or 0, e[other], e[2]))


def model(nodes, edges, roots, spec):
    known = {n[0]: n[1] for n in nodes}
    seen, out, kept, queue = set(), set(), [], deque((r, 0) for r in roots)
    limit = spec.limit
    while queue:
        node, depth = queue.popleft()
        if depth > spec.max_depth or node in seen:
            continue
        seen.add(node)
        if (spec.include_start or depth) and node in known and (spec.node_kinds is None or known[node] in spec.node_kinds):
            out.add(node)
        if limit is not None and len(kept) >= limit:
            break
        found = []
        for is_out in (True, False):
            if spec.direction != (graph.IN if is_out else graph.OUT):
                for kind in spec.edge_kinds or (None,):
                    found += ordered(edges, node, is_out, kind)[:limit]
        for e in found:
            if limit is not None and len(kept) >= limit:
                break
            kept.append(e)
            if depth + 1 <= spec.max_depth:
                queue.append((e[1] if e[0] == node else e[0], depth + 1))
    return out, sorted(kept, key=str)


@pytest.mark.parametrize("seed", range(6))
def test_subgraph(spark, seed):
    nodes, edges, ids = made(seed)
    rng = random.Random(seed + 100)
    n = spark.createDataFrame(nodes, "id string, kind string, name string, file_path string, signature string, start_line long").coalesce(2)
    e = spark.createDataFrame(edges, "source string, target string, kind string, line long, col long").coalesce(2)
    for limit in (rng.randrange(0, 12), None):
        spec = Traversal(rng.randrange(0, 4), rng.choice([None, ("calls",), ("references", "calls")]), rng.choice([None, ("function", "class")]), rng.choice([graph.OUT, graph.IN, graph.BOTH]), limit, rng.random() < 0.5)
        roots = rng.sample(ids, min(len(ids), rng.randrange(1, 3)))
        got_nodes, got_edges = graph.subgraph(n, e, roots, spec)
        want = model(nodes, edges, roots, spec)
        assert {r.id for r in got_nodes.collect()} == want[0], spec
        assert sorted((tuple(r) for r in got_edges.collect()), key=str) == want[1], spec


def test_shortest_path(spark):
    for seed in range(3):
        nodes, edges, ids = made(seed + 20)
        n = spark.createDataFrame(nodes, "id string, kind string, name string, file_path string, signature string, start_line long").coalesce(1)
        e = spark.createDataFrame(edges, "source string, target string, kind string, line long, col long").coalesce(1)
        start, end = ids[0], ids[-1]
        parents, queue, found = {start: None}, deque([start]), False
        while queue and not found:
            at = queue.popleft()
            for x in ordered(edges, at, True, None):
                if x[1] not in parents:
                    parents[x[1]] = at
                    queue.append(x[1])
                    if x[1] == end:
                        found = True
                        break
        want, at = [], end if found else None
        while at:
            want.insert(0, at)
            at = parents[at]
        assert graph.shortest_path(n, e, start, end, 20) == want
    assert graph.shortest_path(n, e, start, start) == []


def test_calls_respect_boundaries(spark):
    nodes = [("a", "function", "run", "src/runtime.x", None, 1), ("b", "function", "post", "src/api.x", None, 1), ("c", "function", "post", "legacy/api.x", None, 1), ("d", "function", "z", "lib/z.x", None, 1), ("i", "import", "lib::z", "src/runtime.x", None, 1)]
    n = spark.createDataFrame(nodes, "id string, kind string, name string, file_path string, signature string, start_line long")
    e = spark.createDataFrame([("a", t, "calls", i, 0) for i, t in enumerate("bcd")], "source string, target string, kind string, line long, col long")
    assert [r.id for r in graph.callees(n, e, "a").collect()] == ["b", "d"]
    assert [r.id for r in graph.callers(n, e, "c").collect()] == []
    assert graph.dangling(n.filter("id <> 'c'"), e).count() == 1
