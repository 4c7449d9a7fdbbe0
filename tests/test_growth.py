"""Work that must grow no faster than its input: what is computed how often, and what meets what."""

import pyarrow as pa

from skein.operators import graph
from skein.plans import adapters
from skein.sources import ingest

NODES = "id string, kind string, name string, file_path string, signature string, start_line long"
EDGES = "source string, target string, kind string, line long, col long"


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_parsed_in_batches():
    files = pa.RecordBatch.from_pylist([{"path": f"src/f{i}.rs", "language": "rust", "content": f"mod m;\nfn f{i}() {{\n    g();\n}}\n", "tried": [{"name": "m", "guess": "src/m/mod.rs", "turn": 1}, {"name": "m", "guess": "src/m.rs", "turn": 0}]} for i in range(10)])
    found = list(ingest._parse(iter([files])))
    assert len(found) == 1 and found[0].num_rows == 60
    assert {r["signature"] for r in found[0].to_pylist() if r["kind"] == "module" and r["what"] == "node"} == {"src/m.rs"}


def test_parsed_rows_meet_no_other_rows(spark):
    files = spark.range(3).selectExpr("concat('src/f', id, '.rs') AS path", "'rust' AS language", "concat('mod f', id + 1, ';') AS content", "'h' AS content_hash", "1L AS size", "0L AS modified_at")
    nodes = ingest.ingest(files, once=False)["nodes"]
    assert {(r.file_path, r.signature) for r in nodes.filter("kind = 'module'").collect()} == {("src/f0.rs", "src/f1.rs"), ("src/f1.rs", "src/f2.rs"), ("src/f2.rs", None)}
    before_parsing = plan(nodes).split("MapInArrow")[0]
    assert "Join" not in before_parsing  # of the parsed rows, of which there are many more than files


def test_each_pair_of_files_meets_each_import_once(spark):
    nodes = spark.createDataFrame([(f"i{i}", "import", "z", "src/a.x", None, i) for i in range(5)], NODES)
    pairs = spark.createDataFrame([(i, "src/a.x", to) for i in range(5) for to in ("lib/z.x", "lib/y.x")], "n int, from_path string, to_path string")
    found = graph.valid_calls(pairs, nodes)
    assert sorted((r.n, r.to_path) for r in found.collect()) == [(i, "lib/z.x") for i in range(5)]
    assert plan(found).count("Aggregate") >= 2


def test_dangling_meets_ids_once_for_each_end(spark):
    nodes = spark.createDataFrame([("a", "function", "a", "f", None, 1)] * 2, NODES)
    edges = spark.createDataFrame([("a", "a", "calls", 1, 1), ("a", "b", "calls", 1, 1), ("c", "b", "calls", 1, 1), ("c", "a", "calls", 1, 1), (None, "a", "calls", 1, 1), ("c", None, "calls", 1, 1)], EDGES)
    found = graph.dangling(nodes, edges)
    assert sorted((r.source, r.target or "") for r in found.collect()) == [("a", "b"), ("c", ""), ("c", "a"), ("c", "b")]
    assert plan(found).count("Join ") == 2


def test_searches_compute_edges_once(spark):
    nodes = spark.createDataFrame([(x, "function", x, "f", None, 1) for x in "abcd"], NODES)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([("a", "b", "calls", 1, 1), ("b", "c", "calls", 1, 1), ("c", "d", "calls", 1, 1)], EDGES).mapInArrow(counted, EDGES)
    for limit in (None, 50):
        read.value = 0
        got = graph.dependencies(nodes, edges, "a", 2, limit)
        assert ({r.id for r in got[0].collect()}, got[1].count(), read.value) == ({"b", "c"}, 3, 3)
    read.value = 0
    assert graph.shortest_path(nodes, edges, "a", "d") == ["a", "b", "c", "d"] and read.value == 3


def test_pairs_of_keys_are_distinct_as_numbers():
    assert adapters.SPARK_EDGES != adapters.EDGES and "SELECT DISTINCT concat" not in adapters.SPARK_EDGES
