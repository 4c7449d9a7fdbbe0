"""Search against SQLite's full-text index, ingest and resolution of small trees, the store, guards, vectors, memories."""

import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import context, guard, outline, resolve, search, vectors
from skein.sources import globs, ingest, tree
from skein.store import Memories, Store, valid_batches
from skein.streaming.sync import auto_sync, difference, synchronised

ROWS = [
    ("a", "add", "src/m.ts::add", None), ("b", "my_func", "src/m.ts::my_func", "adds things"), ("c", "Calculator", "src/m.ts::Calculator", "add add"), ("d", "getHistory", "src/x.ts::Calculator::getHistory", None),
    ("e", "power", "src/x.ts::power", "pow"), ("f", "zeta", "lib/z.rs::zeta", "none"), ("g", "eta", "lib/z.rs::eta", "Élan naïve x² ①"),
]


def test_search_equals_sqlite(spark):
    nodes = spark.createDataFrame(ROWS, "id string, name string, qualified_name string, docstring string").coalesce(1)
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(id, name, qualified_name, docstring)")
    con.executemany("insert into f values (?, ?, ?, ?)", ROWS)
    for query in ["add", "my_func", "history", "Calculator", "src", "add power", "src/x.ts", "elan NAÏVE", 'say "add"', "naive x", "  "]:
        want = {i: -s for i, s in con.execute("select id, rank from f where f match ?", (search.fts_query(query),))} if query.strip() else {}
        got = {r.id: r.score for r in search.search(nodes, query, limit=20).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in got), query


def test_globs():
    import re

    hit = lambda g, p: bool(re.search(globs.to_regex(g), p))
    assert hit("**/*.ts", "a.ts") and hit("**/*.ts", "x/y/a.ts") and not hit("**/*.ts", "a.tsx")
    assert hit("**/node_modules/**", "node_modules/x") and hit("**/node_modules/**", "a/node_modules/b/c") and not hit("**/node_modules/**", "node_modules_x/y")
    assert hit("f[ab]?.py", "fa1.py") and not hit("f[ab]?.py", "fc1.py") and hit("*.{rs,go}", "x.go")


FILES = {
    "src/runtime.rs": "use crate::api::post;\npub fn run() {\n    post();\n}\n", "src/api.rs": "pub fn post() {}\n", "legacy/api.rs": "pub fn post() {}\n",
    "py/a.py": "import os\n\nclass A:\n    def f(self):\n        return g()\n\ndef g():\n    return 1\n", "ts/m.ts": "import { add } from './math';\nexport class C {\n  run(x: number) {\n    return add(x);\n  }\n}\n",
    "ts/math.ts": "export function add(a: number) {\n  return a; // call()\n}\n", "node_modules/x.js": "function no() {}\n", "env1/pyvenv.cfg": "home = x", "env1/lib.py": "def no(): pass\n", "big.rs": "x" * 2000, "c.toml": "a = 1\n",
}


@pytest.fixture
def root(tmp_path):
    for name, body in FILES.items():
        at = tmp_path / "tree" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(body)
    (tmp_path / "tree" / "bad.py").write_bytes(b"\xff\xfe x")
    return str(tmp_path / "tree")


def test_ingest_resolve_sync(spark, root, tmp_path):
    files = tree.read(spark, root, max_bytes=1000)
    assert sorted(r.path for r in files.select("path").collect()) == ["legacy/api.rs", "py/a.py", "src/api.rs", "src/runtime.rs", "ts/m.ts", "ts/math.ts"]
    store = Store(spark, str(tmp_path / "store"))
    store.commit(synchronised(store.tables(), files, ingest.ingest))
    tables = store.tables()
    names = {(r.kind, r.name, r.file_path) for r in tables["nodes"].collect()}
    assert {("function", "run", "src/runtime.rs"), ("import", "post", "src/runtime.rs"), ("class", "A", "py/a.py"), ("function", "g", "py/a.py"), ("class", "C", "ts/m.ts"), ("method", "run", "ts/m.ts"), ("export", "add", "ts/math.ts"), ("function", "add", "ts/math.ts"), ("import", "add", "ts/m.ts")} <= names
    ends = {r.id: (r.name, r.file_path) for r in tables["nodes"].collect()}
    calls = {(ends[r.source][0], ends[r.target][0]) for r in tables["edges"].filter("kind = 'calls'").collect()}
    assert ("f", "g") in calls and ("run", "call") not in calls
    linked = {(ends[r.source], ends[r.target]) for r in resolve.resolve(tables["unresolved_refs"], tables["nodes"]).collect()}
    assert linked == {(("run", "src/runtime.rs"), ("post", "src/api.rs")), (("run", "ts/m.ts"), ("add", "ts/math.ts"))}
    (tmp_path / "tree/ts/math.ts").write_text(FILES["ts/math.ts"] + "export function sub() {}\n")
    (tmp_path / "tree/src/api.rs").unlink()
    again = tree.read(spark, root, max_bytes=1000)
    assert {tuple(r) for r in difference(again, tables["files"], True).collect()} == {("src/api.rs", "removed"), ("ts/math.ts", "modified")}
    store.commit(synchronised(tables, again, ingest.ingest))
    after = store.tables()
    assert after["nodes"].filter("name = 'sub'").count() == 2 and after["nodes"].filter("file_path = 'src/api.rs'").count() == 0
    assert difference(again, after["files"]).count() == 0
    store.clear()
    assert store.tables()["nodes"].count() == 0
    double = tables["nodes"].unionByName(tables["nodes"].filter("name = 'g'"))
    assert valid_batches(double).filter("file_path = 'py/a.py'").count() == 0


def test_unscoped_calls_stay_unresolved(spark):
    nodes = spark.createDataFrame([("r", "function", "run", "src/r.rs", 1, None), ("p", "function", "post", "legacy/a.rs", 1, None)], "id string, kind string, name string, file_path string, start_line long, signature string")
    refs = spark.createDataFrame([(1, "r", "post", "calls", 1, 1, None), (2, "r", "post", "references", 1, 1, None)], "id long, from_node_id string, reference_name string, reference_kind string, line long, col long, candidates array<string>")
    assert [(r.ref, r.target) for r in resolve.resolve(refs, nodes).collect()] == [(2, "p")]


def test_outline(spark):
    body = "# Top\nSee `run()()` and `if`.\n```\n# no\n`no_ref`\n```\n## Sub ##\n`a b` `Thing::x` and `1.2`\n"
    files = spark.createDataFrame([("d.md", body)], "path string, content string")
    assert [(r.line, r.level, r.title) for r in outline.headings(files).orderBy("line").collect()] == [(1, 1, "Top"), (7, 2, "Sub")]
    assert {(r.name, r.section) for r in outline.code_spans(files).collect()} == {("run", "Top"), ("Thing::x", "Sub ##")}


def test_guard(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----"
    rows = spark.createDataFrame([(1, "mail me@x.org now"), (2, key), (3, "fine"), (4, "ssn 123-45-6789"), (5, "x" * 60)], "id long, text string")
    monitor = {r.id: (r.text, r.decision) for r in guard.decided(rows, policy=guard.Policy(max_chars=50)).collect()}
    assert monitor[1] == ("mail [REDACTED_EMAIL] now", "redact") and monitor[2] == (key, "redact") and monitor[3] == ("fine", "allow") and monitor[5] == ("x" * 50, "redact")
    enforce = {r.id: r.decision for r in guard.decided(rows, policy=guard.Policy(enforce=True, max_chars=50)).collect()}
    assert enforce == {1: "redact", 2: "deny", 3: "allow", 4: "redact", 5: "deny"}
    assert guard.input_hits(rows.limit(1).withColumn("text", F.lit("Ignore  previous instructions"))).first()["input_hits"] == 1


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], [2.0, 0.0]), (2, [1.0], [1.0, 2.0]), (3, [0.0, 0.0], [1.0, 1.0]), (4, [1.0, 1.0], [-1.0, -1.0]), (5, [], [])], "id long, a array<float>, b array<float>")
    got = {r.id: r.s for r in rows.select("id", vectors.cosine(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got[1] == pytest.approx(1) and got[2] == got[3] == got[5] == 0 and got[4] == pytest.approx(-1)
    assert [r.v for r in rows.select(vectors.from_bytes(vectors.to_bytes("a")).alias("v")).collect()] == [r.a for r in rows.collect()]
    assert vectors.mean_pool(np.array([[1.0, 2], [3, 4], [9, 9]]), np.array([1, 1, 0])).tolist() == [2, 3]
    nodes = spark.createDataFrame([("x", "add numbers", "m::add", None, None), ("y", "zzz", "q::zzz", None, None)], "id string, name string, qualified_name string, docstring string, signature string")
    made = vectors.embedded(nodes)
    query = made.filter("node_id = 'x'").first()["embedding"]
    assert vectors.top_similar(made, query, 1).first()["node_id"] == "x" and vectors.unembedded(nodes, made).count() == 0


def test_text(spark):
    rows = spark.createDataFrame([("a\nb\r\n",), ("",), ("x",)], "t string")
    assert [tuple(r.r) for r in rows.select(text.line_range(F.col("t"), 0, 1).alias("r")).collect()] == [("a", 1, 2, True), ("", 0, 0, False), ("x", 1, 1, False)]
    assert context.cut("é" * 10, 3) == "é" * 10 + "\n... (truncated) ..." and context.cut("abcd", 3).startswith("abc\n") and context.cut("abc", 3) == "abc"


def test_context(spark):
    nodes = spark.createDataFrame([(*r, "function", "m.ts", "type_script", i + 1, i + 1) for i, r in enumerate(ROWS)], "id string, name string, qualified_name string, docstring string, kind string, file_path string, language string, start_line long, end_line long")
    edges = spark.createDataFrame([("a", "e", "calls", 1, 1)], "source string, target string, kind string, line long, col long")
    sources = spark.createDataFrame([("m.ts", "\n".join(f"line {i}" for i in range(9)))], "path string, content string")
    found = context.build("add", nodes, edges, sources)
    assert [n["id"] for n in found.nodes] == ["a", "c"] and found.blocks[0]["code"] == "line 0" and found.stats()["edges"] == 2
    assert "# Context: add" in found.markdown() and '"task": "add"' in found.json()
    assert context.build("  ", nodes, edges).nodes == []


def test_memories(tmp_path):
    m = Memories(str(tmp_path / "m"))
    m.write("x", "one two one")
    assert m.names() == ["x"] and m.edit("x", "one", "1") == "1 two 1" and m.edit("x", r"(\w+) 1$", "$1 2", "regex") == "1 two 2"
    assert "not found" in m.read("y")
    m.delete("x")
    with pytest.raises(FileNotFoundError):
        m.delete("x")


def test_auto_sync(spark, tmp_path):
    ticks = []
    stream = auto_sync(spark, ticks.append, "1 second", str(tmp_path / "c"))
    import time

    for _ in range(60):
        if ticks:
            break
        time.sleep(0.5)
    stream.stop()
    assert ticks
