"""Every tool on one small project."""

import pytest

from skein.tools import TOOLS, Project, ToolError
from tests.test_engine import FILES, root  # noqa: F401


def test_tools(spark, root):  # noqa: F811
    p = Project(spark, root)
    assert p.index()["added"] == 7 and p.index() == {"added": 0, "modified": 0, "removed": 0}
    assert [r["name"] for r in p.call("callees", {"name": "run", "file": "src/runtime.rs"})["callees"]] == ["post"]
    assert p.call("search", {"query": "post"})["count"] >= 3
    body = p.call("find_symbol", {"name_pattern": "g", "include_body": True, "limit": 20})["symbols"]
    assert any(s["body"] and s["body"].startswith("def g") for s in body)
    g = [r for r in p.call("get_file_nodes", {"file_path": "py/a.py", "kind": "function"})["nodes"] if r["name"] == "g"][0]["id"]
    assert [r["name"] for r in p.call("skein_callers", {"node_id": g})["callers"]] == ["f"]
    assert p.call("find_references", {"node_id": g})["count"] == 2 and p.call("impact", {"node_id": g})["count"] == 2
    assert p.call("dependents", {"node_id": g})["count"] >= 2 and p.call("dependencies", {"name": "A"})["count"] == 2
    found = p.call("path", {"from_name": "A", "to_id": g})
    assert found["path_found"] and [n["name"] for n in found["path"]] == ["A", "f", "g"]
    assert p.call("node", {"node_id": g, "include_edges": True})["incoming"] == 2
    assert p.call("get_symbols_overview", {"file_path": "py/a.py"})["symbol_count"] == 5
    assert p.call("stats")["files_by_language"]["python"] == 1 and p.call("status")["stats"]["files"] == 7
    assert p.call("read_file", {"path": "src/api.rs"})["total_lines"] == 1 and "src/" in p.call("list_dir")["entries"]
    assert p.call("find_file", {"pattern": "a?i.rs"})["matches"] == ["legacy/api.rs", "src/api.rs"]
    assert p.call("get_config", {"section": "sync"})["config"]["sync"]["auto_sync_interval_secs"] == 120
    p.call("update_config", {"section": "context", "key": "max_nodes", "value": 3})
    assert Project(spark, root).config.context.max_nodes == 3
    for bad in ({"section": "x", "key": "y", "value": 1}, {"section": "context", "key": "max_nodes", "value": "3"}):
        with pytest.raises(ToolError):
            p.call("update_config", bad)
    assert p.call("semantic_search", {"query": "post api"})["results"][0]["name"] in ("post", "api.rs")
    assert "# Context: run" in p.call("context", {"task": "run"})["text"]
    assert p.call("audit_docs")["summary"]["stale"] == 0
    p.call("write_memory", {"name": "m", "content": "a b"})
    assert p.call("edit_memory", {"name": "m", "pattern": "a", "replacement": "c"})["content"] == "c b" == p.call("read_memory", {"name": "m"})["content"]
    assert p.call("list_memories")["memories"] == ["m"]
    p.call("delete_memory", {"name": "m"})
    with pytest.raises(ToolError):
        p.call("delete_memory", {"name": "m"})
    with pytest.raises(ToolError):
        p.call("callers", {"name": "post"})
    assert p.call("sync")["added"] == 0 and p.call("session_status")["transitions"] >= 1
    assert len(TOOLS) >= 27
