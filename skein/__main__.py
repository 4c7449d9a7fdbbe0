"""python -m skein ROOT index [--force] | embed | tools | query WORDS | TOOL [JSON] | TOOL --key value ...: one tool's result as JSON.

A value is read as JSON where it is, else as a text. query searches for symbols of any kind, 10 at most or as --limit says.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from skein.tools import Project


def options(args: list[str]) -> dict:
    """--key value pairs; a key without a value is true."""
    out = {}
    for i, a in enumerate(args):
        if a.startswith("--"):
            value = args[i + 1] if i + 1 < len(args) and not args[i + 1].startswith("--") else "true"
            try:
                out[a[2:].replace("-", "_")] = json.loads(value)
            except ValueError:
                out[a[2:].replace("-", "_")] = value
    return out


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    project = Project(SparkSession.builder.appName("skein").getOrCreate(), args[0])
    if args[1] == "index":
        out = project.index("--force" in args)
    elif args[1] == "embed":
        out = {"embedded": project.embed()}
    elif args[1] == "tools":
        out = project.list_tools()
    elif args[1] == "query":
        words = [a for i, a in enumerate(args[2:], 2) if not a.startswith("--") and not args[i - 1].startswith("--")]
        given = {"limit": 10} | options(args[2:])
        found = project.store.index().search(" ".join(words), given.get("kind"), int(given["limit"]))
        out = [r.asDict() for r in found.select("id", "kind", "name", "qualified_name", "file_path", "start_line", "score").collect()]
    else:
        out = project.call(args[1], options(args[2:]) if not args[2:] or args[2].startswith("--") else json.loads(args[2]))
    print(json.dumps(out, indent=2, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
