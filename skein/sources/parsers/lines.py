"""Symbols and calls of languages whose declarations begin a line: each declaration reaches to the next of the same or less indent."""

from __future__ import annotations

import re

_N = r"([A-Za-z_][\w]*[?!]?)"
#: For each language, its comment sign and patterns of what a line begins with: kind, pattern of the name.
_LANGUAGES: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "ruby": ("#", [("method", rf"def\s+(?:self\.)?{_N}"), ("class", r"class\s+([A-Z][\w:]*)"), ("module", r"module\s+([A-Z][\w:]*)"), ("import", r"require(?:_relative)?\s*\(?['\"]([^'\"]+)")]),
    "bash": ("#", [("function", rf"function\s+{_N}"), ("function", rf"{_N}\s*\(\)\s*\{{"), ("import", r"(?:source|\.)\s+([\w./-]+)")]),
    "lua": ("--", [("function", r"(?:local\s+)?function\s+([\w.:]+)"), ("import", r"(?:local\s+\w+\s*=\s*)?require\s*\(?['\"]([^'\"]+)")]),
    "elixir": ("#", [("module", r"defmodule\s+([\w.]+)"), ("function", rf"defp?\s+{_N}"), ("import", r"(?:import|alias|use|require)\s+([\w.]+)")]),
    "erlang": ("%", [("module", r"-module\(([a-z]\w*)"), ("function", r"([a-z]\w*)\([^)]*\)\s*(?:when[^-]*)?->"), ("import", r"-import\(([a-z]\w*)")]),
    "haskell": ("--", [("module", r"module\s+([\w.]+)"), ("class", r"class\s+(?:.*=>\s*)?([A-Z]\w*)"), ("struct", r"(?:data|newtype)\s+([A-Z]\w*)"), ("function", r"([a-z]\w*)\s*::"), ("import", r"import\s+(?:qualified\s+)?([\w.]+)")]),
    "elm": ("--", [("module", r"module\s+([\w.]+)"), ("type_alias", r"type\s+alias\s+(\w+)"), ("enum", r"type\s+([A-Z]\w*)"), ("function", r"([a-z]\w*)\s*:"), ("import", r"import\s+([\w.]+)")]),
    "scala": ("//", [("function", rf"(?:(?:private|protected|override|final|implicit|inline)\s+)*def\s+{_N}"), ("class", r"(?:(?:abstract|case|final|sealed)\s+)*class\s+(\w+)"), ("trait", r"(?:sealed\s+)?trait\s+(\w+)"), ("module", r"(?:case\s+)?object\s+(\w+)"), ("import", r"import\s+([\w.]+)")]),
    "julia": ("#", [("function", rf"function\s+{_N}"), ("struct", r"(?:mutable\s+)?struct\s+(\w+)"), ("module", r"module\s+(\w+)"), ("import", r"(?:using|import)\s+([\w.]+)")]),
    "perl": ("#", [("function", r"sub\s+(\w+)"), ("module", r"package\s+([\w:]+)"), ("import", r"(?:use|require)\s+([A-Z][\w:]*)")]),
    "r": ("#", [("function", r"([\w.]+)\s*(?:<-|=)\s*function\b"), ("import", r"(?:library|require)\(([\w.]+)")]),
    "powershell": ("#", [("function", r"function\s+([\w-]+)"), ("class", r"class\s+(\w+)"), ("import", r"Import-Module\s+([\w.-]+)")]),
    "matlab": ("%", [("function", r"function\s+(?:[^=(]*=\s*)?(\w+)"), ("class", r"classdef\s+(\w+)")]),
    "fortran": ("!", [("function", r"(?:[\w() ]*\s)?(?:function|subroutine)\s+(\w+)"), ("module", r"(?:module|program)\s+(\w+)"), ("import", r"use\s+(\w+)")]),
    "groovy": ("//", [("class", r"(?:abstract\s+)?class\s+(\w+)"), ("function", r"(?:def|void|String|int)\s+(\w+)\s*\("), ("import", r"import\s+([\w.]+)")]),
    "dart": ("//", [("class", r"(?:abstract\s+)?class\s+(\w+)"), ("enum", r"enum\s+(\w+)"), ("function", r"(?:[\w<>?]+\s+)(\w+)\s*\([^;]*\)\s*(?:async\s*)?\{"), ("import", r"import\s+['\"]([^'\"]+)")]),
    "zig": ("//", [("function", r"(?:pub\s+)?(?:export\s+)?fn\s+(\w+)"), ("struct", r"(?:pub\s+)?const\s+(\w+)\s*=\s*(?:packed\s+|extern\s+)?struct"), ("enum", r"(?:pub\s+)?const\s+(\w+)\s*=\s*enum"), ("import", r"const\s+\w+\s*=\s*@import\(['\"]([^'\"]+)")]),
    "nix": ("#", [("function", r"([\w-]+)\s*=\s*(?:\{[^}]*\}|\w+)\s*:"), ("import", r".*\bimport\s+([\w./<>-]+)")]),
    "toml": ("#", [("module", r"\[+([\w.\"-]+)\]+")]),
    "yaml": ("#", [("property", r"([\w-]+):(?:\s|$)")]),
}
LANGUAGES = frozenset(_LANGUAGES)
_COMPILED = {name: (sign, [(kind, re.compile(p)) for kind, p in patterns]) for name, (sign, patterns) in _LANGUAGES.items()}
_CONTAINERS = frozenset("class module struct trait enum".split())
_CALL = re.compile(r"([A-Za-z_][\w]*[?!]?)\s*\(")
_WORDS = frozenset("if elsif elseif while for until unless case when switch return function def fn sub and or not catch".split())


def parse(language: str, text: str):
    sign, patterns = _COMPILED[language]
    rows: list[list] = []  # kind, name, line, column, end
    open_rows: list[int] = []
    lines = text.split("\n")
    for n, line in enumerate(lines, 1):
        body = line.strip()
        if not body or body.startswith(sign):
            continue
        indent = len(line) - len(line.lstrip())
        for kind, pattern in patterns:
            if m := pattern.match(body):
                open_rows = [i for i in open_rows if rows[i][3] < indent]
                rows.append([kind, m[1], n, indent, n, tuple(rows[i][1] for i in open_rows if rows[i][0] in _CONTAINERS), list(open_rows)])
                open_rows.append(len(rows) - 1)
                break
        else:
            if rows and not body.startswith(("end", "}", ")", "fi", "done")):
                open_rows = [i for i in open_rows if rows[i][3] < indent] or ([i for i in open_rows if rows[i][3] <= indent] if language in ("toml", "haskell", "elm", "erlang") else [])
        for i in open_rows:
            rows[i][4] = n
    symbols, calls = [], []
    for kind, name, start, column, end, scope, _ in rows:
        if kind == "import":
            symbols.append(("import", re.split(r"[/.:]+", name.removesuffix(".lua").removesuffix(".rb"))[-1] or name, scope, start, start, column, name))
        else:
            symbols.append((kind, re.split(r"[.:]", name)[-1] if kind == "function" else name, scope, start, end, column, None))
    owner = [-1] * (len(lines) + 2)  # of each line, the innermost callable
    for i, r in enumerate(rows):
        if r[0] in ("function", "method"):
            owner[r[2] : r[4] + 1] = [i] * (r[4] + 1 - r[2])
    for n, line in enumerate(lines, 1):
        i = owner[n]
        if i >= 0 and not line.strip().startswith(sign):
            calls += [(i, m[1], n, m.start()) for m in _CALL.finditer(line) if m[1] not in _WORDS and not (rows[i][2] == n and m[1] == symbols[i][1])]
    return symbols, calls
