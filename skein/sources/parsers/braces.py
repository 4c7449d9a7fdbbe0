"""Symbols and calls of languages with braces, by a lexer: comments and strings are blanked, declarations matched, scopes by braces."""

from __future__ import annotations

import re

LANGUAGES = frozenset("rust type_script java_script tsx jsx go java c cpp c_sharp php kotlin swift".split())
_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`", re.S)
_NAME = r"([A-Za-z_$][\w$]*)"
_COMMON = {"class": "class", "interface": "interface", "enum": "enum", "struct": "struct", "trait": "trait"}
_DECLARATIONS = {
    "rust": [(rf"\bfn\s+{_NAME}", "function"), (rf"\bstruct\s+{_NAME}", "struct"), (rf"\benum\s+{_NAME}", "enum"), (rf"\btrait\s+{_NAME}", "trait")],
    "go": [(rf"\bfunc\s+{_NAME}\s*\(", "function"), (rf"\bfunc\s*\([^)]*\)\s*{_NAME}\s*\(", "method"), (rf"\btype\s+{_NAME}\s+struct\b", "struct"), (rf"\btype\s+{_NAME}\s+interface\b", "interface")],
    "other": [(rf"\b(?:function|fun|func)\s+{_NAME}", "function"), *((rf"\b{word}\s+{_NAME}", kind) for word, kind in _COMMON.items())],
}
_METHOD = re.compile(rf"(?:^|[;{{}}\n])[ \t]*(?:(?:public|private|protected|static|final|async|override|virtual|inline|const|unsigned|export)\s+)*(?:[\w:<>\[\],*&?]+[ \t*&]+)*{_NAME}\s*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)\s*(?::\s*[\w<>\[\]|, ]+)?\s*\{{")
_IMPORTS = re.compile(r"""^[ \t]*(?:import\s+(?P<what>[^;'"\n]*?)\s*(?:from\s*)?['"](?P<from>[^'"\n]+)['"]|use\s+(?P<use>[\w:]+(?:::\{[^}]*\})?)(?:\s+as\s+(?P<alias>\w+))?\s*;|import\s+(?P<java>[\w.]+)\s*;|using\s+(?P<using>[\w.]+)\s*;|\#include\s*[<"](?P<include>[^>"\n]+)[>"])""", re.M | re.X)
_EXPORT = re.compile(rf"^[ \t]*export\s+(?:default\s+)?(?:async\s+)?(?:function\*?|class|interface|enum|const|let|var|type)\s+{_NAME}", re.M)
_REEXPORT = re.compile(rf"""^[ \t]*export\s+(?:type\s+)?(?:\{{(?P<names>[^}}]*)\}}|\*(?:\s+as\s+(?P<all>{_NAME}))?|default\s+(?P<default>{_NAME})\s*;?\s*$)(?:\s*from\s*['"](?P<source>[^'"\n]+)['"])?""", re.M)
_MODULE = re.compile(rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+{_NAME}\s*([;{{])", re.M)
_CALL = re.compile(rf"{_NAME}\s*\(")
_WORDS = frozenset("if for while switch catch return function fn func fun match loop else do new sizeof typeof await class using lock foreach elseif super".split())


def _imports(text: str):
    for m in _IMPORTS.finditer(text):
        if m["from"]:
            names = re.findall(r"([\w$*]+)(?:\s+as\s+([\w$]+))?", m["what"].replace("type ", ""))
            for name, alias in names or [(m["from"], "")]:
                yield m.start(), alias or name, m["from"] + (f"|export={name}" if alias and name != "*" else "")
        elif m["use"]:
            path, _, inner = m["use"].partition("::{")
            for part in inner.rstrip("}").split(",") if inner else [path]:
                name = part.strip().split("::")[-1]
                if name:
                    yield m.start(), m["alias"] or name, path + (f"|export={name}" if m["alias"] else "")
        elif m["include"]:
            yield m.start(), re.sub(r"\.(h|hpp)$", "", m["include"].split("/")[-1]), m["include"]
        else:
            found = m["java"] or m["using"]
            yield m.start(), found.split(".")[-1], found


def _exports(text: str, plain: str):
    """(start, end, name, source) of export lists, re-exports and default exports of names; * for all of a module."""
    for m in _REEXPORT.finditer(text):
        if plain[m.start() : m.end()].strip()[:6] != "export" or m["default"] in ("function", "class", "async", "abstract", "new"):
            continue
        if m["names"] is not None:
            for part in m["names"].split(","):
                words = part.replace("type ", "").split()
                if words:
                    yield m.start(), m.end(), words[-1], m["source"]
        elif m["default"]:
            yield m.start(), m.end(), "default", None
        else:
            yield m.start(), m.end(), m["all"] or "*", m["source"]


def _plain(text: str) -> str:
    """The text with blanks for comments and strings."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def module_names(text: str) -> set[str]:
    """All names of modules in a Rust text, inner ones too."""
    return {m[1] for m in _MODULE.finditer(_plain(text))} if "mod" in text else set()


def parse(language: str, text: str):
    plain = _plain(text)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    pairs, stack = {}, []
    for m in re.finditer(r"[{}]", plain):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()

    def line(at: int) -> int:
        from bisect import bisect_right

        return bisect_right(starts, at)

    found: dict[int, tuple[int, int, str, str, str | None]] = {}  # by place of the name
    for pattern, kind in _DECLARATIONS.get(language, _DECLARATIONS["other"]):
        for m in re.finditer(pattern, plain):
            brace = plain.find("{", m.end())
            stop = plain.find(";", m.end())
            end = pairs.get(brace, m.end()) if brace >= 0 and not 0 <= stop < brace else m.end()
            found[m.start(1)] = (m.start(), end, kind, m[1], None)
    if language not in ("rust", "go"):
        for m in _METHOD.finditer(plain):
            if m[1] not in _WORDS and m.start(1) not in found:
                found[m.start(1)] = (m.start(1), pairs.get(m.end() - 1, m.end()), "method", m[1], None)
    containers = [(s, e, n) for s, e, k, n, _ in found.values() if k not in ("function", "method") and e > s]
    rows = [(s, e, k if k != "method" or any(a < s < b for a, b, _ in containers) or language == "go" else "function", n, sig) for s, e, k, n, sig in found.values()]
    rows += [(at, at, "import", name, signature) for at, name, signature in _imports(text)]
    if language == "rust":  # a module's own symbols are not taken up
        modules = [(m.start(), pairs.get(m.end() - 1, m.end()), m[1]) for m in _MODULE.finditer(plain)]
        rows = [r for r in rows if not any(a < r[0] < b for a, b, _ in modules)]
        rows += [(a, b, "module", name, None) for a, b, name in modules if not any(x < a < y for x, y, _ in modules)]
    if language in ("type_script", "java_script", "tsx", "jsx"):
        rows += [(m.start(), m.end(), "export", m[1], None) for m in _EXPORT.finditer(plain)]
        rows += [(start, end, "export", name, source) for start, end, name, source in _exports(text, plain)]
    rows.sort(key=lambda r: (r[0], r[2], r[3]))
    symbols = []
    for s, e, kind, name, signature in rows:
        scope = tuple(n for a, b, n in sorted(containers) if a < s <= b)
        symbols.append((kind, name, scope, line(s), line(e), s - starts[line(s) - 1], signature))
    callables = [(s, e, i) for i, (s, e, k, *_) in enumerate(rows) if k in ("function", "method") and e > s]
    calls = []
    for m in _CALL.finditer(plain):
        inside = [(e - s, i) for s, e, i in callables if s < m.start() < e]
        if inside and m[1] not in _WORDS and m.start(1) not in found:
            calls.append((min(inside)[1], m[1], line(m.start()), m.start() - starts[line(m.start()) - 1]))
    return symbols, calls
