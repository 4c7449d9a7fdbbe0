"""Symbols and calls of Python files by the ast module."""

from __future__ import annotations

import ast


def parse(text: str):
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    symbols, calls = [], []

    def add(kind, name, scope, node, signature=None):
        symbols.append((kind, name, tuple(scope), node.lineno, node.end_lineno or node.lineno, node.col_offset, signature))
        return len(symbols) - 1

    def walk(node, scope, caller):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                walk(child, scope, add("function", child.name, scope, child))
            elif isinstance(child, ast.ClassDef):
                add("class", child.name, scope, child)
                walk(child, [*scope, child.name], caller)
            elif isinstance(child, ast.Import):
                for a in child.names:
                    add("import", (a.asname or a.name).split(".")[-1], scope, child, a.name)
            elif isinstance(child, ast.ImportFrom):
                for a in child.names:
                    module = "." * child.level + (child.module or "")
                    add("import", a.asname or a.name, scope, child, module if a.asname is None else f"{module}|export={a.name}")
            elif isinstance(child, (ast.Assign, ast.AnnAssign)) and caller is None:
                for target in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(target, ast.Name):
                        add("variable", target.id, scope, child)
                walk(child, scope, caller)
            else:
                if isinstance(child, ast.Call) and caller is not None:
                    f = child.func
                    name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                    if name:
                        calls.append((caller, name, child.lineno, child.col_offset))
                walk(child, scope, caller)

    walk(tree, [], None)
    return symbols, calls
