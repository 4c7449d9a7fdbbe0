"""Parsers: a file's text to symbols and call sites. Python uses its own syntax tree, brace languages a lexer, languages of lines their
beginnings; others give the file only."""

from __future__ import annotations

from skein.sources.parsers.braces import LANGUAGES as BRACE_LANGUAGES
from skein.sources.parsers.braces import parse as parse_braces
from skein.sources.parsers.lines import LANGUAGES as LINE_LANGUAGES
from skein.sources.parsers.lines import parse as parse_lines
from skein.sources.parsers.python_ast import parse as parse_python


def parse(language: str, text: str):
    """(symbols, calls): symbols (kind, name, scope, start_line, end_line, column, signature), calls (symbol's index, name, line, column)."""
    if language == "python":
        return parse_python(text)
    if language in BRACE_LANGUAGES:
        return parse_braces(language, text)
    if language in LINE_LANGUAGES:
        return parse_lines(language, text)
    return [], []
