"""Scalar functions of names, paths and texts as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {
    "type_script": "ts", "tsx": "tsx", "java_script": "js", "jsx": "jsx", "python": "py", "go": "go", "rust": "rs", "java": "java", "c": "c h", "cpp": "cpp cc cxx hpp", "c_sharp": "cs",
    "php": "php", "ruby": "rb", "swift": "swift", "kotlin": "kt", "liquid": "liquid", "blazor": "razor cshtml", "bash": "sh bash", "dart": "dart", "elixir": "ex exs", "elm": "elm", "erlang": "erl hrl",
    "fortran": "f f90 f95", "groovy": "groovy gradle", "haskell": "hs", "julia": "jl", "lua": "lua", "markdown": "md markdown", "matlab": "m", "nix": "nix", "perl": "pl pm", "powershell": "ps1",
    "r": "r", "scala": "scala sc", "toml": "toml", "yaml": "yml yaml", "zig": "zig",
}
BY_EXTENSION = {e: name for name, all_of in LANGUAGES.items() for e in all_of.split()}
SUPPORTED = "type_script java_script tsx jsx python go rust java c cpp c_sharp php ruby swift kotlin liquid markdown blazor unknown".split()
NOT_SYMBOLS = "true false null nil None Some Ok Err self super crate pub fn let mut use mod struct enum impl trait type async await return if else match for while loop break continue".split()


def _folds() -> tuple[str, str]:
    """Precomposed Latin letters with marks, and the letters without them."""
    pairs = []
    for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(i))
        if len(base) > 1 and base[0].isascii() and all(unicodedata.combining(c) for c in base[1:]):
            pairs.append((chr(i), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folds()


def folded(text: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


def tokens(text: Column) -> Column:
    """Words of letters, digits and private-use characters, folded; none for null."""
    return F.coalesce(F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1)), F.array().cast("array<string>"))


def parent(path: Column) -> Column:
    """The directory of a path; empty for a file at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def language(path: Column) -> Column:
    """The language of a path by its extension, whatever its case; unknown for others."""
    found = F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in BY_EXTENSION.items() for x in pair])
    return F.coalesce(F.try_element_at(table, found), F.lit("unknown"))


def is_supported(name: Column) -> Column:
    return name.isin(SUPPORTED)


def looks_like_symbol(text: Column) -> Column:
    """Two bytes or more, no space, not only digits, dots and underscores, beginning with a letter or underscore, and no keyword."""
    return (F.octet_length(text) >= 2) & ~text.contains(" ") & ~text.rlike(r"^[0-9._]+$") & text.rlike(r"^[\p{L}_]") & ~text.isin(NOT_SYMBOLS)


def last_segment(text: Column) -> Column:
    """What follows the last ::, then the last dot, then the last arrow."""
    return F.substring_index(F.substring_index(F.substring_index(text, "::", -1), ".", -1), "->", -1)


def lines(text: Column) -> Column:
    """Lines without their ends; a line end at the very end begins no line."""
    whole = F.regexp_replace(text, "\n$", "")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.split(whole, "\n"), lambda x: F.regexp_replace(x, "\r$", "")))


def line_range(text: Column, start: int, limit: int) -> Column:
    """struct(content, end_line, total_lines, truncated) of lines start to start + limit - 1, counted from 1."""
    start = max(1, start)
    all_lines = lines(text)
    part = F.slice(all_lines, start, limit)
    end = F.least(F.lit(start - 1 + limit), F.size(all_lines))
    return F.struct(F.array_join(part, "\n").alias("content"), end.cast("long").alias("end_line"), F.size(all_lines).cast("long").alias("total_lines"), (F.size(all_lines) > start - 1 + limit).alias("truncated"))


def embed_text(name: Column, qualified: Column, docstring: Column, signature: Column) -> Column:
    return F.concat_ws(" | ", name, F.when(qualified != name, qualified), docstring, signature)
