"""Schemas of the graph tables and the enums that occur in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = (
    "id string, kind string, name string, qualified_name string, file_path string, language string, start_line long, end_line long, start_column long, end_column long, docstring string, "
    "signature string, visibility string, is_exported boolean, is_async boolean, is_static boolean, is_abstract boolean, decorators array<string>, type_parameters array<string>, updated_at long"
)
EDGES = "source string, target string, kind string, metadata map<string,string>, line long, col long"
FILES = "path string, content_hash string, language string, size long, modified_at long, indexed_at long, node_count long, errors array<struct<message:string,line:long,column:long,severity:string,code:string>>"
REFS = "id long, from_node_id string, reference_name string, reference_kind string, line long, col long, candidates array<string>"
VECTORS = "node_id string, embedding array<float>, model string, created_at long"

NODE_KINDS = "file module class struct interface trait protocol function method property field variable constant enum enum_member type_alias namespace parameter import export route component".split()
EDGE_KINDS = "contains calls imports exports extends implements references type_of returns instantiates overrides decorates".split()
CALLABLE = ("function", "method")
AUDITED = ("function", "method", "struct", "class", "interface", "trait", "enum", "type_alias", "constant")


def node_id(path: Column, kind: Column, qualified: Column, line: Column, column: Column) -> Column:
    """SHA-256 of the parts with bars between them; the kind without underscores."""
    return F.sha2(F.concat_ws("|", path, F.replace(kind, F.lit("_"), F.lit("")), qualified, line.cast("string"), column.cast("string")).cast("binary"), 256)
