"""Reference resolution: unresolved references are linked to nodes in one set-based, tier-ranked job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import base_name, parent, stem
from skein.schema import CALLABLE
from skein.scratch import saved

_EXTENSIONS = r"(\.ts)*(\.tsx)*(\.rs)*$"


def _clean(hint: Column) -> Column:
    """What a path must end with to be the module that an import names."""
    return F.regexp_replace(F.substring_index(hint, "::", -1), _EXTENSIONS, "")


def hint_matches(path: Column, hint: Column) -> Column:
    """Whether a file may be the module that an import names: by the end of its path, its stem, or the folder of a mod.rs."""
    clean = _clean(hint)
    return F.endswith(F.regexp_replace(path, _EXTENSIONS, ""), clean) | (stem(path) == clean) | (F.endswith(path, F.lit("/mod.rs")) & (base_name(parent(path)) == clean))


_KEY = ["reference_kind", "reference_name", "from_path", "own"]


def hints(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """keys with module and export: the first import of the reference's name in the referring file; the module is its signature's or its name."""
    imports = nodes.filter("kind = 'import'").withColumn("nth", F.row_number().over(Window.partitionBy("file_path", "name").orderBy("start_line", "id"))).filter("nth = 1")
    signature = F.split("signature", r"\|export=")
    found = imports.select(
        F.col("file_path").alias("from_path"), F.col("name").alias("reference_name"), F.coalesce(signature[0], F.col("name")).alias("module"), F.coalesce(F.try_element_at(signature, F.lit(2)), F.col("name")).alias("export")
    )
    return keys.join(found, ["from_path", "reference_name"], "left")


def own_candidates(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """own (the reference), node, to_path: the callables among the candidate ids that calls bring with them."""
    spread = refs.filter("reference_kind = 'calls' and size(candidates) > 0").select(F.col("id").alias("own"), F.explode("candidates").alias("node"))
    return spread.join(nodes.filter(F.col("kind").isin(*CALLABLE)).select(F.col("id").alias("node"), F.col("file_path").alias("to_path")), "node").distinct()


_COUNTS = ("n_any", "any", "n_callable", "callable")


def _counted(rows: DataFrame, *by: Column) -> DataFrame:
    """Per key, how many nodes and callables there are, and the smallest id of each."""
    return rows.groupBy(*by).agg(F.sum("n_any").alias("n_any"), F.min("any").alias("any"), F.sum("n_callable").alias("n_callable"), F.min("callable").alias("callable"))


def _by_hint(keys: DataFrame, counted: DataFrame) -> DataFrame:
    """keys (of which each has a module) with the counts of the files of their name that the module may be.

    A file of a name is listed under its stem, its folder if it is a mod.rs, and the ends of its path that are as long as some module
    of that name; so modules meet files by equality, and files that look alike are counted before they meet.
    """
    wanted = keys.withColumn("clean", _clean(F.col("module")))
    lengths = wanted.groupBy("reference_name").agg(F.collect_set(F.length("clean")).alias("lengths"))  # no longer than paths are
    bare = F.regexp_replace("to_path", _EXTENSIONS, "")
    ends = F.transform(F.filter("lengths", lambda n: n <= F.length(bare)), lambda n: F.right(bare, n))
    others = F.array(stem(F.col("to_path")), F.when(F.endswith("to_path", F.lit("/mod.rs")), base_name(parent(F.col("to_path")))))
    listed = counted.join(lengths, "reference_name").withColumn("clean", F.explode(F.array_distinct(F.array_compact(F.concat(ends, others)))))
    return wanted.join(_counted(listed, F.col("reference_name"), F.col("clean")), ["reference_name", "clean"])


def resolve(refs: DataFrame, nodes: DataFrame, limit: int | None = None, files: DataFrame | None = None) -> DataFrame:
    """ref, source, target, kind, line, col, tier of the references that have exactly one best candidate.

    Calls take their own candidate ids if any of these is a callable, else callables by name; other kinds take any node by name.
    Tiers: exports of the hinted module (which replace all else), files that match the import hint, same file, same folder, and
    for other kinds than calls any. Only the best tier that has candidates counts; one candidate there links, more do not. With files
    (path), references without any candidate try those that a framework's rules name (tier 5). limit takes the references with the
    smallest ids.

    References of one kind, name and file have the same outcome, and so are ranked once. Each tier is an equi-join with counts by name
    and file, folder or module, or by name alone: nothing pairs the files that use a name with those that define it. References with
    their files, their keys, and the counts of the names that these use are written down, since tiers read them again.
    """
    if limit is not None:
        refs = refs.orderBy("id").limit(limit)
    paths = nodes.select(F.col("id").alias("from_node_id"), F.col("file_path").alias("from_path"))
    given = own_candidates(refs, nodes)
    marked = refs.join(given.select(F.col("own").alias("id"), F.lit(True).alias("given")).distinct(), "id", "left")
    placed = saved(marked.join(paths, "from_node_id").withColumn("own", F.when(F.col("given"), F.col("id")).otherwise(F.lit(-1))).drop("given", "candidates"))
    keys = saved(hints(placed.select(_KEY).distinct(), nodes))
    exports = nodes.filter("kind = 'export'").groupBy(F.col("signature").alias("module"), F.col("name").alias("export")).agg(F.count("*").alias("n"), F.min("id").alias("node"))
    over = keys.join(exports, ["module", "export"]).select(*_KEY, F.lit(0).alias("tier"), "n", "node")
    callable = F.col("kind").isin(*CALLABLE)
    names = keys.select(F.explode(F.array("reference_name", F.substring_index("reference_name", "::", -1))).alias("name")).distinct()  # the fallback seeks last segments
    counted = saved(nodes.join(names, "name", "left_semi").groupBy(F.col("name").alias("reference_name"), F.col("file_path").alias("to_path")).agg(
        F.count("*").alias("n_any"), F.min("id").alias("any"), F.sum(callable.cast("long")).alias("n_callable"), F.min(F.when(callable, F.col("id"))).alias("callable")
    ))
    calls = F.col("reference_kind") == "calls"
    plain = keys.filter("own = -1")
    folder = parent(F.col("to_path")).alias("folder")

    def tier(rows: DataFrame, number: int) -> DataFrame:
        n, node = F.when(calls, F.col("n_callable")).otherwise(F.col("n_any")), F.when(calls, F.col("callable")).otherwise(F.col("any"))
        return rows.select(*_KEY, F.lit(number).alias("tier"), n.alias("n"), node.alias("node")).filter("n > 0")

    found = over.unionByName(tier(_by_hint(plain.filter("module is not null"), counted), 1))
    found = found.unionByName(tier(plain.join(counted.withColumnRenamed("to_path", "from_path"), ["reference_name", "from_path"]), 2))
    found = found.unionByName(tier(plain.withColumn("folder", parent(F.col("from_path"))).join(_counted(counted, F.col("reference_name"), folder), ["reference_name", "folder"]), 3))
    found = found.unionByName(tier(plain.filter(~calls).join(_counted(counted, F.col("reference_name")), "reference_name"), 4))
    own = keys.filter("own <> -1").join(given, "own")
    near = F.when(hint_matches(F.col("to_path"), F.col("module")), 1).when(F.col("to_path") == F.col("from_path"), 2).when(parent(F.col("to_path")) == parent(F.col("from_path")), 3)
    found = found.unionByName(own.withColumn("tier", near).filter("tier is not null").groupBy(*_KEY, "tier").agg(F.count("*").alias("n"), F.min("node").alias("node")))
    best = found.groupBy(*_KEY).agg(F.min(F.struct("tier", "n", "node")).alias("b")).select(*_KEY, "b.*")
    if files is not None:
        best = saved(best)
        best = best.unionByName(_fallback(keys.join(best, _KEY, "left_anti"), counted, files))
    single = best.filter("n = 1").select(*_KEY, F.col("node").alias("target"), "tier")
    return placed.join(single, _KEY).select(F.col("id").alias("ref"), F.col("from_node_id").alias("source"), "target", F.col("reference_kind").alias("kind"), "line", "col", "tier")


def _fallback(keys: DataFrame, counted: DataFrame, files: DataFrame) -> DataFrame:
    """Of keys without candidates, the nodes of their name, or of its last segment, in the files that a framework's rules name."""
    names = keys.select(F.col("reference_name").alias("name"), "from_path").distinct()
    named = framework_hints(names, files).select(F.col("name").alias("full"), "from_path", F.col("path").alias("to_path"))
    sought = named.withColumn("reference_name", F.explode(F.array_distinct(F.array(F.substring_index("full", "::", -1), F.col("full")))))
    held = sought.join(counted, ["reference_name", "to_path"]).groupBy("full", "from_path").agg(F.sum("n_any").alias("n"), F.min("any").alias("node"))
    return keys.join(held.withColumnRenamed("full", "reference_name"), ["reference_name", "from_path"]).select(*_KEY, F.lit(5).alias("tier"), "n", "node")


# Hints of frameworks: possible files of a name, of which those that exist count.
_FACADES = "App Artisan Auth Blade Broadcast Bus Cache Config Cookie Crypt DB Event File Gate Hash Http Lang Log Mail Notification Queue Route Session Storage".split()
_REACT_DIRS = ("components", "src/components", "app/components", "src/app/components")
_REACT_ENDS = (".tsx", ".ts", ".jsx", ".js", "/index.tsx", "/index.ts", "/index.jsx", "/index.js")


def framework_paths(name: Column, from_path: Column) -> dict[str, Column]:
    """For each framework, in the order in which they are tried, the paths that a name may stand for."""
    snake = F.replace(name, F.lit("::"), F.lit("/"))
    tail = lambda prefix: F.regexp_replace(snake, f"^{prefix}/", "")
    holder = F.regexp_replace(tail("crate"), "/[^/]*$", "")
    here = parent(from_path)
    both = lambda base: [F.concat(base, F.lit(".rs")), F.concat(base, F.lit("/mod.rs"))]
    under = lambda d, x: F.concat(F.when(d == "", F.lit("")).otherwise(F.concat(d, F.lit("/"))), x)
    rust = (
        F.when(name.startswith("crate::"), F.array(*both(F.concat(F.lit("src/"), tail("crate"))), *both(F.concat(F.lit("src/"), holder))))
        .when(name.startswith("super::"), F.array(*both(under(parent(here), tail("super")))))
        .when(name.startswith("self::"), F.array(*both(under(here, tail("self")))))
        .when(name.rlike("^[a-z][a-z0-9_]*$"), F.array(*both(under(here, name))))
    )
    ends = lambda base: [F.concat(base, F.lit(e)) for e in _REACT_ENDS]
    react = (
        F.when(name.startswith("./"), F.array(*ends(under(here, F.substring(name, 3, 1000)))))
        .when(name.startswith("../"), F.array(*ends(under(parent(here), F.substring(name, 4, 1000)))))
        .when(name.rlike("^[@~]/"), F.array(*[x for root in ("src/", "app/", "") for x in ends(F.concat(F.lit(root), F.substring(name, 3, 1000)))]))
        .when(name.rlike("^[A-Z][A-Za-z0-9]*$"), F.array(*[x for d in _REACT_DIRS for x in ends(F.concat(F.lit(f"{d}/"), name))]))
    )
    dotted = F.replace(name, F.lit("."), F.lit("/"))
    blazor = (
        F.when(name.rlike(r"^[A-Z]\w*(\.\w+)+$"), F.array(*[F.concat(F.lit(b), dotted, F.lit(".cs")) for b in ("", "src/", "Services/", "Models/")]))
        .when(name.rlike("^[A-Z][A-Za-z0-9]*$"), F.array(F.concat(F.lit("**/"), name, F.lit(".razor")), F.concat(F.lit("**/"), name, F.lit(".cs"))))
    )
    psr = F.replace(F.when(F.startswith(name, F.lit("App\\")), F.concat(F.lit("app"), F.substring(name, 4, 1000))).otherwise(name), F.lit("\\"), F.lit("/"))
    laravel = (
        F.when(name.contains("\\"), F.array(F.concat(psr, F.lit(".php")), F.concat(F.lit("src/"), psr, F.lit(".php"))))
        .when(name.isin(_FACADES), F.array(F.concat(F.lit("app/Facades/"), name, F.lit(".php"))))
        .when(name.rlike(r"^[a-z]\w*(\.\w+)+$"), F.array(F.concat(F.lit("resources/views/"), dotted, F.lit(".blade.php"))))
    )
    return {"rust": rust, "react": react, "blazor": blazor, "laravel": laravel}


def framework_hints(names: DataFrame, files: DataFrame, frameworks: tuple[str, ...] = ("rust", "react", "blazor", "laravel")) -> DataFrame:
    """names(name, from_path) -> name, from_path, framework, path of the first framework with existing files, and those files."""
    tried = framework_paths(F.col("name"), F.col("from_path"))
    spread = [names.select("name", "from_path", F.lit(i).alias("turn"), F.lit(f).alias("framework"), F.explode(tried[f]).alias("guess")) for i, f in enumerate(frameworks)]
    every = spread[0]
    for more in spread[1:]:
        every = every.unionByName(more)
    exact = every.join(files.select(F.col("path").alias("guess")), "guess").withColumnRenamed("guess", "path")
    skipped = F.col("path").rlike("(^|/)(bin|obj|node_modules|[.]git|target)/")
    anywhere = every.filter(F.col("guess").startswith("**/")).withColumn("base", F.substring("guess", 4, 1000)).join(files.select("path", base_name(F.col("path")).alias("base")), "base").filter(~skipped & (F.size(F.split("path", "/")) <= 9)).drop("base", "guess")
    found = exact.unionByName(anywhere.select(exact.columns))
    first = found.groupBy("name", "from_path").agg(F.min("turn").alias("turn"))
    return found.join(first, ["name", "from_path", "turn"]).select("name", "from_path", "framework", "path").distinct()
