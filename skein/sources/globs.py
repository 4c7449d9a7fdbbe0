"""Globs as regular expressions for rlike, and the include and exclude predicate of a scan."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INCLUDE = [f"**/*.{e}" for e in "ts tsx js jsx py go rs java c h cpp hpp cc cxx cs php rb liquid razor".split()]
_DIRS = (
    ".git node_modules vendor Pods dist build out bin obj target .next .nuxt .svelte-kit .output .turbo .cache .parcel-cache .vite .astro .docusaurus .gatsby .webpack .nx .yarn/cache .pnpm-store "
    "storybook-static .expo web-build ios/Pods ios/build android/build android/.gradle __pycache__ .venv venv *_venv *-venv env .env .pytest_cache .mypy_cache .ruff_cache .tox .nox *.egg-info .eggs "
    "go/pkg/mod target/debug target/release .gradle .m2 generated-sources .kotlin .vs .nuget artifacts publish cmake-build-* CMakeFiles bazel-* vcpkg_installed .conan Debug Release x64 release *.app "
    "DerivedData .build .swiftpm xcuserdata Carthage/Build SourcePackages .composer storage/framework bootstrap/cache .bundle tmp/cache public/assets public/packs .yardoc coverage htmlcov .nyc_output "
    "test-results .coverage .idea logs tmp temp _build docs/_build site"
).split()
EXCLUDE = [f"**/{d}/**" for d in _DIRS] + ["**/*.min.js", "**/*.bundle.js", "**/*.asar"]


def to_regex(glob: str) -> str:
    """The regular expression of a whole path. A star crosses slashes; **/ also stands for nothing, /** for what follows a slash."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out.append("/.*")
            i += 3
        elif glob[i] == "*":
            while glob[i : i + 1] == "*":
                i += 1
            out.append(".*")
        elif glob[i] == "?":
            out.append(".")
            i += 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out.append("[" + ("^" + re.escape(body[1:]) if body[0] in "!^" else re.escape(body)).replace(r"\-", "-") + "]")
            i = end + 1
        elif glob[i] == "{" and (end := glob.find("}", i)) > 0:
            out.append("(?:" + "|".join(to_regex(x)[1:-1] for x in glob[i + 1 : end].split(",")) + ")")
            i = end + 1
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return "^" + "".join(out) + "$"


def matches(path: Column, glob: str) -> Column:
    return path.rlike(to_regex(glob))


def any_of(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{to_regex(g)})" for g in globs)) if globs else F.lit(False)


def included(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Any exclude match drops a path; else any include match keeps it; else it is dropped."""
    return ~any_of(path, EXCLUDE if exclude is None else exclude) & any_of(path, INCLUDE if include is None else include)


def found_by_name(name: Column, pattern: str) -> Column:
    """A file finder's match on base names: a glob of *, ? and [abc] if the pattern has such signs, else a substring."""
    if not re.search(r"[*?\[]", pattern):
        return name.contains(pattern)
    return reduce(lambda a, b: a & b, [name.rlike(to_regex(pattern))])


def entries(paths: DataFrame, folder: str) -> DataFrame:
    """entry: what lies right under a folder among paths, folders with a slash behind their names."""
    rest = F.substring("path", len(folder) + 2, 1 << 20) if folder else F.col("path")
    inside = paths.filter(F.startswith("path", F.lit(f"{folder}/"))) if folder else paths
    parts = F.split(rest, "/")
    return inside.select(F.concat(parts[0], F.when(F.size(parts) > 1, "/").otherwise("")).alias("entry")).distinct()
