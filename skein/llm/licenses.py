"""Licence scans: lines, runs of lines and whole texts compared to licence templates by Dice's coefficient over word bigrams.

Text is normalised to lower-case ASCII words. A unit of n distinct bigrams reaches a coefficient of t with a template of m only
if n lies between m t / (2 - t) and m (2 - t) / t, and only if it holds one of the template's m - ceil(m t / (2 - t)) + 1 rarest
bigrams. Texts without a word that all such units hold one of are left out first. Size bounds and these probes leave few candidates,
whose bigrams are then counted exactly. Runs of lines, or of words, are
built only around a template's probes, where enough of its bigrams are near; repeated bigrams count in a run's length, which is
at most m (2 - t) / t. All of it is DataFrame operations; the templates are constants of this module.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from math import ceil, floor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import column

THRESHOLD = Fraction(4, 5)
#: (licence, lines of a template). Lines are joined by spaces.
TEMPLATES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("Licensed under the Apache License, Version 2.0",)),
    ("Apache-2.0", ("SPDX-License-Identifier: Apache-2.0",)),
    ("MIT", ("Released under the MIT License",)),
    ("MIT", ("Licensed under the MIT License",)),
    ("MIT", ("SPDX-License-Identifier: MIT",)),
    ("GPL-3.0", ("This work is licensed under the", "GNU General Public License, version 3")),
    ("GPL-2.0", ("This work is licensed under the", "GNU General Public License, version 2")),
    ("LGPL-3.0", ("This work is licensed under the", "GNU Lesser General Public License, version 3")),
    ("AGPL-3.0", ("This work is licensed under the", "GNU Affero General Public License, version 3")),
    ("CC-BY-NC-4.0", ("Licensed under CC BY-NC 4.0",)),
    ("CC-BY-4.0", ("Licensed under CC BY 4.0",)),
    ("CC-BY-SA-4.0", ("Licensed under CC BY-SA 4.0",)),
    ("CC-BY-4.0", ("This work is licensed under a Creative", "Commons Attribution 4.0 International License")),
    ("CC-BY-SA-4.0", ("This work is licensed under a Creative", "Commons Attribution-ShareAlike 4.0 International License")),
    ("BSD-3-Clause", ("Released under the BSD 3-Clause License",)),
    ("BSD-2-Clause", ("Released under the BSD 2-Clause License",)),
    ("MPL-2.0", ("This Source Code Form is subject to", "the terms of the Mozilla Public License, v. 2.0")),
    ("ISC", ("Permission to use, copy, modify, and/or", "distribute this software for any purpose", "with or without fee is hereby granted,", "provided that the above copyright notice", "and this permission notice appear in all copies")),
    ("MIT", ("Permission is hereby granted, free of charge,", "to any person obtaining a copy", "of this software and associated documentation files", '(the "Software"), to deal in the', "Software without restriction, including without limitation", "the rights to use, copy, modify,", "merge, publish, distribute, sublicense, and/or sell", "copies of the Software, and to permit", "persons to whom the Software is", "furnished to do so, subject to", "the following conditions")),
    ("Unlicense", ("This is free and unencumbered software", "released into the public domain")),
)
_COMMON = frozenset("the of to a and or in is this for any it be with by that all on as are".split())
#: Bigrams of a text that are looked through at once for runs, beside those around them.
_BLOCK = 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_bigrams() -> list[tuple[int, str, list[str]]]:
    """Number, licence and distinct bigrams, the most telling first, of each template."""
    import re

    out = []
    for i, (name, lines) in enumerate(TEMPLATES):
        words = re.findall("[a-z0-9]+", " ".join(lines).lower())
        pairs = sorted(set(zip(words, words[1:])), key=lambda p: (sum(w in _COMMON for w in p), -sum(map(len, p)), p))
        out.append((i, name, [" ".join(p) for p in pairs]))
    return out


def bounds(m: int, t: Fraction = THRESHOLD) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach t with a template of m."""
    return ceil(m * t / (2 - t)), floor(m * (2 - t) / t)


def probes(pairs: list[str], t: Fraction = THRESHOLD) -> list[str]:
    return pairs[: len(pairs) - ceil(len(pairs) * t / (2 - t)) + 1]


def telling(t: Fraction = THRESHOLD) -> list[str]:
    """Words of which every text with a unit that reaches a template holds one.

    Such a unit holds low of the template's m bigrams, so one of any m - low + 1. Words are added until each template has so many
    bigrams with one of them.
    """
    known = [(pairs, len(pairs) - bounds(len(pairs), t)[0] + 1) for _, _, pairs in template_bigrams()]
    every = sorted({w for pairs, _ in known for p in pairs for w in p.split()} - _COMMON - {"under"}, key=lambda w: (-len(w), w))
    chosen: list[str] = []
    holds = lambda p, w: any(w in x for x in p.split())
    hit = lambda p: any(holds(p, w) for w in chosen)
    while left := [(pairs, n) for pairs, need in known if (n := need - sum(map(hit, pairs))) > 0]:
        gain = lambda w: sum(min(n, sum(not hit(p) and holds(p, w) for p in pairs)) for pairs, n in left)
        chosen.append(max(every, key=lambda w: gain(w) * min(len(w), 6)))
    return [w for w in chosen if not any(w != x and x in w for x in chosen)]


def _may_hold(rows: DataFrame) -> DataFrame:
    """Rows whose text holds a telling word: lower case adds letters, but takes away none of a to z and no digit."""
    words = telling()
    return rows.filter(F.exists(F.array(F.lower("text")), lambda t: reduce(lambda a, b: a | b, [t.contains(w) for w in words])))


def _plain(text) -> F.Column:
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def _bigrams(words: str) -> F.Column:
    n = F.size(words) - 1
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def _with_bigrams(units: DataFrame) -> DataFrame:
    """Units with pairs, their distinct bigrams, in place of their text; none if it has fewer than two words.

    Each step is the row of a one-element array, so that it is computed once, however often later filters name it.
    """
    worded = units.select("doc_id", "line", F.explode(F.array(F.split(_plain("unit"), " "))).alias("words")).filter(F.size("words") > 1)
    return worded.select("doc_id", "line", F.explode(F.array(F.array_distinct(_bigrams("words")))).alias("pairs"))


def _table(spark: SparkSession) -> DataFrame:
    """template, license, m, low, high, bigram: some hundred constant rows."""
    rows = [f"({i}, '{name}', {len(pairs)}, {bounds(len(pairs))[0]}, {bounds(len(pairs))[1]}, '{p}')" for i, name, pairs in template_bigrams() for p in pairs]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(template, license, m, low, high, bigram)")


def _probed(spark: SparkSession) -> DataFrame:
    """template, license, m, low, high, pairs, probes, bigram: a row for each probe."""
    words = lambda x: f"array({', '.join(map(repr, x))})"
    rows = [f"('{name}', {len(p)}, {bounds(len(p))[0]}, {bounds(len(p))[1]}, {words(p)}, {words(probes(p))})" for _, name, p in template_bigrams()]
    return spark.sql(f"SELECT *, explode(probes) AS bigram FROM VALUES {', '.join(rows)} AS t(license, m, low, high, pairs, probes)")


def _runs(rows: DataFrame, by_word: bool) -> DataFrame:
    """doc_id, license, line, n, m, c of the runs of lines (by_word: of words) of each text that reach a template.

    A run that reaches it holds one of its probes, and at least low of its bigrams lie within high of that one. Runs are built from
    the first probe that they hold. A run of words starts and ends with bigrams of the template, as what lies outside only lowers
    the coefficient.
    """
    known = template_bigrams()
    every = sorted({p for _, _, pairs in known for p in probes(pairs)})
    reach = max(bounds(len(p))[1] for _, _, p in known) - 1
    held = F.split(F.lit("|".join(every)), "[|]")
    words = rows.select("doc_id", "text", F.explode(F.array(F.split(_plain("text"), " "))).alias("words")).filter(F.size("words") > 1)
    own = words.select("doc_id", "text", F.explode(F.array(_bigrams("words"))).alias("own")).filter(F.arrays_overlap("own", held))
    # the line of each word; the bigrams with the line of their first word, and whether they begin and end a line
    counts = F.transform(F.split("text", "\n"), lambda x, i: F.array_repeat(i + 1, F.size(F.filter(F.split(_plain(x), " "), lambda w: w != ""))))
    lined = own.select("doc_id", "own", F.explode(F.array(F.flatten(counts))).alias("at"))
    line = lambda i: F.get("at", i)
    begins, ends = (lambda i: F.coalesce(line(i - 1) != line(i), F.lit(True))), (lambda i: F.coalesce(line(i + 1) != line(i + 2), F.lit(True)))
    marked = F.transform("own", lambda b, i: F.struct(b.alias("b"), line(i).alias("line"), begins(i).alias("begins"), ends(i).alias("ends")))
    marked = lined.select("doc_id", F.explode(F.array(marked)).alias("own"))
    # blocks with what lies around them, then the surroundings of each probe; place counts from 1 in its surroundings
    start = F.sequence(F.lit(1), F.size("own"), F.lit(_BLOCK))
    around = lambda of, s, n: F.slice(of, F.greatest(s - reach, F.lit(1)), n + reach + F.least(s - 1, F.lit(reach)))
    blocks = F.transform(start, lambda s: F.struct(F.least(s, F.lit(reach + 1)).alias("first"), around("own", s, _BLOCK).alias("own")))
    blocks = marked.select("doc_id", F.explode(blocks).alias("x")).select("doc_id", "x.first", "x.own").filter(F.arrays_overlap(F.transform("own", lambda x: x["b"]), held))
    places = F.filter(F.transform("own", lambda x, i: F.when(x["b"].isin(every), i + 1)), lambda i: i.between(F.col("first"), F.col("first") + _BLOCK - 1))
    near = F.transform(places, lambda i: F.struct(F.least(i, F.lit(reach + 1)).alias("place"), around("own", i, 1).alias("own")))
    near = blocks.select("doc_id", F.explode(near).alias("x")).select("doc_id", "x.place", "x.own")
    near = near.select("doc_id", "place", "own", F.transform("own", lambda x: x["b"]).alias("pairs_near"), F.get("own", F.col("place") - 1)["b"].alias("bigram"))
    tried = near.join(F.broadcast(_probed(rows.sparkSession)), "bigram").filter(F.size(F.array_intersect("pairs_near", "pairs")) >= F.col("low"))
    at = F.transform("own", lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i")))
    edge = lambda side: (lambda e: F.array_contains("pairs", e["x"]["b"]) if by_word else e["x"][side])
    before = F.coalesce(F.array_max(F.transform(F.filter(at, lambda e: (e["i"] < F.col("place")) & F.array_contains("probes", e["x"]["b"])), lambda e: e["i"])), F.lit(0))
    starts = F.filter(at, lambda e: e["i"].between(F.greatest(before + 1, F.col("place") - F.col("high") + 1), F.col("place")) & edge("begins")(e))
    stops = F.filter(at, lambda e: e["i"].between(F.col("place"), F.col("place") + F.col("high") - 1) & edge("ends")(e))
    columns = ["doc_id", "license", "m", "low", "high", "pairs", "pairs_near"]
    spans = tried.select(*columns, F.explode(starts).alias("start"), stops.alias("stops")).select(*columns, "start", F.explode("stops").alias("stop"))
    long = F.col("stop.i") - F.col("start.i") + 1
    spans = spans.filter(long.between(F.col("low"), F.col("high"))).select("doc_id", "license", "m", "pairs", F.col("start.x.line").alias("line"), F.explode(F.array(F.slice("pairs_near", F.col("start.i"), long))).alias("own"))
    return spans.select("doc_id", "license", "line", F.size(F.array_distinct("own")).alias("n"), "m", F.size(F.array_intersect("own", "pairs")).alias("c"))


def scanned(docs: DataFrame, by_word: bool = False) -> DataFrame:
    """doc_id, license, dice (6 decimals), line (from 1; 0 for the whole text) of each licence that a line, a run of consecutive
    lines or the whole text reaches; by_word: that any run of words reaches, inside a line or over lines. A run has its first line.

    Of several units that reach a licence, the one with the greatest coefficient, then the first, is given. Rows with an equal
    doc_id are one document, as are those without. Null, empty and one-word texts reach none; extra columns are not read.
    """
    known = template_bigrams()
    every = sorted({p for _, _, pairs in known for p in probes(pairs)})
    low, high = min(bounds(len(p))[0] for _, _, p in known), max(bounds(len(p))[1] for _, _, p in known)
    rows = docs.select(column(docs, "doc_id", "long"), column(docs, "text", "string")).filter("text is not null")
    rows = _may_hold(rows)
    lines = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "unit")).select("doc_id", (F.col("at") + 1).alias("line"), "unit")
    whole = rows.filter(F.instr("text", "\n") > 0).select("doc_id", F.lit(0).alias("line"), F.col("text").alias("unit"))
    units = _with_bigrams(lines.unionByName(whole)).withColumn("n", F.size("pairs"))
    held = F.split(F.lit("|".join(every)), "[|]")
    found = units.filter(F.col("n").between(low, high)).filter(F.arrays_overlap("pairs", held)).withColumn("unit", F.monotonically_increasing_id())
    table = F.broadcast(_table(docs.sparkSession))
    hits = found.select("doc_id", "line", "n", "unit", F.explode("pairs").alias("bigram")).join(table, "bigram").filter("n between low and high")
    shared = hits.groupBy("doc_id", "line", "n", "unit", "template", "license", "m").agg(F.count("*").alias("c"))
    t = THRESHOLD
    runs = _runs(rows if by_word else rows.filter(F.instr("text", "\n") > 0), by_word)
    counted = shared.select("doc_id", "license", "line", "n", "m", "c").unionByName(runs)
    reached = counted.filter(F.col("c") * 2 * t.denominator >= (F.col("n") + F.col("m")) * t.numerator)
    dice = F.round(F.col("c") * 2 / (F.col("n") + F.col("m")), 6)
    best = reached.groupBy("doc_id", "license").agg(F.min(F.struct((-dice).alias("less"), "line")).alias("b"))
    return best.select("doc_id", "license", (-F.col("b.less")).alias("dice"), F.col("b.line").cast("long").alias("line"))


def sql() -> str:
    """For DuckDB: each line, whole text and run of lines compared to every template."""
    rows = ", ".join(f"({i}, '{name}', {len(pairs)}, [{', '.join(repr(p) for p in pairs)}])" for i, name, pairs in template_bigrams())
    words = f"string_split(trim(regexp_replace(translate(unit, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ')"
    pairs = lambda a, b: f"list_distinct(list_transform(range({a}, {b}), lambda i: w[i] || ' ' || w[i + 1]))"
    most = max(bounds(len(p))[1] for _, _, p in template_bigrams())
    return f"""
WITH t(template, license, m, pairs) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
units AS (SELECT r, doc_id, unnest(parts) AS unit, unnest(range(1, len(parts) + 1)) AS line FROM d UNION ALL SELECT r, doc_id, text, 0 FROM d WHERE contains(text, chr(10))),
w AS (SELECT r, doc_id, line, {words} AS w FROM units),
l AS (SELECT r, doc_id, line, w, CAST(sum(len(w)) OVER (PARTITION BY r ORDER BY line) AS BIGINT) AS upto FROM w WHERE line > 0 AND w <> ['']),
whole AS (SELECT r, flatten(list(w ORDER BY line)) AS w FROM l GROUP BY r),
runs AS (SELECT a.r, a.doc_id, a.line, a.upto - len(a.w) + 1 AS first, b.upto AS last FROM l a JOIN l b ON a.r = b.r AND b.line > a.line AND b.upto - a.upto + len(a.w) <= {most + 1}),
b AS (
  SELECT doc_id, line, NULL AS long, {pairs("1", "len(w)")} AS own FROM w
  UNION ALL SELECT doc_id, line, last - first, {pairs("first", "last")} FROM runs JOIN whole USING (r)),
s AS (
  SELECT doc_id, line, license, m, len(own) AS n, len(list_intersect(own, pairs)) AS c FROM b, t
  WHERE len(own) BETWEEN ceil(m * 2 / 3.0) AND floor(m * 1.5) AND coalesce(long, m) BETWEEN ceil(m * 2 / 3.0) AND floor(m * 1.5)),
f AS (SELECT doc_id, line, license, round(2.0 * c / (n + m), 6) AS dice FROM s WHERE c * 10 >= (n + m) * 4)
SELECT doc_id, license, CAST(max(dice) AS DOUBLE) AS dice, CAST(arg_min(line, (-dice, line)) AS BIGINT) AS line FROM f GROUP BY doc_id, license"""
