"""URL filters: dated list entries become validity intervals, and captures are held against those of their fetch time.

An entry adds a domain (it and all below it) or a URL prefix to the list, or removes it, on a day. What decides is joined once for
each distinct host and day, or address and day: a host's parent domains, and the address's beginnings of the lengths that prefixes
of its host have, meet the interval of that pattern which holds the day. No pattern, host or day gathers rows; the verdicts are
broadcast to the captures if counted few, else Spark splits hot hosts. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import column, join_small

#: The list of the query: pattern, kind, day, action.
ENTRIES = (
    ("casino-win.example.com", "domain", "2024-01-15", "add"), ("casino-win.example.com", "domain", "2024-04-01", "remove"), ("casino-win.example.com", "domain", "2024-07-01", "add"),
    ("cheap-pills.example.com", "domain", "2023-11-30", "add"), ("free-bets.example.com", "domain", "2024-02-01", "add"), ("free-bets.example.com", "domain", "2024-02-01", "remove"),
    ("free-bets.example.com", "domain", "2024-03-10", "add"), ("free-bets.example.com", "domain", "2024-11-01", "remove"), ("example.net", "domain", "2024-06-01", "add"),
    ("example.net", "domain", "2024-06-15", "remove"), ("ththth.example.net", "domain", "2024-06-10", "add"), ("tionble.example.org/en/", "prefix", "2024-05-01", "add"),
    ("tionble.example.org/en/", "prefix", "2024-09-01", "remove"), ("blog.tionsh.example.com/fr/1", "prefix", "2024-01-01", "add"), ("unseen.invalid", "domain", "2024-01-01", "add"),
)
FIRST_DAY = "2024-01-01"
DAYS = 366


def values(spark: SparkSession, entries=ENTRIES) -> DataFrame:
    rows = ", ".join(f"('{p}', '{k}', DATE '{d}', '{a}')" for p, k, d, a in entries)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(pattern, kind, day, action)")


def host(url: Column) -> Column:
    """The lower-case host of a URL without user, port and final dot; null if there is none."""
    found = F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def address(url: Column) -> Column:
    """Host and what follows it, which prefixes are held against."""
    return F.concat(host(url), F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$", 1))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, kind, since, until: the days (until excluded, null for open) on which a pattern is listed.

    Hosts are compared in lower case, paths as they are. Of entries for one pattern and day, removal counts. Entries with nulls are
    left out; repeated ones change nothing. The window is over the few entries of one pattern.
    """
    plain = entries.select(*(column(entries, c, t) for c, t in (("pattern", "string"), ("kind", "string"), ("day", "date"), ("action", "string")))).dropna()
    pattern = F.concat(F.lower(F.regexp_extract("pattern", "^[^/]*", 0)), F.regexp_extract("pattern", "^[^/]*(.*)$", 1))
    last = plain.groupBy(pattern.alias("pattern"), "kind", "day").agg(F.max((F.col("action") == "remove").cast("int")).alias("removed"))
    spans = last.withColumn("until", F.lead("day").over(Window.partitionBy("pattern", "kind").orderBy("day")))
    return spans.filter("removed = 0").select("pattern", "kind", F.col("day").alias("since"), "until")


RESULT = ("host", "blocked", "n_entries", "pattern", "since")


def _active(asked: DataFrame, spans: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys with the number and the best of the intervals that hold their day, as n_name and best_name; asked has keys, day and pattern."""
    held = asked.join(spans, "pattern").filter("since <= day and (until is null or day < until)")
    best = F.min(F.struct((-F.length("pattern")).alias("less"), "pattern", "since"))
    return held.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), best.alias(f"best_{name}"))


def evaluated(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (with url and fetched, a date) with host, blocked, n_entries, pattern, since.

    n_entries counts the entries active on the day of fetching that the URL falls under; of those, the longest pattern (then the
    first by alphabet) and its day are given. A null, relative or hostless URL, or a null day, falls under none. Every row stays, and
    so do repeated ones; an empty list blocks nothing. Columns of captures that have the names of the five are left out, whatever
    their case; all others stay, whatever their names.
    """
    names = captures.columns
    url, day = (F.col(f"c{names.index(n)}") for n in ("url", "fetched"))
    rows = captures.toDF(*(f"c{i}" for i in range(len(names)))).withColumns({"host": host(url.cast("string")), "address": address(url.cast("string")), "day": day.cast("date")})
    spans = intervals(entries)
    known = rows.filter("host is not null and day is not null")
    labels = F.split("host", "[.]")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = known.select("host", "day").distinct().select("host", "day", F.explode(parents).alias("pattern"))
    domains = _active(asked, spans.filter("kind = 'domain'").drop("kind"), ["host", "day"], "domain")
    prefixes = spans.filter("kind = 'prefix'").drop("kind")
    lengths = prefixes.select(F.substring_index("pattern", "/", 1).alias("host"), F.length("pattern").alias("length")).distinct()
    begun = known.select("host", "address", "day").distinct().join(lengths, "host").filter("length <= length(address)")
    begun = begun.select("address", "day", F.expr("left(address, length)").alias("pattern"))
    found = join_small(rows, domains, ["host", "day"], "left")
    found = join_small(found, _active(begun, prefixes, ["address", "day"], "prefix"), ["address", "day"], "left")
    n = F.coalesce("n_domain", F.lit(0)) + F.coalesce("n_prefix", F.lit(0))
    best = F.array_min(F.array_compact(F.array("best_domain", "best_prefix")))
    own = [F.col(f"c{i}").alias(name) for i, name in enumerate(names) if name.lower() not in RESULT]
    return found.withColumns({"n": n, "best": best}).select(
        *own, "host", (F.col("n") > 0).alias("blocked"), F.col("n").cast("long").alias("n_entries"), F.col("best.pattern").alias("pattern"), F.col("best.since").alias("since")
    )


def pages_as_captures(pages: DataFrame) -> DataFrame:
    """page_id, url and a day of 2024 by page_id, since the table has no fetch time."""
    rows = pages.select(column(pages, "page_id", "long"), column(pages, "url", "string"))
    return rows.withColumn("fetched", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod("page_id", F.lit(DAYS)).cast("int")))


def sql() -> str:
    rows = ", ".join(f"('{p}', '{k}', DATE '{d}', '{a}')" for p, k, d, a in ENTRIES)
    return f"""
WITH e(pattern, kind, day, action) AS (VALUES {rows}),
l AS (SELECT pattern, kind, day, max(CASE WHEN action = 'remove' THEN 1 ELSE 0 END) AS removed FROM e GROUP BY ALL),
s AS (SELECT *, day AS since, lead(day) OVER (PARTITION BY pattern, kind ORDER BY day) AS until FROM l),
c AS (
  SELECT page_id, url, CAST(DATE '{FIRST_DAY}' + CAST(page_id % {DAYS} AS INTEGER) AS DATE) AS fetched,
    lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host, regexp_extract(url, '://[^/?#]*(.*)$', 1) AS rest FROM pages),
m AS (
  SELECT c.page_id, s.pattern, s.since FROM c JOIN s ON removed = 0 AND fetched >= since AND (until IS NULL OR fetched < until)
    AND CASE kind WHEN 'domain' THEN host = pattern OR ends_with(host, '.' || pattern) ELSE starts_with(host || rest, pattern) END),
b AS (SELECT page_id, count(*) AS n, arg_min(pattern, (-length(pattern), pattern)) AS pattern, arg_min(since, (-length(pattern), pattern)) AS since FROM m GROUP BY page_id)
SELECT c.page_id, url, fetched, host, b.n IS NOT NULL AS blocked, CAST(coalesce(b.n, 0) AS BIGINT) AS n_entries, b.pattern, b.since FROM c LEFT JOIN b USING (page_id)"""
