"""Markdown outlines: headings, code-span references, and symbols of source texts, as set-based text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import lines, looks_like_symbol


def _numbered(files: DataFrame) -> DataFrame:
    """path, line (from 1), text, fenced (whether the line stands in or bounds a fenced block), level and title of the heading that it is."""
    rows = files.select("path", F.posexplode(lines(F.col("content"))).alias("at", "text")).select("path", (F.col("at") + 1).cast("long").alias("line"), "text")
    mark = F.col("text").rlike(r"^ {0,3}(```|~~~)").cast("int")
    by = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("fenced", (F.sum(mark).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) % 2 == 1) | (mark == 1))
    signs = F.regexp_extract("text", r"^ {0,3}(#{1,6})(?:[ \t]+|$)", 1)
    under = F.lead("text").over(by)
    plain = F.col("text").rlike(r"^ {0,3}[^\s#>|*+-]") & ~F.col("text").rlike(r"^ {0,3}\d+[.)] ")
    level = F.when(signs != "", F.length(signs)).when(plain & under.rlike(r"^ {0,3}=+[ \t]*$"), 1).when(plain & under.rlike(r"^ {0,3}-+[ \t]*$"), 2)
    title = F.trim(F.regexp_replace(F.regexp_replace("text", r"^ {0,3}#{1,6}(?=[ \t]|$)", ""), r"[ \t]+#+[ \t]*$", ""))
    return rows.withColumn("level", F.when(~F.col("fenced"), level).cast("long")).withColumn("title", F.when(F.col("level").isNotNull(), title))


def headings(files: DataFrame) -> DataFrame:
    """path, line, level, title of headings outside fenced blocks: with number signs before, or underlined."""
    return _numbered(files).filter("level is not null").select("path", "line", "level", "title")


def code_spans(files: DataFrame) -> DataFrame:
    """path, line, col, name, section, section_line: symbol-like inline code outside headings and fences; the section is the heading
    above, or null. A name that stands in a line more than once is given once, at its first place."""
    rows = _numbered(files)
    upto = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = F.last(F.when(F.col("level").isNotNull(), F.struct("title", "line")), ignorenulls=True).over(upto)
    rows = rows.withColumn("above", above).filter("not fenced and level is null")
    spans = rows.select("path", "line", "text", "above", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("`([^`]+)`"), F.lit(1)))).alias("span"))
    named = spans.withColumn("name", F.trim(F.regexp_replace("span", r"(\(\))+$", "")))
    found = named.select("path", "line", (F.instr("text", F.concat(F.lit("`"), F.col("span"), F.lit("`"))) - 1).cast("long").alias("col"), "name", F.col("above.title").alias("section"), F.col("above.line").alias("section_line"))
    return found.filter(looks_like_symbol(F.col("name")))
