"""Guardrails: redaction, deny patterns, size cap, decisions, and running limits of sessions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Category, pattern and what takes its place, in the order in which they are applied to the rewritten text.
REDACTIONS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]"),
    ("phone", r"(?:\+?[0-9]{1,3}[\s.-]?)?(?:\(?[0-9]{3}\)?[\s.-]?)[0-9]{3}[\s.-]?[0-9]{4}", "[REDACTED_PHONE]"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[REDACTED_SSN]"),
    ("credit_card", r"\b(?:[0-9][ -]*?){13,19}\b", "[REDACTED_CARD]"),
    ("access_token", r"\b(?:ghp_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{20,}|AKIA[0-9A-Z]{16})\b", "[REDACTED_TOKEN]"),
)
DENIED_OUTPUT = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"AKIA[0-9A-Z]{16}", r"ghp_[A-Za-z0-9]{20,}", r"xox[baprs]-[A-Za-z0-9-]{20,}")
DENIED_INPUT = (r"(?i)ignore\s+previous\s+instructions", r"(?i)system\s+prompt", r"(?i)developer\s+message", r"(?i)exfiltrat(?:e|ion)", r"(?i)send\s+.*\s+to\s+external")
WRITES = "update_config write_memory delete_memory edit_memory sync".split()


@dataclass(frozen=True)
class Policy:
    enforce: bool = False
    categories: tuple[str, ...] = tuple(c for c, _, _ in REDACTIONS)
    denied: tuple[str, ...] = field(default=DENIED_OUTPUT)
    max_chars: int = 50_000


def _hits(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in patterns], F.lit(0))


def redacted(rows: DataFrame, column: str = "text", categories: tuple[str, ...] = Policy.categories) -> DataFrame:
    """rows with the text redacted category by category and hits, how often anything was replaced."""
    out = rows.withColumn("hits", F.lit(0))
    for name, pattern, mark in REDACTIONS:
        if name in categories:
            out = out.withColumn("hits", F.col("hits") + F.regexp_count(column, F.lit(pattern))).withColumn(column, F.regexp_replace(column, pattern, mark))
    return out


def decided(rows: DataFrame, column: str = "text", policy: Policy | None = None) -> DataFrame:
    """rows with the guarded text, hits and decision (allow, redact or deny).

    Denied patterns are counted after redaction. When enforcing, a denied pattern or too long a text denies; else a denied pattern
    makes the decision redact without changing the text, and too long a text is cut, which is one hit more.
    """
    policy = policy or Policy()
    out = redacted(rows, column, policy.categories).withColumn("denied", _hits(F.col(column), policy.denied))
    long = F.length(column) > policy.max_chars
    out = out.withColumn("too_long", long)
    if policy.enforce:
        decision = F.when((F.col("denied") > 0) | F.col("too_long"), "deny").when(F.col("hits") > 0, "redact").otherwise("allow")
        return out.withColumn("decision", decision).withColumn("hits", F.col("hits") + F.col("denied") + F.col("too_long").cast("int")).drop("denied", "too_long")
    out = out.withColumn(column, F.when(F.col("too_long"), F.left(F.col(column), F.lit(policy.max_chars))).otherwise(F.col(column)))
    out = out.withColumn("hits", F.col("hits") + F.col("denied") + F.col("too_long").cast("int"))
    return out.withColumn("decision", F.when(F.col("hits") > 0, "redact").otherwise("allow")).drop("denied", "too_long")


def input_hits(rows: DataFrame, column: str = "text") -> DataFrame:
    return rows.withColumn("input_hits", _hits(F.col(column), DENIED_INPUT))


def session_limits(calls: DataFrame, session: str, order: list[str], max_calls: int = 500, max_hits: int = 100, max_blocked: int = 25) -> DataFrame:
    """calls (hits, blocked) with running totals within their session and whether a limit has been passed before this call."""
    before = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = calls.withColumns({"n_calls": F.count("*").over(before), "n_hits": F.sum("hits").over(before), "n_blocked": F.sum("blocked").over(before)})
    return out.withColumn("over_limit", (F.col("n_calls") > max_calls) | (F.col("n_hits") > max_hits) | (F.col("n_blocked") > max_blocked))


def flow_transitions(calls: DataFrame, session: str, order: list[str], limit: int = 10) -> DataFrame:
    """calls (risk: read_like or write_like) with how often a write has followed a read so far and whether that passes the limit."""
    by = Window.partitionBy(session).orderBy(*order)
    step = ((F.col("risk") == "write_like") & (F.lag("risk").over(by) == "read_like")).cast("long")
    out = calls.withColumn("step", F.coalesce(step, F.lit(0)))
    total = F.sum("step").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn("transitions", total).withColumn("over_flow", F.col("transitions") > limit).drop("step")


def argument_hash(arguments: Column) -> Column:
    return F.sha2(F.to_json(arguments).cast("binary"), 256)
