"""Findings: stable order, grouping by review, and rendering as rows of text."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Most severe first.
SEVERITIES = ["high", "medium", "low", "info"]
FINDING = "review string, severity string, file string, line int, message string"


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0)), F.lit(len(SEVERITIES) + 1)).cast("int")


def sort_findings(findings: DataFrame, ordinal: str = "ord") -> DataFrame:
    """By severity, review and file; equal ones in the order they were reported."""
    return findings.orderBy(severity_rank(F.col("severity")), F.asc_nulls_last("review"), F.asc_nulls_last("file"), ordinal)


def group_findings(findings: DataFrame, ordinal: str = "ord") -> DataFrame:
    """``(review, n, first_ord)``: counts by review, to be shown in order of first appearance."""
    return findings.groupBy("review").agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first_ord"))


def markdown_cell(text: Column) -> Column:
    """Text for a cell of a Markdown table: pipes escaped, line breaks as spaces."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), "\r\n|\r|\n", " ")


def place(file: Column, line: Column) -> Column:
    return F.when(line.isNull(), file).otherwise(F.concat(file, F.lit(":"), line.cast("string")))


def markdown_rows(findings: DataFrame) -> Column:
    cells = [markdown_cell(F.col("severity")), markdown_cell(place(F.col("file"), F.col("line"))), markdown_cell(F.col("message"))]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def terminal_rows() -> Column:
    return F.format_string("  %-6s %-40s %s", F.col("severity"), place(F.col("file"), F.col("line")), F.col("message"))


def _ordered(findings: DataFrame) -> Iterator[Row]:
    """All findings, sorted; they come a partition at a time, and only the report itself is held."""
    return sort_findings(findings).toLocalIterator()


def render_terminal(findings: DataFrame, failures: list[str] = ()) -> str:
    """Findings by review with counts, most severe first; then the reviews that failed."""
    rows = _ordered(findings.withColumn("__line", terminal_rows()))
    reviews: dict[str, list[str]] = {}
    for row in rows:
        reviews.setdefault(row["review"], []).append(row["__line"])
    out = []
    for name, lines in reviews.items():
        out += [f"{name} ({len(lines)} finding{'' if len(lines) == 1 else 's'})", *lines, ""]
    out += [f"failed: {name}" for name in failures]
    return "\n".join(out or ["No findings."])


def render_markdown(findings: DataFrame, failures: list[str] = ()) -> str:
    rows = _ordered(findings.withColumn("__line", markdown_rows(findings)))
    reviews: dict[str, list[str]] = {}
    for row in rows:
        reviews.setdefault(row["review"], []).append(row["__line"])
    out = ["# Findings", ""]
    for name, lines in reviews.items():
        out += [f"## {name}", "", "| Severity | Location | Message |", "| --- | --- | --- |", *lines, ""]
    if failures:
        out += ["## Failed reviews", "", *[f"- {name}" for name in failures], ""]
    return "\n".join(out)


def render_json(findings: DataFrame, failures: list[str] = ()) -> str:
    keys = ["review", "severity", "file", "line", "message"]
    return json.dumps({"findings": [{k: r[k] for k in keys} for r in _ordered(findings)], "failed_reviews": list(failures)}, ensure_ascii=False)
