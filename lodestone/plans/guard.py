"""The guarded SQL surface: read-only queries over the registered tables, as JSON."""

from __future__ import annotations

import datetime
import decimal
import json
import re
from collections.abc import Mapping
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MAX_ROWS, MAX_LINES = 200, 400

# Functions of the accepted dialect that Spark lacks, as SQL functions.
ALIASES = {
    "strlen": "(s STRING) RETURNS BIGINT RETURN octet_length(s)",
    "regexp_matches": "(s STRING, p STRING) RETURNS BOOLEAN RETURN s RLIKE p",
    "list_contains": "(l ARRAY<STRING>, x STRING) RETURNS BOOLEAN RETURN array_contains(l, x)",
    "array_len": "(l ARRAY<STRING>) RETURNS BIGINT RETURN size(l)",
    "string_split": "(s STRING, d STRING) RETURNS ARRAY<STRING> RETURN split(s, concat('\\\\Q', d, '\\\\E'))",
    "regexp_full_match": "(s STRING, p STRING) RETURNS BOOLEAN RETURN s RLIKE concat('^(?:', p, ')$')",
    "list_distinct": "(l ARRAY<STRING>) RETURNS ARRAY<STRING> RETURN array_distinct(l)",
    "list_sort": "(l ARRAY<STRING>) RETURNS ARRAY<STRING> RETURN array_sort(l)",
    "strpos": "(s STRING, x STRING) RETURNS BIGINT RETURN instr(s, x)",
    "epoch_us": "(t TIMESTAMP) RETURNS BIGINT RETURN unix_micros(t)",
}

#: Logical operators that only read.  Anything else in an analysed plan is refused; files and tables are read through temporary views alone.
READS = frozenset(
    "Project Filter Join Aggregate Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Union Intersect Except SubqueryAlias LocalRelation OneRowRelation "
    "WithCTE CTERelationDef CTERelationRef UnionLoop UnionLoopRef Window Generate LateralJoin Expand Sample Pivot Unpivot Range Tail ResolvedHint "
    "InlineTable Aggregate GroupingSets ScalarSubquery Exists ListQuery LateralSubquery SetOperation RepartitionByExpression Repartition".split()
)
#: Expressions that run code of the caller's choice, whatever function makes them.
CALLS = frozenset(["CallMethodViaReflection", "TryReflect"])
EXPRESSIONS = "org.apache.spark.sql.catalyst."


class Refused(ValueError):
    """A statement that isn't a read of the registered tables."""


def bare_head(sql: str) -> str:
    """The first word of a statement, behind comments and brackets."""
    text = re.sub(r"\A(?:\s+|--[^\n]*(?:\n|\Z)|/\*.*?\*/|\()+", "", sql, flags=re.S)
    found = re.match(r"[A-Za-z]+", text)
    return found[0].upper() if found else ""


def check(spark: SparkSession, sql: str) -> None:
    """Refuses anything but one SELECT or WITH over temporary views.

    The head word gives a quick answer; the analysed plan decides.  Below a temporary view
    stands what the host registered; everywhere else only reading operators and Spark's
    own expressions may stand, so neither a write behind WITH nor a file read by name
    (``parquet.`path```), under whatever name WITH defines, nor a reflective call gets through.
    """
    if bare_head(sql) not in ("SELECT", "WITH", "FROM", "VALUES"):
        raise Refused("only SELECT and WITH are allowed")
    session = spark._jsparkSession
    parsed = session.sessionState().sqlParser().parsePlan(sql)
    for node in _walk(session.sessionState().executePlan(parsed, _mode(spark)).analyzed()):
        if _is_view(node):
            continue
        if node.nodeName() not in READS:
            raise Refused(f"{node.nodeName()} isn't a read of a registered table")
        for found in _expressions(node):
            name = found.getClass().getName()
            if not name.startswith(EXPRESSIONS) or name.rpartition(".")[2] in CALLS:
                raise Refused(f"{name.rpartition('.')[2]} isn't allowed")


def _mode(spark: SparkSession):
    return spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()


def _is_view(node) -> bool:
    return node.nodeName() == "View" and node.isTempView()


def _each(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _walk(plan):
    """The nodes of a plan and of its subqueries, but for what stands below temporary views."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        if _is_view(node):
            continue
        for part in (node.children(), node.innerChildren(), node.subqueries()):
            todo += [child for child in _each(part) if hasattr(child, "innerChildren")]


def _expressions(node):
    todo = list(_each(node.expressions()))
    while todo:
        found = todo.pop()
        yield found
        todo += _each(found.children())


def register_aliases(spark: SparkSession) -> None:
    for name, body in ALIASES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


def bound(spark: SparkSession, sql: str, params: Mapping[str, Any] | None = None) -> DataFrame:
    """A query with ``$name`` parameters bound as values (never pasted into the text)."""
    if not params:
        return spark.sql(sql)
    pieces = re.split(r"('(?:[^']|'')*')", sql)
    marked = "".join(p if k % 2 else re.sub(r"\$([A-Za-z_]\w*)", r":\1", p) for k, p in enumerate(pieces))
    return spark.sql(marked, args=dict(params))


def to_json(value: Any) -> Any:
    """A result value for JSON: wide numbers as decimal strings, lists as lists, all else as text."""
    if value is None or isinstance(value, (bool, str, float)):
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return [to_json(x) for x in value]
    if isinstance(value, (datetime.date, datetime.datetime, datetime.timedelta)):
        return str(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


def envelope(rows: DataFrame, limit: int = MAX_ROWS) -> dict[str, Any]:
    """``headers, rows, total_rows, truncated``: the first ``limit`` rows and the exact count, of one execution.

    Rows are counted as they pass; the first are those of the least place, which each task
    keeps for itself, so a task hands on at most ``limit`` rows.
    """
    counted = Observation()
    placed = rows.observe(counted, F.count(F.lit(1)).alias("n")).withColumn("__place", F.monotonically_increasing_id())
    first = placed.orderBy("__place").limit(limit).collect()
    total = counted.get["n"]
    return {"headers": rows.columns, "rows": [[to_json(x) for x in tuple(r)[:-1]] for r in first], "total_rows": total, "truncated": total > limit}


def query(spark: SparkSession, sql: str, params: Mapping[str, Any] | None = None) -> str:
    """The query tool: a JSON envelope, or a line that begins with ``ERROR:``."""
    try:
        marked = re.sub(r"\$([A-Za-z_]\w*)", "NULL", sql) if params else sql
        check(spark, marked)
        return json.dumps(envelope(bound(spark, sql, params)), ensure_ascii=False)
    except (Refused, PySparkException) as e:
        return f"ERROR: {e}"
    except Exception as e:  # py4j wraps the parser's errors when it is called directly
        return f"ERROR: {str(e).splitlines()[0]}"


def read_source(files: DataFrame, path: str, start: int, end: int) -> str:
    """Numbered lines start to end of a file, clamped to MAX_LINES; unknown paths and empty files are errors."""
    found = files.where(F.col("path") == path).select("content").first()
    if found is None:
        return f"ERROR: no such file: {path}"
    if not found["content"]:
        return f"ERROR: {path} is empty"
    lines = found["content"].split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    first = max(start, 1)
    last = min(max(end, first), first + MAX_LINES - 1, len(lines))
    return "\n".join(f"{k}\t{lines[k - 1].rstrip(chr(13))}" for k in range(first, last + 1))
