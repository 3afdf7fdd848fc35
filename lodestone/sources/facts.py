"""Facts of source files: one pass over each file yields rows of all tables, tagged by table.

Python is parsed with its own grammar; the other languages by a tolerant lexer and
patterns of declarations (see :mod:`lodestone.sources.lexed`).  Offsets are UTF-8 bytes,
lines count from 1 and columns from 0.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions.ids import fnv1a64
from lodestone.functions.text import TODO_KINDS
from lodestone.operators.dedupe import keep_last
from lodestone.scratch import materialize

Rows = list[tuple[str, dict]]


class Facts:
    """Collects one file's rows and gives them their identities."""

    def __init__(self, path: str, language: str, text: str):
        self.path, self.language = path, language
        self.raw = text.encode()
        self.rows: Rows = []
        self.starts = [0]
        for k, b in enumerate(self.raw):
            if b == 10:
                self.starts.append(k + 1)
        self.separator = "::" if language in ("rust", "c", "cpp", "php") else "."
        self.seen_types: set[str] = set()
        self.n_comments = self.n_imports = 0

    def place(self, byte: int) -> tuple[int, int]:
        import bisect

        line = bisect.bisect_right(self.starts, byte)
        return line, byte - self.starts[line - 1]

    def add(self, table: str, **row) -> None:
        self.rows.append((table, row))

    def symbol(self, kind: str, name: str, start: int, end: int, parent: dict | None = None, **flags) -> dict:
        line, col = self.place(start)
        last, last_col = self.place(end)
        ident = f"{self.path}|{line}|{col}|{name}|{kind}"
        qualified = f"{parent['qualified_name']}{self.separator}{name}" if parent else name
        row = {
            "id": ident, "kind": kind, "name": name, "qualified_name": qualified, "language": self.language, "visibility": flags.get("visibility", "public"),
            "file_path": self.path, "parent_id": parent["id"] if parent else None, "is_async": flags.get("is_async", False), "is_static": flags.get("is_static", False),
            "is_abstract": flags.get("is_abstract", False), "is_mutable": flags.get("is_mutable", False), "exported": flags.get("exported", False),
        }
        self.rows.append(("symbol", row))
        self.add("span", entity_id=ident, file_path=self.path, start_byte=start, end_byte=end, start_line=line, end_line=last, start_col=col, end_col=last_col)
        return row | {"start": start, "end": end, "line": line, "col": col, "last": last}

    def scope(self, kind: str, start: int, end: int, parent: str | None) -> str:
        ident = f"{self.path}|{start}|{kind}"
        self.add("scope", id=ident, parent_id=None if parent == ident else parent, file_path=self.path, kind=kind, start_byte=start, end_byte=end)
        return ident

    def binding(self, scope: str, name: str, start: int, kind: str, symbol: str | None = None) -> None:
        self.add("binding", scope_id=scope, name=name, start_byte=start, symbol_id=symbol, binding_kind=kind)

    def occurrence(self, name: str, start: int, end: int, kind: str, symbol: str | None, scope: str) -> None:
        self.add("occurrence", id=f"{self.path}|{start}|{name}|{kind}", name=name, file_path=self.path, start_byte=start, end_byte=end, enclosing_symbol_id=symbol, enclosing_scope_id=scope, occurrence_kind=kind)

    def call(self, caller: str | None, callee: str, receiver: str | None, start: int, end: int) -> None:
        self.add("call_site", id=f"{self.path}:{start}:{end}", caller_id=caller, callee_name=callee, receiver=receiver, file_path=self.path, start_byte=start, end_byte=end)

    def type(self, display: str, kind: str, canonical: str | None = None) -> str:
        ident = f"type:{fnv1a64(f'{self.language}|{self.path}|{display}'):016x}"
        if display not in self.seen_types:
            self.seen_types.add(display)
            self.add("type", id=ident, kind=kind, language=self.language, display_name=display, canonical_name=canonical)
        return ident

    def imported(self, raw_path: str, kind: str) -> None:
        self.add("raw_import", file_path=self.path, position=self.n_imports, raw_path=raw_path, language=self.language, kind=kind)
        self.n_imports += 1

    def comment(self, text: str, kind: str, start: int, end: int, documents: str | None) -> None:
        bare = text.lstrip()
        is_doc = kind in ("doc", "docstring") or bare.startswith(("///", "//!", "/**", "/*!"))
        todo = next((t for t in TODO_KINDS if t in text), None)
        self.add("comment", id=f"{self.path}|{start}|{self.n_comments}|comment", documents_id=documents, file_path=self.path, kind="doc" if is_doc else kind, is_doc=is_doc, text=text, todo_kind=todo, start_byte=start, end_byte=end)
        self.n_comments += 1

    def inherits(self, child: dict, parent: str, kind: str) -> None:
        leaf = parent.rpartition("::")[2].rpartition(".")[2].split("<")[0].split("[")[0].strip()
        self.add("raw_inheritance", file_path=self.path, child_name=child["name"], child_kind=child["kind"], child_start_line=child["line"], child_start_col=child["col"], parent_leaf=leaf, parent_canonical=None, kind=kind)


def innermost(symbols: list[dict], byte: int) -> dict | None:
    """The last span, by start and then by length, that holds the byte."""
    held = [s for s in symbols if s["start"] <= byte <= s["end"]]
    return max(held, key=lambda s: (s["start"], -s["end"]), default=None)


def caller_of(symbols: list[dict], line: int) -> dict | None:
    """The shortest function-like symbol whose lines hold the line; of equals the last."""
    best = None
    for s in symbols:
        if s["kind"] in schemas.CALLABLES and s["line"] <= line <= s["last"] and (best is None or s["last"] - s["line"] <= best["last"] - best["line"]):
            best = s
    return best


def extract_file(path: str, language: str, text: str) -> Rows:
    facts = Facts(path, language, text)
    if language == "python":
        from lodestone.sources.python_facts import extract
    else:
        from lodestone.sources.lexed import extract
    extract(facts, text)
    return facts.rows


def extract(files: DataFrame) -> DataFrame:
    """``(table, file_path, ord, payload)``: all facts of all files, as JSON by table, cut once.  ``ord`` is the order of emission."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, language, text in zip(*[batch.column(c).to_pylist() for c in ("path", "language", "content")]):
                rows = extract_file(path, language, text or "")
                if rows:
                    columns = [pa.array([t for t, _ in rows]), pa.array([path] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array([json.dumps(r) for _, r in rows])]
                    yield pa.RecordBatch.from_arrays(columns, ["table", "file_path", "ord", "payload"])

    made = files.select("path", "language", "content").mapInArrow(run, "table string, file_path string, ord long, payload string")
    return materialize(made, "facts")


def facts_table(facts: DataFrame, name: str) -> DataFrame:
    """One table out of the tagged facts, with the file of each row as ``__file``; of rows with one key the last emitted stays."""
    schema = schemas.schema(name)
    rows = facts.where(F.col("table") == name).select("file_path", "ord", F.from_json("payload", schema).alias("r"))
    rows = rows.select(F.col("file_path").alias("__file"), F.col("ord").alias("__ord"), "r.*")
    if key := schemas.primary_key(name):
        rows = keep_last(rows, key, ["__file", "__ord"])
    return rows.drop("__ord")


def documents_next(comments: DataFrame, symbols: DataFrame) -> DataFrame:
    """Comments with ``documents_id`` of the next declaration in their file, for comments that have none: one window over both."""
    w = Window.partitionBy("file_path").orderBy("start_byte").rowsBetween(1, Window.unboundedFollowing)
    s = symbols.select("file_path", "start_byte", F.col("id").alias("symbol_id"), F.lit(None).cast("string").alias("comment_id"))
    c = comments.select("file_path", "start_byte", F.lit(None).cast("string").alias("symbol_id"), F.col("id").alias("comment_id"))
    after = s.unionByName(c).withColumn("next", F.first("symbol_id", ignorenulls=True).over(w)).where("comment_id is not null")
    return comments.join(after.select(F.col("comment_id").alias("id"), "next"), "id").withColumn("documents_id", F.coalesce("documents_id", "next")).drop("next")
