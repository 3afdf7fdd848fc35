"""From a source tree to answers: build the fact store, resolve it, query it, collect findings."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.catalog import OWNER, Catalog
from lodestone.operators import report
from lodestone.plans import guard
from lodestone.plans.resolution import callers_reached, heirs_reached, importers_reached, namespaces, resolve_calls, resolve_imports, resolve_inheritance
from lodestone.scratch import materialize
from lodestone.sources import files as trees
from lodestone.sources.facts import documents_next, extract, facts_table

#: Tables that extraction gives as they are.
FACTS = [t for t in schemas.TABLES if t not in ("file", "file_classification", "build_meta", "imports", "call_edge", "extends", "implements", "comment")]

#: Tables that are written at once: each is a few small jobs.
AT_ONCE = 8


def each(write: Callable[[str], None]) -> None:
    """Calls ``write`` for every table of FACTS, some at once; the first failure is raised."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        list(pool.map(write, FACTS))


#: A review asks an engine questions and reports findings: ``review(engine, report)``.
Reviewer = Callable[["Engine", Callable[..., None]], None]


class Engine:
    def __init__(self, spark: SparkSession, warehouse: str, root: str):
        self.spark, self.root = spark, root
        self.catalog = Catalog(spark, warehouse, root)

    def open(self, rebuild: bool = False, languages: list[str] | None = None, max_bytes: int | None = None) -> Engine:
        """Reuses the root's store, or builds it; then registers every table as a view."""
        self.catalog.open(lambda c: self.build(trees.load(self.spark, self.root, languages, max_bytes)), rebuild)
        self.catalog.register()
        guard.register_aliases(self.spark)
        return self

    def build(self, files: DataFrame) -> None:
        """All tables from ``file`` rows: one pass of extraction, then joins."""
        c = self.catalog
        c.write("file", files, "path")
        files = c.table("file")
        facts = extract(files)
        each(lambda name: c.write(name, facts_table(facts, name), OWNER, unique=True))
        c.write("comment", self._comments(facts, c.table("symbol"), c.table("span")), "file_path")
        c.write("file_classification", trees.classify(files), "path")
        c.write("imports", resolve_imports(c.table("raw_import"), files, c.table("symbol")), "importer_file_id")
        for name, rows in self._inheritance(c.table("raw_inheritance")).items():
            c.write(name, rows, OWNER)
        c.write("call_edge", self._calls(c.table("call_site")), "file_path")

    def _comments(self, facts: DataFrame, symbol: DataFrame, span: DataFrame) -> DataFrame:
        starts = span.select(F.col("entity_id").alias("id"), "start_byte")
        declared = symbol.where(~F.col("kind").isin("parameter", "variable", "field")).join(starts, "id")
        comments = facts_table(facts, "comment").drop(OWNER)
        python = F.col("file_path").rlike(r"\.pyi?$") | (F.col("kind") == "docstring")
        return documents_next(comments.where(~python), declared).unionByName(comments.where(python))

    def _inheritance(self, raw: DataFrame) -> dict[str, DataFrame]:
        """Both tables of ``raw``, each row with the file of what inherits."""
        c = self.catalog
        extends, implements = resolve_inheritance(raw, c.table("symbol"), c.table("imports"))
        own = c.table("symbol").select(F.col("id").alias("__id"), F.col("file_path").alias(OWNER))
        return {n: r.join(own, F.col(k) == F.col("__id")).drop("__id") for n, r, k in (("extends", extends, "child_id"), ("implements", implements, "impl_id"))}

    def _calls(self, sites: DataFrame) -> DataFrame:
        return resolve_calls(sites, *[self.catalog.table(t) for t in ("symbol", "imports", "local_type", "parameter", "field_type", "type")])

    def refresh(self, files: DataFrame | None = None) -> dict[str, int]:
        """Brings the store up to what ``files`` (all of the tree; by default its present state) holds.

        Files that came, changed or went are told by their contents.  Returns how many of each.
        """
        now = materialize(files if files is not None else trees.load(self.spark, self.root), "tree")
        old = self.catalog.table("file").select("path", *[F.col(c).alias(f"__{c}") for c in ("language", "repo_id", "content")], F.lit(True).alias("__there"))
        both = now.withColumn("__here", F.lit(True)).join(old, "path", "full")
        same = F.col("language").eqNullSafe(F.col("__language")) & F.col("repo_id").eqNullSafe(F.col("__repo_id")) & F.col("content").eqNullSafe(F.col("__content"))
        state = F.when(F.col("__there").isNull(), "added").when(F.col("__here").isNull(), "deleted").when(~same, "changed")
        changes = materialize(both.select("path", state.alias("state")).where("state is not null"), "changes")
        self.apply(now, changes)
        return {s: n for s, n in changes.groupBy("state").count().collect()}

    def apply(self, files: DataFrame, changes: DataFrame) -> None:
        """Applies ``changes`` (path; state added, changed or deleted); ``files`` has at least the rows that are there now.

        Only changed files are extracted.  Of the resolved tables, those rows are made anew
        that belong to changed files or that a change can reach: imports whose candidate names
        a file that came or went has, what inherits from or calls or is typed by a name that a
        changed file declares or declared, and all of a file whose imports may differ.  Every
        table is overwritten in the buckets of such files alone.  A failure on the way leaves
        the store without its version, and the next ``open`` builds it.
        """
        if changes.isEmpty():
            return
        c = self.catalog
        touched = changes.select("path")
        fresh = materialize(files.join(touched, "path", "left_semi"), "fresh")
        facts = extract(fresh)
        own = touched.withColumnRenamed("path", "file_path")
        both = c.table("symbol").join(own, "file_path", "left_semi").unionByName(facts_table(facts, "symbol").drop(OWNER))
        both = materialize(both, "both")
        names, spaces = both.select("name").distinct(), namespaces(both)
        c.mark(None)
        own_buckets = c.buckets(touched)
        c.replace("file", touched, own_buckets, fresh, "path")
        each(lambda name: c.replace(name, touched, own_buckets, facts_table(facts, name), OWNER, True))
        c.replace("comment", touched, own_buckets, self._comments(facts, c.table("symbol").join(own, "file_path", "left_semi"), c.table("span").join(own, "file_path", "left_semi")), "file_path")
        c.replace("file_classification", touched, own_buckets, trees.classify(fresh), "path")

        def of(name: str, some: DataFrame) -> DataFrame:
            return c.table(name).join(some.select(F.col("path").alias("file_path")), "file_path", "left_semi")

        moved = changes.where("state <> 'changed'")
        importers = materialize(importers_reached(c.table("raw_import"), moved, spaces).unionByName(touched).distinct(), "importers")
        c.replace("imports", importers, c.buckets(importers), resolve_imports(of("raw_import", importers), c.table("file"), c.table("symbol")), "importer_file_id")
        heirs = materialize(heirs_reached(c.table("raw_inheritance"), names).unionByName(importers).distinct(), "heirs")
        for name, rows in self._inheritance(of("raw_inheritance", heirs)).items():
            c.replace(name, heirs, c.buckets(heirs), rows, OWNER)
        tables = [c.table(t) for t in ("call_site", "symbol", "local_type", "parameter", "field_type", "type")]
        callers = materialize(callers_reached(*tables, names).unionByName(importers).distinct(), "callers")
        c.replace("call_edge", callers, c.buckets(callers), self._calls(of("call_site", callers)), "file_path")
        c.mark(schemas.VERSION)
        c.register()

    def table(self, name: str) -> DataFrame:
        return self.catalog.table(name)

    def query(self, sql: str, params: Mapping[str, Any] | None = None) -> str:
        return guard.query(self.spark, sql, params)

    def read_source(self, path: str, start: int = 1, end: int = guard.MAX_LINES) -> str:
        return guard.read_source(self.catalog.of_files("file", path), path, start, end)


def run_reviews(engine: Engine, reviews: Mapping[str, Reviewer], workers: int = 4) -> tuple[DataFrame, list[str]]:
    """Findings of all reviews with the order they were reported in, and the reviews that failed.

    What a review reported before it failed is kept.
    """

    def one(item: tuple[str, Reviewer]) -> tuple[str, list[tuple], bool]:
        name, review = item
        rows: list[tuple] = []

        def say(severity: str, file: str, message: str, line: int | None = None) -> None:
            if severity not in report.SEVERITIES:
                raise ValueError(f"no such severity: {severity}")
            rows.append((name, severity, file, line, message))

        try:
            review(engine, say)
        except Exception:  # a review is foreign code; its failure is a result
            return name, rows, False
        return name, rows, True

    with ThreadPoolExecutor(workers) as pool:
        done = list(pool.map(one, reviews.items()))
    rows = [row for _, own, _ in done for row in own]
    found = engine.spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], f"ord long, {report.FINDING}")
    return found, [name for name, _, ok in done if not ok]
