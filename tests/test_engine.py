"""The whole way: a tree of files, the store, the guarded SQL surface, findings."""

import json

import pytest

from lodestone import schemas
from lodestone.catalog import Catalog, validate
from lodestone.engine import Engine, run_reviews
from lodestone.functions.ids import fnv1a64, fnv_series
from lodestone.operators import report
from lodestone.plans import guard, hints
from lodestone.sources import files as trees

import pandas as pd


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "a.py").write_text("from b import help\nclass A:\n    def go(self):\n        return self.stop()\n    def stop(self):\n        return help(1)\n")
    (root / "b.py").write_text("import a\n\ndef help(x: int) -> int:\n    return x\n\ndef lonely():\n    pass\n")
    (root / "skip.py").write_text("x = 1\n")
    (root / "tests").mkdir()
    (root / "tests/test_a.py").write_text("from b import help\ndef test_help():\n    assert help(1)\n")
    (root / ".gitignore").write_text("skip.py\nbuild/\n")
    (root / "build").mkdir()
    (root / "build/c.py").write_text("y = 2\n")
    (root / "bad.py").write_bytes(b"\xff\xfe x")
    return Engine(spark, str(tmp_path_factory.mktemp("house")), str(root)).open()


def test_discovery(engine):
    assert {r["path"] for r in engine.table("file").collect()} == {"a.py", "b.py", "tests/test_a.py"}
    assert trees.discover(engine.root) == ["a.py", "b.py", "bad.py", "tests/test_a.py"]


def test_tables_keep_their_promises(engine):
    for name in schemas.TABLES:
        assert validate(engine.catalog.spark.table(name), name) == {}, name


def test_resolved_edges(engine):
    spark = engine.spark
    assert {tuple(r) for r in engine.table("imports").collect()} == {("a.py", "b.py"), ("b.py", "a.py"), ("tests/test_a.py", "b.py")}
    edges = hints.callees(engine.table("call_edge"), engine.table("symbol"), "go")
    assert [tuple(r) for r in edges.collect()] == [("stop", "a.py")]
    assert {r["name"] for r in hints.callers(engine.table("call_edge"), engine.table("symbol"), "help").collect()} == {"stop", "test_help"}
    assert [tuple(r) for r in hints.import_cycles2(spark.table("imports")).collect()] == [("a.py", "b.py")]
    assert [tuple(r) for r in hints.test_map(spark.table("call_edge"), spark.table("symbol"), spark.table("file_classification")).collect()] == [("test_help", "help")]
    assert "lonely" in {r["name"] for r in hints.dead_exports(spark.table("symbol"), spark.table("occurrence")).collect()}
    assert {r["node"] for r in hints.dependencies(spark.table("imports"), "tests/test_a.py").collect()} == {"a.py", "b.py"}


def every_analysis(spark):
    t = spark.table
    yield from (hints.histogram(t("symbol"), "kind"), hints.biggest_files(t("file")), hints.source_files(t("file"), t("file_classification")), hints.declarations(t("symbol"), "a.py"))
    yield from (hints.symbol_span(t("symbol"), t("span"), "go"), hints.longest_functions(t("symbol"), t("span")), hints.references(t("occurrence"), "go"))
    yield from (hints.callers(t("call_edge"), t("symbol"), "go"), hints.callees(t("call_edge"), t("symbol"), "go"), hints.reachable_callers(t("call_edge"), t("symbol"), "go"))
    yield from (hints.who_imports(t("imports"), "a.py"), hints.hub_files(t("imports")), hints.god_files(t("imports")), hints.coupling(t("imports")), hints.dependencies(t("imports"), "a.py"))
    yield from (hints.import_cycles2(t("imports")), hints.import_cycles3(t("imports")), hints.layer_violations(t("imports"), "a", "b"), hints.dead_exports(t("symbol"), t("occurrence")))
    yield from (hints.inheritance_pairs(t("extends"), t("symbol")), hints.inheritance_depth(t("extends")), hints.duplicate_names(t("symbol")), hints.nesting_depth(t("scope")))
    yield from (hints.test_map(t("call_edge"), t("symbol"), t("file_classification")), hints.first_declarations(t("symbol")))


def test_every_analysis_runs(engine, spark):
    assert all(found.columns and found.count() >= 0 for found in every_analysis(spark))


def test_analyses_run_on_an_empty_catalog(spark, tmp_path):
    Catalog(spark, str(tmp_path), "none").register()
    assert all(found.count() == 0 for found in every_analysis(spark))


def test_dead_exports_leave_out_variables(spark):
    symbol = spark.createDataFrame([("1", n, k, "a", True) for n, k in (("f", "function"), ("v", "variable"), ("p", "parameter"))], "id string, name string, kind string, file_path string, exported boolean")
    occurrence = spark.createDataFrame([], "name string, file_path string")
    assert [r["name"] for r in hints.dead_exports(symbol, occurrence).collect()] == ["f"]


def test_store_is_reused(engine):
    def build(_):
        raise AssertionError("built again")

    engine.catalog.open(build)
    engine.catalog.register()


@pytest.mark.parametrize("sql", ["DROP TABLE symbol", "INSERT INTO symbol SELECT * FROM symbol", "SELECT * FROM parquet.`/etc`", "CREATE TABLE x AS SELECT 1", "WITH x AS (SELECT 1) INSERT INTO symbol SELECT * FROM x", "SELECT * FROM nowhere", "SET a=b"])
def test_guard_refuses(engine, sql):
    assert engine.query(sql).startswith("ERROR"), sql


def test_guard_answers(engine):
    found = json.loads(engine.query("-- a comment\nSELECT CAST(1 AS DECIMAL(10,2)) AS d, array(1, 2) AS l, name FROM symbol WHERE name = $n", {"n": "go"}))
    assert found["rows"] == [["1.00", [1, 2], "go"]] and found["truncated"] is False
    many = json.loads(engine.query("SELECT explode(sequence(1, 300)) AS x"))
    assert len(many["rows"]) == 200 and many["total_rows"] == 300 and many["truncated"]
    assert json.loads(engine.query("SELECT name FROM symbol WHERE false"))["headers"] == ["name"]


def test_read_source(engine):
    assert engine.read_source("b.py", 3, 4) == "3\tdef help(x: int) -> int:\n4\t    return x"
    assert engine.read_source("none.py").startswith("ERROR")


def test_findings(engine):
    def good(e, say):
        say("low", "b", "x|y\nz", 3)
        say("high", "a", "m")

    def bad(e, say):
        say("info", "c", "kept")
        raise RuntimeError

    found, failed = run_reviews(engine, {"one": good, "two": bad})
    assert failed == ["two"]
    assert [r["file"] for r in report.sort_findings(found).collect()] == ["a", "b", "c"]
    text = report.render_markdown(found, failed)
    assert "| low | b:3 | x\\|y z |" in text and "- two" in text
    assert "one (2 findings)" in report.render_terminal(found) and "two (1 finding)" in report.render_terminal(found)
    assert len(json.loads(report.render_json(found, failed))["findings"]) == 3


def test_fnv():
    texts = ["", "a", None, "foobar", "é"]
    assert list(fnv_series(pd.Series(texts))) == [None if t is None else f"{fnv1a64(t):016x}" for t in texts]
    assert f"{fnv1a64('foobar'):016x}" == "85944171f73967e8"
