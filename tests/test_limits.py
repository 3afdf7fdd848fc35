"""Statements that the SQL surface must refuse, and results without cut-offs."""

import json

import pytest

from lodestone.operators import report
from lodestone.operators.intervals import qualified_names
from lodestone.plans import guard
from lodestone.sources.facts import extract_file
from lodestone.sources.files import Ignored, classify


@pytest.fixture
def held(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int").createOrReplaceTempView("held")
    (tmp_path / "x").write_text("secret\n")
    return tmp_path / "x"


def test_refused(spark, held):
    for sql in (
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM held",
        "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT name FROM held WHERE name = (SELECT reflect('java.lang.System', 'getProperty', 'user.home'))",
        f"SELECT * FROM text.`{held}`",
        f"WITH `text.{held}` AS (SELECT 1) SELECT * FROM text.`{held}`",
        f"SELECT * FROM held WHERE name IN (SELECT value FROM text.`{held}`)",
        f"SELECT (SELECT max(value) FROM text.`{held}`) FROM held",
        "DROP VIEW held",
        f"INSERT OVERWRITE DIRECTORY '{held.parent}/y' USING text SELECT name FROM held",
    ):
        assert guard.query(spark, sql).startswith("ERROR"), sql
    assert not (held.parent / "y").exists()


def test_accepted(spark, held):
    for sql, rows in (
        ("SELECT count(*) AS n FROM held", [[2]]),
        ("WITH h AS (SELECT * FROM held) SELECT name FROM h WHERE n = (SELECT max(n) FROM held)", [["b"]]),
        ("SELECT name FROM held h WHERE EXISTS (SELECT 1 FROM held o WHERE o.n > h.n)", [["a"]]),
        ("SELECT upper(name) AS u, CASE WHEN n > 1 THEN 'x' END AS k FROM held ORDER BY n DESC LIMIT 1", [["B", "x"]]),
        ("SELECT * FROM VALUES (1), (2) AS t(x) WHERE x > 1", [[2]]),
    ):
        assert json.loads(guard.query(spark, sql))["rows"] == rows, sql


def test_names_of_any_depth_and_cycles(spark):
    rows = [(k, k - 1 if k else None, f"n{k}") for k in range(200)] + [(1000, 1001, "x"), (1001, 1000, "y"), (1002, 1001, "z"), (1003, 1003, "own")]
    tree = spark.createDataFrame(rows, "id long, up long, name string")
    names = {r["id"]: r["qualified_name"] for r in qualified_names(tree, "id", "up", "name", ".").collect()}
    assert names[199] == ".".join(f"n{k}" for k in range(200)) and names[1003] == "own"
    assert names[1000] is names[1001] is names[1002] is None


def test_every_finding_is_reported(spark):
    found = spark.range(12_000).selectExpr("id as ord", "'r' as review", "'low' as severity", "'f' as file", "cast(id as int) as line", "'m' as message")
    assert len(json.loads(report.render_json(found))["findings"]) == 12_000
    assert report.render_markdown(found).count("| low |") == 12_000 == report.render_terminal(found).count("  low ")


def test_anchored_patterns():
    rules = Ignored().with_file("", ["/build", "out", "a/b"])
    assert rules.drops("build", True) and not rules.drops("src/build", True) and rules.drops("src/out", True)
    assert rules.drops("a/b", True) and not rules.drops("x/a/b", True)


def test_classes_of_files(spark):
    tests = ["conftest.py", "a/FooSpec.java", "a/FooSpec.cs", "x_unittest.cpp", "test_x.cc", "testing/a.go", "a.Test.ts", "XTest.cpp", "t\\tests\\a.rs", "a/ATest.php"]
    others = ["a_spec.rb", "spec/a.py", "x_test.c", "ATests.php", "Test.cpp", "contest/a.py"]
    files = spark.createDataFrame([(p, "x") for p in tests + others] + [("g.py", "a\n# automatically generated\n"), ("h.py", "autogenerated")], "path string, content string")
    found = {r["path"]: r for r in classify(files).collect()}
    assert [p for p in tests if not found[p]["is_test"]] == [] == [p for p in others if found[p]["is_test"]]
    assert found["g.py"]["is_generated"] and not found["h.py"]["is_generated"]


def test_blocks_with_long_conditions():
    text = "function f() {\n  if (" + " && ".join(f"value{k} > {k}" for k in range(60)) + ") {\n    g();\n  }\n}\n"
    kinds = [row["kind"] for name, row in extract_file("f", "typescript", text) if name == "scope"]
    short = [row["kind"] for name, row in extract_file("f", "typescript", "function f() {\n  if (a) {\n    g();\n  }\n}\n") if name == "scope"]
    assert sorted(kinds) == sorted(short)
