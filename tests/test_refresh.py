"""A store that is refreshed equals one that is built anew, after any sequence of changes."""

import os
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lodestone import catalog, schemas
from lodestone.catalog import validate
from lodestone.engine import Engine
from lodestone.streaming.refresh import file_stream, refresh

TREE = {
    "a.py": "from b import help\nclass A:\n    def go(self):\n        return self.stop()\n    def stop(self):\n        return help(1)\n",
    "b.py": "import a\n\ndef help(x: int) -> int:\n    return x\n",
    "c/d.py": "from c.e import Base\nclass D(Base):\n    def run(self, x: Base):\n        x.work()\n",
    "c/e.py": "class Base:\n    def work(self):\n        pass\n",
    "src/m.rs": "mod n;\nuse crate::n::Shape;\npub struct M;\nimpl Shape for M { fn area(&self) -> i32 { helper() } }\n// TODO later\npub fn helper() -> i32 { 1 }\n",
    "src/n.rs": "/// a shape\npub trait Shape { fn area(&self) -> i32; }\n",
    "w/Use.cs": "using My.Space;\nnamespace Other { class U : Thing { void F() { Make(); } } }\n",
    "w/Space.cs": "namespace My.Space { public class Thing { public void Make() {} } }\n",
    "t/x.ts": "import { q } from './y';\nexport function p(a: Q) { return q(a); }\n",
    "t/y.ts": "export interface Q { z: number }\nexport function q(a: Q): Q { return a; }\n",
}


def put(root, tree):
    for path, text in tree.items():
        there = root / path
        there.parent.mkdir(parents=True, exist_ok=True)
        there.write_text(text)


def contents(engine):
    return {t: sorted((tuple(r) for r in engine.table(t).collect()), key=repr) for t in schemas.TABLES}


@pytest.fixture
def tree(tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "BUCKETS", 3)
    root = tmp_path / "tree"
    put(root, TREE)
    return root


def same_as_built(spark, engine, tmp_path, label):
    fresh = Engine(spark, str(tmp_path / f"again-{label}"), str(engine.root)).open()
    mine, theirs = contents(engine), contents(fresh)
    for name in schemas.TABLES:
        assert mine[name] == theirs[name], (label, name)
        assert validate(engine.table(name), name) == {}


STEPS = [
    {"b.py": "def help(x):\n    return other(x)\n\ndef other(x):\n    return help(x)\n", "b/__init__.py": "from b import help\n", "src/n.rs": None},
    {"c/e.py": None, "src/n.rs": "pub trait Form { }\npub fn helper() {}\n", "w/Space.cs": "namespace My.Room { public class Thing { } }\n", "lib/c/e.py": "class Base:\n    def work(self): pass\n    def more(self): self.work()\n"},
]


def bucket_files(engine, table):
    top = f"{engine.catalog.path}/{table}"
    return {os.path.join(d, x) for d, _, names in os.walk(top) for x in names if x.endswith(".parquet")}


def test_refresh_equals_a_fresh_build(spark, tree, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "house"), str(tree)).open()
    draw, texts = random.Random(11), list(TREE.items())
    for step in STEPS:
        for path, text in step.items():
            if text is None:
                os.remove(tree / path)
        put(tree, {p: t for p, t in step.items() if t is not None})
        if step is STEPS[-1]:
            for path, _ in draw.sample(texts, 4):  # any other file's text of the same language, or none
                if (tree / path).exists() and draw.random() < 0.4:
                    os.remove(tree / path)
                else:
                    put(tree, {path: draw.choice([t for p, t in texts if p.rpartition(".")[2] == path.rpartition(".")[2]]) + "\n\n"})
            engine.refresh()
        else:
            assert sum(engine.refresh().values()) == len(step)
    same_as_built(spark, engine, tmp_path, "last")

    # only the buckets of changed files are written
    before = bucket_files(engine, "symbol")
    own = spark.createDataFrame([("a.py",)], "path string").select(catalog.bucket(F.col("path"))).first()[0]
    put(tree, {"a.py": "def lone(): pass\n"})
    # and a failure on the way leaves a store that is built anew
    monkeypatch.setattr(engine, "_calls", lambda sites: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        engine.refresh()
    changed = before ^ bucket_files(engine, "symbol")
    assert changed and all(f"{catalog.BUCKET}={own}" in p for p in changed)
    built = []
    engine.catalog.open(lambda c: built.append(c))
    assert built == [engine.catalog]


def test_stream(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "house"), str(tree)).open()

    def run():
        refresh(engine, file_stream(spark, str(tree)), str(tmp_path / "cp")).awaitTermination()

    before = contents(engine)
    run()
    assert contents(engine) == before
    os.remove(tree / "c/e.py")
    put(tree, {".gitignore": "t/\n", "new.py": "from a import A\nA()\n", "b/__init__.py": "import new\n"})
    run()
    assert engine.refresh() == {}
    assert {r["path"] for r in engine.table("file").collect()} == {p for p in TREE if p != "c/e.py" and not p.startswith("t/")} | {"new.py", "b/__init__.py"}
    assert {tuple(r) for r in engine.table("imports").where("importer_file_id in ('new.py', 'b/__init__.py', 'c/d.py')").collect()} == {("new.py", "a.py"), ("b/__init__.py", "new.py")}
    assert engine.table("symbol").where("file_path = 'c/e.py' or file_path like 't/%'").count() == 0


def test_a_store_that_isn_t_there(spark, tmp_path):
    with pytest.raises(AnalysisException):
        Engine(spark, str(tmp_path / "house"), str(tmp_path)).refresh(spark.createDataFrame([], schemas.schema("file")))
