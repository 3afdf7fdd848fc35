"""Lookups read a small share of a table: by its order, by filters of row groups and by buckets of files."""

import pytest

from lodestone import schemas
from lodestone.catalog import BUCKETS, INDEXED, LAYOUT, OWNER, Catalog
from pyspark.sql import functions as F

ROWS = 240_000


def read(df):
    """Rows of ``df`` and how many rows its scan took out of the files, after row groups and pages were passed over."""
    rows = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return rows, leaf.metrics().apply("numOutputRows").value()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    catalog = Catalog(spark, str(tmp_path_factory.mktemp("indexed")), "/tree")
    hashed = F.sha2(F.col("id").cast("string"), 256)
    each = spark.range(ROWS).select(
        F.substring(hashed, 1, 16).alias("sid"), F.concat(F.lit("n"), (F.col("id") * 7919 % 60_000).cast("string")).alias("name"),
        F.concat(F.lit("src/f"), (F.col("id") % 400).cast("string"), F.lit(".py")).alias("file_path"),
    )
    filled = {"id": F.col("sid"), "name": F.col("name"), "file_path": F.col("file_path")}
    columns = [filled.get(f.name, F.lit("x" if f.dataType.typeName() == "string" else None)).cast(f.dataType).alias(f.name) for f in schemas.schema("symbol").fields]
    catalog.write("symbol", each.select(columns), owner="file_path", unique=True)
    big = each.select(F.lit("one.py").alias("file_path"), F.col("sid").alias("caller_id"), F.col("name").alias("callee_id"))
    catalog.write("call_edge", big, owner="file_path", unique=True)
    return catalog


def test_every_listed_column_exists(spark):
    for name, columns in [*LAYOUT.items(), *INDEXED.items()]:
        assert set(columns) <= {f.name for f in schemas.schema(name).fields}, name


def test_by_id(spark, store):
    """An id lies anywhere: all row groups but its own are passed over."""
    wanted = spark.range(1).select(F.substring(F.sha2(F.lit("4711"), 256), 1, 16)).first()[0]
    rows, seen = read(store.table("symbol").where(F.col("id") == wanted))
    assert len(rows) == 1 and rows[0]["file_path"] == f"src/f{4711 % 400}.py"
    assert seen <= 3 * ROWS / BUCKETS
    assert read(store.table("symbol").where("id = 'absent'"))[1] <= 2 * ROWS / BUCKETS


def test_by_name_in_order(store):
    """A table of one file is ordered by the callee: only the pages that may hold it are read."""
    rows, seen = read(store.table("call_edge").where("callee_id = 'n31337'"))
    assert len(rows) == ROWS / 60_000
    assert seen <= ROWS / 4


def test_by_file(store):
    rows, seen = read(store.of_files("symbol", "src/f7.py", "src/f11.py"))
    assert len(rows) == 2 * ROWS / 400 and {r["file_path"] for r in rows} == {"src/f7.py", "src/f11.py"}
    assert seen <= 3 * ROWS / BUCKETS
    assert store.of_files("symbol", "none.py").count() == 0 and store.of_files("symbol").count() == 0
    assert OWNER not in store.of_files("symbol", "src/f7.py").columns


def test_same_rows_as_a_scan(store):
    whole = store.table("symbol")
    some = [r["id"] for r in whole.where("name in ('n1', 'n59999')").collect()]
    plain = {r["id"] for r in whole.collect() if r["name"] in ("n1", "n59999")}
    assert set(some) == plain and len(some) == len(plain)


def test_it_is_the_filters_that_prune(spark, store):
    """The same lookup without bloom filters and dictionaries reads the whole table."""
    files = spark.read.option("parquet.filter.bloom.enabled", "false").option("parquet.filter.dictionary.enabled", "false").parquet(f"{store.path}/symbol")
    assert read(files.where("id = '4b2777777777777a'"))[1] > ROWS / 2
    files = spark.read.option("parquet.filter.dictionary.enabled", "false").parquet(f"{store.path}/symbol")
    assert read(files.where("id = '4b2777777777777a'"))[1] <= 2 * ROWS / BUCKETS
