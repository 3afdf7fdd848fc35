"""The store of facts: one Parquet table for each relation, built once for a root and reused while its version holds.

Every row belongs to a source file, whose path is kept beside the declared columns.  Tables
are partitioned by a bucket of that path, so a change of some files overwrites the buckets
of those files and leaves the rest of the table alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions.ids import fnv1a64
from lodestone.operators.dedupe import keep_last
from lodestone.scratch import drop, materialize

#: Columns that lookups filter on: tables are laid out by them, so the statistics of row groups and pages prune.
LAYOUT = {
    "symbol": ["name"], "imports": ["imported_id"], "comment": ["file_path"], "occurrence": ["name"], "binding": ["name"],
    "scope": ["file_path"], "call_site": ["callee_name"], "call_edge": ["callee_id"], "extends": ["parent_id"],
}
#: Columns of further lookups, on which the rows aren't ordered: a Parquet bloom filter for each row group prunes (a dictionary does where there is a whole one).
INDEXED = {
    "symbol": ["id", "file_path"], "imports": ["importer_file_id"], "occurrence": ["enclosing_symbol_id"], "binding": ["scope_id"],
    "call_site": ["id", "caller_id"], "call_edge": ["caller_id"], "extends": ["child_id"], "comment": ["documents_id"],
}

#: The columns beside the declared ones: the file that a row belongs to, and its bucket.
OWNER, BUCKET = "__file", "__bucket"
#: Buckets of a table.  A refresh rewrites whole buckets: more of them suit stores of more files.
BUCKETS = 16


class Catalog:
    """Fact tables under ``<warehouse>/<hash of root>``."""

    def __init__(self, spark: SparkSession, warehouse: str, root: str):
        self.spark, self.path = spark, f"{warehouse.rstrip('/')}/{fnv1a64(root):016x}"

    def table(self, name: str) -> DataFrame:
        return self._stored(name).select([f.name for f in schemas.schema(name).fields])

    def of_files(self, name: str, *paths: str) -> DataFrame:
        """The rows of a table that belong to the files ``paths``: of their buckets alone, whose numbers are known when the query is planned."""
        rows = self._stored(name)
        if not paths:
            return self.table(name).limit(0)
        numbers = [bucket(F.lit(p)) for p in paths]
        return rows.where(F.col(BUCKET).isin(numbers) & F.col(OWNER).isin(*paths)).select(self.table(name).columns)

    def _stored(self, name: str) -> DataFrame:
        schema = schemas.schema(name).add(OWNER, "string").add(BUCKET, "integer")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], schemas.schema(name))

    def _prepared(self, name: str, rows: DataFrame, owner: str | None, order: list[str] | None, unique: bool) -> DataFrame:
        """Declared columns, the owner and its bucket; of rows with one key, the last in ``order`` stays."""
        key = schemas.primary_key(name)
        if key and order:
            rows = keep_last(rows, key, order)
        elif key and not unique:
            rows = rows.dropDuplicates(key)
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.schema(name).fields]
        return rows.select(*columns, (F.col(owner) if owner else F.lit("")).alias(OWNER)).withColumn(BUCKET, bucket(F.col(OWNER)))

    def _put(self, name: str, rows: DataFrame, mode: str) -> None:
        by = [BUCKET, *LAYOUT.get(name, [OWNER])]
        filters = {f"parquet.bloom.filter.enabled#{c}": "true" for c in INDEXED.get(name, [])} | {"parquet.bloom.filter.adaptive.enabled": "true"}
        rows.hint("rebalance", BUCKET).sortWithinPartitions(*by).write.mode(mode).options(**filters).partitionBy(BUCKET).parquet(f"{self.path}/{name}")

    def write(self, name: str, rows: DataFrame, owner: str | None = None, order: list[str] | None = None, unique: bool = False) -> None:
        """Writes a whole table; ``owner`` names the column with the path of each row's file; ``unique`` says that no key is there twice."""
        self._put(name, self._prepared(name, rows, owner, order, unique), "overwrite")

    def buckets(self, files: DataFrame) -> list[int]:
        """The buckets of ``files`` (a column ``path``): at most BUCKETS numbers come to the driver."""
        return sorted(r[0] for r in files.select(bucket(F.col("path"))).distinct().collect())

    def replace(self, name: str, files: DataFrame, buckets: list[int], rows: DataFrame, owner: str | None, unique: bool = False) -> None:
        """Puts ``rows`` in the place of all rows of ``files``, which lie in ``buckets``: only these are read and written.

        The new state of the buckets is cut as a table before the old one goes.  What fails
        in between loses them, so callers take the version's mark away first.
        """
        touched = files.select(F.col("path").alias(OWNER)).distinct()
        kept = self._stored(name).where(F.col(BUCKET).isin(buckets)).join(touched, OWNER, "left_anti")
        fresh = self._prepared(name, rows, owner, None, unique)
        merged = materialize(kept.select(fresh.columns).unionByName(fresh), "merged")
        for n in buckets:
            drop(self.spark, f"{self.path}/{name}/{BUCKET}={n}")
        self._put(name, merged, "append")

    def version(self) -> int | None:
        try:
            found = self.table("build_meta").where("key = 'schema_version'").first()
        except AnalysisException:
            return None
        return int(found["value"]) if found else None

    def open(self, build: Callable[[Catalog], None], rebuild: bool = False) -> Catalog:
        """Reuses the store of the present version, or builds it; a store without its version mark was never finished."""
        if rebuild or self.version() != schemas.VERSION:
            build(self)
            self.mark(schemas.VERSION)
        return self

    def mark(self, version: int | None) -> None:
        """Says which version the store is of; none while it is changed, so that what a failure leaves is built anew."""
        rows = [("schema_version", str(version))] if version is not None else []
        self.write("build_meta", self.spark.createDataFrame(rows, schemas.schema("build_meta")))

    def register(self) -> None:
        """Every table as a temporary view; tables that were never written are empty."""
        for name in schemas.TABLES:
            try:
                rows = self.table(name)
                rows.schema  # noqa: B018  resolves the path
            except AnalysisException:
                rows = self.empty(name)
            rows.createOrReplaceTempView(name)

    def clean(self) -> None:
        jvm = self.spark.sparkContext._jvm
        there = jvm.org.apache.hadoop.fs.Path(self.path)
        there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def bucket(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def validate(rows: DataFrame, name: str) -> dict[str, int]:
    """Counts of broken promises: nulls in columns that may not be null, keys that occur twice."""
    fields = [f for f in schemas.schema(name).fields if not f.nullable]
    nulls = rows.agg(*[F.count_if(F.col(f.name).isNull()).alias(f.name) for f in fields]).first().asDict()
    key = schemas.primary_key(name)
    twice = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").count() if key else 0
    return {f"null {k}": v for k, v in nulls.items() if v} | ({"repeated key": twice} if twice else {})
