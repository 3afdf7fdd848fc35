"""Shared intermediate tables: the one way this library cuts lineage.

Every cut is a Parquet table in the folder that ``spark.checkpoint.dir`` names,
so a lost executor costs a re-read and never a recomputation of what came
before.  Nothing is kept in executor-local checkpoints.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder of the session.

    Reads ``spark.checkpoint.dir``.  Only a local-mode session (tests, a laptop)
    may go without: it gets a temporary folder.  On a cluster the setting is
    required, since a machine-local folder would be invisible to other machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    held = _LOCAL.get(spark.sparkContext.applicationId)
    if held is None:
        held = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return held


_LOCAL: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: By session: writers under way, and the setting from before the first.
_WRITERS: dict[str, tuple[int, str]] = {}
_LOCK = threading.Lock()
#: Paths made since the innermost ``only_result`` of this context began.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the scratch folder, removed when the driver's JVM ends."""
    path = f"{scratch_dir(spark)}/lodestone-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(there)
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What the session runs meanwhile deletes its shuffle files at its end, not when the driver happens to collect garbage.

    Writers of several threads may overlap; the last of a session to end puts its setting back.
    """
    name = spark._jsparkSession.sessionUUID()
    with _LOCK:
        n, before = _WRITERS.get(name) or (0, spark.conf.get(CLEANUP))
        _WRITERS[name] = n + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITERS.pop(name)
            if n > 1:
                _WRITERS[name] = n - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: computed once, lineage cut.

    The table replaces the shuffle files that led to it, which go at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytecode of a method from which on the JVM never compiles it; Spark's own limit is eight times as much.
COMPILED, METHOD_LIMIT = 8000, "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Plans made meanwhile aren't fused into methods too large for the JVM's compiler: a join's long condition ran interpreted."""
    before = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, COMPILED)
    try:
        yield
    finally:
        spark.conf.set(METHOD_LIMIT, before)


def only_result(make: Callable[[], DataFrame], label: str = "cut") -> DataFrame:
    """``make()`` cut as a table; the tables that were cut on the way to it are deleted then.

    What ``make`` hands out beside its result must not be read later.
    """
    held = _MADE.set([])
    try:
        df = make()
        passing = _MADE.get()
    finally:
        _MADE.reset(held)
    result = materialize(df, label)
    for path in passing:
        drop(df.sparkSession, path)
    return result


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no later plan reads."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
