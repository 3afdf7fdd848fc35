"""Incremental refresh: new files as a stream, each batch applied to the store as a change of its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.engine import Engine
from lodestone.operators.dedupe import keep_last
from lodestone.scratch import materialize
from lodestone.sources import files as trees


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    """``file`` rows, with their time, of files that appear below the root; paths are relative to it.

    Spark shows a path once: a file that changes in place is found by ``Engine.refresh``.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).schema(schema).load(root)
    return trees.file_rows(rows, root).withColumn("time", F.col("modificationTime")).drop("modificationTime")


def refresh(engine: Engine, stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Applies each batch of ``file_stream`` to the engine's store, which must have been opened.

    Files that are gone, or that the ignore
    files exclude now, go with the batch that is applied next.  Files whose contents the
    store has already are left alone, so a batch that is replayed after a failure changes
    nothing more.
    """

    def apply(batch: DataFrame, _: int) -> None:
        rows = keep_last(materialize(batch, "batch"), ["path"], ["time", "content"]).drop("time")
        listed = materialize(trees.listing(engine.spark, engine.root), "listing")
        if local := trees.local_folder(engine.root):  # streams of files don't show names that begin with an underscore
            unseen = trees.read_local(listed.where(F.col("path").rlike("(^|/)_")), local)
            rows = rows.unionByName(trees.file_rows(unseen, ""))
        rows = materialize(rows.join(listed, "path", "left_semi"), "kept")
        old = engine.table("file").select("path", F.col("content").alias("__content"), F.lit(True).alias("__there"))
        state = F.when(F.col("__there").isNull(), "added").when(~F.col("content").eqNullSafe(F.col("__content")), "changed")
        new = rows.join(old, "path", "left").select("path", state.alias("state")).where("state is not null")
        gone = engine.table("file").select("path").join(listed, "path", "left_anti").select("path", F.lit("deleted").alias("state"))
        engine.apply(rows, materialize(new.unionByName(gone), "changes"))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
