"""What cutting a table leaves on disk."""

import os
import time

from lodestone import scratch

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for local in top for d, _, files in os.walk(local) for f in files if f.startswith("shuffle_")}


def test_shuffle_files_go_when_a_table_is_cut(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    wide = spark.range(10_000).repartition(4, "id").groupBy("id").count()
    held = scratch.materialize(wide)
    for _ in range(50):  # files are deleted in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert held.count() == wide.count() == 10_000  # what led to the table can still be run
    assert spark.conf.get(CLEANUP) == setting
