"""Written tables."""

import os
import time

from pyspark.sql import functions as F

from tablelearn.llm.common import SHUFFLE_CLEANUP, Scratch


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for d in manager.localDirsString() for _, _, names in os.walk(d) for f in names
            if f.startswith("shuffle_") and f.endswith(".data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    """Those of every table of a long operator stayed on disk until the driver collected its garbage."""
    before, told = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    out = Scratch(spark).write(counted)
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert out.count() == 7 and spark.conf.get(SHUFFLE_CLEANUP) == told
    assert counted.count() == 7
