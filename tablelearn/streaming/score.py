"""Score a file stream with a fitted model.

Fitted models here are small parameter tables inlined as literal
expressions, so a model's ``transform`` / ``predict`` works unchanged on a
streaming DataFrame (stateless, narrow projection).  ``run_available`` runs a
``readStream`` -> transform -> parquet ``writeStream`` with the
``availableNow`` trigger (all files present, then stop) and returns the
written result as a batch DataFrame.  Output and stream checkpoint live under
the session's shared checkpoint folder.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def parquet_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 64
                   ) -> DataFrame:
    """A parquet stream over ``path``: a folder, or one file (its folder is
    watched with a glob filter for that name)."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if os.path.isfile(path):
        reader = reader.option("pathGlobFilter", os.path.basename(path))
        path = os.path.dirname(path)
    return reader.parquet(path)


def run_available(spark: SparkSession, stream: DataFrame,
                  transform: Callable[[DataFrame], DataFrame],
                  out_dir: str | None = None) -> DataFrame:
    base = ensure_checkpoint_dir(spark)
    run = uuid.uuid4().hex
    out_dir = out_dir or os.path.join(base, f"stream-out-{run}")
    chk = os.path.join(base, f"stream-chk-{run}")
    q = (transform(stream).writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", chk).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_dir)
