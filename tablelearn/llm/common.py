"""Helpers shared by the operators: name-safe columns, written tables, Arrow maps.

Written tables: an intermediate result that is used more than once, or that
ends an iteration, is written as Parquet under the shared checkpoint folder
(``spark.checkpoint.dir``) and read back.  Executors that hold part of it can
be lost without losing rows.  ``Scratch`` remembers the tables of one call
and drops those that later steps no longer read.  The shuffle files behind a
table go as soon as it is written; else they would stay until the driver
happens to collect its garbage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package, table_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def col(name: str) -> Column:
    """A column by its exact name, even if it holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def need(df: DataFrame, *names: str) -> None:
    """Raise unless every name is a column of ``df`` exactly once."""
    for n in names:
        found = df.columns.count(n)
        if found != 1:
            raise ValueError(f"column {n!r} found {found} times in {df.columns}")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Parquet tables of one operator call in the shared checkpoint folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = ensure_checkpoint_dir(spark).rstrip("/")

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/llm-{uuid.uuid4().hex}"
        before = self.spark.conf.get(SHUFFLE_CLEANUP)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete written tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


def take(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under the given names: ``take(df, id="doc_id")``.

    Columns are found by their exact name, so that others whose names differ
    in case, or hold dots, do no harm.
    """
    need(df, *columns.values())
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{df.columns.index(c)}").alias(n) for n, c in columns.items()])


BATCH_ROWS = 1_000
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, since rows hold whole texts.

    Leaves a session alone whose number of rows in a batch was set by its user.
    """
    if int(spark.conf.get(BATCH_KEY)) == 10_000:       # Spark's own value
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


def map_batches(df: DataFrame, fn: Callable[[list[pa.Array]], list[pa.Array]],
                out: list[tuple[str, str]], done: Callable[[], None] | None = None,
                rows: int | None = None) -> DataFrame:
    """``mapInArrow`` of a function from a batch's columns to the columns ``out``.

    Columns go by position, so any names will do.  ``done`` runs at the end of
    each task, to let go of what its worker has gathered.  ``rows`` is how many
    rows the function gets at once, at most; a batch's if not given.
    """
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)
    names = [f"_{i}" for i in range(len(out))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, rows or b.num_rows or 1):
                part = b.slice(lo, rows) if rows else b
                yield pa.RecordBatch.from_arrays(fn(part.columns), names=names)
        if done:
            done()

    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    schema = ", ".join(f"{n} {kind}" for n, (_, kind) in zip(names, out, strict=True))
    return plain.mapInArrow(run, schema).toDF(*[n for n, _ in out])


def pieces_of(texts: pa.Array, chars: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array that hold about ``chars`` bytes each, ``rows`` at most.

    Bounds what a kernel holds at once; a single longer text is a range of
    its own.
    """
    lengths = pc.binary_length(texts).to_pylist()
    lo = size = 0
    for i, n in enumerate(lengths):
        if i > lo and (size + (n or 0) > chars or i - lo >= rows):
            yield lo, i
            lo, size = i, 0
        size += n or 0
    if lo < len(lengths):
        yield lo, len(lengths)
