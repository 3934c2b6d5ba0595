"""Reading tables and keeping intermediate results where every executor can see them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from beaconlake.sources.shared import written

#: Most bytes and rows of an Arrow batch. Texts differ in length a thousandfold, so a bound in rows alone, as
#: Spark has it by default, does not bound what a task holds.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs only its unfinished tasks. Unlike checkpoint()
    the copy is columnar, so later reads prune columns.
    """
    return written(df, name)


def map_texts(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in batches of bounded size; a task gives its buffers back when it ends."""
    bounded_batches(rows.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(task, schema)


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's bounds of Arrow batches where the user has set none. Spark reads them when a plan runs,
    after an operator has returned it, so they stay set."""
    for key, bound in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(bound))
