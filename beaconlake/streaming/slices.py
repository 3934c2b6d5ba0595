"""Replays: rows that are there already, given to a stream in batches of bounded size and in their order.

Rows are worked out once, by as many tasks as Spark takes for them, and written in one folder for each slice. A slice's folder
appears to the stream in one step once the slice before it is done, so a slice is a batch whatever the number of its files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from beaconlake.functions.ranges import cuts, place
from beaconlake.sources.folder import Folder

#: About how many rows a batch has at most: what a task holds of one key does not grow beyond that.
ROWS = 12_000_000
#: Row groups small enough that several tasks read one file.
GROUP_BYTES = 8 << 20
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def replayed(rows: DataFrame, path: str, start: Callable[[DataFrame], StreamingQuery], *ends: int, order: str = "seq", most: int | None = None) -> None:
    """Runs the query that ``start`` makes of a stream over ``rows``, slice by slice, and stops it. Slices end before each of
    ``ends``. The query is to look for more as soon as a batch is done. There are no batches without rows between slices:
    timers go off in the next slice's batch."""
    spark = rows.sparkSession
    named = rows.where(F.col(order).isNotNull()).withColumn("slice_", place(order, cuts(rows, *ends, order=order, most=most or ROWS)))
    named.write.option("parquet.block.size", GROUP_BYTES).partitionBy("slice_").parquet(f"{path}/staged")
    folder, query = Folder(spark, path), None
    staged = [x for x in folder.names("staged") if x.startswith("slice_=")]
    try:
        for n, name in enumerate(sorted(staged, key=lambda x: int(x.split("=")[1]))):
            folder.rename(f"staged/{name}", f"in/{n}")
            if query is None:
                before = spark.conf.get(EMPTY_BATCHES)
                spark.conf.set(EMPTY_BATCHES, "false")
                try:
                    query = start(spark.readStream.schema(rows.schema).parquet(f"{path}/in/*"))
                finally:
                    spark.conf.set(EMPTY_BATCHES, before)
            query.processAllAvailable()
    finally:
        if query:
            query.stop()
