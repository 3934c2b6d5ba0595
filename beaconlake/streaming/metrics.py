"""The counters of a running stream, kept as a table."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from beaconlake.sources.folder import Folder


class MetricsLog(StreamingQueryListener):
    """Writes what each batch observed as one small file, named by query and batch: a batch that is run again after a
    restart overwrites its own. Batches without input report nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder, self.ended = Folder(spark, path), threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not p.observedMetrics:
            return
        seen = {f"{name}_{k}" if k == "last_packet" else k: v for name, row in p.observedMetrics.items() for k, v in row.asDict().items()}
        line = {"query": str(p.id), "batch": p.batchId, "at": p.timestamp, "seconds": sum(p.durationMs.values()) / 1000 if p.durationMs else None, "rows": p.numInputRows, "counters": {k: v for k, v in seen.items() if v is not None}}
        self.folder.write(f"{p.id}-{p.batchId:020d}.json", json.dumps(line) + "\n")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


@contextmanager
def watched(spark: SparkSession, path: str | None) -> Iterator[None]:
    """Keeps the counters of the query that runs to its end within; without a path, none."""
    if path is None:
        yield
        return
    log = MetricsLog(spark, path)
    spark.streams.addListener(log)
    try:
        yield
        log.ended.wait(60)  # reports come behind the batches that they are of
    finally:
        spark.streams.removeListener(log)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """query, batch, at, seconds, rows and counters (a map) of every batch."""
    return spark.read.schema("query string, batch long, at string, seconds double, rows long, counters map<string, long>").json(path)


def totals(metrics: DataFrame) -> DataFrame:
    """The sum of each counter over all batches, last_packet apart."""
    each = metrics.select(F.explode("counters").alias("counter", "value")).where("counter NOT LIKE '%last_packet'")
    return each.groupBy("counter").agg(F.sum("value").alias("value"))
