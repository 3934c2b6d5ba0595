"""Tables of bucket partitions that grow batch by batch, with a log of what each batch changed.

A batch writes new versions of the partitions that it touches under its own number, and then one small log file: until it
is there readers see the table as it was, and a batch that is run again after it changes nothing. Every so many batches
the log's outcome is written as a checkpoint, so a batch reads a bounded number of small files however old the table is;
versions that were replaced, and logs behind a checkpoint, are removed once they are older than readers may be.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from beaconlake.operators import coverage as V
from beaconlake.sources.folder import Folder

#: Columns that bucket tables are partitioned by.
PARTITIONS = {"acc_type": "string", "bucket": "int"}
#: Files that a batch writes of a partition at most.
FILES = 8
Part = tuple[str, int]


@dataclass
class State:
    """The batch that wrote the live version of each partition, the newest complete batch (-1: none) and the rows' schema."""

    parts: dict[Part, int] = field(default_factory=dict)
    batch: int = -1
    schema: str | None = None


class BucketTable:
    """``checkpoint_every``: log files that a reader has to read at most; ``keep_seconds``: how long a replaced version
    stays for readers that began before it was replaced."""

    def __init__(self, spark: SparkSession, path: str, checkpoint_every: int = 50, keep_seconds: float = 3600):
        self.spark, self.path, self.every, self.keep = spark, path, checkpoint_every, keep_seconds
        self.log = Folder(spark, f"{path}/log")
        self.data = Folder(spark, f"{path}/data")

    def _listed(self) -> tuple[list[int], list[int]]:
        names = [n for n in self.log.names() if n.endswith(".json")]
        return [int(n[:20]) for n in names if not n.endswith(".checkpoint.json")], [int(n[:20]) for n in names if n.endswith(".checkpoint.json")]

    def state(self) -> State:
        batches, checkpoints = self._listed()
        out = State()
        if checkpoints:
            got = json.loads(self.log.read(f"{checkpoints[-1]:020d}.checkpoint.json"))
            out = State({(t, b): v for t, b, v in got["parts"]}, got["batch"], got["schema"])
        for n in batches:
            if n > out.batch:
                got = json.loads(self.log.read(f"{n:020d}.json"))
                for t, b, _ in got["gone"]:
                    out.parts.pop((t, b), None)
                out.parts |= {(t, b): v for t, b, v in got["add"]}
                out.batch, out.schema = n, got["schema"] or out.schema
        return out

    def commit(self, before: State, batch: int, touched: list[Part], removed: list[Part] = [], schema: str | None = None) -> None:  # noqa: B006
        """Makes a batch count: ``touched`` partitions were written under its number, ``removed`` ones are no more."""
        gone = [(*p, before.parts[p]) for p in [*touched, *removed] if p in before.parts]
        self.log.write(f"{batch:020d}.json", json.dumps({"batch": batch, "time": time.time(), "schema": schema, "add": [(*p, batch) for p in touched], "gone": gone}))
        batches, checkpoints = self._listed()
        if len([n for n in batches if n > (checkpoints[-1] if checkpoints else -1)]) >= self.every:
            now = self.state()
            self.log.write(f"{batch:020d}.checkpoint.json", json.dumps({"batch": batch, "schema": now.schema, "parts": [(*p, v) for p, v in now.parts.items()]}))
            self.expire()

    def expire(self) -> None:
        """Removes versions that were replaced over ``keep_seconds`` ago, then the logs that say so, up to the last checkpoint."""
        batches, checkpoints = self._listed()
        old = [n for n in batches if checkpoints and n <= checkpoints[-1]]
        for n in old:
            entry = json.loads(self.log.read(f"{n:020d}.json"))
            if entry["time"] > time.time() - self.keep:
                break
            for t, b, v in entry["gone"]:
                self.data.remove(f"data_batch={v}/acc_type={t}/bucket={b}")
            self.log.remove(f"{n:020d}.json")
        for n in checkpoints[:-1]:
            self.log.remove(f"{n:020d}.checkpoint.json")

    def rows(self, state: State, parts: list[Part] | None = None) -> DataFrame | None:
        """The rows of some partitions or all. Their folders are named to the reader: no other file is opened, and the plan
        does not grow with their number."""
        at = [f"{self.path}/data/data_batch={state.parts[p]}/acc_type={p[0]}/bucket={p[1]}" for p in (state.parts if parts is None else parts) if p in state.parts]
        if not at:
            return None
        schema = StructType.fromJson(json.loads(state.schema))
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*at).select(*schema.names)

    def write(self, rows: DataFrame, batch: int) -> None:
        spread = F.pmod(F.xxhash64(*rows.columns), F.lit(FILES))  # else every task has a file in every partition
        rows.repartition(*PARTITIONS, spread).write.mode("overwrite").partitionBy(*PARTITIONS).parquet(f"{self.path}/data/data_batch={batch}")


def buckets_of(rows: DataFrame) -> list[Part]:
    """The partitions that rows fall into: few, as they are those of one batch."""
    return [(r.acc_type, r.bucket) for r in rows.select(*PARTITIONS).distinct().collect()]


def merge_into(path: str, keys: tuple[str, ...], combine: Callable[..., DataFrame] = V.merge, checkpoint_every: int = 50, keep_seconds: float = 3600) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges a batch's records into the table at ``path``: only the partitions that the
    batch touches are read, combined by key and written. ``combine`` takes records and keys and gives one record a key."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        table = BucketTable(batch.sparkSession, path, checkpoint_every, keep_seconds)
        state = table.state()
        if state.batch >= batch_id:
            return
        new = combine(batch, *keys).persist()
        touched = buckets_of(new)
        old = table.rows(state, touched)
        table.write(combine(new.unionByName(old), *keys) if old is not None else new, batch_id)
        table.commit(state, batch_id, touched, schema=new.schema.json())
        new.unpersist()

    return merge


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as the newest complete batch left it, or None before the first."""
    table = BucketTable(spark, path)
    return table.rows(table.state())


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Writes the live records alone as a new table, after which the old one may be removed."""
    state = BucketTable(spark, path).state()
    rows = BucketTable(spark, path).rows(state)
    if rows is not None:
        new = BucketTable(spark, target)
        new.write(rows, state.batch)
        new.commit(State(), state.batch, list(state.parts), schema=rows.schema.json())


def accumulators(spark: SparkSession, path: str) -> DataFrame:
    """acc_type and bucket of every partition that the table holds: from its log alone, no row is read."""
    parts = BucketTable(spark, path).state().parts
    return spark.createDataFrame(list(parts), ", ".join(f"{c} {t}" for c, t in PARTITIONS.items()))
