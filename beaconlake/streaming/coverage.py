"""The coverage engine on a stream of packets.

Gaps and cells need state that outlives a batch; it is kept per aircraft, which sees its packets in order of arrival, and
goes when the clock of arrival says so. The aggregate itself needs none: each batch's partial records are merged into
bucket tables, and a bucket that is over is rolled up into day, month, year and season once and removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from beaconlake.config import DEFAULT, Config
from beaconlake.functions import buckets as B
from beaconlake.functions import cells as C
from beaconlake.functions import packets as P
from beaconlake.functions.once import once
from beaconlake.operators import coverage as V
from beaconlake.operators.disposition import REASONS, before_state
from beaconlake.operators.ingest import routed
from beaconlake.operators.rollup import into_buckets
from beaconlake.sources.elevation import with_ground
from beaconlake.sources.indexed import write_coverage
from beaconlake.sources.shared import new_path, written
from beaconlake.streaming.slices import replayed
from beaconlake.streaming.tables import PARTITIONS, BucketTable, State, buckets_of, latest, merge_into

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GAPS = "gap int, first boolean, h3_stationary boolean"
#: Rows that state functions put out at a time.
CHUNK = 10_000
#: How far arrivals may be out of order before Spark takes them for late and drops them.
ARRIVAL_DELAY = "1 hour"
#: What a record of the ingested coverage is of.
KEYS = (*PARTITIONS, "file", "cell7", "station")


class AircraftState(StatefulProcessor):
    """What is known of an aircraft: when it was last seen, its packets at each station, its recent cells. All of it is
    forgotten after a silence: by the packet that ends it, or by a timer on the clock of arrival if none comes."""

    def __init__(self, carried: list[str], station_type: str, config: Config = DEFAULT):
        self.carried, self.station_type, self.config = carried, station_type, config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ts long")
        self.heard = handle.getMapState("heard", f"station {self.station_type}", "ts long")
        self.cells = handle.getValueState("cells", "cells array<long>, packets int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        order = np.argsort(batch["seq"].to_numpy(), kind="stable")
        forget, most = self.config.forget_seconds, self.config.max_gap
        seen = self.seen.get()[0] if self.seen.exists() else 0
        cells, packets = (list(self.cells.get()[0]), self.cells.get()[1]) if self.cells.exists() else ([], 0)
        heard = {}
        for at in range(0, len(order), CHUNK):  # some at a time: what is put out never has to fit in memory
            part = batch.iloc[order[at:at + CHUNK]]
            kept, out = [], []
            for i, (ts, station, cell, standing) in enumerate(zip(*(part[c].tolist() for c in ("ts", "station_id", "cell", "standing")), strict=True)):
                if seen and ts - seen > forget:
                    seen, cells, packets = 0, [], 0
                if standing:
                    seen = ts
                    continue
                if station not in heard:  # the store is asked once for each station of a batch, and told once
                    heard[station] = self.heard.getValue((station,))[0] if self.heard.containsKey((station,)) else None
                before = heard[station]
                if before is not None and ts - before > forget:
                    before = None
                gap = min(most, ts - before) if before else min(most, max(1, ts - (seen or ts)))
                heard[station] = ts
                first = seen < ts
                stays = False
                if first:
                    seen = ts
                    if cell not in cells:
                        cells.append(cell)
                    if len(cells) > 4:
                        cells.pop(0)
                        packets = 0
                    else:
                        packets += 1
                    stays = packets / len(cells) > 90
                kept.append(i)
                out.append((gap, first, stays))
            if kept:
                found = pd.DataFrame(out, columns=["gap", "first", "h3_stationary"])
                yield part[self.carried].iloc[kept].reset_index(drop=True).join(found)
        for station, ts in heard.items():
            self.heard.updateValue((station,), (ts,))
        if seen:
            self.seen.update((seen,))
        self.cells.update((cells, packets))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(batch["received"].max() + forget) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for kept in (self.seen, self.heard, self.cells):
            kept.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def stream_gaps(packets: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds gap, first and h3_stationary to a stream that has seq, received, aircraft, station_id, ts, cell and standing;
    standing packets go no further. Other columns are carried along. received is the time of arrival in seconds, the clock on
    which silent aircraft are forgotten: a replay of old packets forgets as the live run did."""
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    carried = [c for c in packets.columns if c not in ("cell", "standing")]
    kinds = dict(packets.dtypes)
    out = ", ".join([*(f"{c} {kinds[c]}" for c in carried), GAPS])
    clocked = packets.withColumn("arrived_", F.timestamp_seconds("received")).withWatermark("arrived_", ARRIVAL_DELAY)
    return clocked.groupBy("aircraft").transformWithStateInPandas(AircraftState(carried, kinds["station_id"], config), out, "Append", "EventTime")


def stream_coverage(packets: DataFrame, path: str, checkpoint: str, ts: str = "ts_s", station: str = "station_id", available_now: bool = True) -> StreamingQuery:
    """Maintains the rolled-up partial records by bucket, global cell and station of a stream of accepted packets
    (with alt, agl, crc, signal, gap, cell7, a station and a time). Late packets count in the bucket of their time."""
    keys = (*PARTITIONS, "file", "cell7", station)

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_into(path, keys)(V.partial(into_buckets(batch, ts, B.ROLLED), *keys), batch_id)

    watched = packets.observe("coverage", F.count(F.lit(1)).alias("packets"), F.max(ts).alias("last_packet"))  # in each progress report
    return _started(watched.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), available_now)


def _started(writer, available_now: bool, every: str = "5 minutes") -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def roll_over(path: str, keys: tuple[str, ...], output: str | None = None, stations: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that counts packets in the bucket of their arrival, and rolls buckets up when they are over.

    A batch has received, the time of arrival, and what a partial record is made of. It changes the open bucket alone, whatever
    times its packets bear. With the first packet of a new period the buckets before it are merged into their day, month,
    year and season and removed, all in the one commit of the batch. ``output`` gets the cells of what was rolled up, as files
    by type and period: each station's, and the global ones if ``stations`` gives the stations' ids. The open bucket's partition is numbered by its start in minutes: packed numbers come again each month.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        table = BucketTable(batch.sparkSession, path)
        state = table.state()
        if state.batch >= batch_id:
            return
        opened = F.floor(B.effective_start("current", F.col("received")) / 60).cast("int")
        new = V.partial(batch.withColumns({"acc_type": F.lit("current"), "bucket": opened, "file": F.lit("")}), *keys).persist()
        now = buckets_of(new)
        stored = [p for p in state.parts if p[0] == "current"]
        if not now:
            table.commit(state, batch_id, [], schema=new.schema.json())
            new.unpersist()
            return
        newest = max(b for _, b in now + stored)
        old = table.rows(state, stored)
        current = (V.merge(new.unionByName(old), *keys) if old is not None else new).persist()
        over = current.where(F.col("bucket") < newest)
        rolled = into_buckets(over.withColumn("at_", F.col("bucket").cast("long") * 60).drop(*PARTITIONS, "file"), "at_").select(*current.columns).persist()
        touched = buckets_of(rolled) if any(b < newest for _, b in now + stored) else []
        before = table.rows(state, touched)
        rolled_up = V.merge(rolled.unionByName(before) if before is not None else rolled, *keys)
        table.write(current.where(F.col("bucket") == newest).unionByName(rolled_up), batch_id)
        if output and touched:
            done = table.rows(State(dict.fromkeys(touched, batch_id), batch_id, new.schema.json()))
            place, station = keys[-2:]
            done = done.withColumnRenamed(place, "h3")
            write_coverage(V.finalise(done, "acc_type", "file", station, "h3"), f"{output}/stations", "acc_type", "file", run=f"batch-{batch_id}")
            if stations is not None:
                numbered = done.join(stations.select(F.col("station").alias(station), F.col("id").alias("station_id")), station)
                write_coverage(V.global_cells(numbered, "acc_type", "file", "h3"), f"{output}/global", "acc_type", "file", run=f"batch-{batch_id}")
        table.commit(state, batch_id, [("current", newest), *touched], [p for p in stored if p[1] < newest], schema=new.schema.json())
        for x in (new, current, rolled):
            x.unpersist()

    return write


def with_open(records: DataFrame, *keys: str) -> DataFrame:
    """The rolled-up records with what the open buckets hold so far."""
    opened = records.where("acc_type = 'current'").withColumn("at_", F.col("bucket").cast("long") * 60).drop(*PARTITIONS, "file")
    return V.merge(records.where("acc_type <> 'current'").unionByName(into_buckets(opened, "at_").select(*records.columns)), *keys)


def stream_ingest(lines: DataFrame, tiles: DataFrame, path: str, checkpoint: str, index: Callable | None = None, config: Config = DEFAULT, available_now: bool = True, output: str | None = None, stations: DataFrame | None = None, every: str = "5 minutes") -> StreamingQuery:
    """Feed lines to coverage on a stream: the rules without state, each aircraft's state, elevation, and the merge into
    the open bucket and the tables that it is rolled up to. lines has seq, received and value. Each progress report has
    the feed's counters: ``feed`` those of the rules without state, ``state`` and ``ground`` the others."""
    raw = routed(lines)
    first = before_state(raw, config.stationary_mode)
    first = once(first.withColumn("altitude", P.altitude(F.col("altitude"))), signal=P.signal(F.col("comment")), crc=P.crc(F.col("comment")))
    place = F.col("route") == "position"
    first = first.observe("feed", F.count_if(F.col("route") != "control").alias("rawCount"), F.count_if(F.col("route") == "invalid").alias("invalidPacket"),
                          *[F.count_if(place & (F.col("reason") == r)).alias(r) for r in REASONS[:6]])
    state = first.where(place & (F.col("reason").isNull() | (F.col("reason") == "ignoredStationary"))).withColumn(
        "cell", C.from_latlng(F.col("latitude"), F.col("longitude"), config.stationary_resolution, index))
    gapped = stream_gaps(state.select("seq", "received", F.col("flarm_id").alias("aircraft"), F.col("station").alias("station_id"), F.col("timestamp").alias("ts"), "cell", "standing", "latitude", "longitude", "altitude", "signal", "crc"), config)
    gapped = gapped.observe("state", F.count_if("h3_stationary").alias("ignoredH3stationary"), F.count_if(~F.col("h3_stationary") & (F.col("signal") <= 0)).alias("ignoredSignal0"))
    placed = with_ground(gapped.where("NOT h3_stationary AND signal > 0"), tiles, "latitude", "longitude")
    placed = placed.observe("ground", F.count_if("ground_failed").alias("ignoredElevation"), F.count(F.lit(1)).alias("count"), F.max("ts").alias("last_packet"))
    heard = placed.where("NOT ground_failed").withColumns({
        "alt": F.col("altitude"), "agl": P.above_ground(F.col("altitude"), F.col("ground")), "station": F.col("station_id"),
        "cell7": C.parent(C.from_latlng(F.col("latitude"), F.col("longitude"), config.station_resolution, index), config.global_resolution)})
    return _started(heard.writeStream.foreachBatch(roll_over(path, KEYS, output, stations)).option("checkpointLocation", checkpoint), available_now, every)


def replay(packets: DataFrame, batches: int = 2) -> DataFrame:
    """Runs accepted packets through stream_coverage in some batches, in the session's shared folder, and
    returns the table that results."""
    spark, at = packets.sparkSession, new_path(packets.sparkSession, "replay")
    needed = packets.select("seq", "ts_s", "alt", "agl", "crc", "signal", "gap", "cell7", "station_id")
    needed.repartition(batches, "seq").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(needed.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    stream_coverage(stream, f"{at}/table", f"{at}/offsets").awaitTermination()
    return latest(spark, f"{at}/table")


def replay_lines(lines: DataFrame, tiles: DataFrame, index: Callable, *splits: int, metrics: str | None = None, output: str | None = None, most: int | None = None) -> DataFrame:
    """Runs feed lines through stream_ingest, in batches of bounded size of which some end before each seq of ``splits``, and
    returns the records with the open bucket's. ``metrics`` keeps the counters of each batch under that path. Tiles are worked
    out once, not by every batch."""
    from beaconlake.streaming.metrics import watched

    spark, at = lines.sparkSession, new_path(lines.sparkSession, "lines")
    known = written(tiles, "tiles")
    with watched(spark, metrics):
        replayed(lines, at, lambda stream: stream_ingest(stream, known, f"{at}/table", f"{at}/offsets", index, available_now=False, output=output, every="0 seconds"), *splits, most=most)
    return with_open(latest(spark, f"{at}/table"), *KEYS)
