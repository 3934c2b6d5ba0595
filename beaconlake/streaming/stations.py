"""The station dimension on a stream: where each station is, whether it moved, and its last status."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from beaconlake.config import DEFAULT, Config
from beaconlake.operators.state_machines import _move_step, _Place
from beaconlake.sources.folder import Folder
from beaconlake.sources.shared import new_path
from beaconlake.streaming.coverage import CHUNK, STATE_STORE, _started
from beaconlake.streaming.slices import replayed
from beaconlake.streaming.tables import BucketTable, latest, merge_into

#: What is kept of a station. seq is the place of the beacon that last changed it.
DOCUMENT = ("seq long, move string, moved boolean, bouncing boolean, primary_lat double, primary_lng double, previous_lat double, previous_lng double, "
            "lat double, lng double, last_location long, status string, last_beacon long")
NAMES = [x.split()[0] for x in DOCUMENT.split(", ")]
#: Partitions of the documents' table.
BUCKETS = 16


def _known(d: dict) -> dict:
    return {k: None if v is None or v != v else v for k, v in d.items()}


def _after(stored, values, rows: np.ndarray) -> np.ndarray:
    """What is known after each row: the stored value, or that of the last row of ``rows`` so far. rows tells which have one."""
    known = np.empty(len(values) + 1, object)
    known[0], known[1:] = stored, values
    return known[np.cumsum(rows)]


class StationState(StatefulProcessor):
    """Goes through a station's beacons in order: those with a place move it, those with a text are its status. A row for
    each beacon tells what is known after it."""

    def __init__(self, config: Config = DEFAULT):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.document = handle.getValueState("document", DOCUMENT)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        stored = _known(initialState.iloc[0].to_dict())
        self.document.update(tuple(stored[n] for n in NAMES))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        d = dict(zip(NAMES, self.document.get(), strict=True)) if self.document.exists() else dict.fromkeys(NAMES)
        pair = lambda name: (d[f"{name}lat"], d[f"{name}lng"]) if d[f"{name}lat"] is not None else None
        place, step = _Place(), _move_step(self.config)
        place.primary, place.previous, place.last = pair("primary_"), pair("previous_"), pair("")
        place.moved, place.bouncing = bool(d["moved"]), bool(d["bouncing"])
        batch = pd.concat([x[["seq", "ts", "lat", "lng", "status"]] for x in rows], ignore_index=True)
        order = np.argsort(batch["seq"].to_numpy(), kind="stable")
        for at in range(0, len(order), CHUNK):  # some at a time: what is put out never has to fit in memory
            part = batch.iloc[order[at:at + CHUNK]]
            seq = part["seq"].to_numpy()
            new = np.diff(seq, prepend=seq[0] - 1) > 0
            if d["seq"] is not None:
                new &= seq > d["seq"]  # the stored document has the others already
            part = part[new]
            if not len(part):
                continue
            placed, told = (part["lat"].notna() & part["lng"].notna()).to_numpy(), part["status"].notna().to_numpy()
            moves = [(*step(place, lat, lng), place.primary, place.previous) for lat, lng in zip(part["lat"][placed].tolist(), part["lng"][placed].tolist(), strict=True)]
            columns = list(zip(*moves, strict=True)) or [()] * 5
            ts, out = part["ts"], {"seq": part["seq"].to_numpy()}
            for name, values in zip(("move", "moved", "bouncing"), columns, strict=False):
                out[name] = _after(d[name], values, placed)
            for name, values in (("primary_", columns[3]), ("previous_", columns[4])):
                for i, axis in enumerate(("lat", "lng")):
                    out[name + axis] = _after(d[name + axis], [v[i] for v in values], placed)
            for name, values, has in (("lat", part["lat"], placed), ("lng", part["lng"], placed), ("last_location", ts, placed), ("status", part["status"], told), ("last_beacon", ts, told)):
                out[name] = _after(d[name], values[has].tolist(), has)
            d = {n: out[n][-1] for n in NAMES}
            d["seq"] = int(d["seq"])
            yield pd.DataFrame({"station": [key[0]] * len(part)} | {n: out[n] for n in NAMES})
        if d["seq"] is not None:
            self.document.update(tuple(d.values()))

    def close(self) -> None:
        pass


def newest(documents: DataFrame, *keys: str) -> DataFrame:
    """The last document of each key."""
    rest = [c for c in documents.columns if c not in keys]
    return documents.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("d_")).select(*keys, "d_.*").select(*documents.columns)


def stream_stations(beacons: DataFrame, path: str, checkpoint: str, config: Config = DEFAULT, available_now: bool = True, rows: str | None = None, every: str = "5 minutes") -> StreamingQuery:
    """Keeps the documents of stations in the table at ``path`` up to date: one upsert by station for each batch.

    beacons has seq, ts, station, and a lat and lng or a status. A new stream, with a checkpoint of its own, goes on from
    the stored documents as its initial state; beacons that they have already are passed over. ``rows`` keeps what was
    known after each beacon, as Parquet files by batch.
    """
    spark = beacons.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kind = dict(beacons.dtypes)["station"]
    stored = latest(spark, path)
    known = (stored if stored is not None else spark.createDataFrame([], f"station {kind}, {DOCUMENT}")).select("station", *NAMES)
    after = beacons.groupBy("station").transformWithStateInPandas(StationState(config), f"station {kind}, {DOCUMENT}", "Append", "None", initialState=known.groupBy("station"))
    begun = _first_batch(spark, path, checkpoint)
    keys = ("acc_type", "bucket", "station")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        if rows:
            batch.write.mode("overwrite").parquet(f"{rows}/batch={begun + batch_id}")
        placed = batch.withColumns({"acc_type": F.lit("station"), "bucket": F.pmod(F.xxhash64("station"), F.lit(BUCKETS)).cast("int")}).select(*keys, *NAMES)
        merge_into(path, keys, newest)(placed, begun + batch_id)
        batch.unpersist()

    return _started(after.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), available_now, every)


def _first_batch(spark, path: str, checkpoint: str) -> int:
    """The table's number of a stream's batch 0: the next one when the stream first began. It is kept beside its checkpoint,
    so that a batch that is run again after a restart has the number it had."""
    folder = Folder(spark, f"{checkpoint.rstrip('/')}-first")
    if "batch" not in folder.names():
        folder.write("batch", str(BucketTable(spark, path).state().batch + 1))
    return int(folder.read("batch"))


def replay_beacons(beacons: DataFrame, split: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Runs beacons through two streams, in batches of bounded size, the second of which starts from what the first stored:
    (documents, rows)."""
    spark, at = beacons.sparkSession, new_path(beacons.sparkSession, "beacons")
    for n, part in enumerate((beacons.where(F.col("seq") < split), beacons.where(F.col("seq") >= split))):
        replayed(part, f"{at}/{n}", lambda stream, n=n: stream_stations(stream, f"{at}/table", f"{at}/offsets{n}", available_now=False, rows=f"{at}/rows", every="0 seconds"), most=most)
    return latest(spark, f"{at}/table"), spark.read.parquet(f"{at}/rows")
