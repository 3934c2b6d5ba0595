"""Forgetting, changeover, upserts and the tables' log on streams."""

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from beaconlake.operators.gaps import with_gaps
from beaconlake.operators.state_machines import h3_stationary, station_moves
from beaconlake.plans import inputs as I
from beaconlake.sources.indexed import read_coverage
from beaconlake.streaming.coverage import CHUNK, KEYS, AircraftState, roll_over, stream_gaps, with_open
from beaconlake.streaming.metrics import read_metrics, totals, watched
from beaconlake.streaming.slices import cuts
from beaconlake.streaming.stations import NAMES, StationState, replay_beacons, stream_stations
from beaconlake.streaming.tables import BucketTable, State, latest, merge_into

SF = "/root/testdata/sf0.001"
HOUR = 3600


def run(spark, rows, path, cuts):
    """Rows through stream_gaps in batches that end before each of the cuts: {seq: (gap, first, stays)}."""
    for n, (a, b) in enumerate(zip([-1, *cuts], [*cuts, 1 << 60], strict=True)):
        rows.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.parquet(f"{path}/in/{n}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")
    q = stream_gaps(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return {r.seq: (r.gap, r.first, r.h3_stationary) for r in spark.read.parquet(f"{path}/out").collect()}


def test_silence_on_a_stream_equals_the_batch(spark, tmp_path):
    """A replay of packets that are years old: stations of the clock of arrival, not of the wall, decide what is forgotten."""
    t = F.lit(I.START) + F.col("seq") * 20 + F.floor(F.col("seq") / 300) * 13 * HOUR
    p = I.packets(spark, SF).select("seq", t.alias("received"), (F.col("user_id") % 2).alias("aircraft"), "station_id", t.alias("ts"), (F.col("k") % 2).cast("long").alias("cell"), (F.col("k") % 16 == 5).alias("standing"))
    got = run(spark, p, str(tmp_path), [250, 600])
    gapped = with_gaps(p, ts="ts", standing=F.col("standing"), arrival=F.col("received"))
    want = h3_stationary(gapped, cell="cell", forgotten="forgotten", standing=F.col("standing"), arrival=F.col("received")).where("NOT standing")
    assert got == {r.seq: (r.gap, r.first, r.h3_stationary) for r in want.collect()}
    never = h3_stationary(gapped, cell="cell", standing=F.col("standing")).where("h3_stationary").count()
    assert sum(x[2] for x in got.values()) < never


def test_silent_aircraft_leave_the_state(spark, tmp_path):
    """The first aircraft is heard no more; arrivals of the other one bring its timer."""
    rows = [(i, I.START + i, 1, 1, I.START + i, 5, False) for i in range(5)] + [(i, I.START + i * HOUR, 2, 1, I.START + i * HOUR, 5, False) for i in range(10, 60, 10)]
    p = spark.createDataFrame(rows, "seq long, received long, aircraft long, station_id int, ts long, cell long, standing boolean")
    run(spark, p, str(tmp_path), [10, 20, 30, 40, 50])
    kept = spark.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", "seen").load()
    assert [r.key.aircraft for r in kept.collect()] == [2]


def heard(spark, rows):
    """(received, ts, cell7, station) as a batch of accepted packets."""
    return spark.createDataFrame([(a, t, c, s, 100, 50, 1, 40, 3) for a, t, c, s in rows], "received long, ts long, cell7 long, station string, alt int, agl int, crc int, signal int, gap int")


def test_changeover(spark, tmp_path):
    at, out = f"{tmp_path}/t", f"{tmp_path}/out"
    write = roll_over(at, KEYS, out, spark.createDataFrame([("A", 1), ("B", 2)], "station string, id int"))
    day = 1704067200 + 5 * 86400
    counts = lambda: {(r.acc_type, r.file, r.station): r["count"] for r in latest(spark, at).collect()}
    write(heard(spark, [(day + 100, day - 86400, 1, "A"), (day + 200, day + 200, 1, "A")]), 0)  # a late packet counts now
    assert counts() == {("current", "", "A"): 2}
    write(heard(spark, [(day + 300, day + 300, 1, "B")]), 1)
    assert counts() == {("current", "", "A"): 2, ("current", "", "B"): 1}
    rolled = {("day", "2024-01-06", s): n for s, n in (("A", 2), ("B", 1))} | {("month", "2024-01", s): n for s, n in (("A", 2), ("B", 1))} | {(t, f, s): n for t, f in (("year", "2024"), ("yearnz", "2023nz")) for s, n in (("A", 2), ("B", 1))}
    write(heard(spark, [(day + 4 * HOUR, day + 4 * HOUR, 2, "A")]), 2)  # a new period: the first is over
    assert counts() == rolled | {("current", "", "A"): 1}
    write(heard(spark, [(day + 4 * HOUR, day + 4 * HOUR, 2, "A")]), 2)  # again after it was complete
    assert counts() == rolled | {("current", "", "A"): 1}
    shown = {(r.acc_type, r.file, r.h3): r["count"] for r in read_coverage(spark, f"{out}/global").collect()}
    assert shown[("day", "2024-01-06", 1)] == 3 and len(shown) == 4
    assert {(r.station, r["count"]) for r in read_coverage(spark, f"{out}/stations").where("acc_type = 'year'").collect()} == {("A", 2), ("B", 1)}
    write(heard(spark, []), 3)
    write(heard(spark, [(day + 86400, day, 1, "A")]), 4)  # the next day: the day's file is final
    assert {(r.acc_type, r.file, r.h3): r["count"] for r in read_coverage(spark, f"{out}/global").collect()}[("day", "2024-01-06", 2)] == 1
    whole = {(r.acc_type, r.file, r.station, r.cell7): r["count"] for r in with_open(latest(spark, at), *KEYS).collect()}
    assert whole[("month", "2024-01", "A", 1)] == 3 and whole[("day", "2024-01-07", "A", 1)] == 1 and whole[("day", "2024-01-06", "A", 2)] == 1
    assert [p for p in BucketTable(spark, at).state().parts if p[0] == "current"] == [("current", (day + 86400) // 60)]


def test_the_log_stays_short(spark, tmp_path):
    """A thousand batches: no more than fifty small files are read, and replaced versions are gone when their time is over."""
    table = BucketTable(spark, str(tmp_path / "t"), keep_seconds=0)
    reads, read = [], table.log.read
    table.log.read = lambda name: reads.append(name) or read(name)
    most, state = 0, State()
    for n in range(1000):
        (tmp_path / f"t/data/data_batch={n}/acc_type=day/bucket={n // 100}").mkdir(parents=True)
        if n % 37 == 0:
            reads.clear()
            assert table.state() == state
            most = max(most, len(reads))
        table.commit(state, n, [("day", n // 100)], schema='{"n": 1}')
        state = State(state.parts | {("day", n // 100): n}, n, '{"n": 1}')
    assert most <= 51 and table.state() == state and len(state.parts) == 10
    assert len(list((tmp_path / "t/log").glob("*.json"))) <= 110
    left = {p.parent.parent.name for p in (tmp_path / "t/data").glob("*/*/*")}
    assert {f"data_batch={n}" for n in state.parts.values()} <= left and len(left) < 70


def test_replaced_versions_stay_for_readers(spark, tmp_path):
    df = spark.createDataFrame([("day", 1, "f", 5, 1, 10, 5, 1, 9, 1)], "acc_type string, bucket int, file string, cell7 long, station_id int, alt int, agl int, crc int, signal int, gap int")
    from beaconlake.operators import coverage as V

    keys = ("acc_type", "bucket", "file", "cell7", "station_id")
    write = merge_into(str(tmp_path / "t"), keys, checkpoint_every=2, keep_seconds=3600)
    write(V.partial(df, *keys), 0)
    before = latest(spark, str(tmp_path / "t"))
    for n in range(1, 5):
        write(V.partial(df, *keys), n)
    assert before.first()["count"] == 1 and latest(spark, str(tmp_path / "t")).first()["count"] == 5
    assert {f.split("data_batch=")[1].split("/")[0] for f in latest(spark, str(tmp_path / "t")).inputFiles()} == {"4"}


def test_stations_go_on_from_their_documents(spark, tmp_path):
    rows = [(1, 10, "A", 47.0, 8.0, None), (2, 11, "A", None, None, "up"), (3, 12, "B", 48.0, 9.0, None)], [(4, 20, "A", 47.5, 8.0, None), (5, 21, "C", None, None, "hi"), (6, 22, "A", 47.0, 8.0, None), (2, 11, "A", None, None, "up")]
    for n, part in enumerate(rows):
        df = spark.createDataFrame(part, "seq long, ts long, station string, lat double, lng double, status string")
        df.write.parquet(f"{tmp_path}/in{n}")
        stream_stations(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in{n}"), f"{tmp_path}/t", f"{tmp_path}/cp{n}", rows=f"{tmp_path}/rows").awaitTermination()
    got = {r.station: r for r in latest(spark, f"{tmp_path}/t").collect()}
    assert sorted(got) == ["A", "B", "C"] and got["A"].status == "up" and got["A"].last_location == 22 and got["C"].lat is None and got["B"].moved is False
    assert [(r.seq, r.move) for r in spark.read.parquet(f"{tmp_path}/rows").where("station = 'A'").orderBy("seq").collect()] == [(1, "still"), (2, "still"), (4, "moved"), (6, "bouncing")]
    assert got["A"].bouncing and set(NAMES) < set(got["A"].asDict())


def test_counters_are_kept(spark, tmp_path):
    for n in range(3):
        spark.range(10 * (n + 1)).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*").observe("x", F.count(F.lit(1)).alias("n"), F.max("id").alias("last_packet"))
    with watched(spark, f"{tmp_path}/m"):
        s.writeStream.foreachBatch(lambda d, i: d.count()).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    m = read_metrics(spark, f"{tmp_path}/m")
    assert m.count() == 3 and {r.counter: r.value for r in totals(m).collect()} == {"n": 60}
    assert json.loads(next((tmp_path / "m").glob("*.json")).read_text())["counters"]["x_last_packet"] in (9, 19, 29)


class Kept:
    """A state variable outside Spark, and the handle that gives it."""

    def __init__(self):
        self.value, self.made = None, {}

    def getValueState(self, name, schema):
        return self.made.setdefault(name, Kept())

    def getMapState(self, name, *schemas):
        return self.made.setdefault(name, Kept())

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        return key in (self.value or {})

    def getValue(self, key):
        return self.value[key]

    def updateValue(self, key, value):
        self.value = (self.value or {}) | {key: value}

    def listTimers(self):
        return []

    def registerTimer(self, at):
        self.at = at


def test_state_functions_put_out_some_rows_at_a_time():
    """However many rows of a key a batch has: frames are bounded, in order, and all of them are there."""
    n = 25_000
    rng = np.random.default_rng(1)
    seq = rng.permutation(n)
    b = pd.DataFrame({"station": 1, "seq": seq, "ts": seq + 1_700_000_000, "lat": np.where(seq % 2 == 0, 47 + seq // 1000 * 0.1, np.nan), "lng": 8.0, "status": np.where(seq % 3 == 0, None, "up")})
    state = StationState()
    state.init(Kept())
    out = list(state.handleInputRows((1,), iter([b[:9000], b[9000:]]), None))
    assert max(map(len, out)) <= CHUNK and len(out) == 3
    rows = pd.concat(out)
    assert rows["seq"].tolist() == list(range(n)) and rows["move"].tolist()[:1001:500] == ["still", "still", "moved"] and rows["status"].tolist()[:3] == [None, "up", "up"]
    assert list(state.handleInputRows((1,), iter([b[:100]]), None)) == [] and state.document.get()[0] == n - 1
    a = pd.DataFrame({"seq": seq, "received": seq, "ts": 1_700_000_000 + seq, "station_id": 1, "cell": 5, "standing": seq % 5 == 0})
    flown = AircraftState(["seq", "received", "ts", "station_id"], "int")
    flown.init(Kept())
    out = list(flown.handleInputRows((1,), iter([a]), None))
    assert max(map(len, out)) <= CHUNK and len(out) == 3
    rows = pd.concat(out)
    assert rows["seq"].tolist() == [i for i in range(n) if i % 5] and rows["h3_stationary"].sum() == n * 4 // 5 - 90


def test_replayed_batches_are_bounded_and_in_order(spark, tmp_path):
    """Many small batches over a restart give what the walk over all beacons gives."""
    b = I.beacons(spark, SF).select("seq", F.col("ts_s").alias("ts"), F.col("station_id").alias("station"), "lat", "lng", F.lit(None).cast("string").alias("status"))
    assert cuts(b, 10, most=300)[:2] == [10, 257] and cuts(b, 500, most=500) == [500] and cuts(b.limit(0), 5) == [5]
    documents, rows = replay_beacons(b, 500, most=300)
    sizes = sorted(r["count"] for r in rows.groupBy("batch").count().collect())
    assert sum(sizes) == b.count() and sizes[-1] <= 310 and len(sizes) == 4
    want = {r.seq: (r.move, r.moved, r.bouncing) for r in station_moves(b.withColumnRenamed("station", "station_id")).collect()}
    assert {r.seq: (r.move, r.moved, r.bouncing) for r in rows.collect()} == want
    assert {r.station: r.seq for r in documents.collect()} == {r.station: r.last for r in b.groupBy("station").agg(F.max("seq").alias("last")).collect()}


def test_replayed_lines_are_dealt_to_tasks(spark, monkeypatch):
    """Lines are written by several tasks in slices of bounded size, and tiles are worked out once, not by each batch."""
    from beaconlake.streaming import coverage, slices

    given, feeds = [], []
    ingest = coverage.stream_ingest
    monkeypatch.setattr(coverage, "stream_ingest", lambda lines, tiles, path, *rest, **more: given.append((tiles, path)) or ingest(lines, tiles, path, *rest, **more))
    run = slices.replayed
    monkeypatch.setattr(coverage, "replayed", lambda rows, path, *rest, **more: feeds.append(path) or run(rows, path, *rest, **more))
    lines = I.feed_lines(spark, SF, True)
    whole = coverage.replay_lines(lines.repartition(4), I.tiles(spark, SF), I.grid_cell, 500)
    [(tiles, path)] = given
    assert "event_id" not in tiles._jdf.queryExecution().optimizedPlan().toString()  # a table, not made of the packets again
    assert [BucketTable(spark, path).state().batch, spark.conf.get(slices.EMPTY_BATCHES)] == [1, "true"]
    files = spark.read.parquet(f"{feeds[0]}/in/*").groupBy(F.regexp_extract(F.input_file_name(), r"/in/(\d+)/", 1).alias("slice"), F.input_file_name()).count().groupBy("slice").agg(F.count("*").alias("files"), F.sum("count").alias("rows")).collect()
    assert sorted((r.slice, r.files, r.rows) for r in files) == [("0", 4, 500), ("1", 4, 500)]
    small = coverage.replay_lines(lines, I.tiles(spark, SF), I.grid_cell, 500, most=150)
    assert BucketTable(spark, given[1][1]).state().batch == 7
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    assert rows(small) == rows(whole) and rows(whole)
