"""Streams give what batches give; files keep what they are given."""

import socket
import threading

import pytest
from pyspark.sql import functions as F

from beaconlake.operators import coverage as V
from beaconlake.operators.gaps import with_gaps
from beaconlake.operators.rollup import into_buckets
from beaconlake.operators.state_machines import h3_stationary
from beaconlake.plans import inputs as I
from beaconlake.sources import feed, files, indexed
from beaconlake.streaming.coverage import stream_coverage, stream_gaps
from beaconlake.streaming.tables import compact, latest, merge_into

SF = "/root/testdata/sf0.001"


def test_stream_of_coverage_equals_batch(spark, tmp_path):
    acc = I.accepted(spark, SF).select("seq", "ts_s", "alt", "agl", "crc", "signal", "gap", "cell7", "station_id")
    for i in range(3):
        acc.where(F.col("seq") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(acc.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_coverage(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    keys = ["acc_type", "bucket", "file", "cell7", "station_id"]
    want = V.partial(into_buckets(acc), *keys)
    got = latest(spark, f"{tmp_path}/out").select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    stream_coverage(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()  # nothing new
    assert latest(spark, f"{tmp_path}/out").select(*want.columns).exceptAll(want).count() == 0


def test_stream_of_gaps_equals_batch(spark, tmp_path):
    p = I.packets(spark, SF).select("seq", F.col("pts").alias("received"), "aircraft", "station_id", F.col("pts").alias("ts"), (F.col("k") % 3).cast("long").alias("cell"), (F.col("k") % 9 == 1).alias("standing"))
    for lo in (0, 400, 700):
        p.where((F.col("seq") >= lo) & (F.col("seq") < {0: 400, 400: 700, 700: 10**9}[lo])).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{lo}")
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = stream_gaps(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = h3_stationary(with_gaps(p.withColumnRenamed("ts", "pts"), standing=F.col("standing")), cell="cell", forgotten="forgotten", standing=F.col("standing")).where("NOT standing")
    want = {r.seq: (r.gap, r.first, r.h3_stationary) for r in batch.collect()}
    got = {r.seq: (r.gap, r.first, r.h3_stationary) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want


def serving(lines: bytes):
    """A service that greets each client with the same lines: (port, what clients sent, how to end it)."""
    server, heard = socket.create_server(("127.0.0.1", 0)), []

    def client(c):
        heard.append(c.recv(200))
        c.sendall(lines)
        while more := c.recv(200):
            heard.append(more)

    def serve():
        while True:
            try:
                c, _ = server.accept()
            except OSError:
                return
            threading.Thread(target=client, args=(c,), daemon=True).start()

    threading.Thread(target=serve, daemon=True).start()
    return server.getsockname()[1], heard, server.close


def test_feed_over_a_socket():
    port, heard, end = serving(b"# hello\r\nA>B,qAS,C:x\r\nhalf")
    reader = feed.FeedReader({"feeds": f"127.0.0.1:{port}", "filter": "r/1/2/3", "wait": "0.5", "keepalive": "0"})
    start, now = reader.initialOffset(), reader.latestOffset()
    [p] = reader.partitions(start, now)
    rows = list(reader.read(p))
    assert [r[2] for r in rows] == ["# hello", "A>B,qAS,C:x"] and rows[1][0] == rows[0][0] + 1 and abs(rows[0][1] - now["at"]) < 5
    assert b"filter r/1/2/3" in heard[0]
    assert list(reader.read(p)) == [] and len(heard) > 1 and any(b"alive" in h for h in heard)  # the connection stays open
    end()


def test_feeds_are_read_by_tasks(spark, tmp_path):
    """Two services, a partition each; a stream keeps what both sent, in order of arrival."""
    (a, _, end_a), (b, _, end_b) = serving(b"one\ntwo\n"), serving(b"three\n")
    lines = feed.live(spark, feeds=f"127.0.0.1:{a},127.0.0.1:{b}", wait="1", spool=str(tmp_path / "spool"))
    q = lines.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    for _ in range(60):
        q.awaitTermination(1)
        if any((tmp_path / "out").glob("*.parquet")) and spark.read.schema("seq long, received long, value string").parquet(f"{tmp_path}/out").count() >= 3:
            break
    q.stop()
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()
    got = [r.value for r in rows]
    assert set(got) == {"one", "two", "three"} and got.index("one") < got.index("two") and len({r.seq for r in rows}) == len(rows)
    end_a(), end_b()


def test_names_in_one_case(spark):
    from beaconlake.functions.stations import normalise_case

    df = spark.createDataFrame([("aBc-1",), ("",), (None,)], "name string")
    assert [tuple(r) for r in df.select(normalise_case(F.col("name")), normalise_case(F.col("name"), True)).collect()] == [("aBc-1", "ABC-1"), ("", ""), (None, None)]


def test_landed_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    assert sorted(r.value for r in feed.landed(spark, str(tmp_path)).collect()) == ["one", "two"]


def test_coverage_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"d{i % 2}", i * 2) for i in range(50)], "h3 long, period string, count long")
    indexed.write_coverage(df, f"{tmp_path}/t", "period")
    indexed.write_coverage(df.where("period = 'd1'").withColumn("count", F.lit(1).cast("long")), f"{tmp_path}/t", "period")
    got = indexed.read_coverage(spark, f"{tmp_path}/t")
    assert got.count() == 50 and {r["count"] for r in got.where("period = 'd1'").collect()} == {1} and got.where("period = 'd0' AND h3 = 4").first()["count"] == 8


def test_station_files(spark, tmp_path):
    st = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "c", 0)], "id int, station string, last_packet long")
    files.write_stations(st, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/stations").count() == 1 and spark.read.json(f"{tmp_path}/stations-complete").count() == 3


KEYS = ("acc_type", "bucket", "file", "cell7", "station_id")


def partials(spark, rows):
    df = spark.createDataFrame([(t, b, f"{t}{b}", c, s, 1, 1, 1, 1, 1, 1) for t, b, c, s in rows], "acc_type string, bucket int, file string, cell7 long, station_id int, alt int, agl int, crc int, signal int, gap int, seq int")
    return V.partial(df, *KEYS)


def test_batches_rewrite_only_what_they_touch(spark, tmp_path):
    at = str(tmp_path / "t")
    write = merge_into(at, KEYS)
    assert latest(spark, at) is None
    write(partials(spark, [("day", 1, 5, 1), ("day", 2, 5, 1), ("year", 7, 5, 1)]), 0)
    write(partials(spark, [("day", 2, 5, 1), ("day", 3, 6, 2), ("year", 7, 5, 2)]), 1)
    write(partials(spark, [("day", 2, 5, 1), ("day", 9, 9, 9)]), 1)  # the same batch again after it was complete
    got = {(r.acc_type, r.bucket, r.station_id): r["count"] for r in latest(spark, at).collect()}
    assert got == {("day", 1, 1): 1, ("day", 2, 1): 2, ("day", 3, 2): 1, ("year", 7, 1): 1, ("year", 7, 2): 1}
    assert sorted(p.name for p in (tmp_path / "t/data/data_batch=1/acc_type=day").iterdir()) == ["bucket=2", "bucket=3"]
    opened = spark.read.parquet(f"{at}/data").where("data_batch = 1 AND acc_type = 'day' AND bucket = 3").inputFiles()
    assert opened
    # a batch that died before it was listed: its files are there, the table is as before, and running it again counts once
    partials(spark, [("day", 1, 5, 1)]).write.partitionBy("acc_type", "bucket").parquet(f"{at}/data/data_batch=2")
    assert {(r.acc_type, r.bucket, r.station_id): r["count"] for r in latest(spark, at).collect()} == got
    write(partials(spark, [("day", 1, 5, 1)]), 2)
    assert latest(spark, at).where("acc_type = 'day' AND bucket = 1").first()["count"] == 2
    compact(spark, at, f"{at}2")
    assert sorted(map(tuple, latest(spark, f"{at}2").collect())) == sorted(map(tuple, latest(spark, at).collect()))
    assert [p.name for p in (tmp_path / "t2/data").iterdir() if p.is_dir()] == ["data_batch=2"]


def test_lookups_open_only_their_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"d{i % 5}", i) for i in range(100)], "h3 long, period string, count long")
    indexed.write_coverage(df, f"{tmp_path}/t", "period")
    plan = indexed.read_coverage(spark, f"{tmp_path}/t", period="d3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan
    assert indexed.read_coverage(spark, f"{tmp_path}/t", period="d3").count() == 20


def test_spooled_lines_survive_a_restart(tmp_path):
    port, _, end = serving(b"one\r\ntwo\r\n")
    options = {"feeds": f"127.0.0.1:{port}", "wait": "0.5", "spool": str(tmp_path / "spool")}
    reader = feed.FeedReader(options)
    [p] = reader.partitions({"at": 5}, {"at": 7})
    rows = list(reader.read(p))
    assert [r[2] for r in rows] == ["one", "two"]
    again = feed.FeedReader(options)  # after a restart of the driver, or of the task
    assert list(again.read(p)) == rows
    [later] = again.partitions({"at": 7}, {"at": 9})
    (tmp_path / "spool/000000000009-0.jsonl.working").write_text("a task that died\n")
    assert list(again.read(later)) == [] and len(list((tmp_path / "spool").iterdir())) == 2
    again.commit({"at": 7})
    assert [x.name for x in (tmp_path / "spool").iterdir()] == ["000000000009-0.jsonl"]
    end()


def test_previous_output_is_kept_once(spark, tmp_path):
    at = f"{tmp_path}/t"
    for rows in ([(1, "a", 1), (2, "b", 1)], [(1, "a", 2)], [(1, "a", 3)]):
        indexed.write_coverage(spark.createDataFrame(rows, "h3 long, period string, count long"), at, "period", keep_previous=True)
    assert {(r.period, r["count"]) for r in indexed.read_coverage(spark, at).collect()} == {("a", 3), ("b", 1)}
    assert {(r.period, r["count"]) for r in indexed.read_coverage(spark, at, previous=True).collect()} == {("a", 2)}


def test_stations_fall_back_to_the_older_layout(spark, tmp_path):
    st = spark.createDataFrame([(2, "b", 1.0, 2.0, True, 5), (1, "a", 1.0, 2.0, False, 6), (3, "c", None, None, True, 0)], "id int, station string, lat double, lng double, valid boolean, last_packet long")
    files.write_station_table(st, str(tmp_path / "new"), "2024-01-05")
    assert [r.id for r in files.read_stations(spark, str(tmp_path / "new"), "day.2024-01-05").collect()] == [2]
    assert [r.id for r in files.read_stations(spark, str(tmp_path / "new"), "day.2024-01-05", True).orderBy("id").collect()] == [1, 2]
    st.drop("valid").write.parquet(str(tmp_path / "old/stations"))
    assert files.read_stations(spark, str(tmp_path / "old"), "day.2024-01-05").count() == 3
    with pytest.raises(FileNotFoundError):
        files.read_stations(spark, str(tmp_path / "none"), "day.2024-01-05")
