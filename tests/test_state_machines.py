"""The cell record found by segments against a walk through every packet, whatever the pattern of cells and silences."""

import os
import random

import pytest
from pyspark.sql import functions as F

from beaconlake.operators.gaps import with_gaps
from beaconlake.operators.state_machines import DEFAULT, _move_step, _Place, _segments, h3_stationary, station_moves


def walk(rows, limit, most):
    """rows: (seq, aircraft, t, cell, first, standing, forgotten) in order."""
    out, records = {}, {}
    for seq, who, _, cell, first, standing, forgotten in rows:
        if forgotten or who not in records:
            records[who] = ([], 0)
        cells, n = records[who]
        stays = False
        if first and not standing:
            if cell not in cells:
                cells = [*cells, cell]
            cells, n = (cells[1:], 0) if len(cells) > most else (cells, n + 1)
            stays = n / len(cells) > limit
            records[who] = (cells, n)
        out[seq] = stays
    return out


SCHEMA = "seq long, aircraft string, t long, cell10 long, first boolean, standing boolean, forgotten boolean"


@pytest.mark.parametrize("limit, most, stretch", [(3, 2, 60), (5, 4, 100), (2, 3, 10**9)])
def test_segments_equal_a_walk(spark, limit, most, stretch):
    rng = random.Random(limit)
    rows, state = [], {}
    for seq in range(6000):
        who = rng.choice(["a", "b", "c", "d", None])
        here = state.setdefault(who, [0, "park"])
        if rng.random() < 0.02:
            here[1] = rng.choice(["park", "fly", "circle", "hop"])
        here[0] += here[1] == "fly"
        cell = 10**17 + {"park": here[0] * 100 + rng.randrange(2), "fly": here[0] * 100, "circle": here[0] * 100 + seq % 7, "hop": rng.randrange(most + 2)}[here[1]]
        rows.append((seq, who, seq, cell, rng.random() < 0.9, rng.random() < 0.1, rng.random() < 0.004))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.seq: r.h3_stationary for r in h3_stationary(df, forgotten="forgotten", standing=F.col("standing"), arrival=F.col("t"), forget=stretch, limit=limit, most=most).collect()}
    want = walk(rows, limit, most)
    assert got == want and 100 < sum(want.values()) < 5000


def test_thirteen_hours_of_silence(spark):
    """An aircraft in its hangar is stationary; after a silence its first packets count again, also behind a standing one."""
    for standing in (False, True):
        rows = [(i, 7, 1, 1700000000 + i, 5, False) for i in range(95)] + [(100, 7, 1, 1700000100 + 13 * 3600, 5, standing), (101, 7, 1, 1700000101 + 13 * 3600, 5, False)]
        p = spark.createDataFrame(rows, "seq long, aircraft long, station_id int, pts long, cell10 long, still boolean")
        gapped = with_gaps(p, standing=F.col("still"), arrival=F.col("pts"))
        got = {r.seq: r.h3_stationary for r in h3_stationary(gapped, forgotten="forgotten", standing=F.col("still"), arrival=F.col("pts")).collect()}
        assert not got[89] and got[90] and got[94] and not got[100] and not got[101]


def test_a_long_flight_is_many_segments(spark):
    """One aircraft's history is spread over tasks: a segment for nearly every cell that it enters."""
    df = spark.range(5000).select(F.col("id").alias("seq"), F.lit(1).alias("aircraft"), F.floor(F.col("id") / 3).alias("cell10"), F.lit(True).alias("first"))
    s = _segments(df, "aircraft", "seq", F.col("first"), "cell10", F.lit(False), F.floor(F.col("seq") / 1000), 4)
    assert s.select("segment_").distinct().count() > 1500
    parked = spark.range(5000).select(F.col("id").alias("seq"), F.lit(1).alias("aircraft"), (F.col("id") % 4).alias("cell10"), F.lit(True).alias("first"))
    assert h3_stationary(parked, arrival=F.col("seq"), forget=500).where("h3_stationary").count() == 5000 - 360
    assert h3_stationary(parked.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the given tables are not here")
def test_ingest_reads_lines_once(spark, monkeypatch):
    """Lines are scanned and parsed for one narrow table; windows, cells and ground are planned once behind it."""
    from beaconlake.operators import ingest
    from beaconlake.plans import inputs as I

    sf = "/root/testdata/sf0.001"
    written, plans = ingest.written, {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return written(df, name)

    monkeypatch.setattr(ingest, "written", kept)
    monkeypatch.setattr("beaconlake.operators.state_machines.written", kept)
    fates = ingest.packets(I.feed_lines(spark, sf, True), I.tiles(spark, sf).limit(0), I.grid_cell)
    last = fates._jdf.queryExecution().optimizedPlan().toString()
    assert set(plans) == {"packets", "cells", "segments"}
    assert plans["packets"].count("Relation [event_id") == 1 and "Window" not in plans["packets"]
    assert plans["cells"].count("Relation [seq") == 1 and plans["cells"].count("ArrowEvalPython") == 1
    assert "comment" not in last and last.count("MapInPandas") == 1 and last.count("ArrowEvalPython") == 1


def test_moves_of_stations_with_most_beacons(spark):
    """Ranges, runs and stretches without a move against one walk: a station with most rows that rests, jitters, drives and
    jumps by turns, others, and a station without a name; some beacons have no place."""
    rng, rows = random.Random(7), []
    at = {w: [47.0, 8.0] for w in ("a", "b", None)}
    for seq in range(12000):
        who = "a" if rng.random() < 0.7 else rng.choice(["b", None])
        mode, p = seq // 500 % 5, at[who]
        if mode == 1:
            here = [p[0] + rng.gauss(0, 0.001), p[1] + rng.gauss(0, 0.001)]
        elif mode == 2:
            p[0] += 0.03
            here = list(p)
        elif mode == 3:
            here = [p[0] + rng.choice([0, 0, 0.008, 0.05]), p[1]]
        else:
            here = list(p) if mode == 0 or rng.random() < 0.98 else [p[0], p[1] + rng.choice([0.0005, 0.004])]
        rows.append((seq, who, *(here if rng.random() > 0.01 else rng.choice([[None, here[1]], [float("nan"), None]]))))
    want, state = {}, {}
    step = _move_step(DEFAULT)
    for seq, who, lat, lng in rows:
        s = state.setdefault(who, _Place())
        want[seq] = step(s, lat, lng) if lat is not None and lng is not None and lat == lat else (None, s.moved, s.bouncing)
    df = spark.createDataFrame(rows, "seq long, station string, lat double, lng double").withColumnsRenamed({"station": "station_id"}).repartition(7)
    got = {r.seq: (r.move, r.moved, r.bouncing) for r in station_moves(df).collect()}
    assert got == want and {w[0] for w in want.values()} == {"still", "near", "moved", "in_motion", "bouncing", None}
    assert station_moves(df).columns == [*df.columns, "move", "moved", "bouncing"] and station_moves(df.limit(0)).collect() == []


def test_resting_stations_are_not_walked(spark, monkeypatch):
    """Of a station's beacons at one place only the first two of each range reach Python."""
    from beaconlake.operators import state_machines

    walked, seen = state_machines._walked, []
    monkeypatch.setattr(state_machines, "_walked", lambda changes, config: seen.append(changes.count()) or walked(changes, config))
    rest = spark.range(20000).select(F.col("id").alias("seq"), F.lit(1).alias("station_id"), F.when(F.col("id") < 15000, 47.0).otherwise(48.0).alias("lat"), F.lit(8.0).alias("lng"))
    assert station_moves(rest).groupBy("move").count().where("move = 'still'").first()["count"] == 19999 and seen[0] <= 12


@pytest.mark.parametrize("arrival", [None, "t"])
def test_windows_of_one_aircraft_are_bounded(spark, monkeypatch, arrival):
    """Most packets are one aircraft's, all within the forgetting time: its windows fall apart into ranges, its record does not."""
    from beaconlake.operators import state_machines

    rng, rows, here = random.Random(3), [], 0
    for seq in range(4000):
        who = "a" if rng.random() < 0.9 else "b"
        here += seq // 400 % 3 == 1 and seq % 5 == 0
        rows.append((seq * 3, who, seq, here * 10 + rng.randrange(3), rng.random() < 0.9, False, rng.random() < 0.001))
    made, sizes = state_machines._segments, []

    def seen(packets, aircraft, order, first, cell, forgotten, stretch, most):
        sizes.append(packets.groupBy(aircraft, stretch).count().agg(F.max("count")).first()[0])
        return made(packets, aircraft, order, first, cell, forgotten, stretch, most)

    monkeypatch.setattr(state_machines, "_segments", seen)
    df = spark.createDataFrame(rows, SCHEMA)
    got = h3_stationary(df, forgotten="forgotten", standing=F.col("standing"), arrival=F.col(arrival) if arrival else None, limit=20, per_range=300)
    assert {r.seq: r.h3_stationary for r in got.collect()} == walk(rows, 20, 4) and sizes[0] <= 310
    assert 100 < got.where("h3_stationary").count() < 3500
