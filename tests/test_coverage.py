"""The coverage engine: golden records, laws of the aggregate, keys, buckets, state machines."""

import datetime as dt
import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from beaconlake.functions import buckets as B
from beaconlake.functions import cells as C
from beaconlake.functions import geo, viz
from beaconlake.functions import packets as P
from beaconlake.functions import stations as S
from beaconlake.operators import coverage as V
from beaconlake.operators import disposition as D
from beaconlake.operators import maintenance as M
from beaconlake.operators import rollup as R
from beaconlake.operators import stations as ST
from beaconlake.operators.gaps import with_gaps
from beaconlake.operators.state_machines import h3_stationary, station_moves
from beaconlake.plans import api

SAMPLE = "alt int, agl int, crc int, signal int, gap int, station_id int"


def samples(spark, rows):
    return spark.createDataFrame([(*r, None)[:6] for r in rows], SAMPLE)


GOLDEN = [
    ([(10, 11, 1, 12, 0)], dict(min_alt=10, min_alt_sig=12, min_agl=11, sum_sig=3, sum_crc=1, count=1, sum_gap=0)),
    ([(10, 11, 1, 12, 0)] * 2, dict(sum_sig=6, sum_crc=2, count=2)),
    ([(10, 10, 10, 10, 10)] * 2, dict(sum_sig=4, sum_crc=20, count=2, sum_gap=20)),
    ([(10, 10, 10, 10, 10), (1, 12, 0, 20, 0)], dict(min_alt=1, min_alt_sig=20, min_agl=10, sum_sig=7, sum_crc=10, sum_gap=10)),
    ([(10, 10, 10, 10, 10), (12, 1, 9, 20, 0)], dict(min_alt=10, min_alt_sig=10, min_agl=1, sum_sig=7, sum_crc=19)),
    ([(100, 100, 0, 255, 0)], dict(sum_sig=63)),
    ([(0, 0, 0, 8, 0), (0, 5, 0, 9, 0)], dict(min_alt=0, min_alt_sig=9, min_agl=5)),
    ([(-5, 3, 0, 8, 0), (7, 5, 0, 9, 0)], dict(min_alt=-5, min_alt_sig=8, min_agl=3)),
]


@pytest.mark.parametrize("rows, want", GOLDEN)
def test_partial(spark, rows, want):
    got = V.partial(samples(spark, rows)).first().asDict()
    assert {k: got[k] for k in want} == want


@pytest.mark.parametrize("dest, src, want", [
    ((5, 10, 2, 8, 1), (10, 11, 1, 12, 1), dict(min_alt=5, min_alt_sig=8, min_agl=10, sum_sig=5, sum_crc=3, count=2, sum_gap=2)),
    ((10, 10, 2, 8, 1), (10, 11, 1, 12, 1), dict(min_alt=10, min_alt_sig=12, min_agl=10)),
    ((10, 10, 2, 24, 1), (10, 11, 1, 12, 1), dict(min_alt_sig=24, sum_sig=9)),
])
def test_merge(spark, dest, src, want):
    both = V.partial(samples(spark, [dest])).unionByName(V.partial(samples(spark, [src])))
    got = V.merge(both).first().asDict()
    assert {k: got[k] for k in want} == want


def test_merge_is_associative_and_order_free(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 0, 5, 9, 30]), rng.choice([0, 3, 8]), rng.randint(0, 9), rng.randint(1, 255), rng.randint(0, 60), rng.randint(1, 4)) for _ in range(300)]
    whole = V.partial(samples(spark, rows), "station_id").orderBy("station_id").collect()
    for n in (2, 5):
        cut = V.partial(samples(spark, rows).withColumn("part", F.pmod(F.hash("*"), F.lit(n))), "part", "station_id")
        assert V.merge(V.merge(cut, "station_id", "part"), "station_id").orderBy("station_id").collect() == whole


def by_station(spark, ids):
    return V.partial(samples(spark, [(10, 11, 1, 12, 0, i) for i in ids]).withColumn("h3", F.lit(1)), "h3", "station_id")


@pytest.mark.parametrize("ids, tokens", [([1, 2, 2], [(2, 60), (1, 30)]), ([1, 2, 2, 1], [(1, 50), (2, 50)]), ([1, 2, 2, 1, 3], [(1, 40), (2, 40), (3, 20)])])
def test_global_cells(spark, ids, tokens):
    cell = V.global_cells(by_station(spark, ids), "h3").first()
    assert cell["count"] == len(ids) and cell.num_stations == len(set(ids))
    decoded = spark.createDataFrame([(t,) for t in cell.stations.split(",")], "t string").select(S.decode_token(F.col("t")).alias("d")).collect()
    assert [(r.d.station_id, r.d.percent) for r in decoded] == tokens


def test_rollup_and_prune(spark):
    valid = spark.createDataFrame([(1,), (2,)], "station_id int")
    got = lambda new, old, ok: {r.station_id: r["count"] for r in R.rollup(by_station(spark, new), by_station(spark, old), ok, "h3", "station_id").collect()}
    assert got([1, 2], [2], valid) == {1: 1, 2: 2}
    assert got([1, 2, 2, 1], [3], valid) == {1: 2, 2: 2}
    assert got([3], [1], valid) == {3: 1, 1: 1}  # new records are never held against the valid stations
    assert got([1], [3], valid.limit(0)) == {1: 1}
    assert V.prune(by_station(spark, [3]), valid).collect() == []


def test_averages(spark):
    got = V.finalise(V.partial(samples(spark, [(100, 100, 5, 20, 4)] * 2))).first()
    assert (got.avg_sig, got.avg_crc, got.avg_gap) == (20, 50, 16)


@pytest.mark.parametrize("when, want", [
    ("2024-06-15 12:00", ((15 << 7) | 4, 175, 3717, 2024, 2023, "2024-06-15", "2024-06", "2024", "2023nz")),
    ("2024-07-01 00:00", (128, (6 << 5) | 1, (232 << 4) | 6, 2024, 2024, "2024-07-01", "2024-07", "2024", "2024nz")),
    ("2024-01-01 00:00", (128, 1, 232 << 4, 2024, 2023, "2024-01-01", "2024-01", "2024", "2023nz")),
])
def test_buckets(spark, when, want):
    s = int(dt.datetime.fromisoformat(when).replace(tzinfo=dt.UTC).timestamp())
    x = spark.createDataFrame([(s,)], "s long")
    got = x.select(*[B.bucket(t, F.col("s")).alias(t) for t in B.TYPES], *[B.file_name(t, F.col("s")).alias("f" + t) for t in B.ROLLED]).first()
    assert tuple(got) == want


def test_keys(spark):
    cell = int("87088619affffff", 16)
    row = spark.createDataFrame([(cell,)], "h long").select(
        C.low(F.col("h")).alias("lo"), C.high(F.col("h")).alias("hi"), C.resolution(F.col("h")).alias("res"), C.to_hex(F.col("h")).alias("hex"),
        B.pack(F.lit(1), F.lit(5)).alias("p"), B.pack(F.lit(3), F.lit(0)).alias("m"), B.pack(F.lit(0), F.lit(0xFFF)).alias("c"),
        C.lock_key(F.lit(0), B.pack(F.lit(1), F.lit(0)), F.col("h")).alias("lock"), C.parse_key(F.lit("2005/00_meta"))["is_meta"].alias("meta"), C.from_hex(F.lit("87088619affffff")).alias("back")).first()
    assert (row.lo, row.hi, row.res, row.hex, row.back) == (0x9AFFFFFF, 0x8708861, 7, "87088619affffff", cell)
    assert (row.p, row.m, row.c, row.lock, row.meta) == ("1005", "3000", "0fff", "0/1000/87088619affffff", True)


def test_comment_fields(spark):
    texts = ["id06DDE626 -019fpm +0.0rot 5.5dB 3e -4.3kHz ", "id 70.0dB ", "x .dB ", "", None, "a 5.5dB"]
    got = spark.createDataFrame([(t,) for t in texts], "c string").select(P.signal(F.col("c")), P.crc(F.col("c")), P.climb(F.col("c")), P.rotation(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(22, 3, 19.0, 0.0), (255, 0, 0.0, 0.0), (0, 0, 0.0, 0.0), (0, 0, 0.0, 0.0), (0, 0, 0.0, 0.0), (0, 0, 0.0, 0.0)]


def test_ignored_names(spark):
    names = {"Spider": True, "12345": True, "": True, "fnb1": True, "a b": True, "n0test-1": True, "LFLE": False, "GOOD_1-x": False, None: True}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", S.ignored(F.col("n")).alias("x"))
    assert {r.n: r.x for r in df.collect()} == names


def test_gaps_follow_arrival(spark):
    rows = [(1, 1, 7, 100, False), (2, 1, 7, 103, False), (3, 2, 7, 103, False), (4, 1, 7, 300, False), (5, 1, 7, 290, False), (6, 1, 7, 291, True), (7, 2, 7, 295, False), (8, 1, 7, 99999, False)]
    df = spark.createDataFrame(rows, "seq int, station_id int, aircraft int, pts long, still boolean")
    got = {r.seq: (r.gap, r.first) for r in with_gaps(df, standing=F.col("still")).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5, 7, 8)] == [(1, True), (3, True), (1, False), (60, True), (-10, False), (60, True), (1, True)]


def test_standing_modes(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (20.0,), (None,)], "s double")
    f = lambda m: [r[0] for r in df.select(D.standing(F.col("s"), F.lit(0.0), F.lit(0.0), m)).collect()]
    assert f("as_coded") == [False, True, True, False] and f("intended") == [True, True, False, False]


def test_dispositions_in_order(spark):
    base = dict(source_callsign="ICA123456", dest_callsign="APRS", digipeaters=["qAS", "ST1"], timestamp=5, speed=0.0, comment="id +019fpm +1.0rot 5.5dB 1e ")
    cases = [({}, "count"), (dict(digipeaters=["qAS", "TEST"]), "ignoredStation"), (dict(digipeaters=[]), "ignoredStation"), (dict(source_callsign="PAW123456"), "ignoredPAW"), (dict(source_callsign="A1"), "invalidTracker"), (dict(timestamp=0), "invalidTimestamp"),
             (dict(dest_callsign="OGNTRK", digipeaters=["ST1"]), "ignoredTracker"), (dict(dest_callsign="OGNTRK"), "count"), (dict(speed=5.0, comment="id +019fpm +0.0rot 5.5dB "), "ignoredStationary"), (dict(comment="id "), "ignoredSignal0")]
    rows = [tuple((base | c)[k] for k in base) + (i,) for i, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "source_callsign string, dest_callsign string, digipeaters array<string>, timestamp long, speed double, comment string, i int")
    got = {r.i: r.reason for r in D.after_state(D.before_state(df)).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_stationary_aircraft(spark):
    rows = [(1, i, 5, True) for i in range(91)] + [(2, i, i % 4, True) for i in range(361)] + [(3, i, i % 5, True) for i in range(600)] + [(4, i, 5, False) for i in range(200)]
    got = h3_stationary(spark.createDataFrame(rows, "aircraft int, seq int, cell10 int, first boolean")).where("h3_stationary").collect()
    assert sorted((r.aircraft, r.seq) for r in got) == [(1, 90), (2, 360)]


def test_station_moves(spark):
    km = 1 / 111.0
    path = [0, 0.05, 1, 5, 10, 5.0, 10.05]
    df = spark.createDataFrame([(1, i, 47.0 + p * km, 8.0) for i, p in enumerate(path)] + [(2, i, 47.0 + (i % 2) * 5 * km, 8.0) for i in range(4)], "station_id int, seq int, lat double, lng double")
    got = sorted((r.station_id, r.seq, r.move) for r in station_moves(df).collect())
    assert [m for s, _, m in got if s == 1] == ["still", "still", "near", "moved", "moved", "bouncing", "moved"]
    assert [m for s, _, m in got if s == 2] == ["still", "moved", "bouncing", "moved"]


def test_distance_and_elevation(spark):
    r = spark.range(1).select(geo.distance_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("d"), geo.elevation(F.lit(1), F.lit(134), F.lit(160)).alias("e"), geo.elevation(F.lit(None), F.lit(1), F.lit(1)).alias("n")).first()
    assert abs(r.d - 20015.114) < 0.01 and r.e == -10000 + (65536 + 134 * 256 + 160) // 10 and r.n == 0


def test_palette(spark):
    p = spark.range(1).select(viz.palette("00ff00ff", "ff0000").alias("p"), viz.primary_station_colour(F.lit("1z,x")).alias("c"), viz.primary_station_colour(F.lit("")).alias("m")).first()
    assert p.p[0] == [0, 255, 0, 255] and p.p[4] == [128, 128, 0, 255] and len(p.p) == 8 and p.c[:2] == [7, 245] and p.m == [255, 0, 255, 128]


def test_ids_and_history(spark):
    known = spark.createDataFrame([("a", 4)], "station string, id int")
    got = ST.allocate_ids(spark.createDataFrame([("b",), ("a",), ("c",), ("b",), (None,)], "station string"), known).collect()
    assert {r.station: r.id for r in got} == {"a": 4, "b": 5, "c": 6}
    m = M.push_start(spark.createDataFrame([(1, i) for i in range(300)], "k int, t long"), "k", "t").first()
    assert m.all_starts == list(range(50, 300))


def test_listing_and_prefixes(spark):
    names = ["ST1.day.2024-01-02.arrow", "ST1.day.2024-01-01.arrow", "ST1.yearnz.2023nz.arrow", "junk.txt"]
    got = {(r.station, r.acc_type): (r["all"], r.current) for r in api.station_files(api.listing(spark.createDataFrame([(n,) for n in names], "name string"))).collect()}
    assert got == {("ST1", "day"): ("2024-01-01,2024-01-02", "2024-01-02"), ("ST1", "yearnz"): ("2023nz", "2023nz")}
    p = spark.createDataFrame([("day.2023-09-23",), ("month.2023-09",), ("year.2023",), ("yearnz.2023nz",), ("x",)], "f string").select(api.period_prefix(F.col("f"))).collect()
    assert [r[0] for r in p] == ["2023-09", "2023-09", "2023", "2023", ""]


def test_pruning_equals_recomputing(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 9), rng.randint(0, 9), 1, rng.randint(1, 200), 5, rng.randint(1, 6)) for _ in range(200)]
    df = samples(spark, rows).withColumn("h3", F.col("alt") % 3)
    valid = spark.createDataFrame([(1,), (4,)], "station_id int")
    pruned = V.global_cells(V.prune(V.partial(df, "h3", "station_id"), valid), "h3").orderBy("h3").collect()
    assert pruned == V.global_cells(V.partial(df.where("station_id IN (1, 4)"), "h3", "station_id"), "h3").orderBy("h3").collect()


def test_empty_inputs(spark):
    none = samples(spark, []).withColumn("h3", F.lit(1))
    assert V.global_cells(V.partial(none, "h3", "station_id"), "h3").collect() == []
    assert list(itertools.chain(V.merge(V.partial(none, "h3"), "h3").collect())) == []


@pytest.mark.parametrize("most, shown", [(255, 255), (None, 300)])
def test_a_cell_with_more_stations_than_a_byte_counts(spark, most, shown):
    cell = V.global_cells(by_station(spark, range(1, 301)), "h3", most=most).first()
    assert cell.num_stations == shown and len(cell.stations.split(",")) == 30


def test_top30_counts_all_stations(spark, tmp_path):
    """More stations in a cell than the header's byte holds: the query tells their number, as its SQL does."""
    from beaconlake.plans import queries as Q
    from tests.oracle import same

    e = spark.range(2000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 20).alias("ts"), (F.col("id") % 2000 * 7).alias("user_id"), F.lit(20.0).alias("value"), F.lit('{"k": 5}').alias("props"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df = Q.QUERIES["top30_tokens"](spark, str(tmp_path))
    same(df, con, Q.SQL["top30_tokens"])
    assert df.agg(F.max("num_stations")).first()[0] > 255
