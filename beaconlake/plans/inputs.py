"""Domain inputs derived from the given tables: packets, feed lines, coverage histories, stations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.functions import buckets as B
from beaconlake.functions import cells as C
from beaconlake.functions import geo
from beaconlake.functions.once import once
from beaconlake.operators import coverage as V
from beaconlake.operators.gaps import with_gaps
from beaconlake.sources import png

#: Start of the events, and how many seconds of theirs one second of the packet clock stands for.
START, COMPRESSION = 1704067200, 1800
#: Bits of a well-formed index of mode 1 and resolution 8 with its unused digits set.
CELL8_BASE = 576460752303423488 + 36028797018963968


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet for each event, in arrival order by seq."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    ts_s = B.epoch_seconds(F.col("ts"), dict(e.dtypes)["ts"])
    base = e.select(F.col("event_id").alias("seq"), ts_s.alias("ts_s"), F.col("user_id"), F.col("value"), k.alias("k"))
    alt = F.col("seq") * 37 % 3000
    cell8 = F.lit(CELL8_BASE) + F.shiftleft((F.col("k") % 5).cast("long"), 45) + F.shiftleft(F.col("user_id") % 7, 24) + F.shiftleft(F.col("seq") % 7, 21) + 2097151
    return base.select(
        "seq", "ts_s", (F.lit(START) + F.floor((F.col("ts_s") - START) / COMPRESSION)).alias("pts"), (F.col("user_id") % 15).alias("aircraft"),
        (1 + F.col("k") % 12).cast("int").alias("station_id"), F.least(F.floor(F.col("value") + 0.5), F.lit(255)).cast("int").alias("signal"),
        (F.col("k") % 10).cast("int").alias("crc"), alt.cast("int").alias("alt"), F.greatest(alt - F.col("k") * 10, F.lit(0)).cast("int").alias("agl"),
        cell8.alias("cell8"), C.parent(cell8, 7).alias("cell7"), "k", "user_id")


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with their gaps, in windows of a stretch of the packet clock each, whatever an aircraft sends in all."""
    return with_gaps(packets(spark, sf_dir), arrival=F.col("pts"))


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with a signal; the test follows the windows, which see all packets."""
    return gapped(spark, sf_dir).where("signal > 0")


def daily(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Partial records for each UTC day and the keys."""
    return V.partial(accepted(spark, sf_dir).withColumn("day", B.utc_date(F.col("ts_s"))), "day", *keys)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The station dimension that the packets imply: every third id's name is missing from it."""
    p = packets(spark, sf_dir).where("signal > 0")
    return p.groupBy(F.col("station_id").alias("id")).agg(F.max("ts_s").alias("last_packet")).withColumn("station", F.when(F.col("id") % 5 != 0, F.concat(F.lit("ST"), "id")))


def beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location beacons: stations that rest, jitter, drive on, jump, and change between two places."""
    p = packets(spark, sf_dir)
    jump = F.when(F.col("station_id") % 4 == 0, 0.0).when(F.col("station_id") % 4 == 1, (F.col("k") % 2) * 0.01).when(F.col("station_id") % 4 == 2, F.floor(F.col("k") / 25) * 0.02).otherwise((F.col("seq") % 2) * 0.5)
    return p.select("seq", "ts_s", "station_id", (F.lit(47.0) + F.col("station_id") * 0.1 + jump).alias("lat"), (F.lit(8.0) + jump).alias("lng"))


def feed_lines(spark: SparkSession, sf_dir: str, every_fate: bool = False) -> DataFrame:
    """Raw feed lines made from the events: packets, receivers' own lines and noise. With every_fate there are also
    positions without a time, two aircraft that never leave their place, and unreadable lines of receivers."""
    p = packets(spark, sf_dir).withColumn("speed", F.col("k") % 4 * 20)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    clock = F.pmod(F.col("ts_s"), F.lit(86400))
    time = F.concat(two(F.floor(clock / 3600)), two(F.floor(clock / 60) % 60), two(clock % 60))
    relay = F.when(F.col("k") % 17 == 3, "FNB7").when(F.col("k") % 17 == 5, "12345").otherwise(F.concat(F.lit("ST"), F.col("station_id").cast("string")))
    source = F.when(F.col("k") % 19 == 2, "PAW12345").when(F.col("k") % 19 == 4, "ABC").otherwise(F.concat(F.lit("ICA0000"), two(F.col("aircraft"))))
    dest = F.when(F.col("k") % 11 == 1, "OGNTRK").otherwise("APRS")
    first = F.when(F.col("k") % 22 == 1, "RELAY*").otherwise("qAS")
    rot = F.when(F.col("k") % 4 == 1, "+0.0").otherwise("-1.5")
    stays = F.lit(every_fate) & (F.col("aircraft") < 2)
    when = F.when(F.lit(every_fate) & (F.col("k") % 23 == 7), "!").otherwise(F.concat(F.lit("/"), time, F.lit("h")))
    position = F.concat(
        source, F.lit(">"), dest, F.lit(","), first, F.lit(","), relay, F.lit(":"), when, F.lit("47"), two(F.when(stays, 30).otherwise(F.col("k") % 60)),
        F.lit(".50N/008"), two(F.when(stays, 15).otherwise(F.col("user_id") % 60)), F.lit(".25E'"),
        F.lit("090/"), F.lpad(F.col("speed").cast("string"), 3, "0"), F.lit("/A="), F.lpad(F.col("alt").cast("string"), 6, "0"),
        F.lit(" id06"), two(F.col("aircraft")), F.lit(" +019fpm "), rot, F.lit("rot "), (F.col("signal") / 4).cast("decimal(8,2)").cast("string"), F.lit("dB "), F.col("crc").cast("string"), F.lit("e -4.3kHz "))
    own = F.concat(relay, F.lit(">OGNSDR,TCPIP*,qAC,SERVER1:"), F.when(F.col("k") % 2 == 0, F.lit(">v0.3 up")).otherwise(F.concat(F.lit("/"), time, F.lit("h4700.00NI00800.00E&/A=001000"))))
    line = F.when(F.col("k") == 97, "# server 1").when(F.col("k") == 98, "user x pass y").when(F.col("k") == 99, own).when(F.col("k") == 96, "broken line")
    if every_fate:
        line = line.when(F.col("k").isin(94, 95), F.concat(F.when(F.col("k") == 94, "FNB7").otherwise(relay), F.lit(">OGNSDR,TCPIP*,qAC,SERVER1:what is this")))
    line = line.otherwise(position)
    return once(p.select("seq", F.col("ts_s").alias("received"), "k", "user_id", "speed", "alt", "aircraft", "station_id", "signal", "crc", "ts_s"), value=line).select("seq", "received", "value")


def grid_cell(lat: np.ndarray, lng: np.ndarray, res: int) -> np.ndarray:
    """A stand-in for the index of a place, for these queries only: minutes of latitude and longitude in the bits of a
    well-formed cell. Real places need the published index."""
    at = np.floor((lat + 90) * 60).astype(np.int64) * 21600 + np.floor((lng + 180) * 60).astype(np.int64)
    return (1 << 59) + (res << 52) + (at << 21) + ((1 << 3 * (15 - res)) - 1)


def grid_centre(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centre of the minute that a stand-in cell was made from."""
    at = cells >> 21 & (1 << 31) - 1
    return (at // 21600 + 0.5) / 60 - 90, (at % 21600 + 0.5) / 60 - 180


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster tiles of two by two pixels under the feed's positions: some are missing, some can't be read."""
    p = packets(spark, sf_dir)
    stays = F.col("aircraft") < 2
    at = geo.tile(F.lit(47.0) + (F.when(stays, 30).otherwise(F.col("k") % 60) + 0.5) / 60, F.lit(8.0) + (F.when(stays, 15).otherwise(F.col("user_id") % 60) + 0.25) / 60, 11)
    known = once(p, at=at).select(F.col("at.x").alias("x"), F.col("at.y").alias("y")).distinct().where("y % 3 <> 0")
    raised = lambda i: ((F.col("x") * 7 + F.col("y") + 11 * i) % 900 + 10000) * 10
    pixel = lambda m: F.struct(F.floor(m / 65536).cast("int").alias("r"), (F.floor(m / 256) % 256).cast("int").alias("g"), (m % 256).cast("int").alias("b"))
    return known.select("x", "y", F.lit(2).alias("width"), F.lit(2).alias("height"), F.when((F.col("x") * 3 + F.col("y")) % 7 != 3, F.array(*[pixel(raised(i)) for i in range(4)])).alias("pixels"))


def png_tiles(places: DataFrame) -> DataFrame:
    """Terrain tiles under places as the bytes of images of 16 by 8 pixels, under every row filter: some are missing, some broken."""
    at = geo.tile(F.col("lat"), F.col("lng"), 11)
    known = places.select(at["x"].alias("x"), at["y"].alias("y")).distinct().where("y % 3 <> 0")

    @F.pandas_udf("binary")
    def image(xs: pd.Series, ys: pd.Series) -> pd.Series:
        py, px = np.mgrid[0:8, 0:16]
        out = []
        for x, y in zip(xs, ys, strict=True):
            tenths = ((x * 37 + y * 11 + px * 13 + py * 101) % 4000 - 300 + 10000) * 10
            pixels = np.stack([tenths >> 16, tenths >> 8 & 255, tenths & 255], axis=2)
            whole = png.encode(pixels, [(x + y + i) % 5 for i in range(8)])
            out.append(whole[:40] if (x * 3 + y) % 7 == 3 else whole)
        return pd.Series(out)

    return known.select("x", "y", image("x", "y").alias("png"))


def purchase_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets over several years, for the longer buckets, from shipments."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        B.epoch_seconds(F.col("l_shipdate"), dict(li.dtypes)["l_shipdate"]).alias("ts_s"), (F.col("l_suppkey") % 20 + 1).cast("int").alias("station_id"), (F.col("l_partkey") % 50).alias("h3"),
        F.col("l_quantity").cast("int").alias("signal"), (F.col("l_linenumber") % 10).cast("int").alias("crc"), (F.col("l_partkey") % 60).cast("int").alias("gap"),
        (F.col("l_orderkey") % 3000).cast("int").alias("alt"), (F.col("l_orderkey") % 500).cast("int").alias("agl"))
