"""The station dimension: ids, validity, latest state."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.config import DEFAULT
from beaconlake.functions.geo import distance_km
from beaconlake.functions.stations import GLOBAL_ID, GLOBAL_NAME, decode_token
from beaconlake.sources.shared import written


def allocate_ids(names: DataFrame, known: DataFrame, name: str = "station", id_: str = "id") -> DataFrame:
    """(station, id) of every name: its known id, or the next free ones in name order.

    New names are sorted over all tasks and written with their place in their partition; a partition's first number
    follows from the counts of those before it, one row for each partition.
    """
    new = names.select(name).distinct().where(F.col(name).isNotNull()).join(known, name, "left_anti")
    placed = written(new.sort(name).withColumn("at_", F.monotonically_increasing_id()), "names").withColumn("part_", F.shiftright("at_", 33))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("part_").agg(F.count("*").alias("n_")).select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    top = known.agg(F.coalesce(F.max(id_), F.lit(0)).alias("top_"))
    number = F.col("top_") + F.col("base_") + F.col("at_").bitwiseAND((1 << 33) - 1) + 1
    numbered = placed.join(counts, "part_").crossJoin(F.broadcast(top)).select(name, number.cast("int").alias(id_))  # top has one row
    return known.select(name, F.col(id_).cast("int")).unionByName(numbered)


def is_valid(last_packet: Column, last_beacon: Column, moved: Column, now: Column, expiry_days: int = DEFAULT.station_expiry_days) -> Column:
    """Heard within the expiry time, by packet, else by beacon, and not moved. Never heard counts as just heard."""
    last = F.coalesce(F.nullif(last_packet, F.lit(0)), F.nullif(last_beacon, F.lit(0)), now)
    return (last > now - expiry_days * 86400) & ~F.coalesce(moved, F.lit(False))


def with_purge(stations: DataFrame, limit: float = DEFAULT.purge_limit) -> DataFrame:
    """Adds purge: whether to purge an invalid station. If more than ``limit`` of the valid ones would go at
    once, none does. ``stations`` has valid and was_valid."""
    share = stations.agg((F.count_if(F.col("was_valid") & ~F.col("valid")) / F.count_if(F.col("valid"))).alias("share_"))
    return stations.crossJoin(F.broadcast(share)).withColumn("purge", ~F.col("valid") & (F.coalesce("share_", F.lit(1.0)) <= limit)).drop("share_")  # share has one row


def latest(rows: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """For each key the values of its last row."""
    return rows.groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values], F.max(order).alias(order))


def skippable(changed_since: Column, last_packet: Column, moved: Column, is_global: Column, has_output: Column, any_retired: Column) -> Column:
    """A station without anything new needs no rollup."""
    return ~is_global & ~any_retired & has_output & ~F.coalesce(moved, F.lit(False)) & (F.coalesce(last_packet, F.lit(0)) < changed_since)


def search(stations: DataFrame, pattern: str, name: str = "station") -> DataFrame:
    """Stations whose name a pattern finds, whatever the case; all for patterns under two characters or that
    can't be read."""
    try:
        re.compile(pattern)
    except re.error:
        return stations
    return stations.where(F.col(name).rlike(f"(?i){pattern}")) if len(pattern) > 1 else stations


def with_global(stations: DataFrame, id_: str = "id", name: str = "station") -> DataFrame:
    """The global station in front of the others, with id 0."""
    one = stations.sparkSession.range(1).select(F.lit(GLOBAL_ID).cast("int").alias(id_), F.lit(GLOBAL_NAME).alias(name))
    return one.unionByName(stations.select(F.col(id_).cast("int"), name))


def shown(stations: DataFrame, all_stations: bool = False) -> DataFrame:
    """What the map shows: valid stations, or all if asked for or if the table does not tell."""
    return stations if all_stations or "valid" not in stations.columns else stations.where("valid")


def unsaved(stations: DataFrame) -> DataFrame:
    """On a graceful stop: stations heard since their document was last written by a beacon."""
    return stations.where(F.coalesce("last_beacon", F.lit(0)) < F.coalesce("last_packet", F.lit(0)))


def validity_counts(stations: DataFrame) -> DataFrame:
    """One row: stations valid now, those that are not any more, and those that moved. stations has valid,
    was_valid and moved; a moved station is not valid."""
    ok = F.col("valid") & ~F.col("moved")
    return stations.agg(F.count_if(ok).alias("validStations"), F.count_if(~ok & F.col("was_valid")).alias("invalidStations"), F.count_if("moved").alias("movedStations"))


def of_cell(cells: DataFrame, stations: DataFrame, lat: str = "cell_lat", lng: str = "cell_lng") -> DataFrame:
    """The stations that a cell lists, in its order, with the distance of each from the cell's centre in whole km and
    its share. cells has h3, stations and a centre; stations id, station, lat and lng. A distance is empty where the
    station's place is unknown, a share where it is 10 % or less, a name null where the dimension lacks the station."""
    rows = cells.where("stations <> ''").select("h3", lat, lng, F.posexplode(F.split("stations", ",")).alias("place", "t_"))
    rows = rows.select("h3", "place", lat, lng, decode_token(F.col("t_")).alias("d_")).select("h3", "place", lat, lng, "d_.*")
    known = stations.select(F.col("id").alias("station_id"), F.col("station").alias("name"), F.col("lat").alias("lat_"), F.col("lng").alias("lng_"))
    km = F.round(distance_km(F.col(lat), F.col(lng), F.col("lat_"), F.col("lng_"))).cast("long").cast("string")
    placed = F.col("lat_").isNotNull() & ~F.isnan("lat_")
    return rows.join(known, "station_id", "left").select(
        "h3", "place", "station_id", "name", F.when(placed, F.concat(km, F.lit(" km"))).otherwise("").alias("distance"),
        F.when(F.col("percent") > 10, F.concat(F.col("percent").cast("string"), F.lit("%"))).otherwise("").alias("share"))


def listed(cells: DataFrame, stations: DataFrame, *keys: str) -> DataFrame:
    """The stations that each cell lists, by number: cells with keys and tokens, stations with id and name.
    Stations without a name, or with a place that is no number, are left out."""
    ids = cells.where("stations <> ''").select(*keys, F.explode(F.split("stations", ",")).alias("t_")).select(*keys, decode_token(F.col("t_"))["station_id"].alias("id"))
    there = stations.where("station IS NOT NULL")
    there = there.where("lat IS NULL OR NOT isnan(lat)") if "lat" in stations.columns else there
    found = ids.join(there.select("id"), "id")
    return found.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_set("id")), lambda x: x.cast("string")), ",").alias("ids"))
