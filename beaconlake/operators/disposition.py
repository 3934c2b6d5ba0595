"""Why packets are dropped: the first rule that applies, in the order in which state is updated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.functions import packets as P
from beaconlake.functions.once import once
from beaconlake.functions.stations import ignored

REASONS = ("ignoredStation", "ignoredPAW", "invalidTracker", "invalidTimestamp", "ignoredTracker", "ignoredStationary",
           "ignoredH3stationary", "ignoredSignal0", "ignoredElevation", "count")


def standing(speed: Column, rotation: Column, climb: Column, mode: str = "as_coded") -> Column:
    """Not turning and hardly climbing. As coded, packets with any speed but zero are tested; as intended,
    those slower than 1."""
    tested = (F.coalesce(speed, F.lit(0.0)) != 0) if mode == "as_coded" else (F.coalesce(speed, F.lit(99.0)) < 1)
    return tested & (rotation == 0) & (climb < 30)


def before_state(p: DataFrame, mode: str = "as_coded") -> DataFrame:
    """Adds station, flarm_id, standing and reason to parsed packets, from the rules that need no state."""
    relays = F.col("digipeaters")
    rest = F.slice(relays, 1, F.greatest(F.size(relays) - 1, F.lit(0)))
    tracker = (F.col("dest_callsign") == "OGNTRK") & ~F.coalesce(F.try_element_at(rest, F.lit(1)).startswith("qA"), F.lit(False))
    named = once(p, station=P.station(relays), flarm_id=P.flarm_id(F.col("source_callsign")),
                 standing=standing(F.col("speed"), P.rotation(F.col("comment")), P.climb(F.col("comment")), mode), ignored_=ignored(P.station(relays)))
    return once(named, reason=F.when(F.col("ignored_"), "ignoredStation")
                .when(F.col("source_callsign").startswith("PAW"), "ignoredPAW")
                .when(F.col("flarm_id").isNull(), "invalidTracker")
                .when(F.coalesce(F.col("timestamp"), F.lit(0)) == 0, "invalidTimestamp")
                .when(F.coalesce(tracker, F.lit(False)), "ignoredTracker")
                .when(F.col("standing"), "ignoredStationary")).drop("ignored_")


def after_state(p: DataFrame, h3_stationary: Column | None = None, ground_failed: Column | None = None) -> DataFrame:
    """Adds signal and crc and completes reason; packets that pass every rule have reason count."""
    p = once(p, signal=P.signal(F.col("comment")), crc=P.crc(F.col("comment")))
    reason = F.coalesce(
        F.col("reason"), F.when(h3_stationary, "ignoredH3stationary") if h3_stationary is not None else F.lit(None),
        F.when(F.col("signal") <= 0, "ignoredSignal0"), F.when(ground_failed, "ignoredElevation") if ground_failed is not None else F.lit(None), F.lit("count"))
    return p.withColumn("reason", reason)


def counts(p: DataFrame, *keys: str) -> DataFrame:
    """A column for each reason, over the whole table or each key. reason is worked out once a row: rows are counted
    by reason first. A packet whose ground could not be told had passed all other rules, and is in count too."""
    by_reason = p.groupBy(*keys).pivot("reason", list(REASONS)).count()
    n = {r: F.coalesce(F.col(f"`{r}`"), F.lit(0)).alias(r) for r in REASONS}
    return by_reason.select(*keys, *(n | {"count": (F.coalesce("count", F.lit(0)) + F.coalesce("ignoredElevation", F.lit(0))).alias("count")}).values())


def station_counts(p: DataFrame, station: str = "station") -> DataFrame:
    """The counters that a station's document holds: packets of aircraft that stay in few cells are among the
    standing ones there, and stations that are ignored have no document."""
    known = counts(p.where("reason <> 'ignoredStation'"), station)
    return known.withColumns({"ignoredStationary": F.col("ignoredStationary") + F.col("ignoredH3stationary"), "ignoredH3stationary": F.lit(0).cast("long")}).drop("ignoredStation")
