"""Packet gaps from the order of arrival, per receiving station and per aircraft."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.config import DEFAULT


def with_gaps(packets: DataFrame, station: str = "station_id", aircraft: str = "aircraft", order: str = "seq", ts: str = "pts",
              standing: Column | None = None, max_gap: int = DEFAULT.max_gap, forget: int = DEFAULT.forget_seconds, arrival: Column | None = None) -> DataFrame:
    """Adds prev, seen, gap, first and forgotten to packets in their order of arrival.

    prev is the time of the pair's packet before; seen the latest time of the aircraft's packets before, at
    any station, where a standing packet overwrites it. Both are forgotten after ``forget`` seconds. The gap is
    ts - prev, or without prev the time since seen, at least 1; at most ``max_gap``, and it may be negative for
    late packets. A packet is first if it is newer than seen. Standing packets change seen but are no
    packets of a pair. At a forgotten packet nothing is known of the aircraft any more: whatever else is kept of it starts
    anew there. Nulls in a key form a key of their own.

    With ``arrival``, a clock in seconds that runs with ``order`` and that packet times do not run behind by more
    than they are late, one aircraft may have any number of packets: as all is forgotten after a while, each
    stretch of ``forget`` seconds is a window of its own, which the stretch before it is read into once more.
    """
    still = F.coalesce(standing, F.lit(False)) if standing is not None else F.lit(False)
    t = F.col(ts)
    stretches = packets.withColumns({"stretch_": F.lit(0).cast("long"), "again_": F.lit(False)})
    if arrival is not None:
        own = F.floor(arrival / forget)
        stretches = (packets.withColumn("x_", F.explode(F.array(F.struct(own.alias("stretch_"), F.lit(False).alias("again_")), F.struct((own + 1).alias("stretch_"), F.lit(True).alias("again_")))))
                     .select("*", "x_.stretch_", "x_.again_").drop("x_"))
    by_aircraft = Window.partitionBy(aircraft, "stretch_").orderBy(order)
    earlier = by_aircraft.rowsBetween(Window.unboundedPreceding, -1)
    rows = stretches.withColumn("still_", still).withColumn("island_", F.sum(F.col("still_").cast("int")).over(by_aircraft.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = Window.partitionBy(station, aircraft, "stretch_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    fresh = lambda x: F.when(t - x <= forget, F.nullif(x, F.lit(0)))
    newest = F.max(F.struct("island_", t.alias("t_"))).over(earlier)["t_"]  # of the last standing packet and those after it
    return (rows.withColumns({"prev": fresh(F.last(F.when(~F.col("still_"), t), ignorenulls=True).over(before)), "seen": fresh(newest)})
            .withColumns({
                "gap": F.when(F.col("prev").isNotNull(), F.least(F.lit(max_gap), t - F.col("prev")))
                .otherwise(F.least(F.lit(max_gap), F.greatest(F.lit(1), t - F.coalesce("seen", t)))).cast("int"),
                "first": F.coalesce(F.col("seen") < t, F.lit(True)), "forgotten": F.col("seen").isNull()})
            .where("NOT again_").drop("still_", "island_", "stretch_", "again_"))
