"""From feed lines to coverage: every packet's fate, its gap, its cells and its height above ground."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.config import DEFAULT, Config
from beaconlake.functions import cells as C
from beaconlake.functions import packets as P
from beaconlake.functions import stations as S
from beaconlake.functions.once import once
from beaconlake.operators import disposition as D
from beaconlake.operators.gaps import with_gaps
from beaconlake.operators.state_machines import h3_stationary
from beaconlake.sources.elevation import with_ground
from beaconlake.sources.shared import written

#: What the stateful steps carry; lines and comments stay behind.
_CARRIED = ["seq", "received", "station", "flarm_id", "timestamp", "latitude", "longitude", "altitude", "signal", "crc", "standing", "reason"]


def routed(lines: DataFrame) -> DataFrame:
    """Parsed lines with their route. lines has seq, received and value."""
    parsed = once(P.parse(lines), ignored_source=S.ignored(F.col("source_callsign")))
    return once(parsed, route=P.route(F.col("value"))).drop("ignored_source")


def packets(lines: DataFrame, tiles: DataFrame, index: Callable | None = None, config: Config = DEFAULT) -> DataFrame:
    """Every position packet of the feed with its final reason; those with reason count have gap, cells, alt and agl.

    Rules without state come first; what they leave of each line is written as a narrow table. Packets that pass them, and
    standing ones, go through the aircraft's state in their order of arrival, in windows of bounded stretches: gaps, then the
    cells that the aircraft was last in, which like the gaps are forgotten after a silence. What is left and has a signal is
    placed on elevation tiles. ``index`` gives the cell of a place.
    """
    first = D.before_state(routed(lines).where("route = 'position'"), config.stationary_mode)
    first = once(first.withColumn("altitude", P.altitude(F.col("altitude"))), signal=P.signal(F.col("comment")), crc=P.crc(F.col("comment")))
    first = written(first.select(*_CARRIED), "packets")  # read by the dropped packets and by those that go on: lines are parsed once
    state = F.col("reason").isNull() | F.col("standing") & (F.col("reason") == "ignoredStationary")
    gapped = with_gaps(first.where(state), "station", "flarm_id", ts="timestamp", standing=F.col("standing"), max_gap=config.max_gap, forget=config.forget_seconds, arrival=F.col("received"))
    celled = gapped.withColumn("cell10", C.from_latlng(F.col("latitude"), F.col("longitude"), config.stationary_resolution, index))
    moving = h3_stationary(celled, "flarm_id", forgotten="forgotten", standing=F.col("standing"), arrival=F.col("received"), forget=config.forget_seconds).where("reason IS NULL")
    judged = moving.withColumn("reason", F.when(F.col("h3_stationary"), "ignoredH3stationary").when(F.col("signal") <= 0, "ignoredSignal0"))
    heard = F.col("reason").isNull()  # the others take part in no lookup: they have no place
    judged = judged.withColumns({"lat_": F.when(heard, F.col("latitude")), "lng_": F.when(heard, F.col("longitude"))})
    placed = with_ground(judged, tiles, "lat_", "lng_")
    placed = placed.withColumn("cell8", C.from_latlng(F.col("lat_"), F.col("lng_"), config.station_resolution, index)).withColumns({
        "reason": F.coalesce("reason", F.when(F.col("ground_failed"), "ignoredElevation").otherwise("count")), "alt": F.when(heard, F.col("altitude")),
        "agl": F.when(heard, P.above_ground(F.col("altitude"), F.col("ground"))), "cell7": C.parent(F.col("cell8"), config.global_resolution)})
    keep = ["seq", "received", "station", "flarm_id", "timestamp", "signal", "crc", "reason"]
    return first.where("reason IS NOT NULL").select(*keep).unionByName(placed.select(*keep, "gap", "first", "alt", "agl", "cell8", "cell7"), allowMissingColumns=True)


def counters(lines: DataFrame, fates: DataFrame, seconds: int) -> DataFrame:
    """The feed's counters for each period of arrival: lines but control lines (rawCount), unreadable lines of receivers
    (invalidPacket), packets by reason, and both rates a second. ``fates`` is what packets() returns."""
    period = F.floor(F.col("received") / seconds).alias("period")
    raw = routed(lines).where("route <> 'control'").groupBy(period).agg(F.count("*").alias("rawCount"), F.count_if(F.col("route") == "invalid").alias("invalidPacket"))
    packets_ = D.counts(fates.withColumn("period", period), "period")
    rate = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) / seconds, 6)
    joined = raw.join(packets_, "period", "left")
    return joined.select("period", "rawCount", "invalidPacket", *[F.coalesce(F.col(f"`{r}`"), F.lit(0)).alias(r) for r in D.REASONS], rate("count").alias("pps"), rate("rawCount").alias("rawPps"))
