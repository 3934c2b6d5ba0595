"""The mergeable coverage aggregate: partial, merge, prune, header and final columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.config import DEFAULT
from beaconlake.functions.stations import token

PARTIAL = ("count", "sum_sig", "sum_crc", "sum_gap", "max_sig", "min_alt", "min_alt_sig", "min_agl")


def _lowest(alt: Column, signal: Column) -> list[Column]:
    """Lowest altitude that is not 0, and the strongest signal there; altitude 0 means unknown, and if all
    are, the strongest signal of all. Both in one long, so that hash aggregation is possible."""
    packed = F.min(F.when(alt != 0, F.shiftleft(alt.cast("long"), 8).bitwiseOR(255 - signal.cast("long"))))
    return [F.coalesce(F.shiftright(packed, 8), F.lit(0)).cast("int").alias("min_alt"),
            F.coalesce(255 - packed.bitwiseAND(255), F.max(signal)).cast("int").alias("min_alt_sig")]


def _lowest_agl(agl: Column) -> Column:
    return F.coalesce(F.min(F.nullif(agl, F.lit(0))), F.lit(0)).cast("int").alias("min_agl")


def partial(packets: DataFrame, *keys: str, alt: str = "alt", agl: str = "agl", crc: str = "crc", signal: str = "signal", gap: str = "gap") -> DataFrame:
    """One mergeable record for each key from packets. Signals are added up in whole decibels."""
    s = F.col(signal)
    return packets.groupBy(*keys).agg(
        F.count("*").alias("count"), F.sum(F.shiftright(s, 2)).cast("long").alias("sum_sig"), F.sum(crc).cast("long").alias("sum_crc"),
        F.sum(gap).cast("long").alias("sum_gap"), F.max(s).cast("int").alias("max_sig"), *_lowest(F.col(alt), s), _lowest_agl(F.col(agl)))


def merge(partials: DataFrame, *keys: str) -> DataFrame:
    """Records of the same key into one. Associative and commutative; a single record stays as it is."""
    return partials.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("count", "sum_sig", "sum_crc", "sum_gap")], F.max("max_sig").alias("max_sig"),
        *_lowest(F.col("min_alt"), F.col("min_alt_sig")), _lowest_agl(F.col("min_agl")))


def _averages() -> dict[str, Column]:
    return {"avg_sig": F.expr("(4 * sum_sig) div count").cast("int"), "avg_crc": F.expr("(10 * sum_crc) div count").cast("int"), "avg_gap": F.expr("(4 * sum_gap) div count").cast("int")}


def finalise(records: DataFrame, *keys: str) -> DataFrame:
    """Station coverage: lowest points, strongest signal and the averages in quarters and tenths."""
    return records.withColumns(_averages()).select(*keys, "min_agl", "min_alt", "min_alt_sig", "max_sig", "avg_sig", "avg_crc", "count", "avg_gap")


def recover(final: DataFrame) -> DataFrame:
    """Sums back from the averages of a station's final record, as far as rounding allows."""
    return final.withColumns({
        "sum_sig": F.expr("(avg_sig * count) div 4"), "sum_crc": F.expr("(avg_crc * count) div 10"), "sum_gap": F.expr("(avg_gap * count) div 4")})


def prune(by_station: DataFrame, valid: DataFrame, station: str = "station_id") -> DataFrame:
    """Drops the records of stations that are not valid. Cells left without stations are gone."""
    return by_station.join(valid.select(station).distinct(), station, "left_semi")


def global_cells(by_station: DataFrame, *keys: str, station: str = "station_id", shown: int = DEFAULT.shown_tokens, most: int | None = 255) -> DataFrame:
    """Cells with their header made from the stations' records, so pruned stations leave no trace.

    stations lists the first ``shown`` tokens by count, then id; num_stations stops at ``most``, the largest number that the
    header's byte holds, or with None nowhere. One shuffle: a cell's stations meet in one array, of one element for each station.
    """
    listed = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("neg"), F.col(station).alias("id"))))
    cells = by_station.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("count", "sum_sig", "sum_crc", "sum_gap")], F.max("max_sig").alias("max_sig"),
        *_lowest(F.col("min_alt"), F.col("min_alt_sig")), _lowest_agl(F.col("min_agl")), listed.alias("list_"))
    tokens = F.array_join(F.transform(F.slice("list_", 1, shown), lambda x: token(x["id"], -x["neg"], F.col("count"))), ",")
    return cells.withColumns(_averages() | {
        "stations": tokens, "num_stations": F.size("list_") if most is None else F.least(F.size("list_"), F.lit(most)),
        "expected_gap": F.expr("(4 * sum_gap) div (count * size(list_))").cast("int")}).select(
            *keys, "min_agl", "min_alt", "min_alt_sig", "max_sig", "avg_sig", "avg_crc", "count", "avg_gap", "stations", "expected_gap", "num_stations")


def fan_out(packets: DataFrame, station: str = "station_id", fine: str = "cell8", coarse: str = "cell7") -> DataFrame:
    """Each packet twice: for its station's cell and for the global one."""
    return packets.withColumn("x_", F.explode(F.array(
        F.struct(F.lit("station").alias("scope"), F.col(fine).alias("h3")), F.struct(F.lit("global").alias("scope"), F.col(coarse).alias("h3"))))).select("*", "x_.scope", "x_.h3").drop("x_")
