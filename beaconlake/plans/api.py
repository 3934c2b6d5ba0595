"""The query surface: files of a station, and a cell's history, contributing stations and drill-down.

``daily`` tables hold final coverage by day: station tables (day, station_id, h3, ...), global ones (day, h3,
stations, ...). Functions take an optional cell and period so that filters reach the scan; without them
they answer for all cells at once.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beaconlake.config import DEFAULT
from beaconlake.functions import cells as C
from beaconlake.functions.stations import UNKNOWN, decode_token
from beaconlake.sources.indexed import lookup

FILE = r"^([^.]+)\.(day|month|year|yearnz)\.([0-9]{4}(?:nz|(?:-[0-9]{2}){0,2}))\.arrow$"


def period_prefix(file: Column) -> Column:
    """Year, or year and month, that a selected file's name stands for."""
    return F.regexp_extract(file, r"([0-9]{4}(?:-[0-9]{2})?)(?:-[0-9]{2})?(?:nz)?$", 1)


def period_range(period: str) -> tuple[str, str]:
    """The first day of a year, a month or a day written YYYY[-MM[-DD]], and the first day after it: a range that
    reaches the scan."""
    year, month, day = ([int(x) for x in period.split("-")] + [0, 0])[:3]
    first = dt.date(year, month or 1, day or 1)
    after = first + dt.timedelta(days=1) if day else dt.date(year + month // 12, month % 12 + 1, 1) if month else dt.date(year + 1, 1, 1)
    return first.isoformat(), after.isoformat()


def date_label(day: Column) -> Column:
    return F.date_format(day, "MM/dd")


#: Date patterns of the periods' files and of their labels on an axis.
_PERIODS = {"day": ("yyyy-MM-dd", "MM/dd"), "month": ("yyyy-MM", "yyyy/MM"), "year": ("yyyy", "yyyy")}


def tick_label(acc_type: str, day: Column) -> Column:
    return F.date_format(day, _PERIODS[acc_type][1])


def file_of(acc_type: str, day: Column) -> Column:
    return F.concat(F.lit(f"{acc_type}."), F.date_format(day, _PERIODS[acc_type][0]))


def first_day(period: Column) -> Column:
    """The first day of a period written as a day, a month or a year."""
    return F.concat(period, F.when(F.length(period) == 4, "-01-01").when(F.length(period) == 7, "-01").otherwise("")).try_cast("date")


def listing(names: DataFrame, name: str = "name") -> DataFrame:
    """station, acc_type and period of output file names; others are dropped."""
    part = lambda i: F.regexp_extract(name, FILE, i)
    return names.where(F.col(name).rlike(FILE)).select(part(1).alias("station"), part(2).alias("acc_type"), part(3).alias("period"))


def station_files(files: DataFrame) -> DataFrame:
    """For each station and type all periods in order, and the latest as current."""
    return files.groupBy("station", "acc_type").agg(F.array_join(F.array_sort(F.collect_set("period")), ",").alias("all"), F.max("period").alias("current"))


def _at(rows: DataFrame, cell: int | None, period: str | None) -> DataFrame:
    if cell is not None:
        rows = rows.where(F.col("h3") == cell)
    if period:
        first, after = period_range(period)
        rows = rows.where((F.col("day") >= F.lit(first).cast("date")) & (F.col("day") < F.lit(after).cast("date")))
    return rows


def recent(rows: DataFrame, now: Column, days: int = DEFAULT.graph_days) -> DataFrame:
    return rows.where(F.col("day") >= F.date_sub(now, days))


def point_lookup(spark: SparkSession, path: str, cell: int, **where) -> DataFrame:
    """The rows of one cell in the coverage under a path, through its index of files."""
    return lookup(spark, path, cell, **where)


def h3_details(daily: DataFrame, cell: int | None = None, period: str | None = None) -> DataFrame:
    """Days of a cell at a station in display units; a day without gaps has only its date."""
    shown = lambda x: F.when(F.col("avg_gap") != 0, x)
    extra = [shown(F.shiftright(F.nullif("expected_gap", F.lit(0)), 2)).alias("expected_gap")] if "expected_gap" in daily.columns else []
    keys = [c for c in ("station_id", "h3") if c in daily.columns]
    return _at(daily, cell, period).select(
        *keys, date_label(F.col("day")).alias("date"), shown(F.shiftright("avg_gap", 2)).alias("avg_gap"), shown(F.col("max_sig") / 4).alias("max_sig"),
        shown(F.col("avg_sig") / 4).alias("avg_sig"), shown(F.col("min_alt_sig") / 4).alias("min_alt_sig"), shown(F.col("min_agl")).alias("min_agl"), shown(F.col("count")).alias("count"), *extra)


def token_shares(daily: DataFrame, stations: DataFrame) -> DataFrame:
    """h3, day, station name and percent for each listed station with a share; a station that the dimension
    lacks is ``unknown`` with its id, so that two such stay apart."""
    listed = (daily.where("stations <> ''").select("h3", "day", F.explode(F.split("stations", ",")).alias("t"))
              .select("h3", "day", decode_token(F.col("t")).alias("d")).select("h3", "day", "d.station_id", "d.percent").where("percent > 0"))
    names = stations.select(F.col("id").alias("station_id"), F.col("station").alias("name_"))
    return listed.join(names, "station_id", "left").select("h3", "day", F.coalesce("name_", F.concat(F.lit(UNKNOWN + "-"), F.col("station_id").cast("string"))).alias("station"), F.col("percent").cast("long").alias("value"))


def _ranked(shares: DataFrame) -> DataFrame:
    """One row for each cell, day and station, with the station's total and rank in the cell and the day's sum."""
    by = shares.groupBy("h3", "day", "station").agg(F.sum("value").alias("value"))
    with_total = by.withColumn("total", F.sum("value").over(Window.partitionBy("h3", "station"))).withColumn("day_total", F.sum("value").over(Window.partitionBy("h3", "day")))
    return with_total.withColumn("rank", F.dense_rank().over(Window.partitionBy("h3").orderBy(F.col("total").desc(), "station")))


def top_series(shares: DataFrame, top: int = DEFAULT.top) -> DataFrame:
    """For each cell the stations with the largest sums, ranked, and the rest as Other."""
    sums = shares.groupBy("h3", "station").agg(F.sum("value").alias("total"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("h3").orderBy(F.col("total").desc(), "station")))
    shown = ranked.withColumns({"rank": F.least("rank", F.lit(top + 1)), "rest": F.when(F.col("rank") > top, F.col("total")).otherwise(0)})
    other = F.struct(F.lit("Other").alias("station"), F.lit(top + 1).alias("rank"), F.col("rest").alias("total"))
    own = F.struct("station", "rank", "total")
    rows = shown.select("h3", F.explode(F.when(F.col("rank") <= top, F.array(own, other)).otherwise(F.array(other))).alias("x"))
    return rows.select("h3", "x.*").groupBy("h3", "station", "rank").agg(F.sum("total").alias("total"))


def top_data(shares: DataFrame, whole: Column | None = None, top: int = DEFAULT.top) -> DataFrame:
    """For each cell and day the values of the cell's top stations, 0 where missing, and Other: what is left
    of ``whole`` (100 for shares), or of the day's sum. ``shares`` is read once."""
    inside = F.col("rank") <= top
    best = F.array_sort(F.collect_set(F.when(inside, F.struct("rank", "station"))).over(Window.partitionBy("h3")))
    days = _ranked(shares).withColumn("best", best).groupBy("h3", "day", "day_total", "best").agg(
        F.map_from_entries(F.collect_list(F.when(inside, F.struct("rank", "value")))).alias("values"), F.coalesce(F.sum(F.when(inside, F.col("value"))), F.lit(0)).alias("taken"))
    rest = (whole if whole is not None else F.col("day_total")) - F.col("taken")
    own = F.transform("best", lambda b: F.struct(b["station"].alias("station"), b["rank"].alias("rank"), F.coalesce(F.element_at("values", b["rank"]), F.lit(0)).cast("long").alias("value")))
    other = F.array(F.struct(F.lit("Other").alias("station"), F.lit(top + 1).alias("rank"), rest.cast("long").alias("value")))
    return days.select("h3", date_label(F.col("day")).alias("date"), F.explode(F.concat(own, other)).alias("x")).select("h3", "x.*", "date")


def h3_summary(daily_global: DataFrame, stations: DataFrame, cell: int | None = None, period: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(series, data) of the percent shares of a global cell's stations."""
    shares = token_shares(_at(daily_global, cell, period), stations)
    return top_series(shares), top_data(shares, F.lit(100))


def h3_others(daily_station: DataFrame, monthly_global: DataFrame, stations: DataFrame, cell: int | None = None, period: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(series, data) of the packet counts of every station that the cell's parent lists."""
    fine = _at(daily_station, cell, period).withColumn("parent_", C.parent(F.col("h3"), 7))
    listed = (monthly_global.where("stations <> ''").select(F.col("h3").alias("parent_"), F.explode(F.split("stations", ",")).alias("t"))
              .select("parent_", decode_token(F.col("t"))["station_id"].alias("station_id")).distinct())
    names = stations.select(F.col("id").alias("station_id"), F.coalesce("station", F.concat(F.lit(UNKNOWN + "-"), F.col("id").cast("string"))).alias("station"))
    counts = fine.join(listed, ["parent_", "station_id"], "left_semi").join(names, "station_id").select("h3", "day", "station", F.col("count").alias("value"))
    return top_series(counts), top_data(counts)


def percent_share(values: DataFrame) -> DataFrame:
    """Each station's share of the day's sum, in percent with one decimal."""
    total = F.sum("value").over(Window.partitionBy("day"))
    return values.withColumn("percent", F.floor(F.col("value") * 1000 / total + 0.5) / 10)


def calendar(available: DataFrame, key: str, day: str = "day") -> DataFrame:
    """Every day from a key's first to its last, with 1 where there is a file."""
    span = available.groupBy(key).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    spine = span.select(key, F.explode(F.sequence("a", "b")).alias(day))
    return spine.join(available.select(key, day).distinct().withColumn("x", F.lit(1)), [key, day], "left").select(key, day, F.coalesce("x", F.lit(0)).alias("available"))


def picked(cells: DataFrame) -> DataFrame:
    """The one-letter record that the map hands over for a cell."""
    tokens = F.when(F.coalesce(F.col("stations"), F.lit("")) == "", 0).otherwise(F.size(F.split("stations", ",")))
    return cells.select(
        C.pad(C.to_hex(F.col("h3"), 16), 16).alias("h"), F.col("avg_sig").alias("a"), F.col("min_alt").alias("b"), F.col("count").alias("c"), F.col("min_alt_sig").alias("d"), F.col("max_sig").alias("e"),
        F.col("avg_crc").alias("f"), F.col("min_agl").alias("g"), F.col("avg_gap").alias("p"), F.col("expected_gap").alias("q"), F.col("stations").alias("s"), F.coalesce("num_stations", tokens).alias("t"))
