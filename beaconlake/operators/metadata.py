"""What is written beside the records: an accumulator's document, and those of each output and station."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake import schema
from beaconlake.config import DEFAULT
from beaconlake.functions.buckets import TYPES, bucket, effective_start, file_name


def utc_text(s: Column) -> Column:
    """ISO text of epoch seconds, in UTC whatever the session's zone."""
    day, clock = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(s / 86400).cast("int")), F.pmod(s, F.lit(86400))
    two = lambda x: F.lpad(F.floor(x).cast("long").cast("string"), 2, "0")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), two(clock / 3600), F.lit(":"), two(clock / 60 % 60), F.lit(":"), two(clock % 60), F.lit(".000Z"))


def document(now: Column, earlier: Column | None = None, keep: int = DEFAULT.history) -> Column:
    """An accumulator's document at ``now``: its start, the buckets of all types, and the starts so far, of which the
    newest ``keep`` stay. ``earlier`` is the array of starts that the stored document holds."""
    start = F.struct(now.alias("start"), utc_text(now).alias("start_utc"))
    before = F.coalesce(earlier, F.array().cast("array<struct<start:long,start_utc:string>>")) if earlier is not None else F.array().cast("array<struct<start:long,start_utc:string>>")
    starts = F.concat(before, F.array(start))
    types = F.map_from_arrays(F.array(*map(F.lit, TYPES)), F.array(*[F.struct(
        bucket(t, now).alias("bucket"), file_name(t, now).alias("file"), effective_start(t, now).cast("long").alias("effective_start")) for t in TYPES]))
    return F.struct(now.alias("start"), utc_text(now).alias("start_utc"), bucket("current", now).alias("current_accumulator"), types.alias("accumulators"),
                    F.slice(starts, F.greatest(F.size(starts) - keep + 1, F.lit(1)), keep).alias("all_starts"))


def encode(document_: Column) -> Column:
    return F.to_json(document_)


def decode(text: Column) -> Column:
    return F.from_json(text, schema.METADATA)


def outputs(stations: DataFrame, counters: DataFrame, now: Column) -> DataFrame:
    """For each output its file's name and document: the station's fields, when it was last written, and the rollup's
    counters. stations has station and more, counters station, acc_type, file and more."""
    about = F.struct(*[F.col(f"s.{c}").alias(c) for c in stations.columns], now.alias("last_output_file"), F.struct(*[F.col(f"c.{c}").alias(c) for c in counters.columns if c not in ("station", "acc_type", "file")]).alias("rollup"))
    joined = counters.alias("c").join(stations.alias("s"), F.col("c.station") == F.col("s.station"))
    return joined.select(F.concat_ws(".", "c.station", "c.acc_type", "c.file", F.lit("json")).alias("name"), F.to_json(about).alias("value"))
