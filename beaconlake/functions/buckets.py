"""Time buckets as functions of epoch seconds. Everything is in UTC and independent of the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beaconlake.config import DEFAULT

#: Codes of the accumulator types (fixed values; 2 is unused).
TYPES = {"current": 0, "day": 1, "month": 3, "year": 4, "yearnz": 5}
ROLLED = ("day", "month", "year", "yearnz")


def epoch_seconds(ts: Column, kind: str) -> Column:
    """Seconds of a timestamp column; one without zone is read as UTC."""
    if kind == "timestamp_ntz":
        ts = F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp")
    return F.unix_seconds(ts)


def utc_date(s: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(s / 86400).cast("int"))


def minute_of_day(s: Column) -> Column:
    return F.floor(F.pmod(s, F.lit(86400)) / 60)


def _start(date: Column) -> Column:
    return F.date_diff(date, F.lit("1970-01-01").cast("date")).cast("long") * 86400


def _season(s: Column) -> Column:
    return F.year(F.add_months(utc_date(s), -6))


def bucket(acc_type: str, s: Column, rollup_minutes: int = DEFAULT.rollup_minutes) -> Column:
    """The bucket number of a type: packed bit fields, 12 bits for all but current in practice."""
    d = utc_date(s)
    month0 = F.month(d) - 1
    return {
        "current": lambda: F.shiftleft(F.dayofmonth(d), 7).bitwiseOR(F.floor(minute_of_day(s) / rollup_minutes).cast("int").bitwiseAND(127)),
        "day": lambda: F.shiftleft(F.year(d).bitwiseAND(7), 9).bitwiseOR(F.shiftleft(month0.bitwiseAND(15), 5)).bitwiseOR(F.dayofmonth(d)),
        "month": lambda: F.shiftleft(F.year(d).bitwiseAND(255), 4).bitwiseOR(month0),
        "year": lambda: F.year(d),
        "yearnz": lambda: _season(s),
    }[acc_type]().cast("int")


def file_name(acc_type: str, s: Column) -> Column:
    d = utc_date(s)
    return {
        "current": lambda: F.lit(""),
        "day": lambda: F.date_format(d, "yyyy-MM-dd"),
        "month": lambda: F.date_format(d, "yyyy-MM"),
        "year": lambda: F.date_format(d, "yyyy"),
        "yearnz": lambda: F.concat(_season(s).cast("string"), F.lit("nz")),
    }[acc_type]()


def effective_start(acc_type: str, s: Column, rollup_minutes: int = DEFAULT.rollup_minutes) -> Column:
    """First second of the bucket."""
    d, step = utc_date(s), rollup_minutes * 60
    return {
        "current": lambda: _start(d) + F.floor(F.pmod(s, F.lit(86400)) / step) * step,
        "day": lambda: _start(d),
        "month": lambda: _start(F.trunc(d, "month")),
        "year": lambda: _start(F.trunc(d, "year")),
        "yearnz": lambda: _start(F.make_date(_season(s), F.lit(7), F.lit(1))),
    }[acc_type]()


def accumulators(s: Column, types: tuple[str, ...] = ROLLED, rollup_minutes: int = DEFAULT.rollup_minutes) -> Column:
    """Array of (acc_type, bucket, file, effective_start), to explode."""
    return F.array(*[F.struct(
        F.lit(t).alias("acc_type"), bucket(t, s, rollup_minutes).alias("bucket"), file_name(t, s).alias("file"),
        effective_start(t, s, rollup_minutes).cast("long").alias("effective_start")) for t in types])


def describe(s: Column, rollup_minutes: int = DEFAULT.rollup_minutes) -> Column:
    """(HH:MM of the current bucket, its files, comma-joined)."""
    start = effective_start("current", s, rollup_minutes)
    clock = F.concat(F.lpad(F.floor(minute_of_day(start) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minute_of_day(start) % 60).cast("string"), 2, "0"))
    return F.struct(clock.alias("clock"), F.concat_ws(",", *[file_name(t, s) for t in ROLLED]).alias("files"))


def next_rollup_minutes(s: Column, rollup_minutes: int = DEFAULT.rollup_minutes) -> Column:
    """Minutes until the next multiple of the period since UTC midnight."""
    return (F.lit(rollup_minutes) - minute_of_day(s) % rollup_minutes).cast("int")


def type_code(acc_type: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), acc_type)


def pack(code: Column, bucket_: Column) -> Column:
    """Four hex digits: the type's code, then twelve bits of the bucket."""
    word = F.shiftleft(code.bitwiseAND(15), 12).bitwiseOR(bucket_.bitwiseAND(0xFFF))
    return F.lpad(F.lower(F.hex(word.cast("long"))), 4, "0")


def unpack(key: Column) -> Column:
    word = F.conv(key, 16, 10).cast("int")
    return F.struct(F.shiftright(word, 12).alias("code"), word.bitwiseAND(0xFFF).alias("bucket"))
