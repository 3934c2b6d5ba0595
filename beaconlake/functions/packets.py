"""Feed lines to packets, and what is read from a packet's comment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.functions.once import once

#: Patterns of the comment's fields (fixed values); the captured digits are read up to a second point.
_DIGITS = r"(?=[0-9.])([0-9]+\.?[0-9]*|\.[0-9]+)?[0-9.]*"
SIGNAL = f" {_DIGITS}dB "
CRC = r" ([0-9])e "
ROT = f" [+-]{_DIGITS}rot "
CLIMB = r" [+-]([0-9]+)fpm "
_HEAD = r"^([^>]+)>([^,:]+)((?:,[^:,]*)*):(.*)$"
_POSITION = r"^(?:[/@]([0-9]{2})([0-9]{2})([0-9]{2})h|[!=])([0-9]{2})([0-9]{2}\.[0-9]{2})([NS]).([0-9]{3})([0-9]{2}\.[0-9]{2})([EW]).(?:([0-9]{3})/([0-9]{3}))?(?:/A=(-?[0-9]+))?(.*)$"
_MARK = "\x01"


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The pattern's groups, from 1, by matching once: ``F.get`` gives null where it does not match. The text holds no mark."""
    return F.split(F.regexp_replace(text, pattern, _MARK + _MARK.join(f"${i}" for i in range(1, n + 1))), _MARK)


def _number(text: Column, pattern: str) -> Column:
    """The captured number, 0 where there is none or it has no digit."""
    return F.coalesce(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1).try_cast("double"), F.lit(0.0))


def signal(comment: Column) -> Column:
    """Quarter decibels, rounded half up, at most 255; 0 without a reading."""
    return F.least(F.floor(_number(comment, SIGNAL) * 4 + 0.5), F.lit(255)).cast("int")


def crc(comment: Column) -> Column:
    return _number(comment, CRC).cast("int")


def rotation(comment: Column) -> Column:
    """Magnitude of the turn rate; 0 without one."""
    return _number(comment, ROT)


def climb(comment: Column) -> Column:
    return _number(comment, CLIMB)


def altitude(metres: Column) -> Column:
    return F.floor(F.coalesce(metres, F.lit(0.0))).cast("int")


def above_ground(altitude_: Column, ground: Column) -> Column:
    return F.floor(F.greatest(altitude_ - F.coalesce(ground, F.lit(0)), F.lit(0)) + 0.5).cast("int")


def flarm_id(callsign: Column) -> Column:
    """The last six characters; null for shorter callsigns."""
    return F.when(F.length(callsign) >= 6, F.right(callsign, F.lit(6)))


def station(digipeaters: Column) -> Column:
    """The last relay is the receiving station."""
    return F.coalesce(F.try_element_at(digipeaters, F.lit(-1)), F.lit("unknown"))


def parse(lines: DataFrame, line_col: str = "value", received_col: str = "received") -> DataFrame:
    """Adds the packet's fields to a table of raw lines; unreadable parts are null, no line is lost.

    ``received_col`` is the epoch second of arrival; the line's clock time is taken as the latest such time
    not more than half a day after it. A position may come without a time. Each pattern is matched once a line.
    """
    received = F.col(received_col)
    head, at = (lambda k: F.get("head_", F.lit(k))), (lambda k: F.get("at_", F.lit(k)))
    number = lambda k: at(k).try_cast("double")
    clock = at(1).try_cast("int") * 3600 + at(2).try_cast("int") * 60 + at(3).try_cast("int")
    same_day = F.floor(received / 86400) * 86400 + clock
    when = F.when(same_day > received + 43200, same_day - 86400).when(same_day < received - 43200, same_day + 86400).otherwise(same_day)
    headed = once(lines, head_=_groups(F.translate(F.col(line_col), _MARK, " "), _HEAD, 4))
    placed = once(headed, source_callsign=head(1), dest_callsign=head(2), digipeaters=F.filter(F.split(head(3), ","), lambda d: d != ""),
                  body=F.nullif(head(4), F.lit("")), at_=_groups(head(4), _POSITION, 13))
    return once(placed, timestamp=when.cast("long"),
                latitude=(number(4) + number(5) / 60) * F.when(at(6) == "S", -1).otherwise(1),
                longitude=(number(7) + number(8) / 60) * F.when(at(9) == "W", -1).otherwise(1),
                speed=number(11) * 1.852, altitude=number(12) * 0.3048, comment=F.ltrim(at(13))).drop("head_", "at_")


def route(line: Column) -> Column:
    """control, position, location, status, invalid or ignored; needs the parsed columns and ignored_source, which
    tells whether the source's name is none of a receiver.

    A line with a position and a comment that starts with id is a packet; of the others only lines from
    receivers count, by their destination or a qAC relay.
    """
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    receiver = (F.col("dest_callsign") == "OGNSDR") | line.contains("qAC")
    return (F.when(line.startswith("#") | line.startswith("user"), "control")
            .when(F.col("source_callsign").isNull() | (F.col("body").isNull()), "ignored")
            .when(placed & F.col("comment").startswith("id"), "position")
            .when(F.coalesce(receiver, F.lit(False)) & F.col("ignored_source"), "ignored")
            .when(F.coalesce(receiver, F.lit(False)) & placed, "location")
            .when(F.coalesce(receiver, F.lit(False)) & F.col("body").startswith(">"), "status")
            .when(F.coalesce(receiver, F.lit(False)), "invalid").otherwise("ignored"))
