"""Map scores and colours of coverage cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 8


def _log2(x: Column) -> Column:
    return F.log2(x.cast("double"))


def _top(x: Column) -> Column:
    return F.least(x, F.lit(254.0))


def score(name: str, max_count: Column | None = None) -> Column:
    """A cell's score, about 0 to 255, from the columns of a coverage table; an unknown name is avg_sig.
    ``count`` is scaled by the table's largest count. A logarithm of 0 is null. The numbers are fixed values, those of the
    map that the scores are for."""
    c = F.col
    double = lambda x: F.shiftleft(c(x), 1)
    table = {
        "count": lambda: _log2(c("count")) * 254 / _log2(max_count),
        "avg_sig": lambda: _top(c("avg_sig") * 3.0),
        "avg_sig_exp1": lambda: _top((_log2(double("avg_sig")) - 2) * 40),
        "avg_sig_exp": lambda: _top((_log2(c("avg_sig")) - 1) * 24),
        "max_sig_exp": lambda: _top((_log2(double("max_sig")) - 1) * 24),
        "max_sig_exp1": lambda: _top((_log2(double("max_sig")) - 2) * 48),
        "max_sig": lambda: _top(c("max_sig") * 1.3),
        "min_alt": lambda: _top(c("min_alt") / 20.0),
        "min_agl": lambda: _top(c("min_agl") / 20.0),
        "min_alt_sig": lambda: c("min_alt_sig").cast("double"),
        "avg_crc": lambda: 255 - _top(c("avg_crc") * 5.0),
        "avg_gap": lambda: _log2(F.greatest(c("avg_gap"), F.lit(4)) - 3) * 31.75,
        "expected_gap": lambda: _log2(F.greatest(F.coalesce(c("expected_gap"), c("avg_gap")), F.lit(1))) * 31.75,
        "stations": lambda: _top(_log2(F.greatest(F.coalesce(c("num_stations"), F.lit(1)), F.lit(1))) * 32),
    }
    return table.get(name, table["avg_sig"])()


SCORES = ("count", "avg_sig", "avg_sig_exp1", "avg_sig_exp", "max_sig_exp", "max_sig_exp1", "max_sig", "min_alt", "min_agl", "min_alt_sig", "avg_crc", "avg_gap", "expected_gap", "stations")


def primary_station_colour(tokens: Column) -> Column:
    """Red, green, blue and alpha from the first three base-36 digits; magenta without stations."""
    digit = lambda i: F.conv(F.substring(tokens, i, 1), 36, 10).cast("int") * 7
    return F.when(tokens != "", F.array(digit(1), digit(2), digit(3), F.lit(128))).otherwise(F.array(*map(F.lit, (255, 0, 255, 128))))


def palette(start: str, end: str) -> Column:
    """The colours between two hex RGBA values, as an array of STEPS arrays; a missing channel is ff."""
    channels = [(int(start[i:i + 2] or "ff", 16), int(end[i:i + 2] or "ff", 16)) for i in (0, 2, 4, 6)]
    colour = lambda k: F.array(*[(F.lit(a) + F.floor(k * F.lit(b - a) / STEPS + 0.5)).cast("int") for a, b in channels])
    return F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), colour)


def colour_index(score_: Column) -> Column:
    """Place of a score in the palette, from 0; it wraps around above 255 and is 0 for scores below 0."""
    return F.coalesce(F.greatest(F.floor(score_ / 255 * STEPS) % STEPS, F.lit(0)), F.lit(0)).cast("int")


def column_height(name: str) -> Column:
    """What 3-D columns show: the lowest altitude or height above ground, else 0."""
    return {"min_alt": F.col("min_alt"), "min_agl": F.col("min_agl")}.get(name, F.lit(0))


def station_colour(selected: Column, valid: Column) -> Column:
    return F.when(selected, "selected").when(valid, "valid").otherwise("invalid")
