"""Cell index arithmetic on longs. Parents, resolutions and text forms are plain bit operations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def resolution(cell: Column) -> Column:
    return F.shiftright(cell, 52).bitwiseAND(15).cast("int")


def parent(cell: Column, res: int) -> Column:
    """The ancestor at a coarser resolution: its resolution bits set, all finer digits 7."""
    kept = cell.bitwiseAND(F.lit(~(15 << 52))).bitwiseOR(F.lit(res << 52))
    return kept.bitwiseOR(F.lit((1 << 3 * (15 - res)) - 1))


def to_hex(cell: Column, width: int = 15) -> Column:
    return pad(F.lower(F.hex(cell)), width)


def from_hex(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("decimal(20,0)").cast("long")


def high(cell: Column) -> Column:
    return F.shiftrightunsigned(cell, 32)


def low(cell: Column) -> Column:
    return cell.bitwiseAND(F.lit(0xFFFFFFFF))


def join_words(lo: Column, hi: Column) -> Column:
    """The cell of two unsigned 32-bit words, as the older files store it."""
    return F.shiftleft(hi.cast("long"), 32).bitwiseOR(lo.cast("long"))


def pad(text: Column, width: int) -> Column:
    """Zeros in front up to the width; longer texts stay whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def db_key(packed: Column, cell: Column) -> Column:
    return F.concat(packed, F.lit("/"), to_hex(cell))


def lock_key(db: Column, packed: Column, cell: Column) -> Column:
    return F.concat_ws("/", F.lower(F.conv(db.cast("string"), 10, 36)), packed, to_hex(cell))


def parse_key(key: Column) -> Column:
    """db (0 in the short form), code, bucket and cell of either key form; meta rows have is_meta."""
    parts = F.split(F.when(F.length(key) <= 20, F.concat(F.lit("0/"), key)).otherwise(key), "/")
    word = F.conv(parts[1], 16, 10).cast("int")
    return F.struct(F.conv(parts[0], 36, 10).cast("int").alias("db"), F.shiftright(word, 12).alias("code"), word.bitwiseAND(0xFFF).alias("bucket"),
                    from_hex(parts[2]).alias("cell"), is_meta(parts[2]).alias("is_meta"))


def is_meta(cell_text: Column) -> Column:
    return cell_text.startswith("00") | cell_text.startswith("80")


def from_latlng(lat: Column, lng: Column, res: int, index: Callable[[np.ndarray, np.ndarray, int], np.ndarray] | None = None) -> Column:
    """The cell of a place. ``index`` takes arrays of latitudes and longitudes and a resolution and gives an array of
    cells; without one the h3 package is used, which must then be installed on the executors. No other grid is passed
    off as it."""
    if index is None:
        import h3

        index = np.vectorize(lambda a, b, r: int(h3.latlng_to_cell(a, b, r), 16), otypes=[np.int64])

    @F.pandas_udf("long")
    def cell(a: pd.Series, b: pd.Series) -> pd.Series:
        ok, out = (a.notna() & b.notna()).to_numpy(), pd.array(np.zeros(len(a), dtype=np.int64), dtype="Int64")
        out[ok] = index(a.to_numpy()[ok], b.to_numpy()[ok], res)
        out[~ok] = pd.NA
        return pd.Series(out)

    return cell(lat, lng)


def to_latlng(cell: Column, index: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> Column:
    """Centre of a cell as struct(lat, lng), by ``index``, which takes an array of cells, or the h3 package."""
    if index is None:
        import h3

        index = np.vectorize(lambda c: h3.cell_to_latlng(f"{c:x}"), otypes=[float, float])

    @F.pandas_udf("lat double, lng double")
    def centre(c: pd.Series) -> pd.DataFrame:
        ok, out = c.notna().to_numpy(), np.full((len(c), 2), np.nan)
        out[ok] = np.column_stack(index(c.to_numpy()[ok].astype(np.int64)))
        return pd.DataFrame(out, columns=["lat", "lng"])

    return centre(cell)
