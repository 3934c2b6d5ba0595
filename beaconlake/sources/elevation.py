"""Ground elevation from raster tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.functions.geo import elevation, tile
from beaconlake.sources.png import decode


def heights(png: bytes | None) -> tuple[int, int, np.ndarray] | None:
    """Width, height and metres, row by row, of a terrain tile; None for what is no image with three channels."""
    try:
        pixels = decode(png or b"").astype(np.int64)
    except ValueError:
        return None
    if pixels.shape[2] < 3:
        return None
    tenths = (pixels[:, :, 0] * 256 + pixels[:, :, 1]) * 256 + pixels[:, :, 2]
    return pixels.shape[1], pixels.shape[0], np.floor(tenths / 10.0 - 10000).astype(np.int16).ravel()


def decoded(tiles: DataFrame) -> DataFrame:
    """Tiles (x, y and png, the bytes of an image) as x, y, width, height and metres, two bytes a pixel. A tile that can't be
    read has null metres. Tiles are decoded where they are, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 16):
                part = b.slice(at, 16)
                got = [heights(x.as_py()) for x in part.column(2)]
                cols = [pa.array([g and g[i] for g in got], pa.int32()) for i in (0, 1)] + [pa.array([None if g is None else g[2] for g in got], pa.list_(pa.int16()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["x", "y", "width", "height", "metres"])

    return tiles.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "png").mapInArrow(run, "x int, y int, width int, height int, metres array<short>")


def tiles_under(places: DataFrame, tiles: DataFrame, lat: str = "lat", lng: str = "lng", zoom: int = 11) -> DataFrame:
    """The tiles that places are on, and no others."""
    at = tile(F.col(lat), F.col(lng), zoom)
    keys = places.select(at["x"].alias("x"), at["y"].alias("y")).distinct()
    return tiles.join(keys, ["x", "y"], "left_semi")


def with_ground(places: DataFrame, tiles: DataFrame, lat: str = "lat", lng: str = "lng", zoom: int = 11) -> DataFrame:
    """Adds tile, ground (metres) and ground_failed to places. ``tiles`` has x, y, width, height and either metres (see
    decoded) or pixels, an array of (r, g, b) by rows; or x, y and png, and is then decoded, of a batch only the tiles that
    places are on. A tile that could not be read has null pixels, and the ground of its places has failed. Where there is no
    tile or pixel the ground is at 0. The join is on the tile's number, so each tile is read once however many places are on it."""
    if "png" in tiles.columns:
        tiles = decoded(tiles if places.isStreaming else tiles_under(places, tiles, lat, lng, zoom))
    raster = "metres" if "metres" in tiles.columns else "pixels"
    at = places.withColumn("tile", tile(F.col(lat), F.col(lng), zoom))
    known = tiles.select(F.col("x").alias("x_"), F.col("y").alias("y_"), F.col("width").alias("w_"), F.col("height").alias("h_"), F.col(raster).alias("raster_"))
    joined = at.join(known, (F.col("tile.x") == F.col("x_")) & (F.col("tile.y") == F.col("y_")), "left")
    p = F.get("raster_", (F.floor(F.col("tile.fy") * F.col("h_")) * F.col("w_") + F.floor(F.col("tile.fx") * F.col("w_"))).cast("int"))
    ground = F.coalesce(p.cast("int"), F.lit(0)) if raster == "metres" else elevation(p["r"], p["g"], p["b"])
    return (joined.withColumns({"ground": ground, "ground_failed": F.col("x_").isNotNull() & F.col("raster_").isNull()})
            .drop("x_", "y_", "w_", "h_", "raster_"))
