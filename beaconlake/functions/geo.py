"""Distances, areas and ground elevation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in km, and the mean area of a cell by resolution in km² (fixed, published values).
EARTH_KM = 6371.007180918475
CELL_KM2 = {7: 5.161293360, 8: 0.7373275975, 10: 0.01504750190}


def distance_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def area_km2(cells: Column, resolution: int) -> Column:
    return cells * F.lit(CELL_KM2[resolution])


def elevation(red: Column, green: Column, blue: Column) -> Column:
    """Metres of a terrain pixel; 0 where a channel is missing."""
    metres = F.floor((red * 65536 + green * 256 + blue) / 10.0 - 10000)
    return F.coalesce(metres, F.lit(0)).cast("int")


def tile(lat: Column, lng: Column, zoom: int) -> Column:
    """(x, y) of the web map tile and the fractions of it, for joining places to raster tiles."""
    n = float(1 << zoom)
    x = (lng + 180.0) / 360.0 * n
    phi = F.radians(lat)
    y = (1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / F.pi()) / 2.0 * n
    return F.struct(F.floor(x).cast("int").alias("x"), F.floor(y).cast("int").alias("y"), (x - F.floor(x)).alias("fx"), (y - F.floor(y)).alias("fy"))
