"""Station tables, the layout of files for other readers, older layouts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beaconlake.functions import cells as C
from beaconlake.operators.stations import shown


def read_stations(spark: SparkSession, path: str, file: str, all_stations: bool = False) -> DataFrame:
    """The typed station table of a period, or where it has none the one table of the older layout."""
    for at in (f"{path}/stations/stations.{file}", f"{path}/stations"):
        try:
            return shown(spark.read.parquet(at), all_stations)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    raise FileNotFoundError(f"no stations for {file} under {path}")


def station_table(stations: DataFrame) -> DataFrame:
    """The typed table of the stations heard so far."""
    heard = stations.where(F.coalesce("last_packet", F.lit(0)) != 0)
    return heard.select(F.col("id").cast("int"), F.col("station").alias("name"), F.col("lat").cast("float"), F.col("lng").cast("float"), F.col("valid").cast("boolean"), F.col("last_packet").cast("long"))


def write_station_table(stations: DataFrame, path: str, day: str) -> None:
    """The table of a day, sorted by id."""
    station_table(stations).orderBy("id").write.mode("overwrite").parquet(f"{path}/stations/stations.day.{day}", compression="gzip")


#: Names and types of the columns of output files for other readers (fixed values).
LAYOUT = {"h3lo": pa.uint32(), "h3hi": pa.uint32(), "minAgl": pa.uint16(), "minAlt": pa.uint16(), "minAltSig": pa.uint8(), "maxSig": pa.uint8(), "avgSig": pa.uint8(),
          "avgCrc": pa.uint8(), "count": pa.uint32(), "avgGap": pa.uint8()}
GLOBAL_LAYOUT = LAYOUT | {"stations": pa.utf8(), "expectedGap": pa.uint8(), "numStations": pa.uint8()}


def for_readers(cells: DataFrame) -> DataFrame:
    """Final coverage in the columns of output files; keys and other columns stay in front."""
    h, c = F.col("h3"), F.col
    own = {"min_agl", "min_alt", "min_alt_sig", "max_sig", "avg_sig", "avg_crc", "count", "avg_gap", "stations", "expected_gap", "num_stations", "h3"}
    wide = [c("stations"), c("expected_gap").alias("expectedGap"), c("num_stations").alias("numStations")] if "stations" in cells.columns else []
    return cells.select(*[x for x in cells.columns if x not in own], C.low(h).alias("h3lo"), C.high(h).alias("h3hi"), c("min_agl").alias("minAgl"), c("min_alt").alias("minAlt"), c("min_alt_sig").alias("minAltSig"),
                        c("max_sig").alias("maxSig"), c("avg_sig").alias("avgSig"), c("avg_crc").alias("avgCrc"), "count", c("avg_gap").alias("avgGap"), *wide)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Names and change times of the files under a path, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "path", "modificationTime", "length")


def legacy_cells(rows: DataFrame) -> DataFrame:
    """Rows of either older layout with one long h3: a 64-bit column, or two unsigned words."""
    if "h3lo" in rows.columns:
        return rows.withColumn("h3", C.join_words(F.col("h3lo"), F.col("h3hi"))).drop("h3lo", "h3hi")
    return rows.withColumn("h3", F.col("h3").cast("long"))


def write_stations(stations: DataFrame, path: str) -> None:
    """stations: those heard so far; stations-complete: all; both gzipped JSON lines by id."""
    stations.where(F.coalesce("last_packet", F.lit(0)) != 0).orderBy("id").write.mode("overwrite").json(f"{path}/stations", compression="gzip")
    stations.orderBy("id").write.mode("overwrite").json(f"{path}/stations-complete", compression="gzip")
