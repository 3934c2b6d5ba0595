"""Coverage tables in files sorted by cell, with an index of what each file holds.

A write puts its files beside those that are there and then switches one small pointer to a new index, so readers see all
of it or none, and what the partitions held before can be kept in the same step. The index has for each file its partition
and its least and greatest cell: a lookup reads the index and opens the one file of a partition that may hold the cell.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from beaconlake.sources.folder import Folder

#: Generations in the index: what readers see, and what was there before.
LIVE, PREVIOUS = 0, 1


def _pointer(spark: SparkSession, path: str) -> dict | None:
    folder = Folder(spark, path)
    return json.loads(folder.read("current.json")) if "current.json" in folder.names() else None


def _index(spark: SparkSession, path: str, pointer: dict) -> DataFrame:
    return spark.read.schema(StructType.fromJson(pointer["index_schema"])).parquet(f"{path}/index/v={pointer['index']}")


def write_coverage(cells: DataFrame, path: str, *partitions: str, cell: str = "h3", keep_previous: bool = False, files: int | None = None, run: str | None = None) -> None:
    """Replaces the partitions that ``cells`` holds. Rows are dealt by partition and cell in ranges of equal size, whatever
    the partitions' sizes, and are sorted by cell in each file. ``keep_previous`` keeps what the partitions held, for one
    more write of each. ``run`` names the write: one that was complete is not done again."""
    spark = cells.sparkSession
    pointer = _pointer(spark, path)
    run = run or uuid.uuid4().hex
    if pointer and run in pointer["runs"]:
        return
    by = [*partitions, cell]
    at = f"{path}/runs/run={run}"
    dealt = cells.repartitionByRange(files, *by) if files else cells.repartitionByRange(*by)
    (dealt.sortWithinPartitions(*by).write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{cell}", "true").partitionBy(*partitions).parquet(at))
    zones = spark.read.schema(cells.schema).parquet(at).groupBy(*partitions, F.col("_metadata.file_path").alias("file_")).agg(
        F.min(cell).alias("least_"), F.max(cell).alias("greatest_"), F.count("*").alias("rows_"))
    new = zones.withColumn("generation_", F.lit(LIVE))
    if pointer:
        old, touched = _index(spark, path, pointer), zones.select(*partitions).distinct()
        same = reduce(and_, [old[p].eqNullSafe(touched[p]) for p in partitions], F.lit(True))
        gone = old.join(touched, same, "left_semi")
        stays = old.join(touched, same, "left_anti")
        if keep_previous:
            stays = stays.unionByName(gone.where(F.col("generation_") == LIVE).withColumn("generation_", F.lit(PREVIOUS)))
        else:
            stays = stays.unionByName(gone.where(F.col("generation_") == PREVIOUS))
        new = new.unionByName(stays)
    number = pointer["index"] + 1 if pointer else 0
    new.write.mode("overwrite").parquet(f"{path}/index/v={number}")
    Folder(spark, path).write("current.json", json.dumps({
        "index": number, "runs": [*(pointer["runs"] if pointer else []), run][-1000:], "cell": cell, "partitions": list(partitions),
        "schema": cells.schema.jsonValue(), "index_schema": new.schema.jsonValue()}))


def _asked(where: dict) -> Column:
    return reduce(and_, [F.col(c).isNull() if v is None else F.col(c) == v for c, v in where.items()], F.lit(True))


def _read(spark: SparkSession, path: str, pointer: dict, at: list[str]) -> DataFrame:
    schema = StructType.fromJson(pointer["schema"])
    if not at:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/runs").parquet(*at).select(*schema.names)


def read_coverage(spark: SparkSession, path: str, previous: bool = False, **where) -> DataFrame:
    """The coverage of a station, a period or both, as ``station_id=3, day='2024-01-05'``: conditions on the columns that the
    files are partitioned by. Only the folders of those partitions are listed and read."""
    pointer = _pointer(spark, path)
    if pointer is None:
        raise FileNotFoundError(f"no coverage under {path}")
    index = _index(spark, path, pointer).where(F.col("generation_") == (PREVIOUS if previous else LIVE)).where(_asked(where))
    folders = index.select(F.regexp_replace("file_", "/[^/]*$", "").alias("at")).distinct().collect()  # one for each partition
    return _read(spark, path, pointer, [r.at for r in folders]).where(_asked(where))


def lookup(spark: SparkSession, path: str, cell: int, **where) -> DataFrame:
    """The rows of one cell: at most one file of each partition that is asked for is opened, and in it the row groups that
    may hold the cell."""
    pointer = _pointer(spark, path)
    if pointer is None:
        raise FileNotFoundError(f"no coverage under {path}")
    index = _index(spark, path, pointer).where((F.col("generation_") == LIVE) & (F.col("least_") <= cell) & (F.col("greatest_") >= cell)).where(_asked(where))
    return _read(spark, path, pointer, [r.file_ for r in index.select("file_").collect()]).where(F.col(pointer["cell"]) == cell)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Removes the files of writes that no index entry names any more, and older indexes; for times without readers."""
    pointer, folder = _pointer(spark, path), Folder(spark, path)
    named = {r.run for r in _index(spark, path, pointer).select(F.regexp_extract("file_", "/run=([^/]+)/", 1).alias("run")).distinct().collect()}
    gone = [f"runs/{n}" for n in folder.names("runs") if n.removeprefix("run=") not in named] + [f"index/{n}" for n in folder.names("index") if n != f"v={pointer['index']}"]
    for n in gone:
        folder.remove(n)
    return gone
