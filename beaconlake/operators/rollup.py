"""Rollup of partial records into day, month, year and season buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.functions.buckets import ROLLED, accumulators
from beaconlake.operators.coverage import PARTIAL, merge


def into_buckets(records: DataFrame, ts: str = "ts_s", types: tuple[str, ...] = ROLLED) -> DataFrame:
    """Each record once for each bucket type that its time falls in."""
    return records.withColumn("x_", F.explode(accumulators(F.col(ts), types))).select("*", "x_.acc_type", "x_.bucket", "x_.file").drop("x_")


def rollup(current: DataFrame, stored: DataFrame | None, valid: DataFrame | None, *keys: str, station: str = "station_id") -> DataFrame:
    """New records merged into the stored ones of the same key: one shuffle, no join of the two.

    Only stored records are held against the valid stations; new ones always count.
    """
    if stored is None:
        return merge(current, *keys)
    kept = stored.join(valid.select(station).distinct(), station, "left_semi") if valid is not None else stored
    cols = [*keys, *PARTIAL]
    return merge(current.select(*cols).unionByName(kept.select(*cols)), *keys)


def rollup_counters(current: DataFrame, stored: DataFrame, valid: DataFrame, group: list[str], cell: str = "h3", station: str = "station_id") -> DataFrame:
    """For each group how many cells were added, updated, left as they were, emptied, or lost stations.

    ``current`` and ``stored`` hold records by group, cell and station.
    """
    ok = valid.select(station).distinct().withColumn("ok_", F.lit(True))
    old = stored.join(ok, station, "left").select(*group, cell, station, F.lit(0).alias("new_"), F.lit(1).alias("old_"), F.coalesce("ok_", F.lit(False)).alias("kept_"))
    new = current.select(*group, cell, station, F.lit(1).alias("new_"), F.lit(0).alias("old_"), F.lit(True).alias("kept_"))
    cells = new.unionByName(old).groupBy(*group, cell).agg(
        F.max("new_").alias("src"), F.max("old_").alias("dest"), F.count_if((F.col("old_") == 1) & F.col("kept_")).alias("kept"), F.count_if((F.col("old_") == 1) & ~F.col("kept_")).alias("gone"))
    src, dest = F.col("src") == 1, F.col("dest") == 1
    return cells.groupBy(*group).agg(
        F.count_if(src & ~dest).alias("h3added"), F.count_if(src & dest).alias("h3updated"),
        F.count_if(~src & (F.col("gone") == 0)).alias("h3no_change"), F.count_if(~src & (F.col("kept") == 0)).alias("h3emptied"),
        F.count_if((F.col("gone") > 0) & (src | (F.col("kept") > 0))).alias("h3stations_removed"),
        F.count_if(src | (F.col("kept") > 0)).alias("arrow_records"), F.count_if(src).alias("h3source"))


def retired(old: DataFrame, new: DataFrame) -> DataFrame:
    """Accumulators of which the bucket changed, with the earliest start among them as cut-off."""
    pairs = old.alias("o").join(new.alias("n"), "acc_type").where("o.bucket <> n.bucket")
    least = pairs.agg(F.min("n.effective_start").alias("cut_off"))
    return pairs.select("acc_type", F.col("o.bucket").alias("bucket"), F.col("o.file").alias("file")).join(F.broadcast(least))  # one row


def recovery_plan(blocks: DataFrame, existing: DataFrame, types: int = len(ROLLED), limit: int = 3) -> DataFrame:
    """What to do with blocks left over from a crash: blocks has block, acc_type and bucket of each target;
    a block is rolled up unless ``limit`` or more of its targets no longer exist."""
    missing = blocks.join(existing.select("acc_type", "bucket").distinct().withColumn("there_", F.lit(1)), ["acc_type", "bucket"], "left")
    return missing.groupBy("block").agg(F.count_if(F.col("there_").isNull()).alias("missing")).withColumn("action", F.when(F.col("missing") < limit, "rollup").otherwise("drop"))


def recover(blocks: DataFrame, stored: DataFrame, existing: DataFrame, *keys: str, limit: int = 3) -> tuple[DataFrame, DataFrame]:
    """Carries out recovery_plan: (records, plan). ``blocks`` holds the records of blocks left over, with block and the
    buckets recorded for it, one row for each target; they are merged into those of ``stored``, except for blocks that
    the plan drops."""
    plan = recovery_plan(blocks.select("block", "acc_type", "bucket").distinct(), existing, limit=limit)
    good = blocks.join(plan.where("action = 'rollup'").select("block"), "block", "left_semi")
    return rollup(good, stored, None, *keys), plan


def statistics(stations: DataFrame, records: DataFrame, retired_: int, purged: DataFrame) -> DataFrame:
    """One row about a rollup: databases worked on, stations skipped, operations (records merged), buckets retired,
    records removed with purged stations, and records put out. ``stations`` has id and skip, ``records`` of the
    rollup and ``purged`` station_id."""
    s = stations.agg(F.count_if(~F.col("skip")).alias("databases"), F.count_if("skip").alias("skippedStations"))
    r = records.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("operations"), F.count("*").alias("arrowRecords"))
    p = purged.agg(F.count("*").alias("recordsRemoved"))
    return s.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(p)).withColumn("retiredBuckets", F.lit(retired_).cast("long"))  # one row each


def startup_statistics(checked: DataFrame) -> DataFrame:
    """One row about a start-up, from one row for each database: whether data was merged or purged, and its records."""
    return checked.agg(
        F.count_if("datapurged").alias("datapurged"), F.count_if("datamerged").alias("datamerged"), F.count_if(F.col("datapurged") | F.col("datamerged")).alias("datachanged"),
        F.count("*").alias("databases"), F.coalesce(F.sum("records"), F.lit(0)).alias("arrowRecords"))
