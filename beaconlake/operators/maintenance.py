"""Checks and upkeep: reconciling output with state, metadata history, backups, purges, dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.config import DEFAULT
from beaconlake.functions.buckets import TYPES
from beaconlake.sources.arrow import write_arrow


def reconcile(output: DataFrame, state: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of output that the state lacks (absent) or holds otherwise, with the columns that differ."""
    o, s = output.select(*keys, *values), state.select(*keys, *[F.col(v).alias(f"{v}_s") for v in values], F.lit(True).alias("there_"))
    differ = F.array_compact(F.array(*[F.when(~F.col(v).eqNullSafe(F.col(f"{v}_s")), v) for v in values]))
    joined = o.join(s, keys, "left").withColumn("absent", F.col("there_").isNull()).withColumn("differ", F.when(F.col("absent"), "").otherwise(F.concat_ws(",", differ)))
    return joined.where(F.col("absent") | (F.col("differ") != "")).select(*keys, "absent", "differ")


def push_start(starts: DataFrame, key: str, time: str, keep: int = DEFAULT.history) -> DataFrame:
    """For each key the newest ``keep`` starts, oldest first. The rank limit is applied before the shuffle too."""
    newest = starts.select(key, time).withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(F.col(time).desc()))).where(F.col("n_") <= keep)
    return newest.groupBy(key).agg(F.array_sort(F.collect_list(time)).alias("all_starts"))


def purge(records: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """Records without those of the dropped accumulators or stations."""
    return records.join(dropped.select(*keys).distinct(), keys, "left_anti")


def unexpected(existing: DataFrame, expected: DataFrame) -> DataFrame:
    """Accumulators in the store that no current period accounts for."""
    return existing.select("acc_type", "bucket").distinct().join(expected.select("acc_type", "bucket"), ["acc_type", "bucket"], "left_anti")


def sizes(records: DataFrame, *keys: str, bytes_each: int = 24) -> DataFrame:
    """Rows and stored bytes for each accumulator."""
    return records.groupBy(*keys).agg(F.count("*").alias("rows"), (F.count("*") * bytes_each).alias("bytes"))


def backup(*accumulators: DataFrame) -> DataFrame:
    """All accumulators in one table, tagged by the columns that they share."""
    out = accumulators[0]
    for a in accumulators[1:]:
        out = out.unionByName(a)
    return out


def write_backup(path: str, day: str, *accumulators: DataFrame) -> None:
    """Writes accumulators as gzipped Arrow files, backup.<day>.<type>, which have their names once all of them are whole."""
    whole = backup(*accumulators)
    rest = [c for c in ("bucket", "h3", "cell7", "station_id") if c in whole.columns]
    named = whole.withColumn("file", F.concat(F.lit(f"backup.{day}."), F.col("acc_type")))
    write_arrow(named, path, *rest, compress="gzip", batch=3000, mode="overwrite")


def dump(rows: DataFrame, match: str | None = None) -> DataFrame:
    """Rows as JSON text, those only that a pattern finds."""
    text = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    return text.where(F.col("value").rlike(match)) if match else text


def interval_deltas(counts: DataFrame, at: str, value: str, seconds: int) -> DataFrame:
    """Change since the interval before and rate a second, for one row for each interval."""
    before = F.lag(value).over(Window.orderBy(at))
    return counts.withColumns({"delta": F.col(value) - before, "rate": F.round(F.col(value) / seconds, 6)})


def startup_check(existing: DataFrame, metadata: DataFrame, files: DataFrame) -> DataFrame:
    """What to do with each accumulator found at start: purge it if its type is unknown, its metadata or its
    output file is missing. existing has acc_type and bucket; metadata these and file; files has file."""
    m = metadata.select("acc_type", "bucket", "file").distinct()
    f = files.select("file").distinct().withColumn("there_", F.lit(True))
    joined = existing.select("acc_type", "bucket").distinct().join(m, ["acc_type", "bucket"], "left").join(f, "file", "left")
    reason = F.when(~F.col("acc_type").isin(*TYPES), "unknown type").when(F.col("file").isNull(), "no metadata").when((F.col("acc_type") != "current") & F.col("there_").isNull(), "no file").otherwise("keep")
    return joined.select("acc_type", "bucket", reason.alias("action"))


def pointers(files: DataFrame) -> DataFrame:
    """For each station and type the name without a period and the newest file it stands for."""
    newest = files.groupBy("station", "acc_type").agg(F.max("period").alias("period"))
    return newest.select(F.concat_ws(".", "station", "acc_type", F.lit("arrow")).alias("link"), F.concat_ws(".", "station", "acc_type", "period", F.lit("arrow")).alias("target"))
