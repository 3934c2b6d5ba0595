"""Indexed coverage, Arrow files by sink and source, and images of tiles."""

import gzip
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from beaconlake.plans import inputs as I
from beaconlake.sources import arrow, elevation, files, indexed, png
from beaconlake.sources.arrow import Piece

# the index


def cells(spark, n=4000):
    return spark.range(n).select((F.col("id") * 7).alias("h3"), F.when(F.col("id") % 10 < 8, "2024-01-01").otherwise("2024-01-02").alias("day"), F.col("id").alias("count"))


def test_a_lookup_opens_one_file(spark, tmp_path):
    at = f"{tmp_path}/t"
    indexed.write_coverage(cells(spark), at, "day", files=8)
    assert len(indexed.read_coverage(spark, at).inputFiles()) >= 8
    for cell, day in ((0, "2024-01-01"), (7 * 2001, "2024-01-01"), (7 * 3999, "2024-01-02")):
        found = indexed.lookup(spark, at, cell, day=day)
        assert len(found.inputFiles()) == 1 and [tuple(r) for r in found.collect()] == [(cell, day, cell // 7)]
    assert len(indexed.lookup(spark, at, 7 * 8).inputFiles()) <= 2  # both days, one file each
    assert indexed.lookup(spark, at, -5).collect() == [] and indexed.lookup(spark, at, 3).collect() == []
    assert max(r.n for r in indexed.read_coverage(spark, at).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()) < 1000  # the large day is dealt out


def test_writes_are_one_step(spark, tmp_path):
    at = f"{tmp_path}/t"
    df = lambda rows: spark.createDataFrame(rows, "h3 long, day string, count long")
    indexed.write_coverage(df([(1, "a", 1), (2, "b", 1)]), at, "day")
    indexed.write_coverage(df([(1, "a", 2)]), at, "day", keep_previous=True, run="x")
    indexed.write_coverage(df([(1, "a", 9)]), at, "day", keep_previous=True, run="x")  # the same write again: nothing is lost
    got = lambda **k: {(r.day, r["count"]) for r in indexed.read_coverage(spark, at, **k).collect()}
    assert got() == {("a", 2), ("b", 1)} and got(previous=True) == {("a", 1)}
    df([(1, "a", 7)]).write.partitionBy("day").parquet(f"{at}/runs/run=died")  # a write that died before its pointer
    assert got() == {("a", 2), ("b", 1)}
    before = indexed.read_coverage(spark, at)
    indexed.write_coverage(df([(1, "a", 3)]), at, "day")
    assert {(r.day, r["count"]) for r in before.collect()} == {("a", 2), ("b", 1)}
    assert "runs/run=died" in indexed.vacuum(spark, at) and got() == {("a", 3), ("b", 1)} and got(previous=True) == {("a", 1)}
    with pytest.raises(FileNotFoundError):
        indexed.read_coverage(spark, f"{tmp_path}/none")


# Arrow files


def named(spark, n=1000, names=2):
    return spark.range(n).select(F.concat(F.lit("f"), (F.col("id") % names).cast("string")).alias("file"), F.col("id").alias("h3lo"), (F.col("id") * 3 - 5).cast("int").alias("minAgl"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("stations"))


@pytest.mark.parametrize("compress, kind", [("none", "stream"), ("gzip", "stream"), ("both", "stream"), ("none", "file")])
def test_arrow_round_trip(spark, tmp_path, compress, kind):
    at = str(tmp_path / "a")
    arrow.write_arrow(named(spark), at, "h3lo", compress=compress, kind=kind, batch=100, tasks=1)
    names = sorted(p.name for p in (tmp_path / "a").iterdir())
    suffixes = {"none": [".arrow"], "gzip": [".arrow.gz"], "both": [".arrow", ".arrow.gz"]}[compress]
    assert names == [f"f{i}{s}" for i in range(2) for s in suffixes]
    raw = (tmp_path / "a" / names[0]).read_bytes()
    t = (pa.ipc.open_file if kind == "file" else pa.ipc.open_stream)(gzip.decompress(raw) if names[0].endswith(".gz") else raw)
    assert t.schema.field("h3lo").type == pa.uint32() and t.schema.field("minAgl").type == pa.uint16()
    whole = t.read_all()
    assert whole["h3lo"].to_pylist() == list(range(0, 1000, 2)) and whole["minAgl"][0].as_py() == 0 and {b.num_rows for b in whole.to_batches()} == {100}
    back = arrow.read_arrow(spark, at, file="f1")
    assert back.where("h3lo = 7").select("file", "minAgl", "stations").distinct().collect() == [("f1", 16, "s7")] and back.count() == 500 * len(suffixes)


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    at = str(tmp_path / "a")
    arrow.write_arrow(named(spark, 5000, 1), at, "h3lo", kind="file", batch=100, tasks=1)
    df = arrow.read_arrow(spark, at, "h3lo long", split="20000")
    assert df.rdd.getNumPartitions() > 4 and df.agg(F.count("*"), F.sum("h3lo")).first() == (5000, sum(range(5000)))
    fs, path = arrow.opened(f"{at}/f0.arrow")
    [b] = arrow._batches(fs, Piece(path, 3, 4), ["stations"])
    assert b.schema.names == ["stations"] and b.num_rows == 100
    assert arrow.read_arrow(spark, at, "h3lo long").rdd.getNumPartitions() == 1


def test_a_large_file_has_parts(spark, tmp_path):
    at = str(tmp_path / "a")
    arrow.write_arrow(named(spark, 900, 1), at, "h3lo", tasks=3)
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == [f"f0.{i:05d}.arrow" for i in range(3)]
    assert arrow.read_arrow(spark, at, "h3lo long").count() == 900
    arrow.write_arrow(named(spark, 10, 1), at, "h3lo", tasks=1, mode="overwrite")
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["f0.arrow"]


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    at = str(tmp_path / "a")
    bad = named(spark).withColumn("minAgl", F.when(F.col("h3lo") == 999, F.raise_error(F.lit("no more"))).otherwise(F.col("minAgl")))
    with pytest.raises(Exception, match="no more"):
        arrow.write_arrow(bad, at, "h3lo", tasks=4)
    assert not (tmp_path / "a").exists() or list((tmp_path / "a").iterdir()) == []
    arrow.write_arrow(named(spark).limit(0), at, "h3lo")
    assert not (tmp_path / "a").exists() or list((tmp_path / "a").iterdir()) == []


def test_rows_of_a_file_must_be_together(spark, tmp_path):
    spark.dataSource.register(arrow.ArrowFiles)
    with pytest.raises(Exception, match="not together"):
        named(spark, 10).coalesce(1).write.format("beacon_arrow").option("path", str(tmp_path / "a")).mode("append").save()


# tiles


def test_every_row_filter():
    """An image of which every row is filtered by hand."""
    rows = [[0, 10, 20, 30], [1, 5, 3, 250], [2, 1, 1, 1], [3, 7, 7, 7], [4, 9, 0, 200]]
    want = [[10, 20, 30], [5, 8, 2], [6, 9, 3], [10, 16, 16], [19, 19, 219]]
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    head = struct.pack(">IIBBBBB", 3, 5, 8, 0, 0, 0, 0)
    packed = zlib.compress(b"".join(map(bytes, rows)))
    data = png.SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"x") + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")
    assert png.decode(data)[:, :, 0].tolist() == want


@pytest.mark.parametrize("filters", [[0] * 256, [1] * 256, [2] * 256, [3] * 256, [4] * 256, [i % 5 for i in range(256)], [0, 2, 2, 0] * 64])
def test_images_come_back(filters):
    rng = np.random.default_rng(1)
    for channels in (1, 3, 4):
        pixels = rng.integers(0, 256, (256, 256 if channels == 3 else 31, channels))
        assert (png.decode(png.encode(pixels, filters)) == pixels).all()


def test_what_is_no_image():
    whole = png.encode(np.zeros((4, 4, 3)))
    for bad in (b"", b"GIF89a", whole[:30], whole[:-20], whole.replace(b"IHDR", b"XXXX")):
        with pytest.raises(ValueError):
            png.decode(bad)
        assert elevation.heights(bad) is None
    assert elevation.heights(None) is None and elevation.heights(png.encode(np.zeros((4, 4, 1)))) is None


def test_ground_from_images(spark):
    places = spark.createDataFrame([(1, 47.3, 8.2), (2, 47.3, 8.2), (3, 0.0, 0.0), (4, None, None)], "seq long, lat double, lng double")
    tiles = I.png_tiles(places).unionByName(spark.createDataFrame([(5, 5, bytearray(b"broken"))], "x int, y int, png binary"))
    got = {r.seq: r for r in elevation.with_ground(places, tiles).collect()}
    assert got[1].ground == got[2].ground and got[4].ground == 0 and not got[4].ground_failed
    assert elevation.tiles_under(places, tiles).count() == I.png_tiles(places).count()
    assert {r.x for r in elevation.decoded(tiles).where("metres IS NULL").collect()} >= {5}
    assert elevation.decoded(tiles.limit(0)).collect() == []


def test_layout_is_typed():
    assert list(files.GLOBAL_LAYOUT)[:2] == ["h3lo", "h3hi"]
