"""Near-duplicate groups by SimHash fingerprints, with pigeonring candidate filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.base import map_texts, materialize, table
from beaconlake.llm.components import components

BITS, DISTANCE, SHINGLE, SEED = 64, 2, 3, 42
#: Widths of the ring's segments.
SEGMENTS = (13, 13, 13, 13, 12)
#: Leading segments of a chain whose budget allows no difference: they are equal, so they are the join key.
EXACT = -(-len(SEGMENTS) // DISTANCE) - 1
#: Larger buckets are not compared pair by pair but linked through fingerprints one bit away.
CROWDED = 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # very long texts in bounded steps
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) and text_key (a hash of the text) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), b.column(2)], names=["doc_id", "fp", "text_key"])

    text = F.col(text_col)
    return map_texts(docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key")), run, f"doc_id {kind}, fp long, text_key long")


def _turned(fp: Column, slot: int) -> Column:
    """The bits turned so that the chain starting at a segment starts at bit 0."""
    at = sum(SEGMENTS[:slot])
    return fp if not at else F.shiftrightunsigned(fp, at).bitwiseOR(F.shiftleft(fp, BITS - at))


def _low(bits: Column, width: int) -> Column:
    return bits.bitwiseAND(F.lit((1 << width) - 1)) if width < BITS else bits


def _widths(slot: int) -> list[int]:
    ring = SEGMENTS[slot:] + SEGMENTS[:slot]
    return [sum(ring[:n + 1]) for n in range(len(ring))]


def _slots(fp: Column) -> Column:
    return F.array(*[F.struct(F.lit(s).alias("slot"), _low(_turned(fp, s), _widths(s)[EXACT - 1]).alias("key")) for s in range(len(SEGMENTS))])


def _chain_holds(x: Column) -> Column:
    """Whether the differing bits x of a pair found in a slot keep within each prefix's share of the
    distance: the first n segments of the chain may differ in n * DISTANCE / segments bits."""
    test = F.lit(False)
    for s in range(len(SEGMENTS)):
        within = F.lit(True)
        for n in range(EXACT, len(SEGMENTS) - 1):
            within = within & (F.bit_count(_low(_turned(x, s), _widths(s)[n])) <= (n + 1) * DISTANCE // len(SEGMENTS))
        test = F.when(F.col("slot") == s, within).otherwise(test)
    return test & (F.bit_count(x) <= DISTANCE)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs within DISTANCE bits.

    If two fingerprints differ in at most DISTANCE bits, some chain of consecutive segments around the
    ring keeps within its proportional share at every length (pigeonring). Its first EXACT segments are
    therefore equal: they are the join key, and longer prefixes prune before the full comparison.
    A bucket of more than CROWDED fingerprints emits no pairs: two fingerprints two bits apart are both
    one bit from a third value, at which at most 65 fingerprints meet, all within two bits of each other.
    """
    keyed = fps.select("fp", F.explode(_slots(F.col("fp"))).alias("s")).select("fp", "s.slot", "s.key")
    shared = keyed.groupBy("slot", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(keyed.join(shared, ["slot", "key"]), "met")
    few = met.where(F.col("n") <= CROWDED)
    x = F.col("a").bitwiseXOR(F.col("b"))
    near = (few.select("slot", "key", F.col("fp").alias("a")).join(few.select("slot", "key", F.col("fp").alias("b")), ["slot", "key"])
            .where(F.col("a") < F.col("b")).where(_chain_holds(x)).select("a", "b"))
    crowd = met.where(F.col("n") > CROWDED).select("fp").distinct()
    flips = F.array(*[F.lit(0).cast("long")] + [F.shiftleft(F.lit(1).cast("long"), i) for i in range(BITS)])
    around = (crowd.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("centre"))
              .groupBy("centre").agg(F.sort_array(F.collect_set("fp")).alias("m")).where(F.size("m") > 1)
              .select(F.col("m")[0].alias("a"), F.explode(F.slice("m", 2, BITS + 1)).alias("b")))
    return near.unionByName(around)


def _named(rows: DataFrame) -> DataFrame:
    """(doc_id, fp) -> for each fingerprint its group (a fingerprint of it) and the group's smallest id."""
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    linked = components(links(nodes.select("fp")))
    grouped = (nodes.join(linked, nodes.fp == linked.node, "left")
               .select("fp", "least", F.coalesce("component", "fp").alias("group")))
    least = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    return materialize(grouped.drop("least").join(least, "group"), "named")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Rows link if their fingerprints differ in DISTANCE bits or fewer; component_id is the smallest id
    reachable over links, itself included. Rows of one fingerprint are one node, however many they are.
    Null, empty and blank texts have fingerprint zero and link like any other. Rows with a null id take
    part, and get the smallest id that is not null, or null. Repeated rows repeat. Whole texts count.
    Other columns are ignored. An empty table gives an empty result.
    """
    rows = materialize(with_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return rows.join(_named(rows), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, with their columns, of which each near-duplicate group keeps one: that with its
    smallest id. Of a group's rows that share this id, or have none, the smallest in column order stays.

    Texts are read twice and fingerprinted once: rows are told apart by id and a hash of the text. What falls out
    is written as a table of these keys, so that Spark knows its size: it is broadcast while that is small, and
    texts are shuffled only beyond.
    """
    slim = materialize(with_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fates = slim.join(_named(slim), "fp").withColumn("first", F.col("doc_id").eqNullSafe(F.col("component_id")))
    fallen = materialize(fates.where("NOT first").select("doc_id", "text_key").distinct(), "fallen")
    shared = fates.where("first").groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    tied = materialize(fates.where("first").join(shared, "group").select("doc_id", "text_key", "group").distinct(), "tied")

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.col(id_col).alias("id_"), F.xxhash64(F.col(text_col)).alias("key_"))
    same = F.col("id_").eqNullSafe(F.col("doc_id")) & (F.col("key_") == F.col("text_key"))
    kept = rows.join(fallen, same, "left_anti")
    if not tied.isEmpty():
        least = rows.join(tied, same).groupBy("group").agg(F.min("row_").alias("row_"))
        kept = kept.join(tied, same, "left_anti").select("row_").unionByName(least.select("row_"))
    return kept.select("row_.*")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
