"""Best-fit packing by a grouping genetic algorithm: documents into as few training sequences as it can.

A solution's genes are whole bins. Crossover puts well-filled bins of one parent into the other, whose bins that share a
document with them are dissolved; documents displaced thereby are exchanged for smaller ones where that fills a bin
better, and the rest goes to the fullest bins that have room. Pieces are dealt into shards of bounded size; each shard
evolves on several islands, whose elites move to their neighbours between epochs. What the loosest bins of all shards
hold is then dealt anew and packed once more.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.base import map_texts, materialize, table
from beaconlake.llm.tokens import encoder, text_ids, tokenizer_path


@dataclass(frozen=True)
class Genetic:
    """Pieces of a shard on average; islands of each shard, and epochs between which elites migrate; solutions of an
    island, and generations of an epoch. A bin is well filled from ``well`` of the capacity on; of the bins that are
    filled less, the loosest ``loose`` of a shard (2 at least) are dealt anew."""

    shard: int = 2000
    islands: int = 3
    epochs: int = 2
    population: int = 8
    generations: int = 12
    well: float = 0.995
    loose: float = 0.1


class Bins:
    """A solution: the pieces of each bin, and how full it is."""

    def __init__(self, groups: list[list[int]], fills: list[int]):
        self.groups, self.fills = groups, fills

    def worth(self) -> tuple[int, int]:
        """Fewer bins first, then fuller ones: the less the better."""
        return len(self.fills), -sum(f * f for f in self.fills)

    def best_fit(self, pieces: list[int], lengths: list[int], capacity: int) -> None:
        """Puts each piece into the fullest bin that has room for it, or a new one. Rooms that occur are the bits of a number."""
        rooms: dict[int, list[int]] = {}
        seen = 0
        for b, f in enumerate(self.fills):
            if f < capacity:
                rooms.setdefault(capacity - f, []).append(b)
                seen |= 1 << capacity - f
        for i in pieces:
            n = lengths[i]
            above = seen >> n
            if above:
                room = n + (above & -above).bit_length() - 1
                b = rooms[room].pop()
                if not rooms[room]:
                    seen ^= 1 << room
                self.groups[b].append(i)
            else:
                room, b = capacity, len(self.groups)
                self.groups.append([i])
                self.fills.append(0)
            self.fills[b] += n
            if room > n:
                rooms.setdefault(room - n, []).append(b)
                seen |= 1 << room - n

    def exchange(self, pieces: list[int], lengths: list[int], capacity: int, whole: int = 0) -> list[int]:
        """Trades a bin's piece for a longer one of ``pieces`` where that leaves less room; returns what is outside then.
        The first ``whole`` bins stay as they are."""
        outside: dict[int, list[int]] = {}
        seen = 0
        for i in pieces:
            outside.setdefault(lengths[i], []).append(i)
            seen |= 1 << lengths[i]
        for b, group in enumerate(self.groups[whole:], whole):
            for at, i in enumerate(group):
                room = capacity - self.fills[b]
                if not room:
                    break
                longest = (seen & (1 << lengths[i] + room + 1) - 1).bit_length() - 1
                if longest > lengths[i]:
                    group[at] = outside[longest].pop()
                    if not outside[longest]:
                        seen ^= 1 << longest
                    outside.setdefault(lengths[i], []).append(i)
                    seen |= 1 << lengths[i]
                    self.fills[b] += longest - lengths[i]
        return [i for n in sorted(outside, reverse=True) for i in outside[n]]


def crossover(a: Bins, b: Bins, lengths: list[int], capacity: int, how: Genetic, rng: random.Random) -> Bins:
    """Whole well-filled bins of b in front of those of a that share no piece with them; the rest of a is refitted."""
    order = sorted(range(len(b.fills)), key=lambda k: -b.fills[k])
    well = [k for k in order if b.fills[k] >= how.well * capacity] or order[:max(1, len(order) // 10)]
    chosen = rng.sample(well, rng.randint(1, max(1, len(well) // 2)))
    child = Bins([list(b.groups[k]) for k in chosen], [b.fills[k] for k in chosen])
    taken = {i for g in child.groups for i in g}
    displaced: list[int] = []
    for g, f in zip(a.groups, a.fills, strict=True):
        if taken.isdisjoint(g):
            child.groups.append(list(g))
            child.fills.append(f)
        else:
            displaced += [i for i in g if i not in taken]
    return refitted(child, displaced, lengths, capacity, len(chosen))


def mutated(a: Bins, lengths: list[int], capacity: int, rng: random.Random) -> Bins:
    """Dissolves the loosest bin and a few others, and refits what they held."""
    some = rng.sample(range(len(a.fills)), min(len(a.fills), rng.randint(2, 6)))
    gone = {*some, min(range(len(a.fills)), key=a.fills.__getitem__)}
    keep = [k for k in range(len(a.fills)) if k not in gone]
    child = Bins([list(a.groups[k]) for k in keep], [a.fills[k] for k in keep])
    return refitted(child, [i for k in sorted(gone) for i in a.groups[k]], lengths, capacity)


def refitted(child: Bins, displaced: list[int], lengths: list[int], capacity: int, whole: int = 0) -> Bins:
    displaced.sort(key=lambda i: (-lengths[i], i))
    child.best_fit(child.exchange(displaced, lengths, capacity, whole), lengths, capacity)
    return child


def decoded(bin_of: list[int], lengths: list[int]) -> Bins:
    """A migrant: the bin of each piece."""
    out = Bins([[] for _ in range(max(bin_of) + 1)], [0] * (max(bin_of) + 1))
    for i, b in enumerate(bin_of):
        out.groups[b].append(i)
        out.fills[b] += lengths[i]
    return out


def evolve(lengths: list[int], migrants: list[list[int]], capacity: int, how: Genetic, seed: int) -> Bins:
    """The best solution that one island finds in one epoch, from best-fit decreasing, random orders and the elites that
    it kept or was sent. It stops as soon as the bins are as few as the sum of lengths allows."""
    rng, least = random.Random(seed), -(-sum(lengths) // capacity)
    longest_first = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    people = [decoded(m, lengths) for m in migrants]
    while len(people) < how.population and not any(len(p.fills) <= least for p in people):
        order = longest_first if not people else sorted(longest_first, key=lambda i: -lengths[i] * rng.uniform(0.6, 1))
        people.append(Bins([], []))
        people[-1].best_fit(order, lengths, capacity)
    people.sort(key=Bins.worth)
    for _ in range(how.generations):
        if len(people[0].fills) <= least:
            break
        for _ in range(how.population // 2):
            a, b = sorted(rng.sample(range(len(people)), 2))  # the better one gives its well-filled bins half of the time
            a, b = (people[b], people[a]) if rng.random() < 0.5 else (people[a], people[b])
            child = crossover(a, b, lengths, capacity, how, rng)
            people.append(mutated(child, lengths, capacity, rng) if rng.random() < 0.5 else child)
        people.sort(key=Bins.worth)
        del people[how.population:]
    return people[0]


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: whole if it fits, else the remainder first, then full pieces."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def cut_pieces(docs: DataFrame, capacity: int, end_id: int, path: str, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Every piece with a number of its own, as a table: doc_id, piece, start, length, ids_crc32, item and, if asked for, ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "item"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, number, end = encoder(path), TaskContext.get().partitionId() << 33, np.array([end_id], np.uint32)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.concatenate([text_ids(enc, text.as_py() or ""), end])
                for piece, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    own = ids[start:start + length].astype("<u4")
                    rows.append((doc_id, piece, start, length, zlib.crc32(own.tobytes()), number) + ((own.tolist(),) if with_ids else ()))
                    number += 1
            types = [b.column(0).type, pa.int32()] + [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(map_texts(texts, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, item long" + ", ids array<long>" * with_ids), "pieces")


_FOUND = "bins array<int>, offsets array<long>, loose array<boolean>"


def _islands(shards: DataFrame, epoch: int, capacity: int, how: Genetic) -> DataFrame:
    """One epoch on every island: a row for each shard and island, with its lengths and the elites it starts from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.select(["shard", "island", "lengths", "elites"]).to_pylist():
                best = evolve(r["lengths"], r["elites"], capacity, how, (r["shard"] * 64 + r["island"]) * 64 + epoch)
                order = sorted(range(len(best.fills)), key=lambda k: -best.fills[k])
                firm = min(sum(f >= how.well * capacity for f in best.fills), len(order))
                firm = max(firm, len(order) - max(2, int(how.loose * len(order))))
                bins, offsets, loose = ([0] * len(r["lengths"]) for _ in range(3))
                for number, k in enumerate(order):
                    at = 0
                    for i in best.groups[k]:
                        bins[i], offsets[i], loose[i] = number, at, number >= firm
                        at += r["lengths"][i]
                worth = best.worth()
                out.append((bins, offsets, loose, worth[0], worth[1]))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("shard", "island", "items", "lengths")), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                                             names=["shard", "island", "items", "lengths", "bins", "offsets", "loose", "n_bins", "worth"])

    return shards.mapInArrow(run, f"shard long, island int, items array<long>, lengths array<int>, {_FOUND}, n_bins long, worth long")


def deal(pieces: DataFrame, n: int, capacity: int, how: Genetic) -> DataFrame:
    """item, shard, bin, offset and loose of n pieces (item and length), each under the capacity.

    Pieces are dealt to shards by a hash of their number, so that none depends on ids or sources. A shard's lengths and
    elites are one row, of about 80 kB; its islands spread over tasks of their own.
    """
    shards = -(-n // how.shard)
    tasks = max(1, min(20000, -(-shards * how.islands // 4)))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    held = dealt.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("item", F.col("length").cast("int").alias("length")))).alias("x"))
    state = held.select("shard", F.col("x.item").alias("items"), F.col("x.length").alias("lengths"), F.array().cast("array<array<int>>").alias("elites"))
    everyone = F.explode(F.sequence(F.lit(0), F.lit(how.islands - 1)))
    rows = state.select("*", everyone.alias("island"))
    for epoch in range(how.epochs):
        evolved = _islands(rows.repartition(tasks, "shard", "island"), epoch, capacity, how)
        found = F.struct("n_bins", "worth", "island", "bins", "offsets", "loose")
        met = evolved.groupBy("shard").agg(F.first("items").alias("items"), F.first("lengths").alias("lengths"), F.array_sort(F.collect_list(found)).alias("all"))
        if epoch + 1 < how.epochs:  # each island keeps its elite and is sent its neighbour's
            here = met.select("shard", "items", "lengths", "all", everyone.alias("island"))
            own = F.filter("all", lambda x: x["island"].isin(F.col("island"), F.pmod(F.col("island") + 1, F.lit(how.islands))))
            rows = here.select("shard", "items", "lengths", F.transform(own, lambda x: x["bins"]).alias("elites"), "island")
    best = met.select("shard", "items", F.col("all")[0].alias("best"))
    each = best.select("shard", F.inline(F.arrays_zip("items", F.col("best.bins").alias("bins"), F.col("best.offsets").alias("offsets"), F.col("best.loose").alias("loose"))))
    return each.toDF("shard", "item", "bin", "offset", "loose")


def pack_best_fit(docs: DataFrame, capacity: int = 2048, end_id: int = 0, how: Genetic = Genetic(), tokenizer: str | None = None,
                  id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs the ids of every text, each followed by end_id, into as few sequences of at most ``capacity`` as it can.

    One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids if with_ids. Only
    documents longer than the capacity are cut: their first piece is the remainder, the others fill a sequence each. The
    pieces' lengths and numbers, a hundredth of the texts, are what the algorithm moves; texts never leave their tasks.

    A null text counts as empty: its document is end_id alone. Ids may be null or repeat: every row is packed by itself,
    under a number that follows from its place in its partition. Very long texts are cut like others. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    every = cut_pieces(docs, capacity, end_id, tokenizer or tokenizer_path(), id_col, text_col, with_ids)
    short = every.where(F.col("length") < capacity).select("item", "length")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    full = every.where(F.col("length") == capacity).withColumns({"sequence_id": F.shiftleft("item", 2), "offset": F.lit(0).cast("long")})
    n = short.count()
    if not n:
        return full.select(*columns)
    number = lambda kind: F.shiftleft(F.shiftleft("shard", 20) + F.col("bin"), 2) + kind
    first = materialize(deal(short, n, capacity, how).withColumn("sequence_id", number(1)), "deal")
    placed = first
    counts = first.where("loose").agg(F.count("*").alias("pieces"), F.count_distinct("sequence_id").alias("bins")).first()
    if counts.bins > 1 and n > how.shard:
        again = materialize(deal(short.join(first.where("loose").select("item"), "item"), counts.pieces, capacity, how).withColumn("sequence_id", number(2)), "deal")
        if again.agg(F.count_distinct("sequence_id")).first()[0] < counts.bins:
            placed = first.where("NOT loose").unionByName(again)
    packed = every.where(F.col("length") < capacity).join(placed.select("item", "sequence_id", "offset"), "item")
    return packed.select(*columns).unionByName(full.select(*columns))


def op12_genetic(spark, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"))
