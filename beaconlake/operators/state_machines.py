"""The two state machines: aircraft that stay in few cells, and stations that move.

What windows can't settle reads partitions sorted by key and arrival and holds one key's small state at a time, so
a key's rows never have to fit in memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconlake.config import DEFAULT, Config
from beaconlake.functions import ranges
from beaconlake.functions.geo import EARTH_KM
from beaconlake.sources.shared import written


def fold(rows: DataFrame, key: str, order: str, columns: list[str], start: Callable[[], object], step: Callable, out: dict[str, str]) -> DataFrame:
    """Adds columns that ``step(state, *values)`` returns for each row of a key in order. Null is a key too."""
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in out.items()]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for b in batches:
            got = []
            for k, *values in zip(b[key], *(b[c] for c in columns), strict=True):
                k = None if pd.isna(k) else k
                if k != last:
                    last, state = k, start()
                got.append(step(state, *values))
            yield b.assign(**{n: [g[i] for g in got] for i, n in enumerate(out)})

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


class _Cells:
    def __init__(self) -> None:
        self.cells: list = []
        self.packets = 0


def _cell_step(limit: int, most: int) -> Callable:
    def step(s: _Cells, cell, first, known) -> tuple[bool]:
        if known is not None:
            s.cells, s.packets = list(known), 0
            return (False,)
        if not first:
            return (False,)
        if cell not in s.cells:
            s.cells.append(cell)
        if len(s.cells) > most:
            s.cells.pop(0)
            s.packets = 0
        else:
            s.packets += 1
        return (s.packets / len(s.cells) > limit,)

    return step


def _segments(packets: DataFrame, aircraft: str, order: str, first: Column, cell: str, forgotten: Column, stretch: Column, most: int) -> DataFrame:
    """Adds in_ (the cell of a packet that counts), known_ (the cells in the aircraft's record after a packet, where they
    follow from the last few packets alone) and segment_, the order of the packet at which a new count began."""
    rows = packets.withColumns({"stretch_": stretch, "in_": F.when(first, F.col(cell)), "new_": forgotten})
    whole = Window.partitionBy(aircraft, "stretch_").orderBy(order)
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("episode_", F.sum(F.col("new_").cast("int")).over(up_to(whole)))
    own = Window.partitionBy(aircraft, "stretch_", "episode_").orderBy(order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("c1_", F.last("in_", ignorenulls=True).over(before))
    rows = rows.withColumn("entered_", F.col("in_").isNotNull() & (F.col("c1_").isNull() | (F.col("c1_") != F.col("in_"))))
    rows = rows.withColumn("n_", F.sum(F.col("entered_").cast("int")).over(up_to(own))).withColumn("at_", F.when(F.col("entered_"), F.col("in_")))
    same = Window.partitionBy(aircraft, "stretch_", "episode_", "at_").orderBy(order)
    rows = rows.withColumn("last_", F.when(F.col("entered_"), F.coalesce(F.lag("n_").over(same), F.lit(0))))
    known = [F.col("in_"), F.col("c1_")]
    for i in range(2, most):
        rows = rows.withColumn(f"c{i}_", F.last(F.when(F.col("entered_"), F.col(f"c{i - 1}_")), ignorenulls=True).over(before))
        known.append(F.col(f"c{i}_"))
    different = F.col("n_") - F.max("last_").over(up_to(own))  # cells entered in a row, no two of them equal
    rows = rows.withColumn("known_", F.when(F.col("entered_") & (different >= 3 * most), F.array(*reversed(known))))
    rows = rows.withColumn("bound_", F.max(F.when(F.col("new_") | F.col("known_").isNotNull(), F.col(order))).over(up_to(whole)))
    made = written(rows.select(*packets.columns, "stretch_", "in_", "known_", "bound_"), "cells")
    ends = made.groupBy(F.col(aircraft).alias("a_"), F.col("stretch_").alias("s_")).agg(F.max("bound_").alias("end_"))
    carried = ends.select("a_", "s_", F.max("end_").over(Window.partitionBy("a_").orderBy("s_").rowsBetween(Window.unboundedPreceding, -1)).alias("carried_"))
    joined = made.join(carried, F.col(aircraft).eqNullSafe(F.col("a_")) & (F.col("stretch_") == F.col("s_")))
    return joined.withColumn("segment_", F.coalesce("bound_", "carried_", F.lit(-(1 << 62)))).drop("a_", "s_", "carried_", "bound_", "stretch_")


def h3_stationary(packets: DataFrame, aircraft: str = "aircraft", order: str = "seq", cell: str = "cell10", first: str = "first", forgotten: str | None = None,
                  standing: Column | None = None, arrival: Column | None = None, forget: int = DEFAULT.forget_seconds, limit: int = 90, most: int = 4, per_range: int = ranges.ROWS) -> DataFrame:
    """Adds h3_stationary: over ``limit`` first packets for each of the aircraft's last up to ``most`` cells. A fifth cell
    evicts the one that came first and starts the count anew, and so does a ``forgotten`` packet with an empty record.
    Packets that are not first, and standing ones, are never stationary; standing ones matter where they are forgotten.

    An aircraft's history falls apart into segments with a count of their own. They begin where it was forgotten, and where
    three times ``most`` different cells were entered in a row: whatever was known before, the record then holds the last
    ``most`` of them and a count of nothing. Aircraft that fly enter new cells all the time, so their segments are short, and
    those with no more first packets than the limit are settled by counting. Of the long ones, those that never evict a
    cell are settled by the places of their first few hundred packets. Only what is left is walked through packet by packet,
    a segment to a task. With ``arrival``, as in with_gaps, all windows are of bounded stretches of time, and in any case they
    are of ranges of ``order`` with about ``per_range`` packets of all aircraft at most. Null is an aircraft too.
    """
    moves = F.col(first) if standing is None else F.col(first) & ~F.coalesce(standing, F.lit(False))
    stretch = F.floor(arrival / forget) if arrival is not None else F.lit(0).cast("long")
    if ends := ranges.cuts(packets, order=order, most=per_range):  # both run with order, so the number made of them does
        stretch = F.shiftleft(F.coalesce(ranges.place(order, ends), F.lit(0)).cast("long"), 40) + stretch
    rows = _segments(packets, aircraft, order, F.coalesce(moves, F.lit(False)), cell, F.coalesce(F.col(forgotten), F.lit(False)) if forgotten else F.lit(False), stretch, most)
    counted = rows.where("in_ IS NOT NULL")
    each = counted.select(F.col(aircraft).alias("a_"), F.col("segment_").alias("g_"), F.col(order).alias("o_"), "known_", F.explode(F.coalesce("known_", F.array("in_"))).alias("c_"))
    cells = each.groupBy("a_", "g_", "c_").agg(F.min("o_").alias("o_"), F.count_if(F.col("known_").isNull()).alias("n_"), F.count_if(F.col("known_").isNotNull()).alias("k_"))
    of = Window.partitionBy("a_", "g_")
    cells = cells.select("*", F.row_number().over(of.orderBy("o_", "c_")).alias("rank_"), F.sum("n_").over(of).alias("total_"), F.max("k_").over(of).alias("full_"))
    long = cells.where((F.col("rank_") <= most + 1) & (F.col("total_") > limit * F.when(F.col("full_") > 0, most).otherwise(1)))
    long = written(long.groupBy("a_", "g_").agg(F.array_sort(F.collect_list("o_")).alias("entries_")), "segments")  # at most five of a segment
    here = F.col(aircraft).eqNullSafe(F.col("a_")) & (F.col("segment_") == F.col("g_"))
    stays = counted.where("known_ IS NULL").join(long.where(F.size("entries_") <= most), here).select("a_", "g_", F.col(order).alias("o_"))
    place = stays.withColumn("rank_", F.row_number().over(of.orderBy("o_"))).where(F.col("rank_") <= limit * most + 1)
    from_ = place.groupBy(F.col("a_").alias("b_"), F.col("g_").alias("h_")).agg(F.array(*[F.max(F.when(F.col("rank_") == limit * n + 1, F.col("o_"))) for n in range(1, most + 1)]).alias("from_"))
    settled = long.join(from_, F.col("a_").eqNullSafe(F.col("b_")) & (F.col("g_") == F.col("h_")), "left").select("a_", "g_", "entries_", "from_")
    at = rows.join(settled, here, "left").where(F.coalesce(F.size("entries_") <= most, F.lit(True)))
    now = F.size(F.filter("entries_", lambda x: x <= F.col(order)))
    start = F.coalesce(F.element_at("from_", F.greatest(now, F.lit(1))) <= F.col(order), F.lit(False))
    quick = at.withColumn("h3_stationary", F.col("in_").isNotNull() & F.col("known_").isNull() & start)
    hard = rows.join(long.where(F.size("entries_") > most).select("a_", "g_"), here).withColumn("key_", F.concat_ws("/", F.coalesce(F.col(aircraft).cast("string"), F.lit("")), F.col("segment_").cast("string"))).withColumns({"first_": F.col("in_").isNotNull(), "in_": F.coalesce("in_", F.lit(0))})
    slow = fold(hard.select(*packets.columns, "in_", "known_", "key_", "first_"), "key_", order, ["in_", "first_", "known_"], _Cells, _cell_step(limit, most), {"h3_stationary": "boolean"})
    return quick.select(*packets.columns, "h3_stationary").unionByName(slow.select(*packets.columns, "h3_stationary"))


def distance_km(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, h)))


class _Place:
    primary = previous = last = None
    moved = bouncing = False


def _move_step(config: Config) -> Callable:
    def step(s: _Place, lat, lng) -> tuple[str, bool, bool]:
        here = (float(lat), float(lng))
        if s.primary is None:
            s.primary = here
        if s.previous is None:
            s.previous = s.last or s.primary
        far, back = distance_km(s.primary, here), distance_km(s.previous, here)
        state = "still"
        if far > config.moved_km:
            if back > config.moved_km:
                state, s.moved, s.bouncing = "moved", True, False
                s.previous = s.primary
            elif back > config.jitter_km:
                state, s.moved = "in_motion", True
            else:
                state, s.moved, s.bouncing = "bouncing", False, True
            s.primary = here
        else:
            s.bouncing = False
            if far > config.jitter_km:
                state = "near"
        s.last = here
        return state, s.moved, s.bouncing

    return step


#: Distances in km that two ways of rounding may tell apart.
_ROUNDING = 1e-9
#: Beacons without a move after which those that follow are looked at together.
_CALM = 8


def _quiet(lat: np.ndarray, lng: np.ndarray, at: tuple[float, float], config: Config) -> tuple[int, np.ndarray]:
    """How many of the places are surely not further from ``at`` than a move takes, and which of those are near, not still.
    It also stops at what is too close to a threshold to be told apart by another way of rounding."""
    near, done, size = [], 0, 32
    while done < len(lat):
        la, ln = np.radians(lat[done:done + size]), np.radians(lng[done:done + size])
        h = np.sin((la - math.radians(at[0])) / 2) ** 2 + math.cos(math.radians(at[0])) * np.cos(la) * np.sin((ln - math.radians(at[1])) / 2) ** 2
        far = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h)))
        with np.errstate(invalid="ignore"):
            sure = (far < config.moved_km - _ROUNDING) & (np.abs(far - config.jitter_km) > _ROUNDING)
        n = len(sure) if sure.all() else int(np.argmin(sure))
        near.append(far[:n] > config.jitter_km)
        done += n
        if n < len(sure):
            break
        size *= 2
    return done, np.concatenate(near) if near else np.zeros(0, bool)


def _walked(changes: DataFrame, config: Config) -> DataFrame:
    """(id_, move_, moved, bouncing) after each of the rows, key by key in order. Stretches without a move are settled at once."""
    step = _move_step(config)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, calm = object(), None, 0
        for b in batches:
            keys = [None if pd.isna(k) else k for k in b["key_"]]
            lat, lng = b["lat_"].to_numpy(float), b["lng_"].to_numpy(float)
            move, flags, i = np.empty(len(b), object), np.zeros((len(b), 2), bool), 0
            ends = [len(b)] * len(b)  # where a row's key ends
            for j in range(len(b) - 2, -1, -1):
                ends[j] = ends[j + 1] if keys[j] == keys[j + 1] else j + 1
            while i < len(b):
                if keys[i] != last:
                    last, state = keys[i], _Place()
                z = i + 1
                if np.isnan(lat[i]) or np.isnan(lng[i]):
                    flags[i] = state.moved, state.bouncing
                else:
                    move[i], *flags[i] = step(state, lat[i], lng[i])
                    calm = calm + 1 if move[i] in ("still", "near") else 0
                    if calm >= _CALM:
                        n, near = _quiet(lat[z:ends[i]], lng[z:ends[i]], state.primary, config)
                        if n:
                            move[z:z + n], flags[z:z + n] = np.where(near, "near", "still"), (state.moved, False)
                            state.last, state.bouncing, z = (lat[z + n - 1], lng[z + n - 1]), False, z + n
                i = z
            yield pd.DataFrame({"id_": b["id_"], "move_": move, "moved": flags[:, 0], "bouncing": flags[:, 1]})

    rows = changes.repartition("key_").sortWithinPartitions("key_", "at_", "id_")
    return rows.mapInPandas(run, "id_ long, move_ string, moved boolean, bouncing boolean")


def station_moves(beacons: DataFrame, station: str = "station_id", order: str = "seq", lat: str = "lat", lng: str = "lng", config: Config = DEFAULT) -> DataFrame:
    """Adds move (still, near, moved, in_motion, bouncing) and the flags moved and bouncing after each location beacon of a
    station. The first beacon sets the primary place. A beacon with a null or no-number place changes nothing: its move is
    null, its flags are those before it. Null is a station too; beacons of one order are taken in any order.

    Beacons are dealt by station and order in ranges of equal size, so one station may have any number of them. Of beacons
    in a row at one place only a range's first two are walked through: from the second on the station is where it was, and
    nothing changes. What is left, the changes of place, is walked through station by station.
    """
    place = [F.col(c).cast("double") for c in (lat, lng)]
    dealt = beacons.repartitionByRange(station, order).withColumn("id_", F.monotonically_increasing_id())
    by = Window.partitionBy(F.shiftright("id_", 33), station).orderBy(order, "id_")
    known = place[0].isNotNull() & place[1].isNotNull() & ~F.isnan(place[0]) & ~F.isnan(place[1])
    same = reduce(and_, [F.lag(x, n).over(by) == x for x in place for n in (1, 2)], known)
    dealt = dealt.withColumn("new_", ~F.coalesce(same, F.lit(False)))
    rows = written(dealt.withColumn("run_", F.last(F.when(F.col("new_"), F.col("id_")), ignorenulls=True).over(by)), "beacons")
    changes = rows.where("new_").select("id_", F.col(station).alias("key_"), F.col(order).alias("at_"), place[0].alias("lat_"), place[1].alias("lng_"))
    first = _walked(changes, config).withColumnRenamed("id_", "run_")
    return rows.join(first, "run_").select(*beacons.columns, F.col("move_").alias("move"), "moved", "bouncing")
