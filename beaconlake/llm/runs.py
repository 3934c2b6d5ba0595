"""Periodic runs of words: stretches that repeat with a period, at least four times over.

All documents of an Arrow batch are one sequence of word numbers, a document's words being told apart from all others'.
Equal blocks of 1, 2, 4, ... words get equal names by doubling, which also sorts the suffixes. A block asks, among the
suffixes that begin as it does, for the next one in the window to its right: a range successor in a wavelet tree over the
suffix array. Occurrences of a block in a window of its own length form a progression, whose difference is the candidate.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.base import map_texts, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Blocks:
    """Names of all blocks of 2^k words, up to the longest that occurs twice, and the suffix array.

    names[k][i] is where, in the suffix array, the suffixes begin whose first 2^k items equal those from i. ``repeated[k]``
    lists the starts of blocks that occur more than once, each with the range of its suffixes.
    """

    def __init__(self, items: np.ndarray):
        n = len(items)
        kind = np.int32 if n < 2**31 else np.int64
        suffixes = np.argsort(items, kind="stable")
        self.names: list[np.ndarray] = []
        self.repeated: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        name = np.empty(n, kind)
        slots, keys, width = np.arange(n), items[suffixes].astype(np.int64), 1
        while True:
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))  # of each group of equal blocks
            size = np.diff(first, append=len(keys))
            at = suffixes[slots]
            name[at] = np.repeat(slots[first], size)
            many = np.repeat(size > 1, size)
            at, low, span = at[many], np.repeat(slots[first], size)[many], np.repeat(size, size)[many]
            slots = slots[many]
            if not len(slots):
                break
            self.names.append(name.copy())
            self.repeated.append((at, low, low + span))
            after = at + width
            second = np.where(after < n, name[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
            keys = low * np.int64(n + 1) + second
            order = np.argsort(keys, kind="stable")
            suffixes[slots], keys, width = at[order], keys[order], 2 * width
        self.suffixes = suffixes

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many items from i on equal those from j on (i < j)."""
        n, reach = len(self.suffixes), np.zeros_like(i)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i + reach, j + reach
            fits = b + (1 << k) <= n
            reach += (fits & (self.names[k][np.minimum(a, n - 1)] == self.names[k][np.minimum(b, n - 1)])).astype(reach.dtype) << k
        return reach

    def common_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many items before i equal those before j (i < j)."""
        reach = np.zeros_like(i)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - reach - (1 << k), j - reach - (1 << k)
            reach += ((a >= 0) & (self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)])).astype(reach.dtype) << k
        return reach


class WaveletTree:
    """A sequence of distinct numbers under n, by bits from the highest: on each level those with a 0 stand before those
    with a 1. A level is its bits, 64 to a word, and the count of ones before each word: 1.5 to 2 bits a number."""

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for bit in range(max(1, int(n - 1).bit_length()) - 1, -1, -1):
            ones = (numbers >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.concatenate([packed, np.zeros(8 - len(packed) % 8 + 8, np.uint8)])[:(n // 64 + 1) * 8].view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]])
            self.levels.append((bit, words, before, n - int(ones.sum())))
            numbers = np.concatenate([numbers[~ones], numbers[ones]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[at] + np.bitwise_count(words[at] & below).astype(np.int64)

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest number >= least among those at low to high - 1 (-1: none), for many ranges at once."""
        lo, hi, smaller = low.copy(), high.copy(), np.zeros_like(low)
        for bit, words, before, zeros in self.levels:
            a, b = self._ones(words, before, lo), self._ones(words, before, hi)
            right = (least >> bit & 1).astype(bool)
            smaller += np.where(right, (hi - b) - (lo - a), 0)
            lo, hi = np.where(right, zeros + a, lo - a), np.where(right, zeros + b, hi - b)
        there = smaller < high - low
        lo, hi, rank = low[there], high[there], smaller[there]
        found = np.zeros_like(rank)
        for bit, words, before, zeros in self.levels:
            a, b = self._ones(words, before, lo), self._ones(words, before, hi)
            left = (hi - b) - (lo - a)
            right = rank >= left
            found |= right.astype(found.dtype) << bit
            rank = np.where(right, rank - left, rank)
            lo, hi = np.where(right, zeros + a, lo - a), np.where(right, zeros + b, hi - b)
        out = np.full(len(low), -1, np.int64)
        out[there] = found
        return out


def periodic_runs(items: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """(start, length, period) of every run of at least ``least`` items and ``times`` (3 or more) of its smallest period,
    which no neighbouring item extends, by start and then period.

    Blocks of 2^k items are taken at every half of their length. A run of period q with four periods or more holds
    such a block with q <= 2^k < 2q and, within the run, the block's copy q later. No copy stands nearer, or q were not
    the smallest period: so the block's next occurrence gives q. For three periods blocks are taken everywhere.
    """
    if len(items) < 2:
        return np.empty((0, 3), np.int64)
    blocks = Blocks(items)
    starts, lows, highs, windows = [], [], [], []
    for k, (at, low, high) in enumerate(blocks.repeated):
        own = at % max(1, (1 << k) // 2 if times >= 4 else 1) == 0
        starts.append(at[own])
        lows.append(low[own])
        highs.append(high[own])
        windows.append(np.full(int(own.sum()), 1 << k))
    if not starts:
        return np.empty((0, 3), np.int64)
    start, low, high, window = (np.concatenate(x).astype(np.int64) for x in (starts, lows, highs, windows))
    tree = WaveletTree(blocks.suffixes)
    found = np.concatenate([tree.successor(low[i:i + 65536], high[i:i + 65536], start[i:i + 65536] + 1) for i in range(0, len(start), 65536)])
    near = (found >= 0) & (found - start <= window)
    start, period = start[near], (found - start)[near]
    if not len(start):
        return np.empty((0, 3), np.int64)
    begin = start - blocks.common_before(start, start + period)
    length = start + period + blocks.common(start, start + period) - begin
    runs = np.stack([begin, length, period], axis=1)[length >= np.maximum(least, times * period)]
    return np.unique(runs[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def looped(n: int, doc_id) -> np.ndarray:
    """Places of the words of a document of n words, of which, for one id in ten, the last ones repeat with a period."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    places = np.arange(n)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        places[a:] = a + (places[a:] - a) % p
    return places


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those in no run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def find_runs(docs: DataFrame, least: int = 6, times: int = 4, loops: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then period) and collapsed, the words that no
    run repeats joined by spaces, of every text.

    With ``loops`` the last words of one document in ten first become repetitions of one another, drawn from the id
    (a null id draws as an empty one), as a test of known runs. A null text counts as empty. Texts are never cut: a
    very long one is a batch of its own, which holds 60 to 200 bytes for each word. Rows may repeat; each is searched
    by itself, so there are no ties. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            words = [WORD.findall(t.as_py() or "") for t in b.column(1)]
            ends = np.cumsum([len(w) for w in words], dtype=np.int64)
            places = [looped(len(w), i) if loops else np.arange(len(w)) for w, i in zip(words, ids, strict=True)]
            number: dict[str, int] = {}
            named = np.fromiter((number.setdefault(x, len(number)) for w in words for x in w), np.int64, int(ends[-1]) if len(ends) else 0)
            starts = ends - [len(w) for w in words]
            named = named[np.concatenate([p + s for p, s in zip(places, starts, strict=True)])] if len(words) else named
            owner = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
            found = periodic_runs(owner * max(1, len(number)) + named, least, times)
            cut = np.searchsorted(found[:, 0], ends)
            runs, texts = [], []
            for d, (w, p) in enumerate(zip(words, places, strict=True)):
                own = found[cut[d - 1] if d else 0:cut[d]] - [starts[d], 0, 0]
                stays = p[kept_words(len(w), own)] if len(own) else p
                texts.append(" ".join(w[i] for i in stays.tolist()) if len(own) or loops else " ".join(w))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own.tolist()])
            item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(runs, pa.list_(item)), pa.array(texts, pa.string())],
                                             names=["doc_id", "n_words", "runs", "collapsed"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(texts, run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def op13_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents"), loops=True)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), digest(F.array_join(lines, "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", (-F.col("x.start")).alias("start"), F.col("x.length").alias("length"), (-F.col("x.period")).alias("period"),
                       F.floor(F.col("x.length") * 1000 / -F.col("x.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
