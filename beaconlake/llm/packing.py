"""Harmonic packing of token ids into fixed-length training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.base import map_texts, table
from beaconlake.llm.tokens import encoder, text_ids, tokenizer_path

#: Remainders under this many ids stay in one piece.
SMALLEST_CUT = 64
FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of n ids: whole sequences, then from what is left, again and again, the largest reciprocal
    share capacity // k that it holds. A bin of class k takes k such pieces and needs less than k ids of padding. What is
    left under SMALLEST_CUT is one piece of its own class."""
    whole, rest = divmod(n, capacity)
    lengths = [capacity] * whole
    while rest >= SMALLEST_CUT:
        share = capacity // (capacity // (rest + 1) + 1)
        lengths.append(share)
        rest -= share
    return lengths + [rest] * (rest > 0)


def tail_lengths(n: int, capacity: int) -> list[int]:
    """Sequence lengths for n ids left at a worker's end: full ones, then powers of two."""
    return [capacity] * (n // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if (n % capacity) >> b & 1]


class Packer:
    """The bins of one worker. A piece of length l is of class capacity // l; a bin of class k takes
    exactly k pieces, which always fit. Only open bins are held: at most one for each class."""

    def __init__(self, capacity: int, worker: int, keep_ids: bool):
        self.capacity, self.worker, self.keep_ids = capacity, worker, keep_ids
        self.open: dict[int, list[tuple]] = {}
        self.sequences = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        at = 0
        for n in cut_lengths(len(ids), self.capacity):
            k = self.capacity // n
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc_id, at, ids[at:at + n].copy(), len(ids)))  # a view would keep the whole document
            at += n
            if len(bin_) == k:
                self.close(self.open.pop(k))

    def close(self, pieces: list[tuple]) -> None:
        sequence, offset = (self.worker << 36) + self.sequences, 0
        self.sequences += 1
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset)
                             + ((ids.tolist(),) if self.keep_ids else ()))
            offset += len(ids)

    def finish(self) -> None:
        """Bins that did not fill are poured together and cut anew into sequences without padding."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        wanted = iter(tail_lengths(sum(len(p[2]) for p in left), self.capacity))
        now: list[tuple] = []
        room = next(wanted, 0)
        for doc_id, start, ids, total in left:
            while len(ids):
                part = ids[:room]
                now.append((doc_id, start, part, total))
                ids, start, room = ids[len(part):], start + len(part), room - len(part)
                if not room:
                    self.close(now)
                    now, room = [], next(wanted, 0)


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, tokenizer: str | None = None,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs the ids of every text, each followed by end_id, into sequences of at most ``capacity``.

    One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    the ids if with_ids. Workers fill their bins independently and nothing is shuffled; sequence ids
    hold the partition's number. A sequence is full, or its length is a power of two, or it is a full bin of one
    class k, with less than k ids of padding for pieces of a k-th and at most a k-th of the sequence for short tails
    (k >= capacity / SMALLEST_CUT). ``capacity`` is a power of two.

    A null text counts as empty: its document is end_id alone. Ids may be null or repeat (each row is
    packed by itself). Very long texts are cut like others and encoded in parts (see count_tokens); a task holds all
    ids of one text, four bytes each. Other columns are ignored. An empty table gives an empty result.
    """
    if capacity & (capacity - 1) or capacity < 2:
        raise ValueError("capacity must be a power of two")
    path = tokenizer or tokenizer_path()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, id_type = encoder(path), Packer(capacity, TaskContext.get().partitionId(), with_ids), None
        end = np.array([end_id], dtype=np.uint32)

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.rows, strict=True)) or [()] * (len(FIELDS) + with_ids)
            packer.rows = []
            types = [id_type] + [pa.int64()] * 6 + [pa.list_(pa.int64())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=FIELDS + ["ids"] * with_ids)

        for b in batches:
            id_type = b.column(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packer.add(doc_id, np.concatenate([text_ids(enc, text.as_py() or ""), end]))
                if len(packer.rows) >= 20000:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()

    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
