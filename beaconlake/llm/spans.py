"""What the two span finders share: digests of spans, and running a finder over whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.base import map_texts

Span = tuple[str, int, int]


def ordered(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then kind as listed."""
    return sorted(set(spans), key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def find_spans(docs: DataFrame, find: Callable[[str], tuple[list[Span], list[Span], float]], base: tuple[str, ...], added: tuple[str, ...],
               id_col: str, text_col: str, score: str) -> DataFrame:
    """doc_id, n_<kind> for each base kind, base_sha256, spans and the highest score of every text.

    ``find`` gives the base spans, the added spans and the score of one text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    counts = [f"n_{k}" for k in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1):
                own, more, top = find(text.as_py() or "")
                own = ordered(own, base)
                rows.append((*(sum(s[0] == k for s in own) for k in base), digest(own), joined(ordered(own + more, base + added)), top))
            cols = zip(*rows, strict=True) if rows else [()] * (len(base) + 3)
            types = [pa.int64()] * len(base) + [pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                                             names=["doc_id", *counts, "base_sha256", "spans", score])

    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string, {score} double")
