"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.base import bounded_batches, map_texts, table

DIM_BITS = 20
#: Letters at a word's start that count as stems: inflected and suffixed forms share what is learnt.
STEMS = (4, 5, 6, 7)
_PUNCTUATION = bytes(32 if i < 33 or chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))
#: Odd multipliers: a place in the hash space for each pair of word hashes and each gap between them.
_MIX = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


@dataclass(frozen=True)
class Ftrl:
    """alpha and beta set each coordinate's rate, l1 how much evidence a weight needs, l2 its size.

    The model is fitted in one task on at most max_docs labelled documents, chosen by hash of their id, and on
    fewer if these hold more than max_features distinct features in all: that bounds its memory and time at every
    corpus size and text length. One in calibrate_every of these is not learnt from but turns the model's sums
    into probabilities.
    """

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 6
    max_docs: int = 16000
    max_features: int = 1 << 26
    calibrate_every: int = 5


class _Words(dict):
    """Word to its row in a table of hashes: its own and its stems'. Starts anew when it is full."""

    rows = 1 << 17

    def __init__(self) -> None:
        self.table = np.zeros((self.rows, 1 + len(STEMS)), dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        text = word.decode("utf-8", "surrogatepass")
        self.table[row] = [xxhash.xxh32_intdigest(word), *(n << 32 | xxhash.xxh32_intdigest(text[:n].encode("utf-8", "surrogatepass")) for n in STEMS)]
        return row

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) + len(words) > len(self.table):
            self.clear()
            if len(words) > len(self.table):  # one text may have more words than the table has rows
                self.table = np.zeros((len(words), 1 + len(STEMS)), dtype=np.uint64)
        return self.table[np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))]


_words = _Words()


def features(text: str) -> np.ndarray:
    """Places of a text's words, stems, word pairs and pairs one and two words apart; repeats stay."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split()
    every = _words.hashes(words)
    h, shift = every[:, 0], np.uint64(64 - DIM_BITS)
    with np.errstate(over="ignore"):
        parts = [(every * _MIX[0] >> shift).ravel()]
        for gap in (1, 2, 3):
            if len(h) > gap:
                parts.append(((h[:-gap] * _MIX[gap]) ^ (h[gap:] * _MIX[4])) * _MIX[0] >> shift)
    return np.concatenate(parts).astype(np.int64)


def fit(rows: list[tuple[np.ndarray, int]], p: Ftrl) -> tuple[np.ndarray, float]:
    """Weights and intercept from (distinct features, label 0 or 1), read in order, p.epochs times."""
    z, n = np.zeros(1 << DIM_BITS), np.zeros(1 << DIM_BITS)
    ones = sum(y for _, y in rows)
    b = math.log((ones + 0.5) / (len(rows) - ones + 0.5))
    bn = 0.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= p.l1, 0.0, (np.sign(zi) * p.l1 - zi) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for i, y in rows:
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum() + b)))) - y
            if abs(g) < 1e-6:
                continue
            root = np.sqrt(ni + g * g)
            z[i] = zi + g - (root - np.sqrt(ni)) / p.alpha * w
            n[i] = ni + g * g
            bn += g * g
            b -= g * p.alpha / (p.beta + math.sqrt(bn)) * 0.1
    return weights(z, n), b


def calibrate(sums: np.ndarray, ones: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through labels over sums; few labels leave both near 1 and 0."""
    a, c = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * sums + c, -35, 35)))
        h = q * (1 - q)
        slope = np.array([((q - ones) * sums).sum() + a - 1, (q - ones).sum() + 0.1 * c])
        bend = np.array([[(h * sums * sums).sum() + 1, (h * sums).sum()], [(h * sums).sum(), h.sum() + 0.1]])
        step = np.clip(np.linalg.solve(bend, slope), -0.5, 0.5)
        a, c = min(8.0, max(0.2, a - step[0])), c - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return a, c


def score(text: str, w: np.ndarray, b: float) -> float:
    places = features(text)
    active = np.unique(places[w[places] != 0])
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w[active].sum()) + b))))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id's text, mod 3, is 1. A null id is learnt from by none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and values of the weights that L1 leaves, and the intercept.

    A document with several labels is toxic if one says so. Without labelled texts, or with one kind
    of label only, there are no weights and the intercept gives the share of toxic labels (0 without any).
    """
    known = (labels.where(~held_out(F.col("doc_id"))).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
             .withColumn("order_", F.xxhash64("doc_id")).orderBy("order_", "doc_id").limit(p.max_docs))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("order_", "doc_id", "toxic", "text")  # max_docs bounds it

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.unique(features(t.as_py() or "")).astype("<i4").tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(places, pa.binary())], names=["order_", "doc_id", "toxic", "places"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    known_features = map_texts(rows, read, f"order_ long, doc_id {kind}, toxic int, places binary").repartition(1).sortWithinPartitions("order_", "doc_id", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, ends, labels_, last = array("i"), [0], [], None  # one block of memory, given back as a whole
        for batch in batches:
            for order, doc_id, y, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if (order, doc_id) == last or len(flat) + len(found.as_buffer()) // 4 > p.max_features:  # a repeated id: one text of it is enough
                    continue
                last = order, doc_id
                flat.frombytes(found.as_buffer())
                ends.append(len(flat))
                labels_.append(int(y > 0))
        places = np.frombuffer(flat, dtype=np.int32)
        seen = [(places[a:b], y) for a, b, y in zip(ends, ends[1:], labels_, strict=False)]
        if not seen:
            return
        if len({y for _, y in seen}) == 2:
            w, b = fit([x for i, x in enumerate(seen) if i % p.calibrate_every] or seen, p)
            kept = seen[::p.calibrate_every]
            slope, shift = calibrate(np.array([w[i].sum() + b for i, _ in kept]), np.array([y for _, y in kept]))
            w, b = w * slope, b * slope + shift
        else:
            share = (sum(y for _, y in seen) + 0.5) / (len(seen) + 1)
            w, b = np.zeros(1 << DIM_BITS), math.log(share / (1 - share))
        places = np.flatnonzero(w)
        del seen
        yield pa.RecordBatch.from_arrays([pa.array(np.append(places, -1)), pa.array(np.append(w[places], b))], names=["place", "weight"])

    model = map_texts(known_features, run, "place long, weight double").toArrow()  # 2 ** DIM_BITS rows at most
    places, values = model["place"].to_numpy(), model["weight"].to_numpy()
    b = float(values[places < 0][0]) if len(places) else -4.0
    return places[places >= 0], values[places >= 0], b


def with_scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score of each whole text, 0 to 1. A null text counts as empty and gets the
    intercept's score. The weights are sparse and broadcast."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> pa.Array:
        places, values, b = shared.value
        w = np.zeros(1 << DIM_BITS)
        w[places] = values
        return pa.array([score(t.as_py() or "", w, b) for t in column], pa.float64())

    return docs.withColumn(score_col, F.arrow_udf(run, "double")(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Only the words of a text are inputs of its score. Ids may be null (held out) or repeat; each row is
    scored, equal texts get equal scores, and very long texts are read whole. Of a repeated id's texts one is
    learnt from. Labels with a null id or a null toxic are ignored. Empty and null texts get the intercept's
    score. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    scored = with_scores(docs.select("doc_id", "text"), train(docs, labels, p))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with their columns, whose score is below the threshold."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*cols).alias("row_"), F.col("text").alias("text_"))
    scored = with_scores(packed, train(docs, labels, p), "text_", "score_")
    return scored.where(F.col("score_") < threshold).select("row_.*")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
