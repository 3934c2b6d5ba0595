"""Nearest neighbours by inner product over randomly rotated one-bit codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.llm.base import materialize, table
from beaconlake.llm.vectors import matrix, part_of, parts, usable

#: Vectors of an index shard and queries of a block: what meets in one task. Each shard is sent once for each block,
#: each query once for each shard; with four queries to a vector neither outweighs the other by much.
SHARD, BLOCK = 16384, 65536
#: Width of the error bound, in standard errors of a code's estimate.
BOUND = 3.0
#: Candidates with the best estimates, reranked first, or more if more are asked for: their exact products set the bar
#: for the rest.
FIRST = 64
#: Bits to which a query's components are rounded.
PLANES = 4
#: How far products in single precision are off, as a share of both norms, with room to spare.
SINGLE = 2e-5


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated vectors in 64-bit words, and of each vector, scaled by a power of two to components
    of at most one, its norm, that power, and the inner product of its unit vector with its code: the correction that
    makes estimates from the code unbiased."""
    powers = np.frexp(np.abs(x).max(axis=1))[1]
    unit = np.ldexp(x, -powers[:, None])
    turned = unit @ rotation(x.shape[1])
    norms = np.linalg.norm(unit, axis=1)
    align = np.abs(turned).sum(axis=1) / (np.sqrt(x.shape[1]) * norms)
    bits = np.packbits(turned > 0, axis=1)
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64), norms, powers, align


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products with q in double precision, adding component by component, so that equal vectors
    have equal products."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        return np.add.reduce(np.ascontiguousarray((x * q).T), axis=0)


class Codes:
    """A shard's vectors with their codes and correction scalars, for inner products with many queries. Estimates and first
    products are relative to the shard's largest power of two: what counts is their order."""

    def __init__(self, x: np.ndarray, words: np.ndarray, norms: np.ndarray, powers: np.ndarray, align: np.ndarray):
        self.words, self.powers, self.dim, self.most = [np.ascontiguousarray(w) for w in words.T], powers, x.shape[1], powers.max(initial=-2000)
        ones = sum(np.bitwise_count(w).astype(np.float32) for w in self.words)
        with np.errstate(under="ignore"):
            length = np.ldexp(norms, powers - self.most)
            self.single = np.ldexp(x, -self.most).astype(np.float32)
            self.scale = (length / (align * np.sqrt(self.dim))).astype(np.float32)
            self.spread = (BOUND * length * np.sqrt(np.maximum(0.0, 1 - align**2)) / (align * np.sqrt(max(1, self.dim - 1)))).astype(np.float32)
            self.rounding = (SINGLE * length).astype(np.float32)
        self.centred = (2 * ones - self.dim) * self.scale

    def estimates(self, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the products with one rotated query, and how far most are off.

        The query's components are rounded to PLANES bits. The sum of those at a code's ones is then that of its ones in
        each bit plane, times the plane's weight: ands and counts of 64-bit words, without unpacking a code.
        """
        low, high = turned.min(), turned.max()
        step = (high - low) / ((1 << PLANES) - 1) or 1.0
        u = np.rint((turned - low) / step).astype(np.uint8)
        planes = np.packbits((u[None, :] >> np.arange(PLANES)[:, None]) & 1, axis=1)
        planes = np.pad(planes, ((0, 0), (0, -planes.shape[1] % 8))).view(np.uint64)
        at_ones = np.zeros(len(self.scale), np.uint32)
        for j in range(PLANES - 1, -1, -1):
            at_ones <<= 1
            for w, p in zip(self.words, planes[j], strict=True):
                at_ones += np.bitwise_count(w & p)
        off = np.linalg.norm(turned - (low + step * u)) / np.linalg.norm(turned)  # of rounding, small beside that of the codes
        estimate = at_ones.astype(np.float32)
        estimate *= np.float32(2 * step)
        estimate -= np.float32(step * int(u.sum()))
        estimate *= self.scale
        estimate += np.float32(low) * self.centred
        length = np.linalg.norm(turned)
        return estimate, np.float32(length) * np.hypot(self.spread, np.float32(BOUND * off) * self.scale)


def search_block(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: Codes, query_rows: np.ndarray, queries: np.ndarray, k: int,
                 bars: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, place in the shard, product) of the k nearest of one shard for each query of one block, without the
    query's own row, and with ``bars`` none whose product is under the query's bar. Ties go to the smaller id, then the
    smaller row.

    Only vectors whose estimate plus its bound reaches the k-th best product so far are reranked: in single precision, and
    what that leaves in double; and those whose products with the query may leave the range of doubles.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    head = max(FIRST, k + 1)  # one of them may be the query's own row
    own_power = np.frexp(np.abs(queries).max(axis=1))[1] if len(queries) else np.zeros(0, np.int64)
    units = np.ldexp(queries, -own_power[:, None])
    turned = units @ rotation(x.shape[1])
    for i, qi in enumerate(query_rows):
        single, length = units[i].astype(np.float32), np.linalg.norm(units[i])
        if len(rows) > head:
            e, off = codes.estimates(turned[i])
            order = np.argpartition(e, len(e) - head)[-head:]
            with np.errstate(under="ignore", over="ignore"):
                bar = np.partition((codes.single[order] @ single)[rows[order] != qi], -k)[-k] - np.float32(length) * codes.rounding[order].max()
                if bars is not None and np.isfinite(bars[i]):
                    known = np.ldexp(bars[i], -int(codes.most) - int(own_power[i]))
                    bar = max(bar, known - abs(known) * SINGLE)
            e += off
            some = np.flatnonzero(e >= bar)
            near = codes.single[some] @ single + np.float32(length) * codes.rounding[some]
            far = codes.powers + own_power[i]
            odd = np.flatnonzero((far > 1000) | (far < -960))
            order = some[near >= bar]
            order = np.union1d(order, odd) if len(odd) else order
        else:
            order = np.arange(len(rows))
        order = order[rows[order] != qi]
        score = products(x[order], queries[i])
        best = np.lexsort((rows[order], ids[order], -score, ~np.isnan(score)))[:k]  # products without a value come first, as in SQL
        if bars is not None and not np.isnan(bars[i]):
            best = best[~(score[best] < bars[i])]
        found.append((np.full(len(best), qi), order[best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def build_index(vectors: DataFrame) -> DataFrame:
    """Every usable row with a number of its own, its dimension, shard, code, norm, power and correction, as a table."""
    one = vectors.where(usable(F.col("embedding"))).select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding", F.size("embedding").alias("dim"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                codes, norms, powers, align = encode(matrix(part.column("embedding")))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(powers, pa.int32()), pa.array(align)],
                    names=[*part.schema.names, "code", "norm", "power", "align"])

    kind = one.schema["embedding"].dataType.simpleString()
    coded = materialize(one.mapInArrow(run, f"row long, vec_id long, embedding {kind}, dim int, code binary, norm double, power int, align double"), "codes")
    sizes = coded.groupBy("dim").agg(F.count("*").alias("n_rows"))
    return coded.join(sizes.select("dim", parts("n_rows", SHARD).alias("shards")), "dim").withColumn("shard", part_of(F.col("row"), F.col("shards")))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k vectors with the largest inner product for each query.

    ``is_query`` selects the query rows by vec_id. Every row is indexed; all candidates but the query's
    own row are compared through their codes, and the product of those returned is exact. Ties go to the smaller
    id, null last, and among equal ids to any row.

    Each task joins one shard of codes with one block of queries; neither grows with the table, their number
    grows with its square. Of s shards the first sqrt(s) are searched first; the k-th best product that a query finds
    there is its bar, and of the others only what reaches it is shuffled: k / sqrt(s) rows a shard instead of k. Vectors that
    are null, zero, empty or hold null or non-finite components take no part; vectors of different length don't
    meet. Components may have any size: codes are those of vectors scaled by powers of two, and products that leave the
    range of doubles are those of plain double arithmetic. Rows that share an id, or have none, are candidates of their own; rows with a query's id are queries of
    their own. With fewer than k candidates all are returned. Other columns are ignored, whatever their names.
    An empty table gives an empty result.
    """
    index = build_index(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")))
    queries = index.where(is_query).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("dim").alias("dim"), "shards")
    early = F.col("shard") < F.ceil(F.sqrt(F.col("shards").cast("double")))
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    first = _meet(index.where(early), queries.withColumn("bar", F.lit(None).cast("double")), early, k)
    first = materialize(first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "nearest")
    bars = first.where(F.col("rank") == k).select("query_row", F.col("score").alias("bar"))
    rest = _meet(index.where(~early), queries.join(bars, "query_row", "left"), ~early, k)
    best = first.drop("rank").unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(queries.select("query_row", "query_id"), "query_row").select("query_id", "rank", "vec_id", "score")


def _meet(index: DataFrame, queries: DataFrame, which: Column, k: int) -> DataFrame:
    """query_row, row, vec_id and score of what the shards of ``index``, those that ``which`` tells, find for all queries."""
    blocks = queries.groupBy("dim").agg(F.count("*").alias("n_queries"))
    blocks = blocks.select("dim", parts("n_queries", BLOCK).alias("blocks"))
    shard_side = index.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("shards", "blocks")
    query_side = (queries.join(blocks, "dim").withColumn("block", part_of(F.col("query_row"), F.col("blocks")))
                  .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where(which).select(F.col("dim").alias("dim"), "shard", "block", "query_row", "query", "bar"))

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        found, at, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if shard.num_rows and block.num_rows:
            words = np.frombuffer(b"".join(shard["code"].to_pylist()), dtype=np.uint64).reshape(shard.num_rows, -1)
            ids, x = shard["vec_id"].fill_null(np.iinfo(np.int64).max).to_numpy(), matrix(shard["embedding"])
            codes = Codes(x, words, shard["norm"].to_numpy(), shard["power"].to_numpy(), shard["align"].to_numpy())
            bars = block["bar"].cast(pa.float64()).to_numpy(zero_copy_only=False)
            found, at, score = search_block(shard["row"].to_numpy(), ids, x, codes, block["query_row"].to_numpy(), matrix(block["query"]), k, bars)
        return pa.table([pa.array(found), shard["row"].take(at), shard["vec_id"].take(at), pa.array(score)], names=["query_row", "row", "vec_id", "score"])

    keys = ["dim", "shard", "block"]
    return shard_side.groupBy(*keys).cogroup(query_side.groupBy(*keys)).applyInArrow(run, "query_row long, row long, vec_id long, score double")


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP10_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, q.r AS query_row, c.vec_id, c.r, list_dot_product(q.e, c.e) AS score
  FROM (SELECT * FROM v WHERE vec_id % 20 = 0) q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e))
SELECT query_id, (row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id ASC NULLS LAST, r))::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 20
"""
