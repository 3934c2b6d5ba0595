"""Near-duplicate embeddings: a small-world graph for each shard, searched by every shard's vectors."""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.base import materialize, table
from beaconlake.llm.components import components
from beaconlake.llm.hnsw import Hnsw
from beaconlake.llm.vectors import matrix, part_of, parts, usable

#: Distance below the threshold at which single-precision hits are still verified in double.
MARGIN = 1e-4


@dataclass(frozen=True)
class Settings:
    """A shard has about ``shard`` distinct vectors; a task searches one shard for itself, or two for each
    other. Vectors are compared densely at most ``block`` at a time.

    Beams start at beams[0], or at the shard's size if that is less. A beam is accepted if it finds ``recall`` of
    ``audit_links`` links known by brute force, else it is widened: to the next one, and beyond the last twice
    to its double. The known links are those of ``audit`` of the queries, at random, to other
    vectors, and those of as many probes as it takes: members of the shard, each turned away from itself by an
    angle under the threshold's, so that every probe has a link that the graph must find. A query whose whole
    beam is over the threshold goes on to the next beam. What no beam was accepted for is compared with the
    whole shard, exactly: queries with more links than the last beam holds, or all if audits fail to the end.
    """

    threshold: float = 0.93
    shard: int = 16384
    block: int = 16384
    beams: tuple[int, ...] = (64, 128, 256)
    audit: int = 64
    audit_links: int = 512
    recall: float = 0.99

    def widths(self, size: int) -> list[int]:
        """The beams for a shard of a size; none is wider than the shard."""
        return list(dict.fromkeys(min(b, size) for b in (*self.beams, 2 * self.beams[-1], 4 * self.beams[-1])))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component between a half and one. Cosines stay as
    they are to the last bit, and no square of a very small or large component vanishes or overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _cosines(x: np.ndarray, nx: np.ndarray, i: np.ndarray, y: np.ndarray, ny: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for a in range(0, len(i), 1 << 16):
        b = slice(a, a + (1 << 16))
        out[b] = np.einsum("ed,ed->e", x[i[b]], y[j[b]]) / (nx[i[b]] * ny[j[b]])
    return out


def _unite(least: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the groups of i and j; least holds each node's group, named by its smallest node."""
    lo, hi = np.minimum(least[i], least[j]), np.maximum(least[i], least[j])
    while True:
        pairs = np.unique((lo.astype(np.int64) * len(least) + hi)[lo != hi])
        if not len(pairs):
            return
        lo, hi = pairs // len(least), pairs % len(least)
        np.minimum.at(least, hi, lo)
        while not np.array_equal(least, least[least]):
            least[:] = least[least]
        lo, hi = np.minimum(least[lo], least[hi]), np.maximum(least[lo], least[hi])


class Shard:
    """The distinct vectors of a shard, its graph, and what each search finds over the threshold. audits lists what
    was tried: beam, links known, links found, and whether the beam was accepted."""

    def __init__(self, x: np.ndarray, graph: Hnsw | None = None):
        self.x, self.norms = x, np.linalg.norm(x, axis=1)
        self.unit = (x / self.norms[:, None]).astype(np.float32)
        self.graph = graph or Hnsw.build(self.unit)
        self.audits: list[tuple[int, int, int, bool]] = []

    def dense(self, q: np.ndarray, nq: np.ndarray, s: Settings):
        """(query, hits) against the whole shard, exactly, some queries at a time."""
        step = max(1, min(s.block, (1 << 22) // len(self.x)))
        for a in range(0, len(q), step):
            close = q[a:a + step] @ self.x.T >= (s.threshold - MARGIN) * nq[a:a + step, None] * self.norms
            i, j = np.nonzero(close)
            ok = _cosines(q, nq, i + a, self.x, self.norms, j) >= s.threshold
            yield i[ok] + a, j[ok]

    def known(self, q: np.ndarray, s: Settings, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The queries compared by brute force and their exact links, without those of crowded queries: these have
        more links than the last beam holds, and are left for the dense comparison. own: each query's row, no link."""
        found, crowded = [np.zeros((2, 0), dtype=np.int64)], np.zeros(len(q), dtype=bool)
        for i, j in self.dense(q, np.linalg.norm(q, axis=1), s):
            if own is not None:
                i, j = i[own[i] != j], j[own[i] != j]
            n = np.bincount(i, minlength=len(q))
            crowded |= n >= s.beams[-1]
            found.append(np.stack([i, j])[:, n[i] < s.beams[-1]])
        i, j = np.concatenate(found, axis=1)
        return np.flatnonzero(~crowded), i, j

    def probes(self, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Turned members and their exact links: at least audit_links, unless nearly all probes are crowded."""
        rng, dim = np.random.default_rng(5), self.x.shape[1]
        at = rng.integers(0, len(self.x), 2 * s.audit_links)
        member = self.x[at] / self.norms[at, None]
        side = rng.standard_normal(member.shape)
        side -= (side * member).sum(axis=1, keepdims=True) * member
        size = np.linalg.norm(side, axis=1, keepdims=True)
        side = np.divide(side, size, out=np.zeros_like(side), where=size > 1e-9)  # in one dimension there is no side
        c = rng.uniform(s.threshold + MARGIN, 1, (len(at), 1))
        turned = c * member + np.sqrt(1 - c * c) * side if dim > 1 else member
        for n in dict.fromkeys((s.audit_links, len(at))):
            _, i, j = self.known(turned[:n], s)
            if len(i) >= s.audit_links:
                break
        return turned[:n], i, j

    def links(self, q: np.ndarray, s: Settings, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query, member) over the threshold, and the queries left for the dense comparison; the pairs of
        those audited are exact. With own the queries are the members, whose hits on themselves don't count."""
        n, nq = len(q), np.linalg.norm(q, axis=1)
        some = np.random.default_rng(n).permutation(n)[:s.audit]
        seen, i, j = self.known(q[some], s, some if own else None)
        exact = np.zeros(n, dtype=bool)
        exact[some[seen]] = True
        found_i, found_j = [some[i]], [j]
        turned, probe_i, probe_j = self.probes(s)
        q, nq = np.concatenate([q, turned]), np.concatenate([nq, np.linalg.norm(turned, axis=1)])
        unit = (q / nq[:, None]).astype(np.float32)
        true_i, true_j = np.concatenate([some[i], probe_i + n]), np.concatenate([j, probe_j])
        truth = true_i * len(self.x) + true_j
        ask, accepted = np.arange(len(q)), False
        for beam in s.widths(len(self.x)):
            if not len(ask) or accepted and beam > s.beams[-1]:
                break
            ids, sims = self.graph.search(unit[ask], beam)
            hit = (sims >= s.threshold - MARGIN) & (ids >= 0)
            full = np.zeros(len(q), dtype=bool)
            full[ask] = hit.all(axis=1) & (beam < len(self.x))
            i, k = np.nonzero(hit)
            i, j = ask[i], ids[i, k]
            i, j = i[~full[i]], j[~full[i]]
            ok = _cosines(q, nq, i, self.x, self.norms, j) >= s.threshold
            i, j = i[ok].astype(np.int64), j[ok].astype(np.int64)
            asked = np.zeros(len(q), dtype=bool)
            asked[ask] = True
            wanted = truth[asked[true_i] & ~full[true_i]]
            got = int(np.isin(wanted, i * len(self.x) + j).sum())
            good = len(wanted) >= s.audit_links and got >= s.recall * len(wanted)
            self.audits.append((beam, len(wanted), got, good))
            if good:  # else all of them again, with a wider beam
                accepted = True
                new = (i < n) & ~exact[np.minimum(i, n - 1)]
                found_i.append(i[new]), found_j.append(j[new])
                ask = ask[full[ask]]
        todo = ask[ask < n]
        return np.concatenate(found_i), np.concatenate(found_j), todo[~exact[todo]]

    def dump(self) -> dict[str, np.ndarray]:
        """What another task needs, in single precision where that loses nothing."""
        small = self.x.astype(np.float32)
        return {"x": small if np.array_equal(small, self.x) else self.x, "order": self.graph.order, **{f"links{k}": x for k, x in enumerate(self.graph.links)}}

    @classmethod
    def load(cls, z) -> Shard:
        x = z["x"].astype(np.float64)
        unit = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
        return cls(x, Hnsw(unit[z["order"]], z["order"], [z[f"links{k}"] for k in range(sum(f.startswith("links") for f in z.files))]))


AUDIT = -2  # node of the rows that report audits: links known, links found
REPORT = {"node": pa.int64(), "links": pa.int64(), "peer": pa.int64()}


def _reported(columns: list[np.ndarray], *shards: Shard) -> list[np.ndarray]:
    """With one row more for each beam accepted: how many links its audit knew, and found."""
    rows = [(AUDIT, known, found) for x in shards for _, known, found, good in x.audits if good]
    return [np.append(c, np.array([r[k] for r in rows], dtype=np.int64)) for k, c in enumerate(columns)]


def _inner(t: pa.Table, s: Settings, keep_graph: bool) -> pa.Table:
    """Links within one shard: for each node how many vectors it links to and its group's smallest node;
    with keep_graph one more row that holds the shard for the other shards' queries."""
    order = np.argsort(t["node"].to_numpy(), kind="stable")
    nodes, copies, x = t["node"].to_numpy()[order], t["copies"].to_numpy()[order], scaled(matrix(t["embedding"]))[order]
    shard = Shard(x)
    least = np.arange(len(x))
    i, j, dense = shard.links(x, s, own=True)
    full = np.zeros(len(x), dtype=bool)
    full[dense] = True
    counts, extra = np.zeros(len(x), dtype=np.int64), [np.stack([i, j]), np.stack([j, i])]
    for a, b in shard.dense(x[dense], shard.norms[dense], s):
        a = dense[a]
        other = a != b
        np.add.at(counts, a[other], copies[b[other]])
        _unite(least, a, b)
        extra.append(np.stack([b[~full[b]], a[~full[b]]]))
    pairs = np.concatenate(extra, axis=1).astype(np.int64)
    pairs = pairs[:, (pairs[0] != pairs[1]) & ~full[pairs[0]]]  # those compared densely are counted already
    pairs = np.unique(pairs[0] * len(x) + pairs[1])
    np.add.at(counts, pairs // len(x), copies[pairs % len(x)])
    _unite(least, pairs // len(x), pairs % len(x))
    columns = _reported([nodes, counts, nodes[least]], shard)
    blobs = [None] * len(columns[0])
    if keep_graph:
        columns = [np.append(c, -1) for c in columns]
        out = io.BytesIO()
        np.savez(out, nodes=nodes, copies=copies, least=nodes[least], **shard.dump())
        blobs.append(out.getvalue())
    return pa.table([*(pa.array(c, pa.int64()) for c in columns), pa.array(blobs, pa.binary())], names=[*REPORT, "shard_data"])


def _across(pair: pa.Table, s: Settings) -> pa.Table:
    """Links between two shards, found from either side: how many vectors each node links to, and for the
    first shard's nodes one row for each group of the second that they reach."""
    sides, loaded = [], []
    if pair.num_rows < 2:  # no vector fell to the other shard
        return pa.table([pa.array([], pa.int64())] * 3, names=[*REPORT])
    for blob in pair["shard_data"]:
        with np.load(io.BytesIO(blob.as_py()), allow_pickle=False) as z:
            loaded.append((z["nodes"], z["copies"], z["least"]))
            sides.append(Shard.load(z))
    (nodes, copies, _), (nodes2, copies2, least2) = loaded
    width, counts, counts2 = len(nodes2), np.zeros(len(nodes), dtype=np.int64), np.zeros(len(nodes2), dtype=np.int64)
    a, b, dense = sides[1].links(sides[0].x, s)
    b2, a2, dense2 = sides[0].links(sides[1].x, s)
    full, full2 = np.zeros(len(nodes), dtype=bool), np.zeros(width, dtype=bool)
    full[dense], full2[dense2] = True, True
    pairs, reached = [a * width + b, a2 * width + b2], []
    for i, j in sides[1].dense(sides[0].x[dense], sides[0].norms[dense], s):
        i = dense[i]
        np.add.at(counts, i, copies2[j])
        reached.append(np.unique(np.stack([i, least2[j]]), axis=1))
        pairs.append((i * width + j)[~full2[j]])
    for j, i in sides[0].dense(sides[1].x[dense2], sides[1].norms[dense2], s):
        j = dense2[j]
        np.add.at(counts2, j, copies[i])
        reached.append(np.unique(np.stack([i, least2[j]]), axis=1))
        pairs.append((i * width + j)[~full[i]])
    i, j = np.divmod(np.unique(np.concatenate(pairs)), width)
    np.add.at(counts, i[~full[i]], copies2[j[~full[i]]])  # those compared densely are counted already
    np.add.at(counts2, j[~full2[j]], copies[i[~full2[j]]])
    groups = np.unique(np.concatenate([*reached, np.stack([i, least2[j]])], axis=1), axis=1)
    first = np.append(True, groups[0][1:] != groups[0][:-1]) if groups.shape[1] else np.zeros(0, bool)
    linked = counts2 > 0
    rows = [np.append(nodes[groups[0]], nodes2[linked]), np.append(np.where(first, counts[groups[0]], 0), counts2[linked]), np.append(groups[1], nodes2[linked])]
    return pa.table([pa.array(c, pa.int64()) for c in _reported(rows, *sides)], names=[*REPORT])


def link_vectors(vectors: DataFrame, s: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """What near_duplicates returns, and the audits behind it: one row for each beam accepted for a shard or for two
    shards, with the links that the audit knew and those of them that the beam found."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    rows = rows.withColumn("usable", usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    distinct = (rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
                .withColumns({"dim": F.size("embedding"), "node": F.monotonically_increasing_id()}))
    distinct = materialize(distinct, "vectors")
    sizes = distinct.groupBy("label", "dim").agg(F.count("*").alias("n"))
    nodes = (distinct.join(sizes.select("label", "dim", parts("n", s.shard).alias("shards")), ["label", "dim"])
             .withColumn("shard", part_of(F.col("node"), F.col("shards"))))

    def inner(key: tuple, t: pa.Table) -> pa.Table:
        out = _inner(t, s, t["shards"][0].as_py() > 1)
        return pa.table([*out.columns, *(pa.array([k.as_py()] * out.num_rows, k.type) for k in key)], names=[*out.column_names, "label", "dim", "shard"])

    kind = dict(rows.dtypes)["label"]
    within = materialize(nodes.groupBy("label", "dim", "shard").applyInArrow(
        inner, f"node long, links long, peer long, shard_data binary, label {kind}, dim int, shard int"), "within")

    many = nodes.where("shards > 1").select("label", "dim", "shards").distinct()
    one_side = within.where("node = -1").select("label", "dim", "shard", "shard_data").join(many, ["label", "dim"])
    keys = ["label", "dim", "low", "high"]
    both_sides = (one_side.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where("other <> shard")
                  .select("label", "dim", F.least("shard", "other").alias("low"), F.greatest("shard", "other").alias("high"), "shard_data"))

    across = materialize(both_sides.groupBy(*keys).applyInArrow(lambda t: _across(t, s), "node long, links long, peer long"), "across")

    every = within.select("node", "links", "peer").unionByName(across)
    audits, found = every.where(F.col("node") == AUDIT).select(F.col("links").alias("known"), F.col("peer").alias("found")), every.where("node >= 0")
    joined = components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = (distinct.join(counted, "node").join(joined.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left")
             .withColumn("component", F.coalesce("component", "node")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    per_vector = materialize(named.join(least, "component").select("label", "embedding", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"), "named")
    linked = rows.where("usable").join(per_vector, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), audits


def near_duplicates(vectors: DataFrame, s: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Vectors link if their labels are equal and not null and their cosine, in double precision, reaches the
    threshold. n_links counts the other vectors linked directly, component_id is the smallest id reachable
    over links, kept marks the vector with that id. Equal vectors of a label are one node with a count.

    Nodes of a label are spread over shards of bounded size. Each shard builds a graph; its own vectors
    search it, and those of the label's other shards: one task for each two shards searches both ways and
    unites the links before it counts them. Every hit is verified in double precision; audits against brute
    force widen the beams, and crowded queries, or all if every audit fails, are compared with their whole
    shard. Tasks return counts and one row for each group reached, never all pairs of a group.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label
    or id, link with nothing (0 links, their own component). Vectors of different length don't link. Rows
    that share an id are vectors of their own. Other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    return link_vectors(vectors, s, id_col, vector_col, label_col)[0]


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.vec_id = l.a),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT r.vec_id, coalesce(any_value(k.n_links), 0)::BIGINT AS n_links, min(r.c) AS component_id, r.vec_id = min(r.c) AS kept
FROM r LEFT JOIN k ON r.vec_id = k.a GROUP BY r.vec_id
"""
