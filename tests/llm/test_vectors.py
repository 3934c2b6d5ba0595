"""The vector operators against brute force."""

import inspect
import io

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from beaconlake.llm import ann, embed_dedup
from beaconlake.llm.embed_dedup import Settings, near_duplicates
from beaconlake.llm.hnsw import Hnsw

ODD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [None] + [1.0] * 15, 1),
       (9005, [float("inf")] + [1.0] * 15, 1), (9006, [1.0] * 16, None), (None, [1.0] * 16, 1), (9007, [], 1), (9008, [1.0, 2.0], 1)]
SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(n, dim=16, seed=1, spread=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 12), dim))
    x = centres[rng.integers(0, len(centres), n)] + spread * rng.standard_normal((n, dim))
    x[n // 2:n // 2 + n // 10] = x[0]  # copies
    return x.astype(np.float32)


def rows_of(x, labels):
    return [(i, [float(c) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, labels, strict=True))]


def brute(x, labels, threshold=0.93):
    u = x.astype(np.float64)
    u = (u @ u.T) / np.outer(np.linalg.norm(u, axis=1), np.linalg.norm(u, axis=1))
    link = (u >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    least = np.arange(len(x))
    while True:
        new = np.minimum(least, np.where(link, least[None, :], len(x)).min(axis=1))
        if np.array_equal(new, least):
            return link.sum(axis=1), least
        least = new


@pytest.mark.parametrize("shard, block", [(16384, 16384), (60, 40)])
def test_near_duplicates_equal_brute_force(spark, shard, block):
    x = clustered(400)
    labels = np.arange(400) % 3
    labels[:240] = 0
    counts, least = brute(x, labels)
    df = spark.createDataFrame(rows_of(x, labels) + ODD, SCHEMA)
    got = {r.vec_id: r for r in near_duplicates(df, Settings(shard=shard, block=block, beams=(16, 32))).collect()}
    assert [got[i].n_links for i in range(400)] == counts.tolist()
    assert [got[i].component_id for i in range(400)] == least.tolist()
    assert [got[i].kept for i in range(400)] == (least == np.arange(400)).tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in [*range(9001, 9009)])
    assert got[None].n_links == 0 and got[None].component_id is None and not got[None].kept


def test_very_small_and_large_components(spark):
    x = np.random.default_rng(3).standard_normal((200, 16))
    y = np.concatenate([x, x * 1e-200, x[:50] * 1e200])
    same = embed_dedup.scaled(x)
    assert np.array_equal(embed_dedup.scaled(x * 2.0**-700), same) and np.array_equal(embed_dedup.scaled(x * 2.0**900), same)
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(y)], "vec_id long, embedding array<double>, label string")
    for r in embed_dedup.near_duplicates(df).collect():
        first = r.vec_id % 200
        assert (r.n_links, r.component_id, r.kept) == (1 + (first < 50), first, r.vec_id == first)


def test_crowded_group(spark):
    x = clustered(300, spread=0.02)
    x[:200] = x[0] + 0.01 * np.random.default_rng(2).standard_normal((200, 16)).astype(np.float32)
    counts, least = brute(x, np.zeros(300))
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows_of(x, np.zeros(300)), SCHEMA), Settings(beams=(16, 32))).collect()}
    assert [got[i].n_links for i in range(300)] == counts.tolist()
    assert [got[i].component_id for i in range(300)] == least.tolist()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).collect() == []
    assert ann.nearest(empty, F.col("vec_id") % 20 == 0).collect() == []


def test_graph_survives_its_copy():
    shard = embed_dedup.Shard(clustered(700).astype(np.float64))
    u = shard.unit
    ids, sims = shard.graph.search(u[:50], 32)
    out = io.BytesIO()
    np.savez(out, **shard.dump())
    again = embed_dedup.Shard.load(np.load(io.BytesIO(out.getvalue()))).graph.search(u[:50], 32)
    assert np.array_equal(ids, again[0]) and np.array_equal(sims, again[1])
    truth = np.argsort(-(u[:50] @ u.T), axis=1)[:, :10]
    sim = np.take_along_axis(u[:50] @ u.T, truth, 1)
    assert (sims[:, :10] >= sim - 1e-5).mean() > 0.97


@pytest.mark.parametrize("shard, block", [(16384, 4096), (100, 7)])
def test_nearest_recall(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ann, "SHARD", shard)
    monkeypatch.setattr(ann, "BLOCK", block)
    x = clustered(600, spread=0.6)
    df = spark.createDataFrame(rows_of(x, np.zeros(600)) + ODD[:5], SCHEMA)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    u = x.astype(np.float64)
    hits = 0
    for q in range(0, 600, 20):
        s = u @ u[q]
        want = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += len({r.vec_id for r in mine} & set(want))
    assert hits >= 0.99 * 20 * 30


def test_norms_of_any_size(spark):
    """Vectors from 1e-170 to 1e200 among others, queries too: all of brute force, on one shard and on many."""
    x = clustered(400, spread=0.6).astype(np.float64)
    x[20] *= 1e200
    x[40] *= 1e-170
    x[61] *= 1e200
    x[62] *= 1e-170
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    for q in range(0, 400, 20):
        s = ann.products(x, x[q])
        s[q] = -np.inf
        want = np.lexsort((np.arange(400), -s, ~np.isnan(s)))[:20].tolist()  # no value is the largest, as in SQL
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_bars_lose_nothing(spark, monkeypatch):
    """Over 16 shards, four of them searched first: what the others send is little, and the result is brute force's."""
    monkeypatch.setattr(ann, "SHARD", 250)
    x = np.random.default_rng(5).standard_normal((4000, 24))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = ann.nearest(df, F.col("vec_id") % 500 == 0).collect()
    hits = 0
    for q in range(0, 4000, 500):
        s = ann.products(x, x[q])
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(4000), -s))[:20].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 160 and hits >= 158


def test_estimates_from_packed_bits():
    """Estimates are right in the mean, nearly all within their bound, and few vectors of a shard are reranked."""
    x = np.random.default_rng(6).standard_normal((16384, 64)) * 10.0 ** np.random.default_rng(7).integers(-3, 3, 16384)[:, None]
    words, norms, powers, align = ann.encode(x)
    assert words.shape == (16384, 1) and words.dtype == np.uint64
    codes = ann.Codes(x, words, norms, powers, align)
    hits = 0
    for q in range(20):
        unit = np.ldexp(x[q], -powers[q])
        e, off = codes.estimates(unit @ ann.rotation(64))
        true = (np.ldexp(x, -powers[:, None]) @ unit) * np.ldexp(1.0, powers - codes.most)
        others = np.arange(16384) != q
        assert (np.abs(e - true) <= off)[others].mean() > 0.99
        found, at, score = ann.search_block(np.arange(16384), np.arange(16384), x, codes, np.array([q]), x[q:q + 1], 20)
        s = ann.products(x, x[q])
        s[q] = -np.inf
        assert (score == s[at]).all() and q not in at
        hits += len(set(at.tolist()) & set(np.lexsort((np.arange(16384), -s))[:20].tolist()))
    assert hits >= 0.99 * 400


def test_more_neighbours_than_are_reranked_first(spark):
    x = clustered(600, spread=0.6)
    got, hits = ann.nearest(spark.createDataFrame(rows_of(x, np.zeros(600)), SCHEMA), F.col("vec_id") % 100 == 0, k=100).collect(), 0
    for q in range(0, 600, 100):
        mine = [r.vec_id for r in got if r.query_id == q]
        assert len(mine) == len(set(mine)) == 100 and q not in mine
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        hits += len(set(mine) & set([i for i in np.argsort(-s) if i != q][:100]))
    assert hits >= 0.99 * 600


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [2.0, 1.0], 1), (2, [2.0, 5.0], 1), (2, [2.0, 5.0], 1), (20, [1.0, 2.0, 3.0], 1)], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 2, 2.0)]


def test_rows_that_share_an_id_or_have_none(spark):
    rows = [(0, [1.0, 0.0]), (0, [3.0, 0.0]), (7, [2.0, 0.0]), (7, [5.0, 0.0]), (None, [5.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], "vec_id long, embedding array<double>, code string, row int, dim string, shard int")
    got = sorted((r.score, r.vec_id if r.vec_id is not None else -1, r["rank"]) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect() if r.query_id == 0)
    assert got == sorted([(5.0, 7, 1), (5.0, -1, 2), (3.0, 0, 3), (2.0, 7, 4), (15.0, 7, 1), (15.0, -1, 2), (6.0, 7, 3), (3.0, 0, 4)])


def test_clashing_columns_of_links(spark):
    x = clustered(60)
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows_of(x, np.zeros(60))], SCHEMA + ", node int, dim string, links int, copies int")
    counts, least = brute(x, np.zeros(60))
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    assert [got[i].n_links for i in range(60)] == counts.tolist() and [got[i].component_id for i in range(60)] == least.tolist()


class Blind:
    """A graph whose search finds each of its own vectors and no link."""

    def __init__(self, u):
        self.u = u

    def search(self, unit, beam):
        sims = unit @ self.u.T
        ids = np.full((len(unit), beam), -1)
        own = sims.max(axis=1) > 1 - 1e-6
        ids[own, 0] = sims.argmax(axis=1)[own]
        return ids, np.where(ids >= 0, 1.0, -1.0)


def blind_shard(x):
    return embed_dedup.Shard(x, Blind((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)))


@pytest.mark.parametrize("own", [False, True])
def test_rare_links_are_not_left_to_an_unchecked_beam(own):
    """Too few links for an audit; hits of vectors on themselves are none."""
    x = np.random.default_rng(3).standard_normal((500, 16))
    x[111] = x[17] * 1.5
    q = x if own else np.random.default_rng(4).standard_normal((500, 16))
    q[222] = x[333] * 2 + 0.3
    want = {(a, b) for a, b in zip(*np.nonzero((q @ x.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)) >= 0.93), strict=True) if not own or a != b}
    shard, s = blind_shard(x), Settings()
    args = (q, s, True) if own and "own" in inspect.signature(shard.links).parameters else (q, s)
    i, j, dense = shard.links(*args)
    found = {(a, b) for a, b in zip(i, j, strict=True) if not own or a != b}
    assert (222, 333) in want and all(p in found or p[0] in dense for p in want)


def test_audited_links_are_kept():
    """With every link audited nothing is left for the graph or the dense comparison."""
    x = clustered(200).astype(np.float64)
    i, j, dense = blind_shard(x).links(x, Settings(audit=200), own=True)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.93
    np.fill_diagonal(link, False)
    assert not len(dense) and set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero(link)), strict=True))


def test_links_found_from_one_side_count_on_both(monkeypatch):
    """The first shard's search of the second finds nothing; what the second finds in the first counts for both."""
    x, y = clustered(40, seed=5).astype(np.float64), clustered(40, seed=5).astype(np.float64) * 1.5
    u = (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) >= 0.93
    blobs = []
    for v, at in ((x, 0), (y, 100)):
        t = pa.table({"node": np.arange(at, at + 40), "copies": np.ones(40, np.int64), "embedding": v.tolist()})
        blobs.append(embed_dedup._inner(t, Settings(), True)["shard_data"][-1].as_py())
    nothing = np.zeros(0, np.int64)

    def links(self, q, s, own=False):
        return (*np.nonzero(u.T), nothing) if q[0, 0] == embed_dedup.scaled(y)[0, 0] else (nothing, nothing, nothing)

    monkeypatch.setattr(embed_dedup.Shard, "links", links)
    out = embed_dedup._across(pa.table({"shard_data": blobs}), Settings()).to_pandas().groupby("node")["links"].sum()
    assert [out.get(k, 0) for k in range(40)] == u.sum(axis=1).tolist()
    assert [out.get(100 + k, 0) for k in range(40)] == u.sum(axis=0).tolist()


def test_beams_that_pass_their_audit_find_all_links(monkeypatch):
    x = clustered(900, spread=0.1).astype(np.float64)
    searched = []
    search = Hnsw.search
    monkeypatch.setattr(Hnsw, "search", lambda self, q, beam: searched.append(beam) or search(self, q, beam))
    t = pa.table({"node": np.arange(900), "copies": np.ones(900, np.int64), "embedding": x.tolist()})
    out = embed_dedup._inner(t, Settings(beams=(64, 128), audit_links=300), False)
    counts, least = brute(x, np.zeros(900))
    assert searched and out["links"].to_pylist()[:900] == counts.tolist() and out["peer"].to_pylist()[:900] == least.tolist()


def test_audits_need_no_links_to_catch_a_blind_graph():
    """Without a single true link the probes are the evidence: every beam is refused, all is compared densely."""
    x = np.random.default_rng(3).standard_normal((500, 16))
    q = np.random.default_rng(4).standard_normal((4096, 16))
    shard = blind_shard(x)
    i, j, dense = shard.links(q, Settings())
    assert all(known >= 512 and not good for _, known, _, good in shard.audits) and len(shard.audits) == 4
    assert len(dense) >= 4096 - 64


def test_small_shards_are_searched_through_their_graph(spark, monkeypatch):
    x = clustered(40).astype(np.float64)
    searched = []
    search = Hnsw.search
    monkeypatch.setattr(Hnsw, "search", lambda self, q, beam: searched.append((len(q), beam)) or search(self, q, beam))
    t = pa.table({"node": np.arange(40), "copies": np.ones(40, np.int64), "embedding": x.tolist()})
    out = embed_dedup._inner(t, Settings(audit=0), False)
    counts, least = brute(x, np.zeros(40))
    assert out["links"].to_pylist()[:40] == counts.tolist() and out["peer"].to_pylist()[:40] == least.tolist()
    assert searched and searched[0][0] >= 40 and searched[0][1] == 40


@pytest.mark.parametrize("n", [1, 2, 3])
def test_tiny_shards(n):
    x = np.random.default_rng(1).standard_normal((n, 16))
    t = pa.table({"node": np.arange(n), "copies": np.full(n, 3), "embedding": x.tolist()})
    assert embed_dedup._inner(t, Settings(), False)["links"].to_pylist()[:n] == [0] * n


def test_audits_are_reported(spark):
    x = clustered(400)
    df = spark.createDataFrame(rows_of(x, np.arange(400) % 2), SCHEMA)
    _, audits = embed_dedup.link_vectors(df, Settings(shard=120))
    log = audits.collect()
    assert len(log) >= 4 and all(r.known >= 512 and r.found >= 0.99 * r.known for r in log)
