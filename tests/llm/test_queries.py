"""The operators' queries against their SQL, and over whole tables against the contracts read plainly."""

import os
import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

from beaconlake.llm import registry, secrets
from beaconlake.llm.tokens import encoder, text_ids, tokenizer_path
from tests.llm import plain
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def rows_of(spark, name, docs):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    return rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, name):
    same(registry.QUERIES[name](spark, SF), connect(SF), registry.ORACLES[name])


def test_op3_whole_table(spark, docs, library):
    plain.packed(registry.QUERIES["op3_packing"](spark, SF).collect(), lambda t: library.encode(t, add_special_tokens=False).ids, list(docs.items()))


def test_op4_whole_table(spark, docs):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in rows_of(spark, "op4_toxicity", docs):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if not r.held_out and labels.get(r.doc_id) == 0:
            assert not r.predicted


def test_op6_whole_table(spark, docs, library):
    for r in rows_of(spark, "op6_token_counts", docs):
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)


@pytest.mark.parametrize("name, find, kinds", [("op7_secret_scan", plain.secrets, ("assign", "access", "hex")), ("op9_pii", plain.pii, ("email", "ip", "card", "phone"))])
def test_spans_whole_table(spark, docs, name, find, kinds):
    for r in rows_of(spark, name, docs):
        base = find(docs[r.doc_id])
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in base) for k in kinds]
        assert r.base_sha256 == plain.digest(base, kinds)
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert not set(base) - set(spans) and len(set(spans)) == len(spans) and [s[1] for s in spans] == sorted(s[1] for s in spans)
        more = set(spans) - set(base)
        assert all(s[0] not in kinds for s in more)
        if name == "op7_secret_scan":
            assert all(not any(a <= s and e <= b for _, a, b in base) for _, s, e in more)
            assert more == plain.uncovered(plain.sensitive_literals(secrets.assignments(docs[r.doc_id]), secrets.name_score), base)


def test_op8_whole_table(spark, docs):
    fps = {d: plain.fingerprint(t) for d, t in docs.items()}
    least = plain.groups(set(fps.values()), plain.near(fps.values()))
    first = {}
    for d, f in fps.items():
        first[least[f]] = min(d, first.get(least[f], d))
    for r in rows_of(spark, "op8_simhash", docs):
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", first[least[fps[r.doc_id]]])


def test_ids_equal_the_library_on_all_documents(spark, library):
    """Every document of a larger table: the ids that packing takes are those of tokenizers."""
    sf = SF.replace("0.001", "0.01")
    enc, odd = encoder(tokenizer_path()), 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        odd += text_ids(enc, r.text or "").tolist() != library.encode(r.text or "", add_special_tokens=False).ids
    assert odd == 0


def test_links_equal_brute_force_on_a_larger_table(spark):
    """Over the sf0.1 vectors every link is found: recall 1 against all pairs of a label."""
    import numpy as np

    sf = SF.replace("0.001", "0.1")
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    want = {}
    for _, g in t.groupby("label"):
        x = np.array(g.embedding.tolist(), dtype=np.float64)
        u = x / np.linalg.norm(x, axis=1)[:, None]
        link = u @ u.T >= 0.93
        np.fill_diagonal(link, False)
        want |= dict(zip(g.vec_id, link.sum(axis=1).tolist(), strict=True))
    got = {r.vec_id: r.n_links for r in registry.QUERIES["op2_embedding_dedup"](spark, sf).collect()}
    assert Counter(got) == Counter(want)
