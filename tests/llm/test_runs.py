"""Runs against all starts and periods; collapsed texts and digests against the contract read plainly."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from beaconlake.llm import runs

SF = "/root/testdata/sf0.001"


def brute(w, least=6, times=4):
    """Every maximal stretch of each period; a stretch counts under its smallest period only."""
    n, found, best = len(w), [], {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q) and not any(a <= i and i + length <= a + m for a, m in best.items()):
                found.append((i, length, q))
            i = j
        best |= {a: max(m, best.get(a, 0)) for a, m, p in found if p == q}
    return sorted(found, key=lambda r: (r[0], r[2]))


def smallest(w, i, m):
    return next(p for p in range(1, m + 1) if all(w[x] == w[x + p] for x in range(i, i + m - p)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9)), max_size=7), st.integers(0, 3))
def test_runs_equal_brute_force(parts, cut):
    w = [x for root, times in parts for x in (root * times)[:max(1, len(root) * times - cut)]]
    got = runs.periodic_runs(np.array(w, np.int64)).tolist()
    assert [tuple(r) for r in got] == brute(w)
    assert all(smallest(w, s, m) == q for s, m, q in got)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=80))
def test_three_periods_too(w):
    assert [tuple(r) for r in runs.periodic_runs(np.array(w, np.int64), 3, 3).tolist()] == brute(w, 3, 3)


def test_range_successor():
    rng = np.random.default_rng(2)
    for n in (1, 2, 63, 64, 65, 128, 1000):
        numbers = rng.permutation(n)
        tree = runs.WaveletTree(numbers)
        low = rng.integers(0, n, 400)
        high = np.minimum(n, low + rng.integers(1, n + 1, 400))
        least = rng.integers(0, n + 1, 400)
        least = np.minimum(least, n - 1)
        want = [min((x for x in numbers[a:b] if x >= m), default=-1) for a, b, m in zip(low, high, least, strict=True)]
        assert tree.successor(low, high, least).tolist() == want


def plain(text, doc_id):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, original = g % n, list(words)
        p = 1 + (n - a) // (3 + g % 8)
        words = [x if i < a else original[a + (i - a) % p] for i, x in enumerate(words)]
    found = brute(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(words) if i not in gone)))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def digests(df):
    return sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in df.collect()), key=repr)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "one", "a a a a a", "a a a a a a", "x y x y x y x y", "x y x y x y x", "é ü é ü é ü é ü é", "b " * 3000, "end end end end end end"]
    texts += [" ".join(rng.choices("abc", k=rng.randint(0, 40))) for _ in range(300)]
    rows = [(i if i % 11 else None, t, 1, "r") for i, t in enumerate(texts)] + [(5, "q q q q q q q", 1, "r")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, runs string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert digests(runs.op13_runs(spark, str(tmp_path))) == sorted(((i, *plain(t, i)) for i, t, *_ in rows), key=repr)
    assert runs.find_runs(df.limit(0)).collect() == []
    assert {r.collapsed for r in runs.find_runs(df.where("length(text) = 6000 OR text LIKE 'end%' OR text LIKE 'q%'")).collect()} == {"b", "end", "q"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 12000]
    got = {r[0]: r[1:] for r in digests(runs.op13_runs(spark, SF))}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(got[i] == plain(t, i) for i, t in docs) and len(docs) > 100


def test_long_texts():
    rng = np.random.default_rng(4)
    w = rng.integers(0, 50000, 300000)
    w[1000:91000] = np.tile(rng.integers(0, 50000, 9000), 10)
    w[200000:260000] = 7
    got = runs.periodic_runs(w).tolist()
    assert {(1000, 90000, 9000), (200000, 60000, 1)} <= set(map(tuple, got))
