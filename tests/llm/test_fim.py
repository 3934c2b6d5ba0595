"""Cuts by the skip list against plain sums; outputs rebuilt exactly."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconlake.llm import fim


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 17, 64, 1000, 20011])
def test_every_rank_is_reached(n):
    widths = np.random.default_rng(n).integers(1, 90, n)
    lanes = fim.SkipList(widths)
    sums = [0, *np.cumsum(widths).tolist()]
    ranks = range(n + 1) if n < 2000 else random.Random(1).sample(range(n + 1), 2000)
    assert all(lanes.chars_before(r) == sums[r] for r in ranks)
    assert n < 1000 or len(lanes.lanes) >= 4


def plain(text, doc_id):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_odd_rows(spark):
    rng = random.Random(5)
    texts = [None, "", "\n", "\n\n", "a", "a\n", "x<S>y\nz", "<", "<P\n>\nS>", "é\nüß\r\n日本 z\n", "word " * 30000, "l\n" * 50000]
    texts += ["".join(rng.choice("ab <>PSM\né") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    rows = [(i if i % 9 else None, t, "n", 1) for i, t in enumerate(texts)] + [(4, "same\nrow\n", "n", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, output int")
    made = fim.fill_in_middle(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made), key=key) == sorted(((i, *plain(t, i), t or "") for i, t, *_ in rows), key=key)
    assert {r.form for r in made} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(df.limit(0)).collect() == []


def test_shares_of_forms(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc").alias("text"))
    n = {r.form: r["count"] for r in fim.fill_in_middle(df, fim.Fim(seed=1, rate=40, spm=25)).groupBy("form").count().collect()}
    assert abs(n["plain"] - 2400) < 150 and abs(n["spm"] - 400) < 90 and n["psm"] > 1000


def test_long_texts_take_little_time():
    start = time.time()
    assert fim.transform("some words of a line\n" * 400000, 1, fim.Fim())[0] == 400000
    assert time.time() - start < 5
