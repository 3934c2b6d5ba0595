"""SimHash groups against brute force."""

import random

from beaconlake.llm import simhash
from beaconlake.llm.components import components
from tests.llm import plain


def test_fingerprints():
    for t in (None, "", " \t ", "One", "one two", "A b\x0bc d É é", "x " * 500, "a b c d e"):
        assert simhash.fingerprint(t) == plain.fingerprint(t)


def groups_of(spark, fps):
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long").distinct()
    got = {r.node: r.component for r in components(simhash.links(df)).collect()}
    pairs = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2]
    want = plain.groups(signed, pairs)
    assert {f: got.get(f, f) for f in signed} == want


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4]))) for s in seeds for _ in range(8)} | {0, 3, 12, 2**64 - 1}
    groups_of(spark, fps)


def test_crowded_buckets_equal_brute_force(spark):
    rng = random.Random(6)
    s = rng.getrandbits(64)
    fps = {s ^ (sum(1 << b for b in rng.sample(range(30, 64), rng.choice([1, 2, 3, 5, 8])))) for _ in range(300)}
    groups_of(spark, fps)


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100)]
    hub = [(500, i) for i in range(400, 600)]
    odd = [(None, 7), (9, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + hub + odd, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 400 for i in range(400, 600)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rows(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text, "x"), (3, text + " ", "x"), (9, None, "x"), (2, "", "x"), (2, "", "x"), (7, "lonely text here", "x"), (None, text, "x")]
    out = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in out) == sorted([("5", 3), ("3", 3), ("9", 2), ("2", 2), ("2", 2), ("7", 7), ("None", 3)])
    assert {r.fingerprint for r in out if r.doc_id == 9} == {"0" * 16}
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_representatives_of_rows_that_share_ids(spark):
    """Same id and text, same id and another text, no id at all: each group keeps one row with its columns."""
    a, b, c = (" ".join(f"{p}{i}" for i in range(300)) for p in "abc")
    rows = [(1, a, "x"), (1, a, "y"), (1, a, "x"), (1, b, "x"), (2, b, "x"), (None, c, "q"), (None, c, "p"), (4, None, "x"), (5, "", "x"), (6, a + " ", "x")]
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "doc_id long, text string, lang string, fp int, text_key int, `group` string").repartition(5)
    out = simhash.representatives(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "", r.lang) for r in out.collect()) == sorted([("1", a, "x"), ("1", b, "x"), ("None", c, "p"), ("4", "", "x")])
    assert simhash.representatives(df.limit(0)).collect() == []


def test_representatives_without_a_broadcast(spark):
    """Beyond the broadcast threshold the table of what falls out is joined by a shuffle, to the same effect."""
    texts = [" ".join(f"{p}{i}" for i in range(200)) for p in "abcdef"]
    df = spark.createDataFrame([(i, texts[i % 6] if i % 5 else f"only {i} here") for i in range(90)], "doc_id long, text string")
    want = sorted(r.doc_id for r in simhash.representatives(df).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(r.doc_id for r in simhash.representatives(df).collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
