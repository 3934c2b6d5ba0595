"""The pipeline's stages, each on what the one before kept, against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from beaconlake.llm import mixing, secrets, simhash, toxicity
from beaconlake.llm.packing import cut_lengths, pack, tail_lengths
from beaconlake.llm.tokens import balanced, count_tokens, encoder, parts_of, text_ids, tokenizer_path
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvw", k=rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        body = rng.choices(words, k=rng.randint(20, 400))
        toxic = i % 7 == 0
        if toxic:
            body[::10] = ["grumbletosh"] * len(body[::10])
        if i % 50 == 3:
            body[5:5] = ["token", "=", '"24be64439e3e49cf46b2d7c90f3602a3d0b907ff"']
        rows.append((i, " ".join(body), "en", f"s{min(4, i % 9)}", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[10][1], "en", "s1", 0) for i in range(30)]  # copies
    rows += [(2000 + i, rows[20][1] + f" tail{i}", "en", "s1", 0) for i in range(10)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "s2", 0), (None, "all alone in here now", "en", "s2", 21), (11, rows[11][1], "en", "s2", 0), (3002, "word " * 30000, "en", "s3", 0)]
    rows = [(a, t, la, s, len(t) if t is not None else None) for a, t, la, s, _ in rows]
    root = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), rows


def n_words(text):
    return len((text or "").encode().split())


def test_stages(spark, corpus):
    root, rows = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    toxic_ids = {i for i in range(600) if i % 7 == 0}

    clean = corpus_pipeline.toxicity(spark, docs, root)
    kept = clean.collect()
    assert clean.columns == list(corpus_pipeline.COLUMNS)
    gone = Counter(rows) - Counter(map(tuple, kept))
    assert not Counter(map(tuple, kept)) - Counter(rows)
    assert {r[0] for r in gone} <= toxic_ids and len(gone) >= 0.97 * len(toxic_ids)  # held out ones too, and no clean one

    single = corpus_pipeline.simhash_dedup(spark, clean, root)
    one = single.collect()
    groups = {}
    fps = {r.doc_id if r.doc_id is not None else "null": simhash.fingerprint(r.text) for r in kept}
    parent = {k: k for k in fps}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = list(fps)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                parent[find(a)] = find(b)
    for k in keys:
        groups.setdefault(find(k), []).append(k)
    want = sorted(str(min((k for k in g if k != "null"), default="null")) for g in groups.values())
    assert sorted(str(r.doc_id if r.doc_id is not None else "null") for r in one) == want

    masked = corpus_pipeline.secret_masking(spark, single, root).collect()
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in masked if r.text) == sorted(
        (str(r.doc_id), secrets.redact(r.text), len(secrets.redact(r.text))) for r in one if r.text)
    assert sum("[REDACTED]" in (r.text or "") for r in masked) > 5

    docs3 = spark.createDataFrame(masked, SCHEMA)
    mixed = corpus_pipeline.source_mixing(spark, docs3, root).collect()
    taken = {(r.doc_id, r.text): r.copies for r in mixing.mix_sources(docs3).join(docs3.select("doc_id", "text"), "doc_id").collect()}
    assert Counter((r.doc_id, r.text) for r in mixed) == {k: n for k, n in taken.items() if n} | {k: n for k, n in Counter((r.doc_id, r.text) for r in mixed).items() if k[0] is None}

    packed = corpus_pipeline.packing(spark, spark.createDataFrame(mixed, SCHEMA), root).collect()
    check_packing(packed, [(r.doc_id, r.text) for r in mixed])


def check_packing(pieces, docs):
    enc = encoder(tokenizer_path())
    plain.packed(pieces, lambda t: text_ids(enc, t).tolist(), docs)


def test_packing_of_odd_rows(spark):
    docs = [(1, None), (1, None), (None, "a b c"), (2, "word " * 40000), (3, "<|endoftext|> x"), (4, "日本語 ١٢٣ ß")]
    df = spark.createDataFrame([(*d, "x", 5) for d in docs], "doc_id long, text string, sequence_id string, start int")
    check_packing(pack(df).collect(), docs)
    assert pack(df.limit(0)).collect() == []
    assert all(sum(cut_lengths(n, 2048)) == n and sum(tail_lengths(n, 2048)) == n for n in range(0, 9000, 7))


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = [None, "", "a", " it's  <|endoftext|>\n\n x<|endoftext|>", "日本 ١٢٣ \x85 　a", "wörd été " * 20000, " " * 70000 + "x" * 3000, "tab\t\tx\r\n y\x1cz\xa0\xa0é"]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in count_tokens(df).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (len(ids), len((x or "").encode()), len(ids) > 1024)
        assert text_ids(encoder(tokenizer_path()), x or "").tolist() == ids
    assert count_tokens(df.limit(0)).collect() == []
    assert all("".join(parts_of(x or "", True, 50)) == (x or "") for x in texts)
    for rows, parts in balanced([x or "" for x in texts], True):
        assert sum(len(p.encode()) for p in parts[:-1]) < 1 << 18


def test_cuts_are_safe():
    """Short texts of characters that meet badly, cut wherever it is allowed, against the library."""
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(tokenizer_path()), random.Random(1)
    signs = [" ", "  ", "\n", "a", "b", "'s", "<|endoftext|>", "1", "é", "\x85", "\u3000", "日", "\x1c", "\xa0", ".", ",", "\t", "\u200b", "\u180e", "<|", "  a", "'", "ß", "\u2028", "Word"]
    for _ in range(4000):
        x = "".join(rng.choices(signs, k=rng.randint(0, 14)))
        cut = [i for p in parts_of(x, True, 2) for i in t.encode(p, add_special_tokens=False).ids]
        assert cut == t.encode(x, add_special_tokens=False).ids == text_ids(encoder(tokenizer_path()), x).tolist(), repr(x)


def test_words_lose_no_whole_document():
    """A short piece that waits for its bin holds its own ids only."""
    from beaconlake.llm.packing import Packer

    p = Packer(2048, 0, False)
    p.add(1, np.arange(500_000, dtype=np.uint32))
    assert all(x[2].base is None for bin_ in p.open.values() for x in bin_)


def test_piece_model_counts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["a b", None, "wörd été " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in count_tokens(df, tokenizer=path).collect()} == {i: len(m.encode(x or "")) for i, x in enumerate(texts)}


def test_mix_targets_and_reruns(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 50, 400])), f"s{rng.choice([0, 0, 0, 1, 2, 3])}") for i in range(3000)]
    rows += [(5000, None, None), (5001, "a b", None), (None, "a b c", "s1"), (7, "w w", "s2"), (7, "w w", "s2")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    out = mixing.mix_sources(df)
    got = out.collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(df.repartition(7)).collect()))
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    total = sum(r.size for r in got)
    targets = {r.source: (r.target, r.source_size) for r in got}
    assert abs(sum(t for t, _ in targets.values()) - total) < 1e-6 * total
    for source, (target, size) in targets.items():
        assert target <= 3 * size + 1e-9
        assert abs(sum(r.taken for r in got if r.source == source) - target) <= 400
    assert mixing.mix_sources(df.limit(0)).collect() == []


def test_rows_equal_in_id_and_text_split_where_the_budget_ends(spark):
    """Half of a source's words lie in rows that nothing tells apart; as many of them are taken as fit."""
    rows = [(None, "same words here again", "s0")] * 900 + [(i, "w " * (1 + i % 9), "s0") for i in range(600)] + [(5000 + i, "w " * 40, f"s{1 + i % 2}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mix_sources(df).collect()
    assert Counter(map(repr, got)) == Counter(map(repr, mixing.mix_sources(df.repartition(9)).collect()))
    for source in ("s0", "s1", "s2"):
        part = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 20.5
    assert len({r.taken for r in got if r.doc_id is None}) == 2  # the budget ends among them
    taken = Counter({(r.doc_id, r.source): 0 for r in got})
    for r in got:
        taken[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in mixing.repeat_documents(df.withColumn("lang", F.lit("en"))).collect()) == +taken


def test_toxicity_equals_plain_ftrl(spark):
    """Weights, calibration aside, and scores of the distributed operator against scalar FTRL."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40)) + ["Foulness, foul!"] * (i % 3 == 0)) for i in range(240)]
    df = spark.createDataFrame([(i, t, int(i % 3 == 0), 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, toxic int, score int, order_ string").repartition(3)
    p = toxicity.Ftrl(l1=1.0, epochs=3)
    order = [r.doc_id for r in df.where(~toxicity.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").collect()]
    rows = [(sorted(set(plain.toxic_features(texts[i]))), int(i % 3 == 0)) for i in order]
    w, b = plain.ftrl([x for i, x in enumerate(rows) if i % p.calibrate_every], p.alpha, p.beta, p.l1, p.l2, p.epochs)
    kept = rows[::p.calibrate_every]
    slope, shift = toxicity.calibrate(np.array([sum(w.get(i, 0.0) for i in x) + b for x, _ in kept]), np.array([y for _, y in kept]))
    places, values, got_b = toxicity.train(df, df.select("doc_id", "toxic"), p)
    assert set(places.tolist()) == set(w)
    assert all(abs(v - w[i] * slope) < 1e-6 for i, v in zip(places.tolist(), values.tolist(), strict=True)) and abs(got_b - (b * slope + shift)) < 1e-6
    for r in toxicity.toxicity(df, df.select("doc_id", "toxic"), p).collect():
        s = sum(w.get(i, 0.0) for i in set(plain.toxic_features(texts[r.doc_id]))) * slope + b * slope + shift
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(s, -35, 35)))) < 1e-6


def test_training_is_bounded_in_features(spark):
    df = spark.createDataFrame([(i, f"w{i} " * 5 + "foul" * (i % 2), i % 2) for i in range(200)], "doc_id long, text string, toxic int")
    places, _, _ = toxicity.train(df, df.select("doc_id", "toxic"), toxicity.Ftrl(l1=0.0, max_features=300))
    assert 0 < len(places) <= 300


def test_toxicity_held_out_and_odd_rows(spark, corpus):
    root, rows = corpus
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 7 == 0) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert all(r.predicted == 0 for r in none)
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
    odd = spark.createDataFrame([(5, None, "x"), (5, 1, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    assert len(toxicity.toxicity(docs, odd).collect()) == len(rows)


def test_run(spark, corpus):
    """The pipeline's rows against the stages read plainly, one after another, over the whole table."""
    root, rows = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    scores = Counter((r.doc_id, r.predicted) for r in toxicity.toxicity(docs, spark.read.parquet(f"{root}/labels.parquet")).collect())
    kept = [r for r in rows if not scores[r[0], 1] or scores[r[0], 0]]
    fps = [plain.fingerprint(r[1]) for r in kept]
    least, best = plain.groups(set(fps), plain.near(fps)), {}
    for r, f in zip(kept, fps, strict=True):
        order = (r[0] is None, r[0] or 0, r[1] or "", r[3] or "")
        if least[f] not in best or order < best[least[f]][0]:
            best[least[f]] = order, r
    single = [(r[0], secrets.redact(r[1]) if r[1] else r[1], *r[2:4], 0) for _, r in best.values()]
    taken = Counter()
    for r in mixing.mix_sources(spark.createDataFrame(single, SCHEMA)).collect():
        taken[r.doc_id] += r.copies
    mixed = [(r[0], r[1]) for r in single for _ in range(taken[r[0]])]
    check_packing(corpus_pipeline.run(spark, root).collect(), mixed)


def test_run_of_empty_tables_and_extra_columns(spark, corpus, tmp_path):
    root, rows = corpus
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    for n, more in ((0, {}), (40, {"row_": F.lit(1), "fp_": F.lit("x"), "score_": F.lit(None).cast("int"), "size": F.lit(2), "copies": F.lit(3), "group": F.lit("g")})):
        at = f"{tmp_path}/{n}"
        docs.orderBy("doc_id").limit(n).withColumns(more).write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        assert bool(corpus_pipeline.run(spark, at).collect()) == bool(n)


def test_training_reads_16000_labels(spark):
    """Only labels behind the first 10,000 by hash are toxic: a smaller sample sees one kind and has no weights."""
    known = spark.range(40000).selectExpr("id AS doc_id").where(~toxicity.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(16000).collect()
    toxic = {r.doc_id for r in known[10000:]}
    assert len(toxic) == 6000
    rows = [(r.doc_id, "foul words" if r.doc_id in toxic else "fair words", int(r.doc_id in toxic)) for r in known]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    places, _, _ = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert len(places)
