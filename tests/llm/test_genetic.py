"""Packing by the genetic algorithm: whole results, and fewer bins than best fit alone where there is room to gain."""

import os
import random
import zlib

import pytest
from tokenizers import Tokenizer

from beaconlake.llm import genetic
from beaconlake.llm.genetic import Bins, Genetic, evolve, pieces_of
from beaconlake.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"


def best_fit(lengths, capacity):
    b = Bins([], [])
    b.best_fit(sorted(range(len(lengths)), key=lambda i: -lengths[i]), lengths, capacity)
    return b


def check_bins(b, lengths, capacity):
    assert sorted(i for g in b.groups for i in g) == list(range(len(lengths)))
    assert [sum(lengths[i] for i in g) for g in b.groups] == b.fills and max(b.fills) <= capacity


def test_best_fit_takes_the_fullest_bin_with_room():
    for seed in range(20):
        rng = random.Random(seed)
        lengths = [rng.randint(1, 100) for _ in range(150)]
        got, fills = best_fit(lengths, 100), []
        for n in sorted(lengths, reverse=True):
            fits = [k for k, f in enumerate(fills) if f + n <= 100]
            if fits:
                fills[max(fits, key=fills.__getitem__)] += n
            else:
                fills.append(n)
        check_bins(got, lengths, 100)
        assert sorted(got.fills) == sorted(fills)


def triplets(n, capacity, rng):
    out = []
    for _ in range(n):
        a = rng.randint(capacity * 38 // 100, capacity * 49 // 100)
        b = rng.randint(capacity // 4, (capacity - a) * 11 // 20)
        out += [a, b, capacity - a - b]
    rng.shuffle(out)
    return out


def test_evolution_beats_best_fit():
    better = 0
    for seed in range(4):
        lengths = triplets(60, 2048, random.Random(seed))
        alone = len(best_fit(lengths, 2048).fills)
        got = evolve(lengths, [], 2048, Genetic(generations=60), seed)
        check_bins(got, lengths, 2048)
        assert 60 <= len(got.fills) <= alone
        better += len(got.fills) < alone
    assert better >= 3


def test_parents_bins_are_inherited_whole():
    rng = random.Random(3)
    lengths = [rng.randint(300, 900) for _ in range(200)]
    order = list(range(200))
    rng.shuffle(order)
    a, b = best_fit(lengths, 2048), Bins([], [])
    b.best_fit(order, lengths, 2048)
    child = genetic.crossover(a, b, lengths, 2048, Genetic(well=0.97), rng)
    check_bins(child, lengths, 2048)
    assert child.groups[0] in [g for g, f in zip(b.groups, b.fills, strict=True) if f >= 0.97 * 2048]


def test_migrants_are_never_lost():
    lengths = triplets(60, 2048, random.Random(9))
    elite = evolve(lengths, [], 2048, Genetic(generations=40), 1)
    bin_of = [0] * len(lengths)
    for k, g in enumerate(elite.groups):
        for i in g:
            bin_of[i] = k
    assert evolve(lengths, [bin_of], 2048, Genetic(generations=1), 2).worth() <= elite.worth()


def test_only_long_documents_are_cut():
    assert pieces_of(1, 8) == [(0, 1)] and pieces_of(8, 8) == [(0, 8)] and pieces_of(9, 8) == [(0, 1), (1, 8)] and pieces_of(24, 8) == [(0, 8), (8, 8), (16, 8)]


def check(rows, docs, capacity=2048):
    library = Tokenizer.from_file(tokenizer_path())
    ids, want, got, sequences = {}, {}, {}, {}
    for doc, text in docs:
        ids[doc, text] = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, (start, length) in enumerate(pieces_of(len(ids[doc, text]), capacity)):
            crc = zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[doc, text][start:start + length]))
            key = (doc, piece, start, length, crc)
            want[key] = want.get(key, 0) + 1
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    lengths = [r.length for r in rows]
    return len(sequences), -(-sum(lengths) // capacity), len(best_fit(lengths, capacity).fills)


def test_odd_rows(spark):
    docs = [(1, None), (1, None), (None, "a b c"), (None, "a b c"), (2, "word " * 40000), (3, "<|endoftext|> x"), (4, ""), (5, "日本語 ١٢٣ ß")]
    df = spark.createDataFrame([(*d, "x", 5, 1) for d in docs], "doc_id long, text string, sequence_id string, item int, length int")
    check(genetic.pack_best_fit(df).collect(), docs)
    assert genetic.pack_best_fit(df.limit(0)).collect() == []
    with_ids = genetic.pack_best_fit(df, with_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids)) == r.ids_crc32 for r in with_ids)


def test_many_shards_lose_little(spark):
    """Shards of 100 pieces each, then the loose bins of all of them once more: about as few as one best fit over all."""
    rng = random.Random(2)
    docs = [(i, " ".join(["word"] * rng.randint(1, 1500))) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3, "doc_id")
    used, least, alone = check(genetic.pack_best_fit(df, how=Genetic(shard=100)).collect(), docs)
    assert used <= least * 1.01 and used <= alone + 3


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = genetic.op12_genetic(spark, SF).collect()
    used, least, alone = check(rows, docs)
    assert used <= alone and used <= least + 1
    assert sorted(rows, key=repr) == sorted(genetic.op12_genetic(spark, SF).collect(), key=repr)  # reruns agree
