"""Long texts are encoded in parts: the ids stay the library's, and memory is bounded with blanks or without."""

import random
import subprocess
import sys

import pytest
from tokenizers import Tokenizer

from beaconlake.llm.packing import SMALLEST_CUT, cut_lengths
from beaconlake.llm.tokens import encoder, parts_of, text_ids, tokenizer_path

BITS = [*"abzАя日本あ가ß،。、，'sdlm 0159٣²½.,;:!?-_/\\()[]{}<>|@#$%&*+=~`\"\n\t\r\x0b\x0c\x1c\x85\xa0　 ​é", "  ", "'s", "'ll", "é", "<|endoftext|>", "<|", "|>", "endoftext", "\r\n", "😀"]


def test_cuts_fall_between_pre_tokens():
    library, enc, rng = Tokenizer.from_file(tokenizer_path()), encoder(tokenizer_path()), random.Random(8)
    for _ in range(8000):
        text = "".join(rng.choices(BITS, k=rng.randint(2, 25)))
        ids = library.encode(text, add_special_tokens=False).ids
        parts = list(parts_of(text, True, 1))
        assert "".join(parts) == text and [i for p in parts for i in library.encode(p, add_special_tokens=False).ids] == ids
        assert text_ids(enc, text).tolist() == ids


@pytest.mark.parametrize("line", ["abc,123\\n", "абв,123\\n", "日本語、", "a b\\n", "x"])
def test_memory_of_long_texts(line):
    """8 MB without a blank, counted and encoded in a process of its own."""
    size = 8 if line != "x" else 1
    code = f"""
import resource, sys
from beaconlake.llm import tokens as T
enc, text = T.encoder(T.tokenizer_path()), '{line}' * ({size} * 1000000 // len('{line}'.encode()))
T.count_batch(enc, ['warm']), T.text_ids(enc, 'warm')
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert T.count_batch(enc, [text])[0] == len(T.text_ids(enc, text))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300)
    assert float(out.stdout) < 300


def test_classes_are_reciprocal():
    """Whatever a document's length, its pieces are capacity // k for every k in turn, and few."""
    pieces, used = 0, set()
    for n in range(1, 3000):
        lengths = cut_lengths(n, 2048)
        assert sum(lengths) == n
        used |= {2048 // x for x in lengths if x >= SMALLEST_CUT}
        assert all(x == 2048 // (2048 // x) for x in lengths if x >= SMALLEST_CUT)
        pieces += len(lengths)
    assert used == set(range(1, 33)) and pieces / 2999 < 3 and cut_lengths(700, 2048) == [682, 18]
