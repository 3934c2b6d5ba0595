"""Token ids and token counts of whole texts, inside Arrow functions."""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.base import map_texts, table

BYTE_BPE = "byte_bpe_50k.json"
#: Where a byte-level text may be cut, as no pre-token reaches over these places and none looks back:
#: before a run of white space behind something else (white space behind it in Python's sense, the wider one, and before
#: it in ASCII, the narrower one), and between a letter and a mark or digit, whatever a text has instead of blanks.
#: Marks of which special tokens are made (< | >) and the apostrophe of contractions are no such place.
CUT = re.compile(r"(?<=\S)(?=[\t-\r ])|(?<=[A-Za-z\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])(?=[!-&(-;=?@\[-`{}~\u3001\u3002\uff0c\uff1a\uff1b])")
#: Characters beyond those on which both byte-level libraries' character classes are sure to agree.
ODD = re.compile("[^\t-\r -~\xa0-ɏ‐-‧‰-⁞€]")
#: Characters of a part of a long text, and UTF-8 bytes of the parts that one call of the library counts.
PART_CHARS, BATCH_BYTES = 1 << 16, 1 << 18


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def can_cut(path: str) -> bool:
    """Whether CUT is safe: bare byte-level pre-tokens, and no added token that reaches over such a place."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not spec.get("normalizer")
            and not any(t["lstrip"] or t["rstrip"] or CUT.search(t["content"]) or t["content"].startswith(" ") for t in spec.get("added_tokens", ())))


class JsonEncoder:
    """Ids and counts as the tokenizers library gives them for a .json file, without added special tokens.

    Counts come from the library itself, many parts at a time. Ids of plain characters are taken from tiktoken
    where the folder holds the same vocabulary as ranks: they are the same, several times faster.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cuts = can_cut(path)
        self.ranks = None
        ranks_path = path.removesuffix(".json") + ".tiktoken"
        if self.cuts and os.path.exists(ranks_path):
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items() if t.special}
            self.ranks = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.special = set(special)

    def ids(self, part: str) -> list[int]:
        if self.ranks is not None and not ODD.search(part):
            return self.ranks.encode(part, allowed_special=self.special, disallowed_special=())
        return self.library.encode(part, add_special_tokens=False).ids

    def counts(self, parts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode_batch_fast(parts, add_special_tokens=False)]


class PieceEncoder:
    """Ids and counts as sentencepiece gives them for a .model file, without begin and end. Texts are never cut."""

    cuts = False

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, part: str) -> list[int]:
        return self.library.encode(part)

    def counts(self, parts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(parts, num_threads=1)]


@lru_cache(maxsize=4)
def encoder(path: str):
    return PieceEncoder(path) if path.endswith(".model") else JsonEncoder(path)


def parts_of(text: str, cuts: bool, size: int = PART_CHARS) -> Iterator[str]:
    """Parts of a long text whose ids, one after another, are the text's; one part without safe cuts."""
    at = 0
    while cuts and len(text) - at > size:
        cut = CUT.search(text, at + size)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def text_ids(enc, text: str) -> np.ndarray:
    """All ids of a text, as unsigned 32-bit numbers."""
    parts = [np.array(enc.ids(p), dtype=np.uint32) for p in parts_of(text, enc.cuts)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def balanced(texts: list[str], cuts: bool) -> Iterator[tuple[list[int], list[str]]]:
    """The parts of all texts and the texts' places, in batches of about BATCH_BYTES of UTF-8."""
    rows: list[int] = []
    parts: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        for part in parts_of(text, cuts):
            rows.append(i)
            parts.append(part)
            held += len(part.encode("utf-8", "surrogatepass"))
            if held >= BATCH_BYTES:
                yield rows, parts
                rows, parts, held = [], [], 0
    if parts:
        yield rows, parts


def count_batch(enc, texts: list[str]) -> np.ndarray:
    """Tokens of each text."""
    counts = np.zeros(len(texts), dtype=np.int64)
    for rows, parts in balanced(texts, enc.cuts):
        np.add.at(counts, rows, enc.counts(parts))
    return counts


def count_tokens(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text.

    Special strings inside texts are handled as the library does by default; nothing is added,
    truncated or padded. Null and empty texts have 0 bytes and 0 tokens. Ids may be null or repeat and
    equal rows repeat: each row is counted by itself, so there are no ties. An empty table gives an empty
    result; other columns are ignored. Texts never leave the task that read them: only lengths do. Long
    byte-level texts are encoded in parts of about 65,536 characters, cut where a pre-token surely begins: a task holds
    a batch and the tokens of 256 kB, with blanks or without. What cannot be cut takes about 200 bytes of memory for
    each of its bytes: a stretch without such a place, as millions of digits or blanks in a row, which are one
    pre-token, and whole texts of other tokenizers.
    """
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = count_batch(enc, [t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    n_bytes = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), n_bytes.alias("n_bytes"))
    return (map_texts(texts, run, f"doc_id {kind}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
