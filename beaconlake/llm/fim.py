"""Fill-in-the-middle forms of texts, cut between lines by an indexable skip list."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.base import map_texts, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = re.compile("|".join((PREFIX, SUFFIX, MIDDLE)))
#: A unit is on the lane above with this chance, drawn from a hash of its number: reruns build the same lanes.
CHANCE = 4


@dataclass(frozen=True)
class Fim:
    """seed of the draws; percent of texts that are transformed, and of these in suffix-prefix-middle form."""

    seed: int = 7
    rate: int = 100
    spm: int = 50


def unit_widths(text: str) -> np.ndarray:
    """Code points of each line, its line feed included."""
    ends = [m.end() for m in re.finditer("\n", text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return np.diff(np.array(ends, dtype=np.int64), prepend=0)


class SkipList:
    """Units in order, with express lanes. Lane 0 links every unit to the next; a lane above links some of those
    below. Every link carries its width twice: in units and in code points.

    A lane is four arrays over its nodes, the first of which is the head: how many units and code points its
    link reaches over (the last link ends behind the last unit), and where the node stands on the lane below.
    """

    def __init__(self, widths: np.ndarray):
        n = len(widths)
        at = np.arange(n)
        draws = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        draws ^= draws >> np.uint64(29)
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        chars, down = widths, at
        while True:
            self.lanes.append((np.diff(at, append=n), chars, down))
            up = np.flatnonzero((draws[at] & np.uint64(CHANCE - 1)) == 0)
            up = up if len(up) and up[0] == 0 else np.concatenate([[0], up])  # the head is on every lane
            if len(at) <= CHANCE or len(up) == len(at):
                break
            draws >>= np.uint64(2)
            at, chars, down = at[up], np.add.reduceat(chars, up), up

    def chars_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units: on each lane forward while a link does not pass the rank,
        then down, adding up both widths."""
        node = units = chars = 0
        for steps, widths, down in reversed(self.lanes):
            while node < len(steps) and units + steps[node] <= rank:
                units += int(steps[node])
                chars += int(widths[node])
                node += 1
            if node == len(steps):  # behind the last unit
                return chars
            node = int(down[node])
        return chars


def transform(text: str, doc_id, how: Fim) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (none if plain), and the output."""
    widths = unit_widths(text)
    n = len(widths)
    drawn = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= how.rate or MARKS.search(text):
        return n, "plain", None, None, text
    units = SkipList(widths)
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = units.chars_before(first), units.chars_before(last)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < how.spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, how: Fim = Fim(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars and output of every text.

    The two cuts lie between lines and are drawn from the seed and the id: copies under the same id are cut alike, and
    reruns agree. Texts that are empty, hold one of the marks, or are not among ``rate`` percent stay as they are
    (plain). A null text counts as empty; a null id draws as an empty one. Very long texts are cut whole, whatever
    their lines: a task holds one batch of texts, its outputs and 24 bytes for each line of one text. Rows may repeat;
    each is transformed by itself, so there are no ties. Other columns are ignored, whatever their names. An empty
    table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [transform(t.as_py() or "", i, how) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            cols = zip(*rows, strict=True) if rows else [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                                             names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(texts, run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form were made from. No text in parts holds a mark, so the marks split them."""
    parts = F.split(output, MARKS.pattern, 4)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))


def op11_fim(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The restored text is split off the output again, as its reader would.
OP11_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT doc_id, text, list_concat([x || chr(10) FOR x IN p[:-2]], [x FOR x IN p[-1:] IF x <> '']) AS units,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM (SELECT *, string_split(text, chr(10)) AS p FROM t)),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT *, array_to_string(units[:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p),
r AS (SELECT *, string_split(replace(replace(output, '<P>', '<S>'), '<M>', '<S>'), '<S>') AS q FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN q[2] || q[4] || q[3] ELSE q[3] || q[4] || q[2] END) AS restored_sha256 FROM r
"""
