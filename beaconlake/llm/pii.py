"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from beaconlake.llm.base import table
from beaconlake.llm.spans import Span, find_spans

BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "card13", "ssn")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can begin inside a run of digits in none of these, so only the run's start is tried.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile("[^0-9]")
#: Kind: score of the pattern, gain for a passed checksum or for its strict form, words that raise it, words that lower it.
RULES = {
    "email": (0.6, 0.2, ("mail", "email", "contact", "write"), ("example",)),
    "ip": (0.4, 0.2, ("ip", "address", "host", "server"), ("version", "section")),
    "card": (0.3, 0.4, ("card", "visa", "mastercard", "credit", "payment"), ("order", "isbn", "tracking")),
    "phone": (0.5, 0.1, ("phone", "telephone", "call", "tel", "mobile", "fax"), ("isbn",)),
    "iban": (0.2, 0.5, ("iban", "account", "bank", "konto", "cuenta", "compte"), ()),
    "card13": (0.1, 0.3, ("card", "visa", "credit", "payment"), ("order", "isbn", "ean", "tracking")),
    "ssn": (0.3, 0.1, ("ssn", "social", "security"), ("part", "serial")),
}
CONTEXT, LIFT, DROP, LEAST_SCORE = 40, 0.2, 0.3, 0.55


def _words(words: tuple[str, ...]) -> re.Pattern | None:
    """Whole words, singular or plural, between signs that are no letters."""
    return re.compile(f"[^a-zà-öø-ÿ](?:{'|'.join(words)})s?[^a-zà-öø-ÿ]") if words else None


_NEAR = {kind: (pattern, gain, _words(up), _words(down)) for kind, (pattern, gain, up, down) in RULES.items()}
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def is_octet(digits: str) -> bool:
    """Whether a run of digits, of any length, is at most 255."""
    plain = digits.lstrip("0")
    return len(plain) <= 3 and int(plain or "0") <= 255


def luhn(digits: str) -> bool:
    total = sum(_DOUBLED[int(d)] for d in digits[-2::-2]) + sum(int(d) for d in digits[::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str):
    """Leftmost matches of a run of local signs, @ and a dotted domain, reading outward from each @."""
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            past = m.end()
            yield start, past
        at = text.find("@", max(at + 1, past))


def nearby(text: str, start: int, end: int) -> str:
    """The signs before and behind a span, in lower case, with one more on either side that tells whether a word goes on."""
    before = (" " if start <= CONTEXT else "") + text[max(0, start - CONTEXT - 1):start]
    behind = text[end:end + CONTEXT // 2 + 1] + (" " if len(text) - end <= CONTEXT // 2 else "")
    return f"{before} {behind}".replace("İ", "i").lower()  # the one letter that would become two signs


def score(text: str, kind: str, start: int, end: int) -> float:
    pattern, gain, up, down = _NEAR[kind]
    near = nearby(text, start, end)
    s = pattern + gain + LIFT * bool(up and up.search(near)) - DROP * bool(down and down.search(near))
    return min(1.0, max(0.0, s))


def base_spans(text: str) -> list[Span]:
    spans = [("email", s, e) for s, e in emails(text)]
    spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(is_octet, m.groups()))]
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
    if "+" in text:
        spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return spans


def added_spans(text: str) -> list[Span]:
    """Spans beyond the base kinds whose score, after checksum and context, reaches LEAST_SCORE."""
    found = []
    for m in _IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and mod97(plain):
            found.append(("iban", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start():
            digits = _NOT_DIGIT.sub("", m[0])
            if len(digits) == 13 and luhn(digits):
                found.append(("card13", m.start(), m.end()))
    found += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
    return [s for s in found if score(text, *s) >= LEAST_SCORE]


def scan(text: str) -> tuple[list[Span], list[Span], float]:
    own, more = base_spans(text), added_spans(text)
    return own, more, max((score(text, *s) for s in own + more), default=0.0)


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and score of every text.

    Base spans are the matches of the four patterns that pass their checks (parts of an address, digit
    counts, Luhn), whatever their score. Added are account numbers that pass mod-97, 13-digit cards
    that pass Luhn and social security numbers, if whole words nearby lift them to LEAST_SCORE. score is the
    highest of all. A null text counts as empty. Texts are read whole. Ids may be null or repeat, other
    columns are ignored, an empty table gives an empty result.
    """
    return find_spans(docs, scan, BASE, ADDED, id_col, text_col, "score")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return scan_pii(table(spark, sf_dir, "documents"))


#: The query in SQL. Places follow from the lengths of matches and of what lies between them; \b stands for the
#: neighbours that patterns with look-around rule out, once underscores, which it counts as letters, are replaced.
OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), '_', '-') AS u FROM documents),
m AS (
  SELECT r, 'email' AS pattern, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS hits, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS gaps FROM d UNION ALL
  SELECT r, 'ip', regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), string_split_regex(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM d UNION ALL
  SELECT r, 'card', regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), string_split_regex(t, '[0-9]([\x20-]?[0-9])+') FROM d UNION ALL
  SELECT r, 'phone', regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM d UNION ALL
  SELECT r, 'iban', regexp_extract_all(u, '\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b'), string_split_regex(u, '\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b') FROM d UNION ALL
  SELECT r, 'ssn', regexp_extract_all(t, '[0-9-]+'), string_split_regex(t, '[0-9-]+') FROM d),
z AS (SELECT r, pattern, unnest(hits) AS hit, unnest(gaps) AS gap, unnest(range(len(gaps))) AS i FROM m WHERE len(hits) > 0),
h AS (SELECT r, pattern, hit, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY r, pattern ORDER BY i) AS e FROM z QUALIFY hit IS NOT NULL),
c AS (SELECT r, CASE WHEN pattern = 'card' AND length(regexp_replace(hit, '[^0-9]', '', 'g')) = 13 THEN 'card13' ELSE pattern END AS kind, hit, e - length(hit) AS s, e, regexp_replace(hit, '[^0-9]', '', 'g') AS digits FROM h),
v AS (SELECT *, list_sum(list_transform(range(length(digits)), lambda i: CASE WHEN i % 2 = 0 THEN digits[length(digits) - i]::INT
    ELSE digits[length(digits) - i]::INT * 2 - CASE WHEN digits[length(digits) - i] > '4' THEN 9 ELSE 0 END END)) % 10 = 0 AS luhn FROM c
  WHERE CASE kind WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 WHEN 'card13' THEN TRUE WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
    WHEN 'ip' THEN regexp_full_match(hit, '0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}')
    WHEN 'iban' THEN length(replace(hit, ' ', '')) BETWEEN 15 AND 34
    WHEN 'ssn' THEN regexp_full_match(hit, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(hit, '^(000|666|9)|-00-|-0000$') ELSE TRUE END),
k AS (SELECT r, kind, s, e FROM v WHERE CASE WHEN kind IN ('card', 'card13') THEN luhn WHEN kind = 'iban' THEN
  list_reduce(list_prepend(0, list_transform(range(1, length(replace(hit, ' ', '')) + 1), lambda i:
    strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', (substr(replace(hit, ' ', ''), 5) || substr(replace(hit, ' ', ''), 1, 4))[i]) - 1)),
    lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1 ELSE TRUE END),
rules(kind, place, base, start, gain, up, down) AS (VALUES
  ('email', 0, TRUE, 0.6::DOUBLE, 0.2::DOUBLE, 'mail|email|contact|write', 'example'),
  ('ip', 1, TRUE, 0.4, 0.2, 'ip|address|host|server', 'version|section'),
  ('card', 2, TRUE, 0.3, 0.4, 'card|visa|mastercard|credit|payment', 'order|isbn|tracking'),
  ('phone', 3, TRUE, 0.5, 0.1, 'phone|telephone|call|tel|mobile|fax', 'isbn'),
  ('iban', 4, FALSE, 0.2, 0.5, 'iban|account|bank|konto|cuenta|compte', NULL),
  ('card13', 5, FALSE, 0.1, 0.3, 'card|visa|credit|payment', 'order|isbn|ean|tracking'),
  ('ssn', 6, FALSE, 0.3, 0.1, 'ssn|social|security', 'part|serial')),
n AS (SELECT k.r, k.kind, place, base, s::BIGINT AS s, e::BIGINT AS e, start, gain, up, down,
  lower(CASE WHEN s <= 40 THEN ' ' ELSE '' END || substr(t, greatest(s - 41, 0)::BIGINT + 1, least(s, 41)::BIGINT) || ' ' || substr(t, e::BIGINT + 1, 21) || CASE WHEN length(t) - e <= 20 THEN ' ' ELSE '' END) AS near FROM k JOIN rules USING (kind) JOIN d USING (r)),
x AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, start + gain + CASE WHEN regexp_matches(near, '[^a-zà-öø-ÿ](' || up || ')s?[^a-zà-öø-ÿ]') THEN 0.2::DOUBLE ELSE 0 END
  - CASE WHEN down IS NOT NULL AND regexp_matches(near, '[^a-zà-öø-ÿ](' || down || ')s?[^a-zà-öø-ÿ]') THEN 0.3::DOUBLE ELSE 0 END)) AS score FROM n),
g AS (SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (base) AS own, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans, max(score) AS score
  FROM x WHERE base OR score >= 0.55 GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN g USING (r)
"""
