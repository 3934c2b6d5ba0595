"""The span finders against plain regular expressions."""

import random
import time

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from beaconlake.llm import pii, secrets
from beaconlake.llm.spans import digest, joined, ordered
from tests.llm import plain

HEADS = [*"pPaAsStT", "password", "PASSWD", "secret", "token", "api_key", "ApiKey", "AKIA", ":", "=", '"', "'", " ", "abcdef0123456789", "f" * 24, "A" * 16, "\n", "ſecret", "toKen", "é", "."]
BITS = [*"a.@-+ ()0123456789", "x@y.z", "1.2.3.4", "300", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 010-9999", "0" * 30, "b.c", "_", "%", "é", "٣"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(HEADS), max_size=30).map("".join))
def test_secret_base_equals_plain_patterns(text):
    assert joined(ordered(secrets.base_spans(text), secrets.BASE)) == joined(ordered(plain.secrets(text), secrets.BASE))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=30).map("".join))
def test_pii_base_equals_plain_patterns(text):
    assert joined(ordered(pii.base_spans(text), pii.BASE)) == joined(ordered(plain.pii(text), pii.BASE))


@pytest.mark.parametrize("text, value", [
    ('db_pwd = "hunter2hunter2"', "hunter2hunter2"),
    ('{"private_key": "q8Zr5tYw9PxL"}', "q8Zr5tYw9PxL"),
    ('a = "q8Zr5tYw9PxL"\nsigning_key = a', "q8Zr5tYw9PxL"),
    ("auth_credential => 'q8Zr5tYw9PxL'", "q8Zr5tYw9PxL"),
])
def test_literals_of_sensitive_names(text, value):
    own, more, score = secrets.scan(text)
    assert [text[s:e] for _, s, e in more] == [value] and score >= 0.5
    assert value not in secrets.redact(text)


def test_constants_reach_names_through_sums():
    text = 'a = "q8Zr5t"\nb = a + "Yw9PxL"\ndb_pwd = b'
    assert [text[s:e] for _, s, e in secrets.scan(text)[1]] == ["q8Zr5t", "Yw9PxL"]


@pytest.mark.parametrize("text", ["The title: something here", 'color = "blueblueblue"', 'db_pwd = "changeme"', "if key == 'q8Zr5tYw9PxL'", ""])
def test_harmless_assignments(text):
    assert secrets.scan(text)[1] == []


def test_literals_equal_a_plain_reading():
    """Constants, sums, additions and comparisons in any order, values of every kind of quote."""
    rng = random.Random(11)
    names = ["a", "b", "db_pwd", "api_key", "title", "token", "auth_header", "secretKey"]
    values = ['"q8Zr5t"', "'Yw9PxLm2'", "`kkkkkkkkkk`", '"changeme"', "a", "b", "db_pwd", "title", '"xx"', "7f3kQ9zL", '"\'s 1"', '"xxx"', '"x9"', '"é日本語テスト"']
    added = 0
    for _ in range(2000):
        lines = [f"{rng.choice(names)}{rng.choice([' = ', ': ', ' := ', ' += ', ' == ', ' => '])}{' + '.join(rng.choices(values, k=rng.choice([1, 1, 2, 3])))}" for _ in range(rng.randint(1, 8))]
        text = rng.choice(["\n", "; ", ", "]).join(lines)
        own, more, _ = secrets.scan(text)
        want = plain.uncovered(plain.sensitive_literals(secrets.assignments(text), secrets.name_score), plain.secrets(text))
        assert set(more) == want, text
        added += len(want)
    assert added > 1000


def test_redaction_keeps_names_and_clean_texts():
    assert secrets.redact('x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y') == 'x token = "[REDACTED]" y'
    assert secrets.redact("a clean text") == "a clean text"


def test_checksums_and_context():
    assert pii.scan("my iban: DE89 3704 0044 0532 0130 00 ok")[1] == [("iban", 9, 36)]
    assert pii.scan("my iban: DE88 3704 0044 0532 0130 00 ok")[1] == []
    assert pii.scan("ssn 123-45-6789")[1] == [("ssn", 4, 15)]
    assert pii.scan("part 123-45-6789")[1] == []


@pytest.mark.parametrize("text, added", [
    ("the ship discard 4222222222222", False), ("socially 123-45-6789", False), ("cards 4222222222222", True), ("social: 123-45-6789", True), ("4222222222222 visa", True), ("4222222222222 advisable", False),
    ("x" * 50 + "dis" + "card" + " " * 36 + "4222222222222", False), ("x" * 50 + " card" + " " * 36 + "4222222222222", True), ("card" + " " * 36 + "4222222222222", True), ("écard 4222222222222", False),
    ("4222222222222" + " " * 16 + "visa", True), ("4222222222222" + " " * 16 + "visage", False), ("visa border 4222222222222", True)])
def test_context_is_whole_words(text, added):
    assert bool(pii.scan(text)[1]) == added


def test_pii_sql_equals_the_scan_on_odd_texts():
    """Texts in which kinds touch, overlap, repeat, fail a check by one sign, or stand behind signs of two bytes."""
    rng = random.Random(7)
    more = [*BITS, "DE89 3704 0044 0532 0130 00", "DE88370400440532013000", "GB82WEST12345698765432", "123-45-6789", "000-45-6789", "123-00-6789", "4222222222222", "079927398713",
            "iban ", "ssn ", "card ", "part ", "isbn ", "mail ", "example ", "ip ", "version ", "call ", "dis", "s ", "card", "email ", ",", "\n", "\t", "A", "X9", "256.1.1.1", "007.1.1.1", "İ", "😀"]
    texts = [None, "", "1.2.3." + "0" * 3000, "a@b.c " * 2000] + ["".join(rng.choices(more, k=rng.randint(1, 25))) for _ in range(3000)]
    con = duckdb.connect()
    documents = pa.table({"doc_id": range(len(texts)), "text": texts})  # noqa: F841, read by name
    for row in con.sql(pii.OP9_SQL).order("doc_id").fetchall():
        own, added, score = pii.scan(texts[row[0]] or "")
        counts = tuple(sum(s[0] == k for s in own) for k in pii.BASE)
        assert row == (row[0], *counts, digest(ordered(own, pii.BASE)), joined(ordered(own + added, pii.BASE + pii.ADDED)), score)


def test_frames_with_nulls_and_clashing_columns(spark):
    rows = [(1, None, "x", "y"), (None, "", "x", "y"), (3, "mail a@b.cc " * 3000, "x", "y"), (3, "mail a@b.cc " * 3000, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, score string")
    for scan in (pii.scan_pii, secrets.scan_secrets):
        out = scan(docs).collect()
        assert len(out) == 4 and sum(r.spans == "" for r in out) == (2 if scan is pii.scan_pii else 4)
        assert scan(docs.limit(0)).collect() == []
    masked = secrets.redacted(docs).collect()
    assert masked[0].text is None and masked[0].spans == "x"


@pytest.mark.parametrize("text, value", [
    ('private_key: str = "q8Zr5tYw9PxL"', "q8Zr5tYw9PxL"),
    ('private_key:str="q8Zr5tYw9PxL"', "q8Zr5tYw9PxL"),
    ("self.private_key: Optional[dict[str, str]] = 'q8Zr5tYw9PxL'", "q8Zr5tYw9PxL"),
    ('const apiKey: string = "q8Zr5tYw9PxL"', "q8Zr5tYw9PxL"),
    ('let privateKey: string | null = "q8Zr5tYw9PxL";', "q8Zr5tYw9PxL"),
    ("static PRIVATE_KEY: &'static str = \"q8Zr5tYw9PxL\";", "q8Zr5tYw9PxL"),
    ('val privateKey: Option<String>= "q8Zr5tYw9PxL"', "q8Zr5tYw9PxL"),
    ('a: str = "q8Zr5tYw9PxL"\nsigning_key = a', "q8Zr5tYw9PxL"),
    ('else: private_key = "q8Zr5tYw9PxL"', "q8Zr5tYw9PxL"),
    ('private_key = """q8Zr5tYw9PxL"""', "q8Zr5tYw9PxL"),
    ("private_key = '''q8Zr5t\nYw9PxL'''", "q8Zr5t\nYw9PxL"),
    ("const privateKey = `q8Zr5tYw9PxL`", "q8Zr5tYw9PxL"),
    ("privateKey: string = `q8Zr5t\nYw9PxL`", "q8Zr5t\nYw9PxL"),
    ('private_key += "q8Zr5tYw9PxL"', "q8Zr5tYw9PxL"),
    ('a = ""\na += "q8Zr5tYw9PxL"\nprivate_key = a', "q8Zr5tYw9PxL"),
    ('doc = """\nprivate_key = "q8Zr5tYw9PxL"\n"""', "q8Zr5tYw9PxL"),
    ("Use: `\nprivate_key = 'q8Zr5tYw9PxL'\n`", "q8Zr5tYw9PxL"),
    ("private_key: q8Zr5tYw9PxL= ", "q8Zr5tYw9PxL="),
    ("private_key: q8Zr5tYw9PxL = x", "q8Zr5tYw9PxL"),
])
def test_literals_in_common_source_syntax(text, value):
    assert value in [text[s:e] for _, s, e in secrets.scan(text)[1] if s < e]
    assert "str" not in [text[s:e] for _, s, e in secrets.scan(text)[1]]
    assert value not in secrets.redact(text)


def test_parts_added_to_a_name_count_together():
    text = 'private_key = "q8"\nprivate_key += "Zr"\nprivate_key += "5tYw9PxL"\nprivate_key = ""'
    assert {text[s:e] for _, s, e in secrets.scan(text)[1]} == {"q8", "Zr", "5tYw9PxL"}
    assert secrets.redact(text).count("[REDACTED]") == 3


def test_names_added_to_each_other_stay_bounded():
    assert secrets.scan('a = "x"\nb = "y"\n' + "a += a\nb += a\na = a + b\n" * 60)[1] == []


def test_long_runs_of_digits():
    for zeros in (3, 5000):
        text = "at 1.2.3." + "0" * zeros + " and 1.2.3." + "9" * zeros
        assert pii.base_spans(text) == [("ip", 3, 9 + zeros)] == plain.pii(text)


@pytest.mark.parametrize("n", [40, 3000])
def test_constants_added_to_themselves(n):
    """The value doubles with every line; what is known of it does not grow."""
    text = 'a0 = "q8Zr5tYw9PxL"\n' + "".join(f"a{i} = a{i - 1} + a{i - 1}\n" for i in range(1, n + 1)) + f"private_key = a{n}\n"
    began = time.process_time()
    assert [text[s:e] for _, s, e in secrets.scan(text)[1]] == ["q8Zr5tYw9PxL"]
    assert "q8Zr5tYw9PxL" not in secrets.redact(text)
    assert time.process_time() - began < 5


def test_chains_and_lists_of_assignments_take_linear_time():
    for text, n in (("".join(f'a{i} = a{i - 1} + "x{i}y"\n' for i in range(1, 8000)) + "private_key = a7999\n", 8000),
                    ('token = "abcdefgh1234"\n' * 9000, 0), ('db_pwd = "abcdefgh1234"\n' * 9000, 9000), ('private_key += "abcdefgh1234"\n' * 8000, 8000)):
        began = time.process_time()
        own, more, score = secrets.scan(text)
        assert len(more) == n and (n or len(own) == 9000) and score >= 0.5
        assert time.process_time() - began < 5


def test_a_placeholder_over_a_seam_counts():
    assert secrets.scan('db_pwd = "change" + "me"')[1] == []
    assert len(secrets.scan('db_pwd = "chang" + "3me9x7"')[1]) == 2


def test_literals_outside_spans_equal_all_pairs():
    import random

    rng = random.Random(4)
    for _ in range(300):
        cut = lambda: sorted(rng.sample(range(30), 2))
        spans, literals = [("x", *cut()) for _ in range(rng.randint(0, 6))], [(*cut(), 0.5) for _ in range(rng.randint(0, 6))]
        want = sorted(("literal", s, e) for s, e, _ in literals if not any(a <= s and e <= b for _, a, b in spans))
        assert sorted(secrets.outside(literals, spans)) == want
