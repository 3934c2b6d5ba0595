"""The contracts read plainly, row by row, to hold the operators against."""

import hashlib
import math
import re
import zlib

import xxhash

ASSIGN = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def secrets(text):
    spans = [("assign", *m.span()) for m in re.finditer(ASSIGN, text) if len(m[1]) >= 6]
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return spans + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def octet(digits):
    return digits.lstrip("0") == "" or (len(digits.lstrip("0")) <= 3 and int(digits.lstrip("0")) <= 255)


def pii(text):
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(map(octet, m[0].split(".")))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    spans += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return spans + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]


def digest(spans, kinds):
    ordered = sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in ordered).encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text):
    found = words(lower(text))
    if not found:
        return 0
    parts = [" ".join(found[i:i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(nodes, pairs):
    """Smallest node of each node's component."""
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def near(fps):
    fps = list(set(fps))
    return [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2]


M = [x | 1 for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def toxic_features(text):
    """Hashed words, stems of four to seven letters, and pairs of words up to two apart."""
    every = "".join(" " if ord(c) < 33 or c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in text.lower()).encode().split()
    out, h = [], [xxhash.xxh32_intdigest(w) for w in every]
    for w, x in zip(every, h, strict=True):
        for y in [x, *(n << 32 | xxhash.xxh32_intdigest(w.decode()[:n].encode()) for n in (4, 5, 6, 7))]:
            out.append((y * M[0] & 2**64 - 1) >> 44)
    for gap in (1, 2, 3):
        for x, y in zip(h, h[gap:], strict=False):
            out.append(((x * M[gap] ^ y * M[4]) * M[0] & 2**64 - 1) >> 44)
    return out


def ftrl(rows, alpha, beta, l1, l2, epochs):
    """Weights by feature, and the intercept, one coordinate at a time."""
    z, n = {}, {}
    ones = sum(y for _, y in rows)
    b, bn = math.log((ones + 0.5) / (len(rows) - ones + 0.5)), 0.0

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else (math.copysign(l1, zi) - zi) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for places, y in rows:
            w = {i: weight(i) for i in places}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()) + b)))) - y
            if abs(g) < 1e-6:
                continue
            for i in places:
                ni = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(ni + g * g) - math.sqrt(ni)) / alpha * w[i]
                n[i] = ni + g * g
            bn += g * g
            b -= g * alpha / (beta + math.sqrt(bn)) * 0.1
    return {i: weight(i) for i in z if weight(i)}, b


def packed(pieces, ids_of, docs, capacity=2048):
    """Asserts that the pieces hold each id of each document once, and that sequences are gapless and little padded."""
    ids = {(doc, text): [*ids_of(text or ""), 1] for doc, text in docs}
    want, got, where = {}, {}, {}
    for doc, text in docs:
        key = doc, len(ids[doc, text])
        want[key] = want.get(key, 0) + key[1]
        where.setdefault(key, []).append(ids[doc, text])
    sequences = {}
    for p in pieces:
        got[p.doc_id, p.doc_tokens] = got.get((p.doc_id, p.doc_tokens), 0) + p.length
        crc = {zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x[p.start:p.start + p.length])) for x in where[p.doc_id, p.doc_tokens]}
        assert p.ids_crc32 in crc
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got == want
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding <= 0.01 * sum(got.values())


def value_score(value):
    """How much a whole value, as a text, looks like a secret."""
    data = value.encode("utf-8", "surrogatepass")
    if len(value) < 6:
        return 0.0
    bits = -sum(math.log2(data.count(b) / len(data)) for b in data)
    hidden = any(p in value.lower() for p in ("example", "changeme", "placeholder", "your", "xxxx", "none", "null", "true", "false", "todo", "redacted", "$"))
    return min(1.0, 0.4 + min(bits, 36.0) / 60) * (0.2 if hidden else 1.0)


def sensitive_literals(assignments, name_score):
    """Spans of literals whose value reaches a sensitive name: every name holds its whole value as a list of literals."""
    known, best = {}, {}

    def mark(value, weight):
        score = weight * value_score("".join(t for t, _ in value))
        for _, span in value:
            best[span] = max(score, best.get(span, 0.0))

    for name, parts, adds in assignments:
        value = []
        for text, start, end, quoted in parts:
            value += known[text] if not quoted and text in known else [(text, (start, end))]
        weight = name_score(name)
        if weight:
            mark(value, weight)
        if adds and name in known:
            value = known[name] + value
            if weight:
                mark(value, weight)
        known[name] = value
    return {s for s, x in best.items() if x >= 0.5 and s[0] < s[1]}


def uncovered(literals, base):
    return {("literal", s, e) for s, e in literals if not any(a <= s and e <= b for _, a, b in base)}
