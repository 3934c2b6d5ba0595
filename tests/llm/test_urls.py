"""URL rules against a plain reading of them, and the model's decisions on odd rows."""

import re

import pytest

from beaconlake.llm.urls import RULES, filter_urls

CONTRACT = {("org", "/"): "allow", ("example.org", "/es/"): "block", ("example.org", "/en/1"): "block", ("com", "/fr/"): "allow", ("com", "/de/"): "block"}

URLS = ["https://a.example.org/es/1", "http://EXAMPLE.org/en/15?x=1", "http://example.org/en/2", "http://x.com/fr", "http://x.com/france#a", "http://x.com/de/", "http://x.com/de", "http://org", "http://org/", "http://notorg/x",
        "ftp://a://b.org/q", "no scheme", None, "", "http://a.net", "http://a.net/" + "q" * 5000, "http://É.ORG/ü", "http://user@h.com:80/fr/x", "http://x.com?/fr", "://org/x"]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p) for h, p in CONTRACT if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1] if fit else None


def test_rules_and_odd_rows(spark):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)] + [(None, URLS[0], "x", 1), (3, URLS[3], "x", 1)], "page_id long, url string, host string, score int")
    out = filter_urls(df).collect()
    assert len(out) == len(URLS) + 2
    verdicts = {h + p: v for (h, p), v in CONTRACT.items()}
    for r in out:
        url = URLS[r.page_id if r.page_id is not None else 0]
        assert (r.host, r.path, r.rule) == plain(url), url
        assert r.verdict == verdicts[r.rule] if r.rule else r.verdict in ("allow", "block")
        assert (r.score is None) == (r.rule is not None)


def test_model_tells_words_apart(spark):
    rows = [(i, f"http://s{i % 7}.good{i % 5}.org/news/story{i}") for i in range(400)] + [(1000 + i, f"http://x.com/de/casino-win-{i}") for i in range(400)]
    rows += [(5000 + i, f"http://good{i % 5}.net/news/story{i}") for i in range(20)] + [(6000 + i, f"http://x.net/casino-win-{i}") for i in range(20)]
    got = {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[5000 + i] == "allow" and got[6000 + i] == "block" for i in range(20))


@pytest.mark.parametrize("urls", [[], ["http://a.net/x", "http://b.net/"]])
def test_no_decided_urls(spark, urls):
    out = filter_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")).collect()
    assert [r.verdict for r in out] == ["allow"] * len(urls)


def test_rules_are_the_contracts(spark):
    contract = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    assert {h + p: v for h, p, v in RULES} == contract
    wanted = {"http://x.com/fr/": "com/fr/", "http://x.com/fr/a": "com/fr/", "http://x.com/fr": None, "http://x.com/france": None, "http://x.com/de/1": "com/de/", "http://x.com/de": None,
              "http://b.org/es/1": "org/", "http://example.org/es/1": "example.org/es/", "http://a.example.org/en/15": "example.org/en/1", "http://example.org/en/2": "org/", "http://x.net/fr/": None}
    urls = list(wanted)
    out = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert {urls[r.page_id]: r.rule for r in out} == wanted
    assert all(r.verdict == contract[r.rule] for r in out if r.rule)
