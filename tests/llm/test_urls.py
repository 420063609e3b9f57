import math
import os
import re
from collections import Counter
from itertools import product

import pytest

from recordgauge.llm import url_filter as u

SCHEMA = "page_id long, url string, html string"


def plain_split(run, logp, unknown):
    """The best of all splits, by trying them."""
    best = (-math.inf, ())
    for marks in product((0, 1), repeat=len(run) - 1):
        cuts = [0, *(i + 1 for i, m in enumerate(marks) if m), len(run)]
        parts = [run[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        price = sum(max(logp.get(p, -math.inf), unknown + len(p) * u.UNKNOWN_LETTER) for p in parts)
        best = max(best, (round(price, 9), tuple(parts)))
    return best[0]


def test_viterbi_against_all_splits(spark):
    logp = {"the": -2.0, "then": -4.0, "news": -5.0, "new": -4.5, "s": -6.0, "henna": -7.0, "a": -2.5}
    unknown = math.log(1e-4)
    runs = ["thenews", "thennews", "thenna", "newsnews", "xqz", "thexqznew", "a", "news", "sss"]
    table = spark.createDataFrame(list(logp.items()), "word string, logp double")
    found = u.split_runs(spark.createDataFrame([(r,) for r in runs], "run string"), table, unknown).collect()
    assert {r.run for r in found} == set(runs) and len(found) == len(runs)
    for r in found:
        assert "".join(r.words) == r.run
        price = sum(max(logp.get(p, -math.inf), unknown + len(p) * u.UNKNOWN_LETTER) for p in r.words)
        assert round(price, 9) == plain_split(r.run, logp, unknown), r
    assert {r.run: r.words for r in found}["thenews"] == ["the", "news"]


def test_long_runs_and_words(spark):
    word = "y" * 40
    table = spark.createDataFrame([(word, -5.0), ("ab", -3.0)], "word string, logp double")
    runs = [word, "ab" * 3_000, "q" * 5_000]
    found = {r.run: r.words for r in u.split_runs(spark.createDataFrame([(r,) for r in runs], "run string"), table, -15.0).collect()}
    assert found[word] == [word] and found["ab" * 3_000] == ["ab"] * 3_000 and found["q" * 5_000] == ["q" * 5_000]


def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://WWW.Example.com/en/1?q#f", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://blog.example.com/en/", "blog.example.com", "/en/", "example.com/en/", "block"),
        ("https://example.com/en", "example.com", "/en", "com/", "allow"),
        ("x://a.www.example.com/en/É", "a.www.example.com", "/en/É", "www.example.com/en/", "allow"),
        ("x://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("ftp://a.net/es/x", "a.net", "/es/x", "net/es/", "block"),
        ("ftp://a.net/ES/x", "a.net", "/ES/x", None, "allow"),
        ("http://telecom/", "telecom", "/", None, "allow"),
        ("http://com", "com", "", None, "allow"),
        ("http://a.net:80/fr/", "a.net:80", "/fr/", None, "allow"),
        ("a://b://c.net/fr/", "b:", "//c.net/fr/", None, "allow"),
        ("no scheme.com/", "", "", None, "allow"),
        ("://?x", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "<p>some words</p>") for i, c in enumerate(cases)], SCHEMA)
    rows = u.judge(pages).orderBy("page_id").collect()
    for row, case in zip(rows, cases, strict=True):
        assert (row.host, row.path, row.rule, row.verdict) == case[1:], case


def plain_judge(pages):
    """The whole method without Spark; splits by plain search in order of ends."""
    text = Counter()
    for _, _, html in pages:
        text.update(re.findall(r"[^\W\d_]+", re.sub("<[^<>]*>", " ", html or "").lower()))
    total = sum(text.values()) or 1
    logp = {w: math.log(n / total) for w, n in text.items()}
    for w in u.SEED_WORDS:
        logp[w] = max(logp.get(w, -math.inf), math.log(u.SEED_SHARE))
    unknown = math.log(10 / total)

    def split(run):
        best, origin = [0.0], [0]
        for end in range(1, len(run) + 1):
            options = [(best[s] + unknown + (end - s) * u.UNKNOWN_LETTER, 0, s) for s in range(end)]
            options += [(best[s] + logp[run[s:end]], 1, s) for s in range(end) if run[s:end] in logp]
            price, _, start = max(options)
            best.append(price)
            origin.append(start)
        words, end = [], len(run)
        while end:
            words.append(run[origin[end] : end])
            end = origin[end]
        return words

    tokens, bad = [], []
    for _, url, _ in pages:
        m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.DOTALL)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        parts = [[w for run in re.findall(r"[^\W\d_]+", x.lower()) for w in split(run)] for x in (host, path)]
        tokens.append(parts[0] + parts[1])
        bad.append(bool(set(parts[0]) & set(u.SEED_WORDS)))
    counts = {b: Counter(w for t, x in zip(tokens, bad, strict=True) if x == b for w in t) for b in (True, False)}
    sizes = {b: sum(c.values()) for b, c in counts.items()}
    prior = math.log((sum(bad) + 1) / (len(bad) - sum(bad) + 1))

    def weight(w):
        share = (counts[True][w] + counts[False][w]) * u.SMOOTHING / max(1, sizes[True] + sizes[False])
        odds = [(counts[b][w] + share) / (sizes[b] + u.SMOOTHING) for b in (True, False)]
        return math.log(odds[0] / odds[1])

    return [prior + sum(map(weight, t)) for t in tokens]


def pages_of(spark, name):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    return [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{folder}/{name}.parquet").select("page_id", "url", "html").collect()]


def test_the_whole_method_against_a_plain_one(spark):
    pages = pages_of(spark, "pages")
    pages += [(10_000 + i, url, None) for i, url in enumerate(["http://pillspills.org/", "http://the.org/poker", "http://themagicslots.org/x", None])]
    rows = {r.page_id: r for r in u.judge(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert len(rows) == len(pages)
    for (page_id, url, _), score in zip(pages, plain_judge(pages), strict=True):
        assert rows[page_id].score == pytest.approx(score, abs=2e-5), url
        if rows[page_id].rule is None:
            assert rows[page_id].verdict == ("block" if rows[page_id].score > 0 else "allow")
    assert rows[10_000].verdict == "block" and rows[10_003].verdict == "allow"


def test_odd_tables(spark):
    assert u.judge(spark.createDataFrame([], SCHEMA)).collect() == []
    repeated = spark.createDataFrame(
        [(None, "http://a.org/x", "<b>a</b>", 1, "s", "h")] * 2, SCHEMA + ", n long, shape string, host string"
    )
    rows = u.judge(repeated).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].host == "a.org"
    # Unclosed tags, letters outside ASCII, a very long path.
    odd = [(1, "http://bücher.org/" + "straße" * 2_000, "<" * 50_000), (2, "http://x.org/é", "é <p é")]
    assert u.judge(spark.createDataFrame(odd, SCHEMA)).count() == 2
