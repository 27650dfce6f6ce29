"""Line dedup, URL filter, licences: against plain Python, and on odd input."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest

from textrisk.llm import licenses, line_dedup, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def test_lines_on_too_many_pages_of_a_host_go(spark):
    rows = [(i, f"own line {i}\n  Menu \t\nown end {i}", "a") for i in range(6)] + [(9, "Menu\nkeep", "b")]
    got = {r.doc_id: (r.text, r.dropped) for r in line_dedup.dedup_lines(_docs(spark, rows), ratio=0.5, min_pages=3, dropped="dropped").collect()}
    assert got[0] == ("own line 0\nown end 0", 1)
    assert got[9] == ("Menu\nkeep", 0)


def test_ratio_is_exceeded_not_met(spark):
    rows = [(i, "Menu" if i < 3 else f"other {i}", "a") for i in range(6)]
    kept = line_dedup.dedup_lines(_docs(spark, rows), ratio=0.5, min_pages=1)
    assert {r.text for r in kept.collect()} >= {"Menu"}


def test_line_dedup_odd_rows(spark):
    rows = [(None, None, None), (1, "", None), (1, "", None), (2, "x\n\n" * 5000 + "end", ""), (3, "x", None), (4, "x", "")]
    docs = _docs(spark, rows).selectExpr("*", "text as host", "1 as marks", "2 as _marks")
    got = line_dedup.dedup_lines(docs, ratio=0.4, min_pages=2)
    assert got.columns == docs.columns and got.count() == 6
    by_id = {r.doc_id: r.text for r in got.collect()}
    # Null and empty hosts are one host of six pages, on three of which "x" stands.
    assert by_id[None] is None and by_id[1] == "" and by_id[3] == "" and by_id[2] == "\n" * 5000 + "end"
    empty = line_dedup.dedup_lines(docs.limit(0))
    assert empty.count() == 0


def test_marks_too_large_to_broadcast_give_the_same(spark):
    docs = _docs(spark, [(i, f"a {i}\nMenu\n{i} b", f"h{i % 3}") for i in range(30)])
    found = line_dedup.boilerplate_lines(docs, ratio=0.5, min_pages=2)
    large = line_dedup.Boilerplate(found.stored, 1 << 40)
    a = {tuple(r) for r in line_dedup.without_boilerplate(docs, found).collect()}
    assert a == {tuple(r) for r in line_dedup.without_boilerplate(docs, large).collect()}
    assert all("Menu" not in r[1] for r in a)


URLS = [
    (1, "https://EXAMPLE.org/es/x", "example.org", "/es/x", "example.org/es/", "block"),
    (2, "http://a.example.org/en/15?q#f", "a.example.org", "/en/15", "example.org/en/1", "block"),
    (3, "http://b.org/", "b.org", "/", "org/", "allow"),
    (4, "http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    (5, "http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
    (6, "http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
    (7, "http://b.org", "b.org", "", None, None),
    (8, "no scheme/de/", "", "", None, None),
    (9, None, "", "", None, None),
    (10, "x://y://z/a", "y:", "//z/a", None, None),
    (11, "http://ÄB.Com?x/de/", "Äb.com", "", None, None),
    (12, "http://com/de/", "com", "/de/", "com/de/", "block"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", 0.5) for i, u, *_ in URLS] * 2, "page_id long, url string, host string, score double")
    got = url_filter.judge(pages, url_filter.fit(spark))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    rows = got.collect()
    assert len(rows) == 2 * len(URLS)
    by_id = {r.page_id: r for r in rows}
    for i, _, host, path, rule, verdict in URLS:
        r = by_id[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def test_url_model_learns_and_is_native(spark):
    model = url_filter.fit(spark)
    pages = spark.createDataFrame(
        [(1, "https://ads.tracker.example.net/click"), (2, "https://blog.reading.example.net/en/31"), (3, "http://" + "a" * 100_000)],
        "page_id long, url string",
    )
    judged = url_filter.judge(pages, model)
    rows = {r.page_id: r for r in judged.collect()}
    assert rows[1].verdict == "block" and rows[2].verdict == "allow" and len(rows[3].host) == 100_000
    assert not re.search("Python|Arrow|Pandas", judged._jdf.queryExecution().toString())
    assert url_filter.judge(pages.limit(0), model).count() == 0


def _terms(line):
    return re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", line.lower())


def _brute(files):
    """License and cosine of each file's best notice, by the book."""
    cue = re.compile(licenses._CUE)
    lines = [(f, x) for f, t in files for x in (t or "").split("\n") if cue.search(x)]
    corpus = [x for _, x in lines] + [x for _, x in licenses.TEMPLATES]
    df = Counter(t for x in corpus for t in set(_terms(x)))
    idf = {t: math.log((len(corpus) + 1) / (n + 1)) + 1 for t, n in df.items()}
    vector = lambda x: {t: n * idf[t] for t, n in Counter(_terms(x)).items()}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    best = {}
    for f, x in lines:
        v = vector(x)
        for name, template in licenses.TEMPLATES:
            u = vector(template)
            c = sum(w * u.get(t, 0) for t, w in v.items()) / (norm(v) * norm(u)) if v else 0
            if c >= licenses.COSINE:
                best[f] = min(best.get(f, (0, "")), (-round(c, 9), name))
    return best


FILES = [
    ("a/LICENSE", "Licensed under the Apache License, Version 2.0."),
    ("a/b/one.txt", "some text\nmore text about nothing"),
    ("a/b/two.txt", "long prose here and there, much more than the notice itself is long, on and on it goes\nReleased under the MIT License.\nmore prose of that kind"),
    ("a/b/c/COPYING.md", "This work is licensed under the GNU General Public License, version 3."),
    ("a/b/c/d/deep.txt", "text"),
    ("z/alone.txt", "text\ncopyright of somebody else entirely and nobody knows"),
    ("top.txt", ""),
    ("n/null.txt", None),
]


@pytest.fixture(scope="module")
def scanned(spark):
    files = spark.createDataFrame([(p, t, "x", 1.0) for p, t in FILES], "path string, text string, license string, cosine double")
    return {r.path: r for r in licenses.scan(files).collect()}


def test_licences_match_brute_force(scanned):
    brute = _brute(FILES)
    own = {p: (-r.cosine, r.license) for p, r in scanned.items() if r.origin == "own"}
    assert own.keys() == brute.keys()
    for path, (cosine, name) in brute.items():
        assert own[path][1] == name and own[path][0] == pytest.approx(cosine, abs=1e-6)


def test_licences_come_from_the_nearest_directory_above(scanned):
    assert len(scanned) == len(FILES)
    assert (scanned["a/b/one.txt"].license, scanned["a/b/one.txt"].from_directory) == ("Apache-2.0", "a")
    assert scanned["a/b/two.txt"].origin == "own" and scanned["a/b/two.txt"].license == "MIT"
    assert (scanned["a/b/c/d/deep.txt"].license, scanned["a/b/c/d/deep.txt"].origin) == ("GPL-3.0", "inherited")
    for path in ("z/alone.txt", "top.txt", "n/null.txt"):
        assert scanned[path].license is None and scanned[path].origin is None


def test_licences_of_odd_files(spark):
    rows = [(None, "Released under the MIT License."), ("x", "Released under the MIT License."), ("x", "Released under the MIT License."), ("y", None), ("w", "word " * 200_000)]
    got = defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect():
        got[r.path].append(r)
    assert sorted(got) == ["w", "x", "y"] and all(len(v) == 1 for v in got.values())
    assert got["x"][0].origin == "own" and got["y"][0].origin == "inherited"  # "x" is a licence file of the root
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0
