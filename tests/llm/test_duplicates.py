"""MinHash, fingerprints and the suffix array against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textrisk.llm import imatch, minhash, suffix
from textrisk.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)


def _prose(rng, n):
    return " ".join(rng.choice("abcdefgh") + rng.choice("aeiou") + str(rng.randrange(400)) for _ in range(n))


def _edit(rng, text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    """Copies, a group of near copies around one text, chains, a passage that many share, short and empty texts."""
    rng = random.Random(5)
    texts = [_prose(rng, rng.randrange(60, 200)) for _ in range(60)]
    base = _prose(rng, 200)
    texts += [base] + [_edit(rng, base, 4) for _ in range(30)]
    chain = [_prose(rng, 150)]
    for _ in range(6):
        chain.append(_edit(rng, chain[-1], 2))
    texts += chain
    shared = _prose(rng, 70)
    texts += [f"{_prose(rng, 30)} {shared} {_prose(rng, 30)}" for _ in range(30)]
    texts += [texts[0]] * 12 + ["", "", "one two", "one two", "one  TWO", "three four five six seven", "   "]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


def _likeness(a, b):
    """Probability Jaccard similarity as it is defined."""
    def bag(t):
        w = (t or "").lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    x, y = bag(a), bag(b)
    return sum(
        1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys()
    )


def test_likeness_is_the_probability_jaccard(corpus):
    rng = random.Random(1)
    for _ in range(40):
        a = " ".join(rng.choice("xyz") for _ in range(rng.randrange(1, 40)))
        b = _edit(rng, a, 1) if rng.random() < 0.5 else " ".join(rng.choice("xyz") for _ in range(rng.randrange(1, 40)))
        sets = []
        for t in (a, b):
            values = np.array([int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in t.split()], np.int64)
            h, _, c = minhash.weighted(*minhash.windows(values, np.array([len(values)]), 5)[:2])
            sets.append((h, c))
        assert minhash.likeness(*sets) == pytest.approx(_likeness(a, b), abs=1e-9)


def test_signatures_estimate_it(corpus):
    rng = random.Random(2)
    a = " ".join(rng.choice("uvwxyz") for _ in range(150))
    b = _edit(rng, a, 6)
    values = [np.array([hash(w) for w in t.split()], np.int64) for t in (a, b)]
    hashes, owner, _ = minhash.windows(np.concatenate(values), np.array([150, 150]), 5)
    signed = minhash.signatures(*minhash._distinct(hashes, owner), 2, 4096)
    assert (signed[0] == signed[1]).mean() == pytest.approx(_likeness(a, b), abs=0.04)
    # A text's signature does not depend on what is signed with it.
    alone = minhash.signatures(*minhash._distinct(*minhash.windows(values[1], np.array([150]), 5)[:2]), 1, 4096)
    assert (alone[0] == signed[1]).all()


def test_classes_match_brute_force(spark, corpus):
    got = {r.doc_id: r for r in minhash.near_duplicates(_docs(spark, corpus)).collect()}
    root = {i: i for i, _ in corpus}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(corpus, 2):
        if a == b or (a.strip() and b.strip() and _likeness(a, b) >= 0.8):
            low, high = sorted((find(i), find(j)))
            root[high] = low
    assert {i: r.class_id for i, r in got.items()} == {i: find(i) for i, _ in corpus}
    assert sum(r.n_links > 0 for r in got.values()) > 30


def test_satellites_of_members_of_a_hot_group(spark):
    """Each satellite is like one member of a group of 1,500, and not like its centre."""
    rng = random.Random(11)
    base = _prose(rng, 200).split()

    def changed(words, places):
        out = list(words)
        for p in places:
            out[p] = f"edit{rng.randrange(10**9)}"
        return out

    group = [changed(base, [rng.randrange(5, 195)]) for _ in range(1500)]
    satellites = []
    for k in range(20):
        own = next(i for i in range(200) if group[k][i] != base[i])
        free = [p for p in range(5, 195, 7) if abs(p - own) > 5]
        satellites.append(changed(group[k], rng.sample(free, 4)))
        assert _likeness(" ".join(satellites[k]), " ".join(base)) < 0.8 <= _likeness(" ".join(satellites[k]), " ".join(group[k]))
    rows = list(enumerate(" ".join(t) for t in [base, *group, *satellites]))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(_docs(spark, rows)).collect()}
    assert got == dict.fromkeys(range(len(rows)), 0)


def test_one_of_each_class_stays(spark, corpus):
    docs = _docs(spark, corpus).selectExpr("*", "doc_id as class_id", "1 as doc", "text as band")
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    classes = {r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(classes)


def test_parities_never_rule_out_a_link(spark):
    rng = random.Random(11)
    texts = []
    for n in (6, 20, 60, 300):
        base = _prose(rng, n)
        texts += [base, f"{base} {base}", f"{base} {base} {base}"] + [_edit(rng, base, k) for k in (1, 1, 2, 3, 4)]
        texts += [f"{base} {base.split()[0]}", " ".join(base.split()[: n * 5 // 6]), f"{base} {base} {_prose(rng, n // 3 + 1)}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    one = minhash.parities(rows).cache()
    other = one.toDF("o_doc", "o_parity", "o_n_runs")
    passes = minhash.reachable(("parity", "o_parity"), ("n_runs", "o_n_runs"), minhash.THRESHOLD)
    got = {(r.doc, r.o_doc) for r in one.join(other, (F.col("doc") < F.col("o_doc")) & passes).collect()}
    pairs = set(itertools.combinations(range(len(texts)), 2))
    links = {p for p in pairs if _likeness(texts[p[0]], texts[p[1]]) >= minhash.THRESHOLD}
    assert len(links) > 20 and links <= got and len(got) < len(pairs) / 3


def test_near_copies_just_apart_are_not_compared_pair_by_pair(spark, monkeypatch):
    """A group around a text that is not there: all share buckets, few pairs are alike enough."""
    rng = random.Random(12)
    base = _prose(rng, 200)
    texts = [_edit(rng, base, 3) for _ in range(60)]
    compared, compact = [], minhash.compact

    def counted(df, name):
        stored = compact(df, name)
        if name == "likeness":
            compared.append(stored.table.count())
        return stored

    monkeypatch.setattr(minhash, "compact", counted)
    got = {r.doc_id: r for r in minhash.near_duplicates(_docs(spark, list(enumerate(texts)))).collect()}
    links = [p for p in itertools.combinations(range(60), 2) if _likeness(texts[p[0]], texts[p[1]]) >= minhash.THRESHOLD]
    assert sum(compared) <= 1770 // 3
    least = {i: i for i in range(60)}
    for _ in range(60):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert sum(got[i].class_id != least[i] for i in range(60)) <= 1


def test_near_duplicates_of_odd_rows(spark):
    long = "w1 w2 w3 w4 w5 w6 " * 20_000
    rows = [(1, None), (2, None), (None, "a b c d e f"), (3, "a b c d e f"), (4, ""), (5, ""), (6, long), (7, long), (7, long), (8, " \n")]
    docs = _docs(spark, rows)
    got = sorted(((r.doc_id, r.class_id) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 2), (None, None), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6), (7, 6), (8, 8)], key=str)
    assert sorted((r.doc_id for r in minhash.one_of_each(docs).collect()), key=str) == sorted([1, 2, None, 3, 4, 6, 8], key=str)
    twice = _docs(spark, [(1, "a b"), (1, "a b"), (2, "c")])
    assert sorted(r.doc_id for r in minhash.one_of_each(twice).collect()) == [1, 2]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0 and minhash.one_of_each(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 4), (4, 3), (20, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).table.collect()}
    assert {got[i] for i in (1, 2, 3, 4, 5)} == {1} and got[11] == 10 and 20 not in got
    assert {got[i] for i in range(100, 141)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).table.count() == 0


def _passages(texts):
    """Words in runs of MIN_WORDS that another document has too, made one where they touch."""
    n = suffix.MIN_WORDS
    words = {i: (t or "").lower().split() for i, t in texts}
    where = {}
    for i, w in words.items():
        for k in range(len(w) - n + 1):
            where.setdefault(tuple(w[k : k + n]), set()).add(i)
    found = set()
    for i, w in words.items():
        spans = []
        for k in range(len(w) - n + 1):
            if len(where[tuple(w[k : k + n])]) > 1:
                if spans and spans[-1][1] >= k:
                    spans[-1][1] = k + n
                else:
                    spans.append([k, k + n])
        found |= {(i, a, b) for a, b in spans}
    return found


def test_passages_match_brute_force(spark):
    rng = random.Random(9)
    shared = [_prose(rng, n) for n in (50, 51, 64, 120, 300, 49, 40)]
    texts = [f"{_prose(rng, rng.randrange(0, 90))} {rng.choice(shared)} {_prose(rng, rng.randrange(0, 90))}" for _ in range(60)]
    texts += [_prose(rng, 200) for _ in range(20)] + [f"{shared[0]} {_prose(rng, 40)} {shared[2]}", shared[3], shared[3].upper()]
    own = _prose(rng, 60)
    texts += [f"{own} {own} {own}"]  # repeats itself only
    rows = list(enumerate(texts))
    docs = _docs(spark, rows).selectExpr("*", "1 as first", "2 as `left`", "3 as words")
    got = {tuple(r) for r in suffix.repeated_passages(docs).collect()}
    assert got == _passages(rows)


def test_passages_across_tasks(spark):
    """The few rows per task at the seams find each other too."""
    rng = random.Random(4)
    passage = _prose(rng, 80)
    rows = [(i, f"{_prose(rng, 10)} {passage} {_prose(rng, 10)}") for i in range(4)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        got = {tuple(r) for r in suffix.repeated_passages(_docs(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == _passages(rows)


def test_passages_of_odd_rows(spark):
    rng = random.Random(8)
    text = _prose(rng, 60)
    rows = [(1, text), (1, text), (2, None), (None, text), (3, ""), (4, "short"), (5, "same " * 100_000), (6, text + " x"), (7, "copy of a few words"), (8, "copy of a few words")]
    got = {tuple(r) for r in suffix.repeated_passages(_docs(spark, rows)).collect()}
    assert got == {(1, 0, 60), (6, 0, 60)}
    assert suffix.repeated_passages(_docs(spark, rows).limit(0)).count() == 0


def test_lexicon_counts_all_documents(spark):
    rng = random.Random(3)
    texts = [" ".join({rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(8)}) for _ in range(300)]
    docs = _docs(spark, list(enumerate(texts))).repartition(7)
    band = (1.5, 3.0)
    counts = Counter(t for x in texts for t in imatch.terms(x))
    wanted = {imatch.term_number(t) for t, n in counts.items() if 300 * np.exp(-3.0) <= n <= 300 * np.exp(-1.5)}
    assert set(imatch.lexicon(docs, band=band).numbers.tolist()) == wanted and wanted
    assert imatch.terms("Ab, ab_c É-é") == {b"ab", b"ab_c", "é".encode()}


def test_fingerprint_report(spark, corpus):
    docs = _docs(spark, corpus).repartition(5)
    found = imatch.lexicon(docs, band=(0.5, 5.0))
    got = {r.doc_id: r for r in imatch.edit_report(docs, found).collect()}
    texts, order = dict(corpus), sorted((i for i, _ in corpus), reverse=True)
    prints = imatch.Fingerprints(found)
    for k, i in enumerate(order):
        following = order[(k + 1) % len(order)]
        n = len(texts[i]) // 3
        edited = texts[i][: len(texts[i]) - n] + texts[following][:n]
        own, new, others = prints.of(texts[i]), prints.of(edited), prints.of(texts[following])
        r = got[i]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == prints.packed(own, texts[i]).hex() and r.edited_fingerprint == prints.packed(new, edited).hex()
        assert r.near_edited == imatch.likeness(own, new, texts[i] == edited)
        assert r.near_next == imatch.likeness(own, others, texts[i] == texts[following])
    same = {}
    for i, t in corpus:
        assert same.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert {r.doc_id: r.fingerprint for r in imatch.fingerprint(docs, found).collect()} == {i: r.fingerprint for i, r in got.items()}


def test_fingerprint_report_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, "äö€😀 word"), (None, "x"), (3, "y " * 100_000)]
    docs = _docs(spark, rows)
    got = imatch.edit_report(docs, imatch.lexicon(docs)).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 1, 9, 200_000]
    alone = imatch.edit_report(docs.limit(1), imatch.lexicon(docs.limit(1))).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0 and alone[0].near_edited == 1.0
    assert imatch.edit_report(docs.limit(0), imatch.lexicon(docs.limit(0))).count() == 0


def test_few_rows_take_few_tasks(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    context = spark.sparkContext
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "100")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        context.setJobGroup("few-rows", "components of few rows")
        found = connected_components(edges)
        tracker = context.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("few-rows")]
        stages = [tracker.getStageInfo(s) for s in {s for j in jobs for s in j.stageIds}]
        assert sum(s.numCompletedTasks for s in stages if s) < 500
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {r.component for r in found.table.collect()} == {0} and found.table.count() == 41
