"""Mixing sources: against plain Python, and on odd input."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from textrisk.llm import mix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def _brute_targets(sizes: dict, weights=mix.WEIGHTS, repeats=mix.MAX_REPEATS) -> dict:
    """Targets by resharing the excess over and over."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = sum(sizes.values())
    capped: dict = {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        level = rest / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > repeats * sizes[s]]
        if not over:
            return {s: float(capped[s]) if s in capped else weight[s] * level for s in names}
        for s in over:
            capped[s] = repeats * sizes[s]


def _brute_apportion(weights: list[float], seats: int) -> list[int]:
    quotients = sorted((-w / (2 * k + 1), i, k) for i, w in enumerate(weights) if w > 0 for k in range(seats))
    got = [0] * len(weights)
    for _, i, _ in quotients[:seats]:
        got[i] += 1
    return got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_apportion_is_highest_quotients(spark, seed):
    rnd = random.Random(seed)
    groups = []
    for g in range(4):
        n = rnd.randint(1, 9)
        weights = [float(rnd.choice([0, rnd.randint(1, 50), rnd.randint(1, 5000)])) for _ in range(n)]
        groups.append((g, weights, rnd.randint(0, 300)))
    rows = [(g, u, w, seats) for g, weights, seats in groups for u, w in enumerate(weights)]
    df = spark.createDataFrame(rows, "g int, u int, w double, seats long")
    got = {(r.g, r.u): r.quota for r in mix.apportion(df, ["g"], ["u"], "w", "seats").collect()}
    for g, weights, seats in groups:
        want = _brute_apportion(weights, seats) if any(weights) else [0] * len(weights)
        assert [got[(g, u)] for u in range(len(weights))] == want


def test_equal_quotients_go_to_the_first_unit(spark):
    df = spark.createDataFrame([(1, "b", 3.0, 3), (1, "a", 3.0, 3)], "g int, u string, w double, seats long")
    got = {r.u: r.quota for r in mix.apportion(df, ["g"], ["u"], "w", "seats").collect()}
    assert got == {"a": 2, "b": 1}


def test_targets_equal_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 0, None: 300, "é": 40, "Z": 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mix.targets(df).collect()}
    want = _brute_targets(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=1e-12, abs=1e-9)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def _check_mix(rows, got, block_words):
    sizes = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    per_source = defaultdict(int)
    for r in got:
        assert r.size == sizes[r.doc_id]
        assert 0 <= r.taken <= mix.MAX_REPEATS * r.size
        per_source[r.source] += r.taken
    source_sizes = defaultdict(int)
    for i, t, s in rows:
        source_sizes[s] += sizes[i]
    targets = _brute_targets(dict(source_sizes))
    blocks = (sum(source_sizes.values()) + block_words // 2) // block_words
    names = sorted(source_sizes, key=lambda s: (s is None, s or ""))
    quotas = _brute_apportion([targets[s] for s in names], blocks)
    for s, q in zip(names, quotas):
        assert per_source[s] == min(q * block_words, mix.MAX_REPEATS * source_sizes[s])
        assert abs(per_source[s] - targets[s]) <= block_words * len(names)
    for r in got:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == source_sizes[r.source]


def test_mix_takes_each_source_by_its_quota(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        source = rnd.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"])
        rows.append((i, " ".join("w" for _ in range(rnd.randint(0, 60))), source))
    got = mix.mix(_docs(spark, rows), block_words=50, shard_rows=30).collect()
    assert len(got) == 400
    _check_mix(rows, got, 50)
    again = mix.mix(_docs(spark, rows), block_words=50, shard_rows=30).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mix_odd_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "\t a\u00a0b c\n", "a"), (3, "\t a\u00a0b c\n", "a"), (4, "x " * 30000, "b"), (5, "y", None)]
    docs = _docs(spark, rows).selectExpr("*", "1 as size", "'z' as taken", "2 as _sid")
    got = mix.mix(docs, block_words=7, shard_rows=2).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 3, 4, 5]
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].size == 0 and by_id[1].taken == 0 and by_id[2].taken == 0
    assert by_id[3].size == 2 and by_id[4].size == 30000  # a no-break space is no blank
    _check_mix([(i, t, s) for i, t, s in rows if i != 3] + [(3, rows[2][1], "a")] * 2, got, 7)
    assert mix.mix(docs.limit(0)).count() == 0
