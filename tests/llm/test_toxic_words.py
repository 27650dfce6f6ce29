from __future__ import annotations

import zlib

import numpy as np
import pytest

from textrisk.llm import toxicity


@pytest.mark.parametrize("word", ["a", "ab", "idiot", "größe", "слово", "naïve_1", "x" * 40_000, "é" * 20_000])
def test_words_cut_as_bytes_or_characters_have_the_same_buckets(word):
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in toxicity.SIZES for i in range(len(marked) - n + 1)] + [word]
    expected = [zlib.crc32(g.encode()) % toxicity.BUCKETS for g in grams]
    assert sorted(toxicity.buckets(word)) == sorted(expected)
    weights = np.random.default_rng(1).normal(0, 1, toxicity.BUCKETS)
    assert abs(toxicity.Model(weights, 0.0, 0.0).word(word) - weights[expected].mean()) < 1e-12


def test_words_hashed_together_score_like_each_alone():
    model = toxicity.Model(np.random.default_rng(3).normal(size=toxicity.BUCKETS), 0.0, 0.0)
    words = ["a", "ab", "plain", "é", "straße", "日本語", "a😀b", "_1", "x" * 70, "ü" * 70, *(f"w{i}ä"[: 2 + i % 3] + str(i) for i in range(300))]
    assert np.allclose(model.words(words), [model.word(w) for w in words], rtol=0, atol=1e-12)
    assert len(model.words([])) == 0


def test_rare_words_do_not_push_out_frequent_ones(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 40)
    monkeypatch.setattr(toxicity, "HASHED", 30)
    model = toxicity.Model(np.random.default_rng(3).normal(size=toxicity.BUCKETS), 0.0, 0.0)
    asked = []
    alone = toxicity.Model.words
    monkeypatch.setattr(toxicity.Model, "words", lambda self, words: asked.extend(words) or alone(self, words))
    known = toxicity._Scores(model)
    for i in range(100):
        texts = [["often", f"rare{i}", "y" * 80]]
        known.learn(texts)
        assert [known[w] for w in texts[0]] == pytest.approx([model.word(w) for w in texts[0]])
        assert len(known) + len(known.before) <= 44
    assert asked.count("often") == 1 and len(asked) == 101
