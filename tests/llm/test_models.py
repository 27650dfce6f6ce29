"""Classifiers, decontamination, pieces and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from textrisk.llm import decontaminate, minhash, pieces, quality, toxicity
from textrisk.llm.labelled import Sample, held_out, sample
from textrisk.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)


# Labelled sample


def test_sample_is_bounded_and_leaves_the_held_out_alone(spark):
    docs = _docs(spark, [(i, f"text {i}") for i in range(400)] + [(3, "another text 3"), (None, "x")])
    labels = spark.createDataFrame(
        [(i, int(i % 10 == 0)) for i in range(400)] + [(None, 1), (5, None), (5, 7), (10_000, 1)], "doc_id long, toxic int"
    )
    got = sample(docs, labels, "toxic", 20, 100)
    ids = {int(t.split()[-1]) for t in got.texts}
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    assert len(got.texts) == len(ids) <= 40 and (got.labels == 0).sum() == 20
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    share = sum(i % 10 == 0 for i in free) / len(free)
    assert (got.weights * got.labels).sum() / got.weights.sum() == pytest.approx(share, abs=0.02)
    assert sample(docs, labels.limit(0), "toxic", 20, 100).texts == []
    assert docs.where(held_out("doc_id")).count() == sum(not zlib.crc32(str(i).encode()) % 5 for i in [*range(400), 3])


# Toxicity


def _toxic_sample():
    rng = random.Random(2)
    clean = ["the house stands near a quiet river bank and many people walk there every morning".split()] * 1
    words = clean[0] + [f"w{rng.choice('aeiou')}{rng.choice('bcdfg')}{rng.choice('lmnr')}" for _ in range(60)]
    texts, labels = [], []
    for k in range(240):
        body = [rng.choice(words) for _ in range(40)]
        if k % 3 == 0:
            for _ in range(3):
                body[rng.randrange(40)] = rng.choice(["blockhead", "nitwit", "scoundrel"])
        texts.append(" ".join(body))
        labels.append(float(k % 3 == 0))
    return Sample(texts, np.array(labels), np.ones(240))


@pytest.fixture(scope="module")
def toxic_model():
    return toxicity.train(_toxic_sample(), epochs=20)


def test_misspelt_words_score_like_the_words_they_stand_for(toxic_model):
    for word, misspelt in (("blockhead", "blockheadd"), ("scoundrel", "scooundrel")):
        assert toxic_model.word(misspelt) > 0.25 * toxic_model.word(word) > 0
    assert toxic_model.word("blockhead") > 5 * abs(toxic_model.word("morning"))


def test_words_are_read_to_their_end(spark, toxic_model, monkeypatch):
    lead = "house_river_" * 10
    assert toxic_model.word(lead + "blockhead") > toxic_model.word(lead + "morning") + 1e-6
    long = lead * 50 + "blockhead"
    whole, grams = toxic_model.word(long), sorted(toxicity.buckets(long))
    assert len(grams) == sum(len(long) + 3 - n for n in toxicity.SIZES) + 1
    monkeypatch.setattr(toxicity, "BLOCK", 100)
    assert sorted(toxicity.buckets(long)) == grams and toxic_model.word(long) == pytest.approx(whole)
    # Learned from as well: insults that stand only after the 64th character of a run.
    texts = [lead + (rng_word + "_blockhead" if k % 2 else rng_word + "_morning") for k, rng_word in enumerate(f"w{i}" for i in range(60))]
    model = toxicity.train(Sample(texts, np.array([float(k % 2) for k in range(60)]), np.ones(60)), epochs=20)
    scores = [r.s for r in _docs(spark, list(enumerate(texts))).select("doc_id", toxicity.score("text", model).alias("s")).orderBy("doc_id").collect()]
    assert min(scores[1::2]) > max(scores[0::2])


def test_toxic_texts_go_and_odd_ones_stay(spark, toxic_model):
    found = _toxic_sample()
    rows = list(enumerate(found.texts)) + [(1000, None), (1001, ""), (1002, "...!"), (None, found.texts[1]), (1003, (found.texts[1] + " ") * 2_000)]
    docs = _docs(spark, rows).selectExpr("*", "1 as score", "2 as words")
    kept = toxicity.without_toxic(docs, toxic_model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    right = sum((i in ids) == (label == 0) for i, label in enumerate(found.labels))
    assert right >= 0.97 * len(found.texts) and {1000, 1001, 1002, None, 1003} <= ids
    assert toxicity.without_toxic(docs, None).count() == len(rows) and toxicity.train(Sample([], np.zeros(0), np.zeros(0))) is None
    assert toxicity.without_toxic(docs.limit(0), toxic_model).count() == 0


# Quality


def test_quality_learns_from_bags(spark):
    rng = random.Random(6)
    good = lambda n: " ".join("".join(rng.choice("abcdefgh ") for _ in range(6)) for _ in range(n))
    bad = lambda n: "".join(rng.choice("$%&#|!ABC ") for _ in range(n * 7))
    texts = [good(200) if k % 2 else good(120) + bad(90) for k in range(200)]
    labels = np.array([float(k % 2) for k in range(200)])
    model = quality.train(Sample(texts, labels, np.ones(200)), epochs=20)
    scores = quality.score_texts(pa.array(texts), model)
    assert ((scores >= 0.5) == labels).mean() > 0.97
    # Attention: the passages of symbols decide.
    x = quality.features(np.frombuffer((good(70) + " ")[:512].encode().ljust(512) + bad(80)[:512].encode(), np.uint8), np.array([512, 512]))
    _, weight = model.encode(x)
    assert weight[1] > weight[0]
    odd = _docs(spark, [(1, ""), (2, None), (None, good(10)), (3, "é" * 300_000), (1, "")])
    rows = quality.scored(odd, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert quality.scored(odd.limit(0), model).count() == 0 and {r.score for r in quality.scored(odd, None).collect()} == {0.0}


def test_blocks_do_not_change_a_score(monkeypatch):
    rng = np.random.default_rng(1)
    shapes = [(quality.FEATURES, 32), (32,), (32, 16), (32, 16), (16,), (32,), (1,)]
    model = quality.Model(*[rng.normal(0, 0.3, s).astype(np.float32) for s in shapes])
    texts = pa.array(["ab c." * 700, "", None, "Ünï" * 999, "x"])
    whole = quality.score_texts(texts, model)
    monkeypatch.setattr(quality, "BLOCK", 3)
    assert np.allclose(quality.score_texts(texts, model), whole, atol=1e-6)
    assert np.allclose(quality.score_texts(texts.slice(3, 2), model), whole[3:], atol=1e-6)


@pytest.mark.parametrize("name, target, floor", [("op2_quality", "quality", 0.9), ("op9_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, target, floor):
    scored = QUERIES[name](spark, MEDIUM)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", target)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r[target] for r in rows) / len(rows) >= floor


# Decontamination


ITEMS = [
    (1, "A farmer named Tom has 12 apples and gives 5 apples to Anna. How many apples does Tom keep for himself in the end?"),
    (2, "the quick brown fox jumps over the lazy dog while seven swans are swimming by the lake"),
    (3, "tiny one"),
    (4, ""),
    (5, None),
]


def _found(spark, texts, items=ITEMS):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(_docs(spark, texts), benchmark).collect()}


def test_verbatim_items_are_found_whatever_their_slots(spark):
    tale = ITEMS[0][1] + " He sells 5 plums, 7 pears and 9 figs to the old baker who lives near the small bridge over the river."
    items = [(1, "What is 12 + 30 / 4 - 7?"), (2, tale), (3, "Name three rivers that cross 12 borders"), (4, "Sort these words by length and read them. Then count 6")]
    texts = [
        (1, "we ask: what is 12 + 30 / 4 - 7? nobody knows"),
        (2, tale.replace("sells 5", "sells 6")),  # one of two equal numbers
        (3, "Q: Name three rivers that cross 12 borders"),
        (4, "Q: Name three rivers that cross 15 borders"),
        (5, "what is 13 + 30 / 4 - 7 ?"),
        (6, "Name tall hills that cross 12 borders"),
    ]
    got = {(r.doc_id, r.item_id): (round(r.coverage, 2), r.exact) for r in decontaminate.contaminated(
        _docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.keys() == {(1, 1), (2, 2), (3, 3), (4, 3)}
    assert got[1, 1] == (1.0, True) and got[2, 2][1] and got[3, 3] == (1.0, True) and got[4, 3] == (1.0, False)


def test_items_are_found_with_other_values(spark):
    other = ITEMS[0][1].replace("Tom", "Bob").replace("12", "31").replace(" 5 ", " 9 ").replace("Anna", "Ruth")
    mixed = ITEMS[0][1].replace("named Tom", "named Bob").replace("does Tom", "does Jim")
    texts = [
        (1, f"intro words here. {ITEMS[0][1]} trailing words"),
        (2, f"Intro here. {other} And so on."),
        (3, f"Intro here. {mixed}"),
        (4, "nothing of the kind is told in this text, not a word of it, as anyone can see"),
        (5, f"x {ITEMS[1][1].upper()} y"),
        (6, "tiny one"),
        (7, ""),
        (8, None),
        (9, "word " * 100_000 + ITEMS[1][1]),
        (9, "a repeated row"),
        (None, ITEMS[1][1]),
    ]
    got = _found(spark, texts)
    assert set(got) == {(1, 1), (2, 1), (5, 2), (6, 3), (9, 2)}
    assert got[1, 1].exact and not got[2, 1].exact and got[1, 1].coverage == 1.0


def test_windows_that_the_filter_lets_through_by_chance_do_not_count(spark, monkeypatch):
    texts = [(1, f"a b c {ITEMS[1][1]}"), (2, "quite another text with many words in it that nobody has asked for")]
    plain = _found(spark, texts)
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 3)
    assert _found(spark, texts).keys() == plain.keys() == {(1, 2)}


def test_decontamination_of_empty_tables(spark):
    assert _found(spark, [(1, "some text")], []) == {}
    docs = _docs(spark, [(1, "some text"), (None, None)]).selectExpr("*", "1 as id", "2 as item_id", "3 as hash")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.without_benchmark(docs, none).count() == 2
    some = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.without_benchmark(docs, some)
    assert kept.columns == docs.columns and kept.count() == 2
    assert decontaminate.without_benchmark(docs.limit(0), some).count() == 0


def test_planted_items_are_found(spark):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_decontaminate"](spark, MEDIUM).collect()}
    items = spark.read.parquet(f"{MEDIUM}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()
    assert got >= {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    assert len(got) < 0.1 * len(docs)


# Pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def _brute(vocabulary, text):
    """Best sum of scores by trying every piece at every place."""
    best = [0.0] + [-np.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - vocabulary.longest), j):
            score = vocabulary.scores.get(text[i:j], vocabulary.fallback if j - i == 1 else -np.inf)
            best[j] = max(best[j], best[i] + score)
    return best[-1]


def _sum(vocabulary, ids):
    names = {i: vocabulary.scores[p] for p, i in vocabulary.ids.items()}
    data = b"".join(vocabulary.surface[i] for i in ids if i not in names)
    return sum(names[i] for i in ids if i in names) + vocabulary.fallback * len(data.decode())


def _texts(rng, n):
    alphabet = list("abethein    \n▁é😀.,")
    for k in range(n):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 150)))
        yield text.replace(" ", "") if k % 3 == 0 else text


def test_chunks_combine_to_the_best_segmentation(vocabulary):
    rng = random.Random(3)
    known = pieces._Segments(vocabulary)
    for text in _texts(rng, 60):
        full, size = " " + text, rng.choice([16, 17, 23, 40])
        chunks = [pieces.Chunk(full[c : c + size], full[c + size : c + size + 15], vocabulary) for c in range(0, len(full), size)]
        matrices = np.stack([c.matrix(known) for c in chunks])
        states = pieces.borders(matrices)
        ids = [i for c, a, b in zip(chunks, states[:-1], states[1:]) for i in c.ids(int(a), int(b), known)]
        whole = matrices[0]
        for m in matrices[1:]:
            whole = pieces.combine(whole, m)
        best = _brute(vocabulary, full)
        assert whole[0, 0] == best == _sum(vocabulary, ids) == _sum(vocabulary, vocabulary.segment(full))
        assert vocabulary.decode(ids) == text


def test_encode_gives_back_every_text(spark, vocabulary):
    rng = random.Random(4)
    texts = list(_texts(rng, 30)) + ["a" * 5000, " " * 500, "word " * 3000, "", None, "ok", "ok"]
    docs = _docs(spark, [(i, t) for i, t in enumerate(texts)] + [(None, "b" * 200)]).selectExpr("*", "1 as ids", "2 as key")
    for chunk in (16, 64, 16_384):
        rows = pieces.encode(docs, vocabulary, chunk=chunk).collect()
        assert len(rows) == len(texts) + 1
        for r in rows:
            text = "b" * 200 if r.doc_id is None else texts[r.doc_id]
            assert r.decoded == text
            assert (r.ids is None) == (text is None)
            if text is not None:
                assert r.n_tokens == len(r.ids) and r.n_chars == len(text)
                assert _sum(vocabulary, r.ids) == _brute(vocabulary, " " + text)
    assert pieces.encode(docs.limit(0), vocabulary).count() == 0
    with pytest.raises(ValueError):
        pieces.encode(docs, vocabulary, chunk=3)


# Pipeline


def test_each_stage_does_its_work(spark):
    """Stages against plain Python, each on what the one before left."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        after = stage(spark, docs, SMALL)
        old = {r.doc_id: r for r in before.collect()}
        new = {r.doc_id: r for r in after.collect()}
        assert new.keys() <= old.keys()
        if name != "pieces":
            assert after.columns == before.columns
        if name == "line dedup":
            assert new.keys() == old.keys() and all(r.n_chars == len(r.text) for r in new.values())
        elif name == "near duplicates":
            classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(before).collect()}
            assert set(new) == set(classes.values()) and len(new) < len(old)
        elif name == "benchmark decontamination":
            items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert not any(i in r.text for r in new.values() for i in items)
            assert len(new) >= 0.9 * len(old)
        elif name == "toxicity":
            assert len(new) >= 0.8 * len(old)
        else:
            assert all(new[i].decoded == old[i].text for i in old) and new.keys() == old.keys()
        docs = spark.createDataFrame(list(new.values()), after.schema)


def test_run_is_the_stages_in_turn(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows) and all(r.decoded is not None for r in rows)


def test_stages_of_odd_documents(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, None), (3, "word " * 50_000), (4, "plain text of a few words")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        assert stage(spark, docs, SMALL).count() >= 4


def test_training_leaves_the_driver_small():
    """The training matrix is two arrays that go back to the system, not arrays of each text."""
    texts = [" ".join(f"w{(k * i) % 9973}" for i in range(300)) for k in range(1, 41)] + ["", None]
    rows = toxicity._matrix(texts)
    assert rows.index.dtype == np.int32 and rows.share.dtype == np.float32 and rows.cuts[-2] == rows.cuts[-1]
    assert (rows.n_texts == np.bincount(rows.index, minlength=toxicity.BUCKETS)).all()
    index, share, cuts = rows.index.copy(), rows.share.copy(), rows.cuts
    assert np.allclose([share[a:b].sum() for a, b in zip(cuts[:40], cuts[1:41], strict=True)], 1, atol=1e-4)
    common = rows.n_texts >= 8
    rows.learnable(common)
    for k in range(len(texts)):
        kept = common[index[cuts[k] : cuts[k + 1]]]
        span = slice(rows.cuts[k], rows.cuts[k + 1])
        assert (np.flatnonzero(common)[rows.index[span]] == index[cuts[k] : cuts[k + 1]][kept]).all()
        assert (rows.share[span] == share[cuts[k] : cuts[k + 1]][kept]).all()


def test_stages_hand_small_batches_to_python(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(2000).selectExpr("id AS doc_id", "'a text' AS text")

    def largest() -> int:
        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

        return spark.range(0, 2000, 1, 1).mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]

    try:
        spark.conf.set(key, "10000")
        corpus_pipeline.tokenize(spark, docs, "")
        assert largest() <= corpus_pipeline.BATCH_ROWS
        spark.conf.set(key, "100")
        corpus_pipeline.tokenize(spark, docs, "")
        assert largest() <= 100
    finally:
        spark.conf.set(key, before)
