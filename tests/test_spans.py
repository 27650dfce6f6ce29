from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from textrisk.functions.patterns import RULES, Rule
from textrisk.functions.spans import candidate_spans, detect, redact
from textrisk.operators.findings import explode_spans, with_spans
from textrisk.plans.analyze import analyze

GOLDEN = [
    # text, spans, score, label, redacted, matches before overlaps are resolved
    ("Ask wren.b@north.example about it.", [("EMAIL", 4, 24)], 25, 1, "Ask [REDACTED:EMAIL] about it.", 1),
    ("Ring 628-555-0177 at noon.", [("PHONE", 5, 17)], 25, 1, "Ring [REDACTED:PHONE] at noon.", 1),
    ("Read https://bread.example/otis@bread.example today.", [("URL", 5, 45)], 5, 0, "Read [REDACTED:URL] today.", 2),
    ("ID 078-05-1120 or 5500 0000 0000 0004", [("SSN", 3, 14), ("CREDIT_CARD", 18, 37)], 100, 1, "ID [REDACTED:SSN] or [REDACTED:CREDIT_CARD]", 2),
    ("Post to mina@south.example, else 628-555-0100", [("EMAIL", 8, 26), ("PHONE", 33, 45)], 50, 1, "Post to [REDACTED:EMAIL], else [REDACTED:PHONE]", 2),
    ("+1 (415) 555-1234", [("PHONE", 4, 17)], 25, 1, "+1 ([REDACTED:PHONE]", 1),
    ("x+1 415 555 1234", [("PHONE", 1, 16)], 25, 1, "x[REDACTED:PHONE]", 1),
    ("1.2.3.4.5.6.7.8", [("IPV4", 0, 7), ("IPV4", 8, 15)], 20, 0, "[REDACTED:IPV4].[REDACTED:IPV4]", 2),
    ("1234567890123456", [("CREDIT_CARD", 0, 16)], 60, 1, "[REDACTED:CREDIT_CARD]", 1),
    ("12-12-2020-1234", [("DOB", 0, 10)], 15, 0, "[REDACTED:DOB]-1234", 1),
    ("12/25/1990", [("DOB", 0, 10)], 15, 0, "[REDACTED:DOB]", 1),
    ("555 Elm Street", [("ADDRESS_HINT", 0, 14)], 15, 0, "[REDACTED:ADDRESS_HINT]", 1),
    ("123 main st near 10.0.0.1", [("ADDRESS_HINT", 0, 11), ("IPV4", 17, 25)], 25, 1, "[REDACTED:ADDRESS_HINT] near [REDACTED:IPV4]", 2),
    ("see https://a.b/c).", [("URL", 4, 17)], 5, 0, "see [REDACTED:URL]).", 1),
    ("a@b.co,c@d.io", [("EMAIL", 0, 6), ("EMAIL", 7, 13)], 50, 1, "[REDACTED:EMAIL],[REDACTED:EMAIL]", 2),
    ("mailto http://x.y/1?t=4155551234&u=a@b.co end", [("URL", 7, 41)], 5, 0, "mailto [REDACTED:URL] end", 3),
    ("4111-1111-1111-1111 5 Oak Rd", [("CREDIT_CARD", 0, 19)], 60, 1, "[REDACTED:CREDIT_CARD] 5 Oak Rd", 2),
    ("call 415-555-1234 Oak Rd", [("PHONE", 5, 17)], 25, 1, "call [REDACTED:PHONE] Oak Rd", 2),
    ("10 12/25/1990 Park Ave", [("ADDRESS_HINT", 9, 22)], 15, 0, "10 12/25/[REDACTED:ADDRESS_HINT]", 2),
    ("10 Mill St 20 Hill Rd", [("ADDRESS_HINT", 0, 21)], 15, 0, "[REDACTED:ADDRESS_HINT]", 1),
    ("999 123-45-6789 Elm St", [("SSN", 4, 15)], 60, 1, "999 [REDACTED:SSN] Elm St", 2),
    ("1234 5678 9012 3456 Elm St", [("ADDRESS_HINT", 0, 26)], 15, 0, "[REDACTED:ADDRESS_HINT]", 2),
    ("", [], 0, 0, "", 0),
    (None, [], 0, 0, None, 0),
    # Offsets count code points, and word characters beyond ASCII matter.
    ("😀😀 a@b.co", [("EMAIL", 3, 9)], 25, 1, "😀😀 [REDACTED:EMAIL]", 1),
    ("12 Straße Ave", [("ADDRESS_HINT", 0, 13)], 15, 0, "[REDACTED:ADDRESS_HINT]", 1),
    ("١٢٣-٤٥-٦٧٨٩", [("SSN", 0, 11)], 60, 1, "[REDACTED:SSN]", 1),
    ("x²415-555-1234", [], 0, 0, "x²415-555-1234", 0),
    ("mark ￿ a@b.co ￿ 1.2.3.4", [("EMAIL", 7, 13), ("IPV4", 16, 23)], 35, 1, "mark ￿ [REDACTED:EMAIL] ￿ [REDACTED:IPV4]", 2),
]


@pytest.fixture(scope="module")
def analyzed(spark):
    texts = [(i, row[0]) for i, row in enumerate(GOLDEN)]
    df = spark.createDataFrame(texts, "record_id int, text string")
    rows = analyze(df).withColumn("n", F.size(candidate_spans())).collect()
    return {r.record_id: r for r in rows}


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden(analyzed, i):
    text, spans, score, label, redacted, n_candidates = GOLDEN[i]
    row = analyzed[i]
    assert [(s.type, s.start, s.end) for s in row.spans] == spans
    assert [s.match for s in row.spans] == [text[a:b] for _, a, b in spans]
    assert (row.rule_score, row.y_risk, row.redacted_text, row.n) == (score, label, redacted, n_candidates)


def random_texts(n: int) -> list[str]:
    """Texts made of pieces that often form or nearly form personal data."""
    rng = random.Random(7)
    pieces = ["415", "555", "1234", "-", ".", " ", "/", "@", "a", "b.co", "http://", "https://x.y", "+1", "(", ")", "12", "1990",
              "Elm", "St", "road", "ſt", "é", "_", "😀", " ", "1.2.3.4", "123-45-6789", "4111 1111", "\n", "²", "￿", "٣"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_spans_hold_together_on_random_texts(spark):
    df = spark.createDataFrame([(t,) for t in random_texts(2000)], "text string")
    spans = detect()
    df = df.select("text", spans.alias("spans"), candidate_spans().alias("found"))
    df = df.withColumn("redacted", redact(F.col("text"), F.col("spans")))
    for row in df.collect():
        text, kept = row.text, row.spans
        assert all(text[s.start : s.end] == s.match for s in [*kept, *row.found])
        assert all(a.end <= b.start for a, b in zip(kept, kept[1:]))
        assert set(kept) <= set(row.found)
        # A match is only dropped for one that overlaps it, directly or in a chain.
        reach = 0
        for s in row.found:
            assert s in kept or s.start < reach or any(k.start < s.end and s.start < k.end for k in kept)
            reach = max(reach, s.end)
        assert row.redacted.count("[REDACTED:") == len(kept) + text.count("[REDACTED:")


def test_matches_agree_with_a_regex_engine_of_another_make(spark):
    """Python's own classes are Unicode-aware, like the spelled-out ones here."""
    import re

    plain = {
        "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
        "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
        "IPV4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
        "URL": r"\bhttps?://[^\s]+\b",
        "PHONE": r"\b(?:\+1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b",
    }
    texts = random_texts(2000)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rules = [r for r in RULES if r.name in plain]
    for row in df.select("i", candidate_spans("text", rules).alias("found")).collect():
        expected = {(k, m.start(), m.end()) for k, p in plain.items() for m in re.finditer(p, texts[row.i])}
        assert {(s.type, s.start, s.end) for s in row.found} == expected, texts[row.i]


def test_exploding_detects_only_once(spark):
    df = with_spans(spark.createDataFrame([("r", "a@b.co 1.2.3.4")], "record_id string, text string"))
    long = explode_spans(df)
    assert [(r.position, r.type) for r in long.collect()] == [(0, "EMAIL"), (1, "IPV4")]
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan


def test_rules_are_a_parameter(spark):
    df = spark.createDataFrame([("a@b.co 1.2.3.4",)], "text string")
    only_ip = [r for r in RULES if r.name == "IPV4"]
    assert [s.type for s in df.select(detect("text", only_ip).alias("s")).first().s] == ["IPV4"]


def test_long_text_is_processed_whole(spark):
    text = "word " * 100_000 + "a@b.co"
    row = analyze(spark.createDataFrame([(text,)], "text string")).first()
    assert [(s.start, s.end) for s in row.spans] == [(500_000, 500_006)]
    assert row.redacted_text.endswith("word [REDACTED:EMAIL]")


def test_rules_without_a_known_part_run_on_every_text(spark):
    names = Rule("NAME", r"[A-Z][a-z]+", 1)
    df = spark.createDataFrame([("Alice met Bob",), ("Alice met Bob 7",), ("nobody",), (None,)], "text string")
    got = [r.n for r in df.select(F.size(detect(rules=[names])).alias("n")).collect()]
    assert got == [2, 2, 0, 0]
    mixed = df.select(F.size(detect(rules=[*RULES, names])).alias("n")).collect()
    assert [r.n for r in mixed] == [2, 2, 0, 0]


def _seconds(spark, n: int) -> tuple[float, list]:
    text = " ".join(f"user{i}@example.org" for i in range(n))
    df = spark.createDataFrame([(1, text)], "record_id int, text string")
    began = time.perf_counter()
    row = analyze(df).first()
    took = time.perf_counter() - began
    assert len(row.spans) == n and row.spans[-1].end == len(text)
    assert row.redacted_text == " ".join(["[REDACTED:EMAIL]"] * n)
    return took, row.spans


def test_time_grows_with_the_number_of_matches(spark):
    _seconds(spark, 8_000)
    half, whole = (min(_seconds(spark, n)[0] for _ in range(2)) for n in (8_000, 16_000))
    assert whole < 3 and whole <= 2.5 * half
