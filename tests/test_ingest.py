from __future__ import annotations

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textrisk.functions.identity import account_identifier
from textrisk.operators.normalize import accepted, from_labelled_dump, ingest_counters, mastodon, reddit, rejected
from textrisk.plans.ingest import IngestReport, ingest_mastodon, ingest_reddit, normalize_dump
from textrisk.sources.raw import format_of, parse_json_lines, read_labelled_dump, read_raw
from textrisk.sources.records import export_jsonl, export_sample_jsonl, read_records, write_records
from textrisk.streaming.ingest import stream_analysis, stream_records, write_stream
from textrisk.plans.analyze import analyze

REDDIT = [
    {"id": "a7", "author": "wren", "created_utc": 1709251200, "subreddit": "gardens", "title": "Beans", "selftext": "Sown today", "link_id": "t3_a7"},
    {"id": "a8", "author": "otis", "created_utc": 1709337600, "subreddit": "kitchens", "title": "Bread", "selftext": "Rye this time", "link_id": "t3_a8"},
    {"id": "k1", "author": "mina", "created_utc": 1709251200, "subreddit": "gardens", "body": "Mine too", "parent_id": "t3_a7", "link_id": "t3_a7"},
    {"id": "k2", "author": "pell", "created_utc": 1709337600, "subreddit": "kitchens", "body": "Looks good", "parent_id": "t3_a8", "link_id": "t3_a8"},
]
MASTODON = [
    {"id": "501", "created_at": "2025-02-03T09:15:00Z", "account": {"id": "acc-77", "username": "wren"}, "content": "<p>Snow <em>again</em></p>", "uri": "https://north.example.net/@wren/501"},
    {"id": "502", "created_at": "2025-02-21T17:45:00+00:00", "account": {"acct": "otis@bread.example"}, "content": "<p>Here as well</p>", "in_reply_to_id": "501", "conversation_id": "talk-3", "url": "https://bread.example/@otis/502"},
    {"id": "503", "created_at": "2024-11-30T23:59:00", "account": {"username": "mina"}, "text": "No markup here", "uri": "https://south.example.net/@mina/503"},
]
HASHES = {
    name: hashlib.sha256(name.encode()).hexdigest()
    for name in ("wren", "otis", "mina", "pell", "acc-77", "otis@bread.example", "unknown")
}


def write_lines(path: Path, lines) -> str:
    path.write_text("\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines), encoding="utf-8")
    return str(path)


def fields(rows, *names):
    return sorted(tuple(r[n] for n in names) for r in rows)


def test_reddit_dump(spark, tmp_path):
    path, out = write_lines(tmp_path / "reddit.jsonl", REDDIT), str(tmp_path / "records")
    assert ingest_reddit(spark, path, out) == IngestReport(4, 4, 0)
    rows = read_records(spark, out).collect()
    assert fields(rows, "record_id", "record_type", "created_at", "community", "text") == [
        ("a7", "post", "2024-03-01T00:00:00Z", "gardens", "Beans\n\nSown today"),
        ("a8", "post", "2024-03-02T00:00:00Z", "kitchens", "Bread\n\nRye this time"),
        ("k1", "comment", "2024-03-01T00:00:00Z", "gardens", "Mine too"),
        ("k2", "comment", "2024-03-02T00:00:00Z", "kitchens", "Looks good"),
    ]
    assert {r.record_id: (r.parent_record_id, r.thread_id) for r in rows} == {
        "a7": (None, "t3_a7"), "a8": (None, "t3_a8"), "k1": ("t3_a7", "t3_a7"), "k2": ("t3_a8", "t3_a8"),
    }
    assert {r.author_id_hash for r in rows} == {HASHES[a] for a in ("wren", "otis", "mina", "pell")}
    for kind in ("post", "comment"):
        assert (Path(out) / "platform=reddit" / f"record_type={kind}" / "year=2024" / "month=03").is_dir()
    assert {(r.year, r.month) for r in rows} == {("2024", "03")}


def test_mastodon_dump(spark, tmp_path):
    path, out = write_lines(tmp_path / "mastodon.jsonl", MASTODON), str(tmp_path / "records")
    assert ingest_mastodon(spark, path, out) == IngestReport(3, 3, 0)
    rows = {r.record_id: r for r in read_records(spark, out).collect()}
    assert {k: (r.created_at, r.community, r.parent_record_id, r.thread_id, r.text) for k, r in rows.items()} == {
        "501": ("2025-02-03T09:15:00Z", "north.example.net", None, None, "Snow again"),
        "502": ("2025-02-21T17:45:00Z", "bread.example", "501", "talk-3", "Here as well"),
        "503": ("2024-11-30T23:59:00Z", "south.example.net", None, None, "No markup here"),
    }
    assert [rows[i].author_id_hash for i in ("501", "502", "503")] == [HASHES[a] for a in ("acc-77", "otis@bread.example", "mina")]
    for r in rows.values():
        assert (Path(out) / "platform=mastodon" / "record_type=post" / f"year={r.created_at[:4]}" / f"month={r.created_at[5:7]}").is_dir()


def test_bad_reddit_lines(spark, tmp_path):
    lines = [
        '{"id":"1","created_utc":1,"body":"a"}', "", "   ", "{bad", '{"id":"2","created_utc":2} x',
        '{"id":"3","created_utc":2}{"id":"4"}', '{"id":"3","created_utc":2},{"id":"4"}', "[1]", "5", "null", "{'id':'7'}",
        '{"id":null,"created_utc":5}', '{"id":"8","created_utc":"zz"}', '{"id":9,"id":10,"created_utc":NaN}',
        '{"id":11,"created_utc":"12.5","title":"t","author":""}',
    ]
    labelled = normalize_dump(spark, write_lines(tmp_path / "bad.JSONL", lines), "reddit")
    assert fields(accepted(labelled).collect(), "record_id", "created_at", "text", "record_type") == [
        ("1", "1970-01-01T00:00:01Z", "a", "comment"),
        ("11", "1970-01-01T00:00:12.500000Z", "t", "post"),
    ]
    reasons = [r.reject_reason for r in rejected(labelled).collect()]
    assert sorted(reasons) == ["malformed"] * 8 + ["missing created_at"] * 2 + ["missing record_id"]
    counts = ingest_counters(labelled).first()
    assert tuple(counts) == (13, 2, 11)
    assert {r.author_id_hash for r in accepted(labelled).collect()} == {HASHES["unknown"]}


def test_mastodon_details(spark, tmp_path):
    lines = [
        {"id": 1, "created_at": "", "created_at_utc": "2025-01-15 12:00", "content": "", "text": "AT&amp;T", "account": json.dumps({"id": 5})},
        {"id": 2, "created_at": "2025-01-15T12:00:00Z", "content": "<b>AT&amp;T &eacute;&#x41;</b>  x", "account.username": "flat", "uri": "http://[bad", "url": "http://u:p@h:8080/x"},
        {"id": 3, "created_at": "2025-01-15T12:00:00Z", "text": None, "content": ""},
        {"id": 4, "text": "no time"},
        {"id": 5, "created_at": "12:00:00", "text": "bad time"},
        {"id": None, "created_at": "2025-01-15T12:00:00Z", "text": "no id"},
        {"id": 7, "created_at": "2025-01-15T12:00:00Z", "text": "<b>", "account": "{broken", "in_reply_to_id": "", "uri": "tag:x"},
        {"id": 8, "created_at": "2025-01-15T12:00:00Z", "text": "1 < 2 &lt; 3", "account": {"id": "", "acct": None, "username": "mina"}},
    ]
    labelled = normalize_dump(spark, write_lines(tmp_path / "m.jsonl", lines), "mastodon")
    good = {r.record_id: r for r in accepted(labelled).collect()}
    assert {k: r.text for k, r in good.items()} == {"1": "AT&amp;T", "2": "AT&T éA x", "7": "", "8": "1 < 2 &lt; 3"}
    assert good["2"].community == "u:p@h:8080" and good["7"].community is None and good["7"].parent_record_id is None
    assert good["7"].author_id_hash == HASHES["unknown"] and good["8"].author_id_hash == HASHES["mina"]
    assert sorted(r.reject_reason for r in rejected(labelled).collect()) == [
        "missing created_at", "missing record_id", "missing text", "unreadable created_at",
    ]


def test_csv(spark, tmp_path):
    path = tmp_path / "dump.csv"
    path.write_text('id,author,created_utc,title,selftext,body,parent_id\n1,,5,"He said ""hi""","line1\nline2",,\n2,bob,,,,c,\n3,bob,7,,,  c ,\n', encoding="utf-8")
    labelled = reddit(read_raw(spark, str(path), "reddit"))
    rows = accepted(labelled).collect()
    assert fields(rows, "record_id", "record_type", "text", "parent_record_id") in (
        [("1", "post", 'He said "hi"\n\nline1\nline2', None), ("3", "comment", "c", "")],
    )
    assert tuple(ingest_counters(labelled).first()) == (3, 2, 1)


def test_unknown_format(spark):
    assert format_of("A.CSV") == "csv"
    with pytest.raises(ValueError, match="Input must be .jsonl or .csv"):
        read_raw(spark, "dump.txt", "reddit")


def test_row_limit_takes_the_first_lines_of_the_first_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for f in range(3):
        write_lines(folder / f"part-{f}.jsonl", [{"id": f"{f}-{i:03d}", "created_utc": 1} if i % 5 else "{bad" for i in range(100)])
    everything = [f"{f}-{i:03d}" for f in range(3) for i in range(100)]
    for n in (0, 1, 99, 100, 101, 250, 1000):
        raw = read_raw(spark, str(folder), "reddit", format="jsonl", max_rows=n)
        rows = raw.collect()
        assert len(rows) == min(n, 300)
        assert {r.id for r in rows if not r.malformed} == {x for x in everything[:n] if int(x[2:]) % 5}


def test_rerun_replaces_partitions_and_append_adds(spark, tmp_path):
    out = str(tmp_path / "records")
    first = write_lines(tmp_path / "a.jsonl", REDDIT)
    ingest_reddit(spark, first, out)
    ingest_mastodon(spark, write_lines(tmp_path / "b.jsonl", MASTODON), out)
    assert read_records(spark, out).count() == 7
    ingest_reddit(spark, write_lines(tmp_path / "c.jsonl", REDDIT[:1]), out)
    ids = {r.record_id for r in read_records(spark, out).collect()}
    assert ids == {"a7", "k1", "k2", "501", "502", "503"}
    ingest_reddit(spark, write_lines(tmp_path / "d.jsonl", REDDIT[1:2]), out, mode="append", rejects=str(tmp_path / "rejects"))
    assert read_records(spark, out).count() == 7
    assert read_records(spark, out, max_rows=3).count() == 3


def test_labelled_dump(spark, tmp_path):
    lines = [{"id": 1, "text": "a", "binary label": 1, "multi-class label": "x"}, {"id": 2, "text": None}, ""]
    path = write_lines(tmp_path / "l.jsonl", lines)
    rows = from_labelled_dump(read_labelled_dump(spark, path)).collect()
    assert [tuple(r) for r in rows] == [("1", "2025-01-01T00:00:00Z", "a", "1", "x", None), ("2", "2025-01-01T00:00:00Z", "", None, None, None)]
    with pytest.raises(Exception, match="Malformed JSON line"):
        from_labelled_dump(read_labelled_dump(spark, write_lines(tmp_path / "m.jsonl", ["{bad"]))).collect()


def test_jsonl_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None), (3, "c")], "id int, text string")
    export_jsonl(df, str(tmp_path / "all"))
    lines = [line for f in (tmp_path / "all").glob("*.json") for line in f.read_text(encoding="utf-8").splitlines()]
    assert sorted(lines) == ['{"id":1,"text":"é"}', '{"id":2,"text":null}', '{"id":3,"text":"c"}']
    for part in range(3):
        spark.createDataFrame([(10 * part + i,) for i in range(10)], "id int").coalesce(1).write.mode("append").json(str(tmp_path / f"in/{part}"))
    scan = spark.read.schema("id int").json(str(tmp_path / "in/*"))
    export_sample_jsonl(scan.select("*", "_metadata"), str(tmp_path / "some"), n=14)
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "some")).collect()) == list(range(14))


def test_objects_followed_by_brackets_are_malformed(spark):
    good = '{"id":"1","created_utc":1,"body":"a }] b"}'
    plain = '{"id":"2","created_utc":1,"body":"x"}'
    bad = [plain + tail for tail in ("]", "] x", "],[" + plain, "] junk {}", ',"a":5', ',"v":' + plain, '},"seal":"x"')]
    lines = spark.createDataFrame([(v,) for v in [good, plain, *bad]], "value string")
    raw = parse_json_lines(lines, ["id", "created_utc", "body"]).collect()
    assert [r.malformed for r in raw] == [False, False] + [True] * len(bad)
    assert raw[0].body == "a }] b"
    account = account_identifier(F.col("value"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    got = [r[0] for r in lines.select(account).collect()]
    assert got == ["1", "2"] + ["unknown"] * len(bad)


@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_rows_with_other_numbers_of_cells(spark, tmp_path, multi_line):
    path = tmp_path / "dump.csv"
    path.write_text("id,created_utc,body\n1,5,good\n2,5,one,two\n3,5\n4,5,\n", encoding="utf-8")
    raw = read_raw(spark, str(path), "reddit", multi_line=multi_line)
    assert {r.id: r.malformed for r in raw.collect() if not r.malformed} == {"1": False, "4": False}
    labelled = reddit(raw)
    assert tuple(ingest_counters(labelled).first()) == (4, 2, 2)
    assert [r.reject_reason for r in rejected(labelled).select("reject_reason").collect()] == ["malformed"] * 2
    assert [r.record_id for r in accepted(labelled).select("record_id").collect()] == ["1", "4"]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_lines(folder / "a.jsonl", [*MASTODON, "{bad", {"id": 9, "created_at": "2025-01-01", "text": "mail a@b.co <b>&amp;</b>"}])
    query = write_stream(stream_records(spark, str(folder), "mastodon"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert query.awaitTermination(120)
    batch = accepted(mastodon(read_raw(spark, str(folder), "mastodon", format="jsonl")))
    written = read_records(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, batch.collect()))

    live = stream_analysis(spark, str(folder), "mastodon").select("record_id", "rule_score", "redacted_text")
    query = live.writeStream.format("memory").queryName("live").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    expected = analyze(batch).select("record_id", "rule_score", "redacted_text").collect()
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, expected))


def test_writing_splits_by_partition_with_a_rebalance(spark, tmp_path):
    path = write_lines(tmp_path / "r.jsonl", REDDIT)
    records = accepted(normalize_dump(spark, path, "reddit"))
    plan = records.hint("rebalance", "platform", "month")._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan
    write_records(records, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").rglob("*.parquet"))) == 2


def test_ingest_parses_the_dump_once(spark, tmp_path, monkeypatch):
    """Records, rejects and counters come from the staged files: the dump may be
    gone once they are written, and the stage is deleted after."""
    import textrisk.plans.ingest as plan

    path = write_lines(tmp_path / "r.jsonl", [*REDDIT, "{broken", {"id": "x9", "author": "a"}])
    staged_paths = []
    original_stage, original_write = plan.stage, plan.write_records

    def stage_and_remove(labelled):
        staged = original_stage(labelled)
        staged_paths.append(staged.path)
        Path(path).unlink()  # any later scan of the dump would fail
        return staged

    monkeypatch.setattr(plan, "stage", stage_and_remove)
    rejects = str(tmp_path / "rejects")
    report = plan.ingest(spark, path, "reddit", str(tmp_path / "out"), rejects=rejects)
    assert report == IngestReport(6, 4, 2)
    assert read_records(spark, str(tmp_path / "out")).count() == 4
    assert sorted(r.reject_reason for r in spark.read.parquet(rejects).collect()) == ["malformed", "missing created_at"]
    assert "_status" not in spark.read.parquet(rejects).columns
    assert staged_paths and not Path(staged_paths[0]).exists()
    assert original_write is plan.write_records


def test_staged_counters_of_an_empty_dump(spark, tmp_path):
    path = write_lines(tmp_path / "e.jsonl", ["", "  "])
    assert ingest_reddit(spark, path, str(tmp_path / "out")) == IngestReport(0, 0, 0)


def test_csv_with_breaks_in_cells_is_read_by_many_tasks(spark, tmp_path):
    """Records over several lines, also across block boundaries, equal Spark's multiLine reader."""
    import random

    from textrisk.sources.raw import csv_records

    rnd = random.Random(3)
    lines = ["id,created_utc,body"]
    for i in range(3000):
        body = rnd.choice(["plain", '"two\nlines"', '"say ""hi""\n\nthen, go"', '""', '"a\n""b""\nc\n"', "x" * rnd.randint(0, 300)])
        lines.append(f"{i},{1700000000 + i},{body}")
        if i % 500 == 7:
            lines.append("")  # a blank line outside quotes is no record
    path = tmp_path / "big.csv"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        records = csv_records(spark, str(path))
        assert records.rdd.getNumPartitions() > 1
        assert spark.read.text(str(path)).rdd.getNumPartitions() >= 10
        got = {r.id: r.body for r in read_raw(spark, str(path), "reddit").collect()}
        want = {
            r.id: r.body
            for r in spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(path)).collect()
        }
        assert len(got) == 3000 and got == {k: v if v is not None else "" for k, v in want.items()}
        first = read_raw(spark, str(path), "reddit", max_rows=40).collect()
        assert sorted(int(r.id) for r in first) == list(range(40))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
