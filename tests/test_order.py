from __future__ import annotations

import hashlib

import pytest

from textrisk.operators.prefix import split_in_order
from textrisk.plans.train import time_split


def expected_order(rows):
    return sorted(rows, key=lambda r: ((r[1] or ""), hashlib.md5(r[0].encode()).hexdigest()))


def test_split_matches_a_sort(spark):
    rows = [(f"id{i}", f"2024-01-0{1 + i % 3}T0{i % 7}:00:00{'.5' if i % 2 else ''}Z", f"t{i}") for i in range(60)]
    rows.append(("none", None, "x"))
    df = spark.createDataFrame(rows, "record_id string, created_at string, text string").repartition(4)
    ordered = expected_order(rows)
    for n in (0, 1, 7, 30, 59, 60, 61, 70):
        first, second = split_in_order(df, n)
        assert sorted(map(str, map(tuple, first.collect()))) == sorted(map(str, ordered[:n]))
        assert sorted(map(str, map(tuple, second.collect()))) == sorted(map(str, ordered[n:]))


def test_fraction_sorts_as_text(spark):
    rows = [("a", "2024-01-01T00:00:00Z", ""), ("b", "2024-01-01T00:00:00.5Z", "")]
    first, _ = split_in_order(spark.createDataFrame(rows, "record_id string, created_at string, text string"), 1)
    assert first.first().record_id == "b"


def test_one_instant_holding_most_rows(spark):
    rows = [(f"id{i}", "2024-01-01T00:00:00Z", "t") for i in range(500)]
    df = spark.createDataFrame(rows, "record_id string, created_at string, text string")
    first, second = split_in_order(df, 400)
    expected = {r[0] for r in expected_order(rows)[:400]}
    assert {r.record_id for r in first.collect()} == expected and second.count() == 100


def test_copies_are_divided_by_number(spark):
    rows = [("same", "2024-01-01T00:00:00Z", f"t{i % 2}") for i in range(300)] + [("a", "2023-01-01T00:00:00Z", "t")]
    df = spark.createDataFrame(rows, "record_id string, created_at string, text string").repartition(4)
    for n in (1, 100, 151, 152, 300, 301):
        first, second = split_in_order(df, n)
        a, b = [tuple(r) for r in first.collect()], [tuple(r) for r in second.collect()]
        assert len(a) == n and sorted(a + b) == sorted(rows)
        assert ("a", "2023-01-01T00:00:00Z", "t") in a


def test_the_cut_reaches_the_scan(spark, tmp_path):
    rows = [(f"id{i}", f"2024-01-01T00:00:{i:02d}Z", "t") for i in range(50)]
    spark.createDataFrame(rows, "record_id string, created_at string, text string").write.parquet(str(tmp_path / "t"))
    first, second = split_in_order(spark.read.parquet(str(tmp_path / "t")), 40)
    assert (first.count(), second.count()) == (40, 10)
    for part, condition in ((first, "LessThanOrEqual(created_at,2024-01-01T00:00:39Z)"), (second, "GreaterThanOrEqual(created_at,2024-01-01T00:00:39Z)")):
        assert condition in part._jdf.queryExecution().executedPlan().toString()


def test_only_missing_times(spark):
    rows = [(f"id{i}", None if i % 2 else "", "t") for i in range(20)]
    df = spark.createDataFrame(rows, "record_id string, created_at string, text string")
    first, second = split_in_order(df, 7)
    assert {r.record_id for r in first.collect()} == {r[0] for r in expected_order(rows)[:7]} and second.count() == 13


def test_time_split_errors(spark):
    empty = spark.createDataFrame([], "record_id string, created_at string, text string")
    with pytest.raises(ValueError, match="no records"):
        time_split(empty)
    one = spark.createDataFrame([("a", "2024", "t")], "record_id string, created_at string, text string")
    with pytest.raises(ValueError, match="Too few records"):
        time_split(one)


def test_first_rows_of_parquet_do_not_depend_on_splits(spark, tmp_path):
    """Row indexes of Parquet files give the same first rows however files are cut."""
    import pandas as pd

    from textrisk.operators.prefix import first_rows, with_position

    folder = tmp_path / "t"
    folder.mkdir()
    ids = iter(range(10_000))
    for f in range(3):
        frame = pd.DataFrame({"id": [next(ids) for _ in range(1500)], "pad": ["x" * 200] * 1500})
        frame.to_parquet(folder / f"part-{f}.parquet", row_group_size=100)
    expected = list(range(4500))
    for split in ("16k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            df = spark.read.parquet(str(folder))
            assert df.rdd.getNumPartitions() > 1 or split == "128m"
            for n in (0, 1, 99, 1500, 1501, 3333, 4500, 5000):
                got = sorted(r.id for r in first_rows(with_position(df), n).collect())
                assert got == expected[:n]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
