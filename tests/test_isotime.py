from __future__ import annotations

import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from textrisk.functions.isotime import epoch_to_iso, to_iso_utc

STAMPS = [
    "2025-01-15T12:00:00Z", "2025-01-15 12:00", "2025-01-15", "2025", "2025-01", "12:00:00", "20250115T120000Z", "20250115",
    "2025-W03-3", "2025-W03", "2025W033", "2025-W53-1", "2020-W53-5", "2020-W54", "2025-W00", "2025-W01-1T10",
    "2025-01-15T12Z", "2025-01-15T12:00Z", "2025-01-15T12:00:00.5Z", "2025-01-15T12:00:00,1234567+02:00",
    "2025-01-15T12:00:00.000001-05:30", "2025-01-15T24:00:00", "2025-02-30", "0001-01-01T00:00:00+01:00", "0001-01-01",
    "9999-12-31T23:59:59.999999", "9999-12-31T23:59:59-01:00", "2025-01-15+00:00", "2025-01-15T1200", "2025-01-15T12:0000",
    "2025-01-15T12:00:00+24:00", "2025-01-15T12:00:00+23:59:59.5", " 2025-01-15T12:00:00Z\n", "2025-1-5",
    "2025-01-15T12:00:00 UTC", "2025-01-15T12:00:00+0530", "2025-01-15x12:00:00", "2025-01-15T12:00:00+05", "2025-01-15T",
    "2025-03-09T02:30:00", "2025-11-02T01:30:00-04:00", "0000-01-01", "1900-01-01T00:00:00", "2025-01-15Z12:00:00Z", "",
]
EPOCHS = [
    "1735689600", "1735689600.0", "1735689600.5", "-1.5", "-0.0000004", "1735689600.1234565", "abc", "", "12d", "1_000", "1__0",
    "1e9", "inf", "nan", "0x10", " 12 ", "253402300799", "253402300800", "-62135596800", "-62135596801", "1735689600.9999999",
    "1.", ".5", "1e400", "+5",
]


def python_iso(value: str) -> str | None:
    """What the standard library makes of a time, Z standing for the zero offset."""
    value = value.strip()
    try:
        parsed = datetime.fromisoformat(value.replace("Z", "+00:00") if value.endswith("Z") else value)
        in_utc = (parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)
    except (ValueError, OverflowError):
        return None
    return in_utc.isoformat().replace("+00:00", "Z")


def python_epoch(value: str) -> str | None:
    try:
        return datetime.fromtimestamp(float(value), tz=timezone.utc).isoformat().replace("+00:00", "Z")
    except (ValueError, OverflowError, OSError):
        return None


def test_iso_times(spark):
    df = spark.createDataFrame([(s,) for s in STAMPS], "s string").select("s", to_iso_utc(F.col("s")).alias("t"))
    assert {r.s: r.t for r in df.collect()} == {s: python_iso(s) for s in STAMPS}


def test_epochs(spark):
    rng = random.Random(3)
    values = EPOCHS + [repr(rng.uniform(-6e9, 6e9)) for _ in range(500)] + [repr(round(rng.uniform(0, 2e9), 6)) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "s string").select("s", epoch_to_iso(F.col("s")).alias("t"))
    assert {r.s: r.t for r in df.collect()} == {v: python_epoch(v) for v in values}


def test_missing_times(spark):
    df = spark.createDataFrame([(None,)], "s string").select(to_iso_utc(F.col("s")), epoch_to_iso(F.col("s")))
    assert tuple(df.first()) == (None, None)
