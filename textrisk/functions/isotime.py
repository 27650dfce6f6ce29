"""Timestamps as ISO-8601 UTC strings.

The arithmetic runs on days, seconds and microseconds, so results do not depend
on the time zone of the session.  Results look like ``2025-01-15T12:00:00Z``,
with six fraction digits where the fraction is not zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textrisk.functions.binding import let
from textrisk.functions.text import strip

# Seconds of the first and last representable instant (years 1 and 9999, UTC).
_FIRST_SECOND = -62135596800
_LAST_SECOND = 253402300799

_DIGITS = r"[0-9](?:_?[0-9])*"
_NUMBER = rf"\A[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"

_DATE = r"\d{4}-\d\d-\d\d|\d{8}|\d{4}-W\d\d(?:-\d)?|\d{4}W\d\d\d?"
_FRACTION = r"(?:[.,]\d+)?"
_CLOCK = rf"\d\d(?::\d\d(?::\d\d{_FRACTION})?|\d\d(?:\d\d{_FRACTION})?)?"
# Groups: date, time, sign and size of the offset.
_ISO = rf"(?s)\A({_DATE})(?:.({_CLOCK})(?:([+-])({_CLOCK}))?)?\z"


def _two(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def _format(instant: Column) -> Column:
    """Text of an instant with the fields ``seconds`` (since 1970) and ``micros``."""
    seconds, micros = instant["seconds"], instant["micros"]
    in_range = seconds.between(_FIRST_SECOND, _LAST_SECOND)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    second_of_day = F.pmod(seconds, F.lit(86400))
    clock = F.concat_ws(
        ":",
        _two(F.floor(second_of_day / 3600)),
        _two(F.floor(second_of_day / 60) % 60),
        _two(second_of_day % 60),
    )
    fraction = F.when(micros == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    )
    return F.when(in_range, F.concat(day.cast("string"), F.lit("T"), clock, fraction, F.lit("Z")))


def _instant(seconds: Column, micros: Column) -> Column:
    """Fields of an instant, microseconds brought into 0..999999."""
    return F.struct(
        (seconds + F.floor(micros / 1_000_000)).cast("long").alias("seconds"),
        F.pmod(micros, F.lit(1_000_000)).cast("long").alias("micros"),
    )


def epoch_to_iso(epoch: Column) -> Column:
    """Seconds since 1970 (text or number, fractions allowed); null if not one."""
    def number(text: Column) -> Column:
        return F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit(""))).try_cast("double")

    return let(let(strip(epoch.cast("string")), number), _number_to_iso)


def _number_to_iso(value: Column) -> Column:
    whole = F.floor(value)
    instant = _instant(whole, F.rint((value - whole) * 1_000_000).cast("long"))
    return F.when(value.between(_FIRST_SECOND - 1, _LAST_SECOND + 1), let(instant, _format))


def _number(text: Column, start: int, length: int) -> Column:
    """Digits at a place of a text that has passed the pattern; null if there are
    none.  (A failed ``try_cast`` costs an exception.)"""
    return F.nullif(F.substring(text, start, length), F.lit("")).cast("int")


def _unix_day(date: Column) -> Column:
    """Days since 1970 of a date without dashes: ``yyyymmdd``, ``yyyyWww``, ``yyyyWwwd``."""
    year = F.substring(date, 1, 4)
    calendar = F.try_to_date(date, "yyyyMMdd")
    week = _number(date, 6, 2)
    weekday = F.coalesce(_number(date, 8, 1), F.lit(1))
    # The fourth of January always lies in the first week.
    fourth = F.try_to_date(F.concat(year, F.lit("0104")), "yyyyMMdd")
    monday = F.date_add(fourth, (week - 1) * 7 - F.weekday(fourth))
    # Week 53 exists only if its Thursday still lies in the year.
    exists = (week >= 1) & weekday.between(1, 7) & (F.year(F.date_add(monday, 3)) == _number(date, 1, 4))
    day = F.when(date.contains("W"), F.when(exists, F.date_add(monday, weekday - 1))).otherwise(calendar)
    return F.when(year != "0000", F.unix_date(day))


def _clock(time: Column) -> Column:
    """Fields of a time without colons: ``hh[mm[ss[.fraction]]]``; empty is zero."""

    def part(start: int) -> Column:
        return F.coalesce(_number(time, start, 2), F.lit(0))

    valid = (part(1) <= 23) & (part(3) <= 59) & (part(5) <= 59)
    return F.struct(
        F.when(valid, part(1) * 3600 + part(3) * 60 + part(5)).alias("seconds"),
        F.rpad(F.substring(time, 8, 6), 6, "0").cast("int").alias("micros"),
    )


def _assemble(parts: Column) -> Column:
    sign = F.when(parts["sign"] == "-", -1).otherwise(1)
    seconds = parts["day"].cast("long") * 86400 + parts["time"]["seconds"] - sign * parts["offset"]["seconds"]
    # An offset below one second counts as none.
    offset_micros = F.when(parts["offset"]["seconds"] == 0, 0).otherwise(parts["offset"]["micros"])
    return let(_instant(seconds, parts["time"]["micros"] - sign * offset_micros), _format)


def _parse(text: Column) -> Column:
    # One match yields all groups.
    groups = F.split(F.regexp_replace(text, _ISO, "$1|$2|$3|$4"), r"\|")

    def from_groups(g: Column) -> Column:
        def digits(i: int, drop: str) -> Column:
            return F.replace(F.get(g, F.lit(i)), F.lit(drop), F.lit(""))

        parts = F.struct(
            let(digits(0, "-"), _unix_day).alias("day"),
            let(digits(1, ":"), _clock).alias("time"),
            F.get(g, F.lit(2)).alias("sign"),
            let(digits(3, ":"), _clock).alias("offset"),
        )
        return let(parts, _assemble)

    return F.when(text.rlike(_ISO), let(groups, from_groups))


def to_iso_utc(value: Column) -> Column:
    """ISO-8601 text in any of its common shapes, converted to UTC; null if bad.

    Extended and basic dates, week dates, any one-character separator, reduced
    precision, fractions with point or comma, and offsets are understood.  A
    time without offset counts as UTC.
    """
    def with_offset(text: Column) -> Column:
        return F.when(text.endswith("Z"), F.replace(text, F.lit("Z"), F.lit("+00:00"))).otherwise(text)

    return let(let(strip(value), with_offset), _parse)
