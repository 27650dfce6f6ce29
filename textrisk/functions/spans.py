"""Span detection and redaction as native column expressions.

A span column has type ``array<struct<type,start,end,match>>``; offsets count
code points from zero and ends are exclusive.  Everything here is row-local, so
it adds no shuffle and also works on a streaming DataFrame.

Detection is written as SQL text: the expression is large, and building it call
by call from Python takes longer than running it on a small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textrisk.functions.patterns import DIGIT, RULES, Rule

# A code point that is not a character and has no place in text.
_RARE = "\uffff"
_SPAN = "struct<start:int,stop:int,rank:int,type:string,match:string>"
_NONE = f"cast(array() AS array<{_SPAN}>)"
# Items that are folded into one list, and spans that are redacted in one go.
_BLOCK = 128


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _gaps(text: str, regex: str) -> str:
    """Texts between the matches.  ``split`` compiles its regex for every row,
    ``regexp_replace`` does not, so the matches first become one rare character
    at which to split; a text that has it already is split the slow way."""
    return f"""IF(contains({text}, '{_RARE}'),
        split({text}, r'{regex}', -1),
        split(regexp_replace({text}, r'{regex}', '{_RARE}'), '{_RARE}', -1))"""


def _fold(items: str, carry: str, element: str, step: str) -> str:
    """``aggregate`` that makes a list: struct(carry, done) over ``items``.

    ``step`` tells from ``state.carry``, ``state.out`` and ``item`` the next state,
    where ``out`` is a list of ``element``.  Appending copies a list, so the items
    are taken in blocks, each with a list of its own, and the time does not grow
    with the square of their number.
    """
    block = _let(
        "part",
        f"""aggregate(block, struct(whole.carry AS carry, cast(array() AS array<{element}>) AS out), (state, item) -> {step})""",
        "struct(part.carry AS carry, concat(whole.done, array(part.out)) AS done)",
    )
    return f"""aggregate(
        transform(sequence(0, greatest(size({items}) - 1, 0), {_BLOCK}), at -> slice({items}, at + 1, {_BLOCK})),
        struct({carry} AS carry, cast(array() AS array<array<{element}>>) AS done),
        (whole, block) -> {block},
        whole -> struct(whole.carry AS carry, flatten(whole.done) AS done))"""


def _find_all(text: str, rule: Rule, rank: int) -> str:
    """Every match of one rule with its offsets, left to right.

    The gaps between the matches and the matches themselves come from two regex
    passes; their running lengths give the offsets.  The gaps are found only
    where there is a match.
    """
    pairs = f"filter(zip_with({_gaps(text, rule.regex)}, matches, (g, m) -> struct(length(g) AS gap, m AS match)), p -> p.match IS NOT NULL)"
    step = f"""struct(state.carry + item.gap + length(item.match) AS carry,
        concat(state.out, array(struct(state.carry + item.gap AS start, state.carry + item.gap + length(item.match) AS stop,
            {rank} AS rank, '{rule.name}' AS type, item.match AS match))) AS out)"""
    with_offsets = _let("pairs", pairs, _fold("pairs", "0", _SPAN, step) + ".done")
    matches = f"regexp_extract_all({text}, r'{rule.regex}', 0)"
    return _let("matches", matches, f"IF(size(matches) > 0, {with_offsets}, {_NONE})")


def _has(text: str, mark: str) -> str:
    """Whether a text has that mark; a plain search is much cheaper than a regex."""
    return f"{text} RLIKE r'\\p{{Nd}}'" if mark == DIGIT else f"contains({text}, '{mark}')"


def _found(text: str, rules: Sequence[Rule]) -> str:
    """Matches of all rules by start, end and rank of the rule; rules that need
    the same mark share the test for it."""

    def of(mark: str | None) -> str:
        lists = [_find_all(text, rule, rank) for rank, rule in enumerate(rules) if rule.needs == mark]
        if mark is None:
            return f"concat({', '.join(lists)})"
        return f"IF({_has(text, mark)}, concat({', '.join(lists)}), {_NONE})"

    marks = dict.fromkeys(rule.needs for rule in rules)
    return f"sort_array(concat({', '.join(of(mark) for mark in marks)}))"


def _spans(candidates: str) -> str:
    return f"transform({candidates}, c -> struct(c.type AS type, c.start AS start, c.stop AS `end`, c.match AS match))"


# Walk the sorted candidates once; of two that overlap the longer one stays, the
# earlier one if they are equally long.  The one that may still lose is carried.
_DISJOINT = f"""IF(size(found) < 2, found, {_let("walked", _fold("found", f"cast(NULL AS {_SPAN})", _SPAN, """CASE
    WHEN state.carry IS NULL THEN struct(item AS carry, state.out AS out)
    WHEN item.start >= state.carry.stop THEN struct(item AS carry, concat(state.out, array(state.carry)) AS out)
    WHEN item.stop - item.start > state.carry.stop - state.carry.start THEN struct(item AS carry, state.out AS out)
    ELSE state END"""), "concat(walked.done, array(walked.carry))")})"""


def candidate_spans(text: str = "text", rules: Sequence[Rule] = RULES) -> Column:
    """All matches of all rules in a text column, before overlaps are resolved."""
    return F.expr(f"IF({text} IS NULL, array(), {_spans(_found(text, rules))})")


def detect(text: str = "text", rules: Sequence[Rule] = RULES) -> Column:
    """Disjoint spans of personal data in a text column; empty for null or "".

    Most texts contain neither a digit nor any of the required markers, so one
    cheap test decides whether the rules run at all.
    """
    marks = dict.fromkeys(rule.needs for rule in rules)
    spans = _let("found", _found(text, rules), _spans(_DISJOINT))
    if None in marks:
        return F.expr(f"IF({text} IS NULL, {_spans(_NONE)}, {spans})")
    trigger = " OR ".join(_has(text, mark) for mark in sorted(marks, key=lambda mark: mark == DIGIT))
    return F.expr(f"IF({trigger}, {spans}, {_spans(_NONE)})")


def redact(text: Column, spans: Column) -> Column:
    """Replace every span by ``[REDACTED:TYPE]``; other text is unchanged.

    Finding a place in a text means walking to it, so blocks of spans first get
    their stretch of the text and are redacted inside it.
    """

    def stretch(first: Column) -> Column:
        block = F.slice(spans, first + 1, F.lit(_BLOCK))
        start = F.when(first == 0, F.lit(0)).otherwise(F.get(spans, first - 1)["end"])
        part = F.substring(text, start + 1, F.element_at(block, -1)["end"] - start)
        inside = F.transform(F.array(F.struct(block.alias("block"), start.alias("start"), part.alias("part"))), within)
        return F.get(inside, F.lit(0))

    def within(s: Column) -> Column:
        def piece(span: Column, i: Column) -> Column:
            before = F.when(i == 0, s["start"]).otherwise(F.get(s["block"], i - 1)["end"])
            gap = F.substring(s["part"], before - s["start"] + 1, span["start"] - before)
            return F.concat(gap, F.lit("[REDACTED:"), span["type"], F.lit("]"))

        return F.array_join(F.transform(s["block"], piece), "")

    firsts = F.sequence(F.lit(0), F.size(spans) - 1, F.lit(_BLOCK))
    tail = F.substring(text, F.element_at(spans, -1)["end"] + 1, F.length(text))
    redacted = F.concat(F.array_join(F.transform(firsts, stretch), ""), tail)
    return F.when(F.size(spans) > 0, redacted).otherwise(text)
