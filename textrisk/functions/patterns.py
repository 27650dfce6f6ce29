"""Detection rules: what counts as personal data, and how much each kind weighs.

The regular expressions are Java ones (Spark runs them in the JVM).  Character
classes are spelled out instead of using ``\\w``, ``\\d``, ``\\s`` and ``\\b``,
whose meaning depends on regex flags and on the Java version; spelled out they
cover the same code points as Unicode-aware classes do elsewhere.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

# Character classes (contents of a bracket expression).  Java keeps single characters
# in one table, which is tested first; only those beyond ASCII are looked up by category.
_ASCII_WORD = string.digits + string.ascii_uppercase + "_" + string.ascii_lowercase
WORD = rf"[{_ASCII_WORD}][[^\x00-\x7F]&&[\p{{L}}\p{{N}}]]"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"

_D = r"\p{Nd}"
_S = f"[{SPACE}]"
_W = f"[{WORD}]"
# Word boundaries: before a word character, after one, and on either side.
_START = f"(?<!{_W})"
_END = f"(?!{_W})"
_EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
_SEP = f"[-.{SPACE}]?"
_DIGIT_HERE = f"(?={_D})"


#: For ``Rule.needs``: a decimal digit of any script.
DIGIT = "\\d"


@dataclass(frozen=True)
class Rule:
    """One kind of personal data.

    ``needs`` is what every match contains: a text, or DIGIT.  It is looked for
    first, because that is much cheaper than the regex.  None means nothing is
    known, and the regex runs on every text.
    """

    name: str
    regex: str
    weight: int
    needs: str | None = None


# Kinds, expressions and weights, in tie-breaking order.
# Possessive quantifiers only cut backtracking that could never succeed, and what
# stands in front rules out most places before the characters around are looked at.
RULES: tuple[Rule, ...] = (
    Rule(
        "EMAIL",
        rf"{_EDGE}[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{_END}",
        25,
        needs="@",
    ),
    Rule(
        "PHONE",
        rf"(?=[+(\p{{Nd}}]){_EDGE}(?:\+1{_SEP})?(?:\(?{_D}{{3}}\)?{_SEP}){_D}{{3}}{_SEP}{_D}{{4}}{_END}",
        25,
        needs=DIGIT,
    ),
    Rule("URL", rf"(?=h){_START}https?://[^{SPACE}]+{_EDGE}", 5, needs="http"),
    Rule("IPV4", rf"{_DIGIT_HERE}{_START}(?:{_D}{{1,3}}\.){{3}}{_D}{{1,3}}{_END}", 10, needs=DIGIT),
    Rule("SSN", rf"{_DIGIT_HERE}{_START}{_D}{{3}}-{_D}{{2}}-{_D}{{4}}{_END}", 60, needs=DIGIT),
    Rule("CREDIT_CARD", rf"{_DIGIT_HERE}{_START}(?:{_D}{{4}}[- ]?){{3}}{_D}{{4}}{_END}", 60, needs=DIGIT),
    Rule("DOB", rf"{_DIGIT_HERE}{_START}{_D}{{1,2}}[/-]{_D}{{1,2}}[/-]{_D}{{2,4}}{_END}", 15, needs=DIGIT),
    Rule(
        "ADDRESS_HINT",
        rf"{_DIGIT_HERE}{_START}{_D}{{1,5}}+{_S}++{_W}++(?:{_S}++{_W}++){{0,3}}{_S}++"
        r"(?iu:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr)"
        rf"{_END}",
        15,
        needs=DIGIT,
    ),
)

WEIGHTS: dict[str, int] = {rule.name: rule.weight for rule in RULES}

# Label rule and score combination.
MAX_SCORE = 100
RISK_THRESHOLD = 25
HIGH_SEVERITY = ("SSN", "CREDIT_CARD")
INTERPRETATION_MARGIN = 10
DECISION_THRESHOLD = 0.5
