"""JSON text that is one object and nothing else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def sole_object(text: Column, fields: str) -> Column:
    """The object that ``text``, without blanks around it, consists of; else null.

    ``fields`` is the object's type, ``struct<...>``.  Spark's parser ignores what
    follows a value, so the text is parsed as the only element of an array.  There
    the value can end early at a bracket in the text.  Where a bracket follows a
    brace, the text is parsed once more as a member before another one that holds
    the text's hash: whoever ends the first form early breaks the second.
    """
    array = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{fields}>", _STRICT)
    sealed = F.concat(F.lit('{"v":'), text, F.lit(',"seal":"'), F.md5(text), F.lit('"}'))
    seal = F.from_json(sealed, "struct<seal:string>", _STRICT)["seal"]
    whole = F.when(text.rlike(r"\}\s*\]"), F.coalesce(seal == F.md5(text), F.lit(False))).otherwise(F.lit(True))
    shaped = text.startswith("{") & text.endswith("}")
    return F.when(shaped & (F.size(array) == 1) & whole, F.get(array, F.lit(0)))
