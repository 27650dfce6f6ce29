"""Benchmark items in documents, also with other numbers, names and units.

A text becomes a template: numbers, names and units turn into typed placeholders,
other words are compared in lower case without punctuation around them.  Windows
of template words of documents and items are joined by hash; along one alignment
the values in the slots must agree in one way: equal values of the item stand
for equal values of the document.  Windows of the plain words are joined as well,
so that a verbatim copy is found whatever its slots are; and windows in which the
first word of a sentence is taken for a name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrisk.llm.common import compact, sized
from textrisk.llm.words import FACTORS, mixed

WINDOW = 8
#: Share of an item's words that consistent windows must cover.
COVERAGE = 0.5
#: Words in a window that are not placeholders, at least (all of them in shorter ones).
LITERALS = 3
#: Bits of the table that tells most document windows apart from item windows.
FILTER_BITS = 22
REMEMBERED = 100_000

_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*%?")
# Words that are units after a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound "
    "pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute "
    "minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent "
    "kmh mph kb mb gb w kw v hz".split()
)
_MARKS = "!\"#&'()*,./:;<=>?@[\\]^_`{|}~«»“”‘’„…—–"
_NUM, _UNIT, _CAP, _END = 1, 2, 4, 8
_AS_WRITTEN, _FIRST_IS_NAME, _PLAIN = 0, 1, 2
_PLACE = {"n": np.uint64(11 << 4), "u": np.uint64(13 << 4), "p": np.uint64(17 << 4)}
def _bare(word: str) -> str:
    """A word without the marks around it; signs of a number stay."""
    return word.lstrip(_MARKS + "%").rstrip(_MARKS + "$€£+-")


class _Words(dict):
    """Number of a word: hash of its bare lower-case form, and what kind of word it is in the last four bits."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bare = _bare(word)
        lower = bare.lower()
        code = 0
        if bare:
            raw = lower.encode()
            code = (zlib.crc32(raw) << 28 ^ zlib.crc32(raw[::-1] + b"~")) << 4 & 0xFFFFFFFFFFFFFFF0 or 16
            if bare[0] in "$€£+-" or bare[0].isdigit():
                code |= _NUM * bool(_NUMBER.fullmatch(bare))
            elif lower in UNITS:
                code |= _UNIT
            if bare[0].isupper() and bare[1:].islower():
                code |= _CAP
        self[word] = code = code | _END * (word[-1:] in ".!?" or word[-2:-1] in (".", "!", "?"))
        return code


class Template:
    """Template words of a text: hashes, a letter for the kind of each slot or blank, and the surface words."""

    def __init__(self, text: str | None, known: _Words):
        words = text.split() if text else []
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        ends = (codes & np.uint64(_END)) > 0
        first = np.concatenate([[True], ends[:-1]]) if len(words) else ends
        real = codes >= np.uint64(16)
        self.words, codes, first = words, codes[real], first[real]
        self.at = np.flatnonzero(real)
        number = (codes & np.uint64(_NUM)) > 0
        unit = (codes & np.uint64(_UNIT)) > 0
        unit[1:] &= number[:-1]
        unit[:1] = False
        name = ((codes & np.uint64(_CAP)) > 0) & ~number & ~unit
        self.first_names = name & first
        name = name & ~first
        self.plain = codes & np.uint64(0xFFFFFFFFFFFFFFF0)
        self.hashes = self.plain.copy()
        self.slots = number | unit | name
        self.kinds = {"n": number, "u": unit, "p": name}
        for mark, where in self.kinds.items():
            self.hashes[where] = _PLACE[mark]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, hashes and forms of the runs of ``size`` template words.

        A run comes with its slots, and where it has sentence-first names with those
        as slots too, if it holds enough literal words; with slots it comes plain as well.
        """
        n = len(self.hashes) - size + 1
        if n < 1:
            return np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int)

        def inside(marks: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(marks)])
            return total[size:] - total[:n]

        enough = size - min(size, LITERALS)
        n_slots, n_first = inside(self.slots), inside(self.first_names)
        forms = [(_AS_WRITTEN, self.hashes, n_slots <= enough)]
        if self.first_names.any():
            named = np.where(self.first_names, _PLACE["p"], self.hashes)
            forms.append((_FIRST_IS_NAME, named, (n_first > 0) & (n_slots + n_first <= enough)))
        if self.slots.any():
            forms.append((_PLAIN, self.plain, n_slots > 0))
        places, found, kinds = [], [], []
        for form, hashes, wanted in forms:
            total = np.full(n, size, np.uint64)
            for i in range(size):
                total += hashes[i : i + n] * FACTORS[i]
            kept = np.flatnonzero(wanted)
            places.append(kept)
            found.append(mixed(total[kept]))
            kinds.append(np.full(len(kept), form))
        return np.concatenate(places), np.concatenate(found), np.concatenate(kinds)

    def values(self, start: int, size: int, form: int) -> list[str]:
        """Slots of a window in a form: kind and bare lower-case value."""
        if form == _PLAIN:
            return []
        slots = self.slots | self.first_names if form == _FIRST_IS_NAME else self.slots
        at = start + np.flatnonzero(slots[start : start + size])
        return [f"{next((k for k, w in self.kinds.items() if w[i]), 'p')}:{_bare(self.words[self.at[i]]).lower()}" for i in at]


_SCHEMA = "size int, pos int, hash bigint, form int, slots array<string>"


def _rows(texts: DataFrame, sizes: list[int] | None, table: np.ndarray | None) -> DataFrame:
    """(id, size, pos, hash, form, slots, n_words) of the windows of (id, text).

    Without ``sizes`` each text gets windows of WINDOW words or its own length;
    with ``table`` only windows whose hash may be in it.
    """
    kind = texts.schema["id"].dataType.simpleString()
    mask = np.uint64((1 << FILTER_BITS) - 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], [], []]
            for i, text in enumerate(batch.column(1)):
                template = Template(text.as_py(), known)
                n = len(template.hashes)
                for size in sizes or ([min(WINDOW, n)] if n else []):
                    at, hashes, forms = template.windows(size)
                    if table is not None:
                        spot = hashes & mask
                        hit = (table[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                        at, hashes, forms = at[hit], hashes[hit], forms[hit]
                    for p, h, f in zip(at.tolist(), hashes.view(np.int64).tolist(), forms.tolist(), strict=True):
                        for column, value in zip(rows, (i, size, p, h, f, template.values(p, size, f), n), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows[0], pa.int64())),
                    pa.array(rows[1], pa.int32()),
                    pa.array(rows[2], pa.int32()),
                    pa.array(rows[3], pa.int64()),
                    pa.array(rows[4], pa.int32()),
                    pa.array(rows[5], pa.list_(pa.string())),
                    pa.array(rows[6], pa.int32()),
                ],
                names=["id", "size", "pos", "hash", "form", "slots", "n_words"],
            )

    return texts.mapInArrow(cut, f"id {kind}, {_SCHEMA}, n_words int")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    coverage: float = COVERAGE,
) -> DataFrame:
    """(id, item, coverage, exact) for each item found in a document.

    ``coverage`` is the share of the item's template words in consistent windows:
    all windows of an alignment whose slots agree; where they do not, those with the
    item's own values in all slots, if each value that stands for several ones stands
    for itself as well (one of two equal numbers changed, but not two other names).  ``exact`` is whether all slots there hold the item's own values.  Null, empty
    and wordless texts hold nothing and are held by nothing; rows with a null id
    are not searched.  Repeated rows of one id count as one document, of one item
    id as one item.

    The documents are read once and no text is shuffled: a bit table of fixed size
    made from the items' windows lets through the few windows that may match,
    however many items there are, and only those are joined.  The items' windows
    are broadcast if they are counted to be small.
    """
    source = benchmark.where(F.col(item_column).isNotNull()).select(F.col(item_column).alias("id"), F.col(item_text).alias("text"))
    cut = compact(_rows(source, None, None), "item-windows").table
    facts = cut.agg(
        F.collect_set("size").alias("sizes"), F.sum(F.lit(64) + F.octet_length(F.array_join("slots", ""))).alias("n")
    ).first()
    spots = cut.select(F.expr(f"hash & {(1 << FILTER_BITS) - 1}").alias("spot")).distinct()  # 2 ** FILTER_BITS rows at most
    bits = np.zeros(1 << FILTER_BITS, np.uint8)
    bits[spots.toArrow().column(0).to_numpy()] = 1
    table = np.packbits(bits, bitorder="little")
    owned = docs.where(F.col(id_column).isNotNull() & F.col(text).isNotNull()).select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    hits = _rows(owned, sorted(facts.sizes), table).withColumnRenamed("id", "doc").drop("n_words")
    items = cut.select(
        F.col("id").alias("item"), "size", "hash", F.col("pos").alias("item_pos"), F.col("form").alias("item_form"), F.col("slots").alias("item_slots"), "n_words"
    )
    met = hits.join(sized(items, facts.n or 0), ["size", "hash"])
    pairs = F.zip_with("item_slots", "slots", lambda i, d: F.struct(i.alias("i"), d.alias("d")))
    places = F.sequence("item_pos", F.expr("item_pos + size - 1"))
    as_written = (F.col("form") == _AS_WRITTEN) & (F.col("item_form") == _AS_WRITTEN)
    all_of = lambda values: F.array_distinct(F.flatten(F.collect_list(values)))
    aligned = met.groupBy("doc", "item", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        all_of(pairs).alias("pairs"),
        all_of(F.when(as_written, pairs)).alias("written_pairs"),
        all_of(places).alias("places"),
        all_of(F.when(as_written, places)).alias("written_places"),
        all_of(F.when(F.col("item_slots") == F.col("slots"), places)).alias("equal_places"),
        F.max("n_words").alias("n_words"),
    )
    agree = lambda name: F.size(name) == F.size(F.array_distinct(f"{name}.i"))
    equal = lambda name: F.col(f"{name}.i") == F.col(f"{name}.d")
    # A verbatim copy with edits: values that stand for several of the document stand for themselves as well.
    renamed = F.filter("written_pairs", lambda p: ~F.exists("written_pairs", lambda q: (q["i"] == p["i"]) & (q["d"] == p["i"])))
    edited = F.size(renamed) == F.size(F.array_distinct(F.transform(renamed, lambda p: p["i"])))
    counted = aligned.select(
        "doc", "item", "n_words",
        F.when(agree("pairs"), F.col("places"))
        .when(agree("written_pairs"), F.array_union("written_places", "equal_places"))
        .when(edited, F.col("equal_places"))
        .otherwise(F.slice("places", 1, 0)).alias("places"),
        F.when(agree("pairs"), equal("pairs")).when(agree("written_pairs"), equal("written_pairs")).otherwise(F.lit(True)).alias("same"),
    )
    return (
        counted.where(F.size("places") > 0)
        .groupBy("doc", "item")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_covered"),
            F.max("n_words").alias("n_words"),
            F.min("same").alias("exact"),
        )
        .select(
            F.col("doc").alias(id_column),
            F.col("item").alias(item_column),
            (F.col("n_covered") / F.col("n_words")).alias("coverage"),
            "exact",
        )
        .where(F.col("coverage") >= coverage)
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found; all columns stay, and rows with a null id do."""
    found = compact(contaminated(docs, benchmark, id_column, text).select(id_column).distinct(), "contaminated").table
    return docs.join(sized(found, 64 * found.count()), id_column, "left_anti")
