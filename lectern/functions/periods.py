"""Years, centuries and closed spans of years as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman digits, the marker of dates before the common era, the last century that counts.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}
BCE, LAST_CENTURY = "p.n.e.", 21
SPAN = "struct<lo: int, hi: int>"

# How years, centuries and decades are written.
_DIGITS = r"[0-9]{3,}"
_CENTURY = r"(?U)\b([IVX]{1,6})(?:\s*[–−-]\s*([IVX]{1,6}))?\s*(?:w\.|wieku|wiek)"
_DECADE = r"(?U)latach\s+(\d{2})\.\s*([IVX]+)\s*(?:w\.|wieku)"


def roman(text: Column) -> Column:
    """Value of a Roman number, read from the right; other characters count nothing."""
    values = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    digits = F.filter(F.split(F.reverse(F.upper(text)), ""), lambda c: c != "")

    def add(state: Column, c: Column) -> Column:
        n = F.coalesce(values[c], F.lit(0))
        return F.struct((state["total"] + F.when(n < state["most"], -n).otherwise(n)).alias("total"), F.greatest(state["most"], n).alias("most"))

    return F.aggregate(digits, F.struct(F.lit(0).alias("total"), F.lit(0).alias("most")), add, lambda s: s["total"])


def years(text: Column) -> Column:
    """All numbers of three or four digits."""
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit(_DIGITS), F.lit(0)), lambda y: F.length(y) <= 4), lambda y: y.cast("int"))


def _span(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def periods(text: Column) -> Column:
    """The spans that a topic names: its centuries, then the span of its years; a decade of a century replaces all."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(_CENTURY), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(_CENTURY), F.lit(2)).alias("b"))
    numbers = F.transform(pairs, lambda p: F.struct(roman(p["a"]).alias("a"), roman(F.when(p["b"] == "", p["a"]).otherwise(p["b"])).alias("b")))
    sound = F.filter(numbers, lambda p: (p["a"] >= 1) & (p["a"] <= p["b"]) & (p["b"] <= LAST_CENTURY))
    centuries = F.transform(sound, lambda p: _span((p["a"] - 1) * 100 + 1, p["b"] * 100))
    found = years(text)
    spans = F.concat(centuries, F.when(F.size(found) > 0, F.array(_span(F.array_min(found), F.array_max(found)))).otherwise(F.array().cast(f"array<{SPAN}>")))
    start = (roman(F.regexp_extract(text, _DECADE, 2)) - 1) * 100 + F.regexp_extract(text, _DECADE, 1).try_cast("int")
    return F.when(text.rlike(_DECADE), F.array(_span(start, start + 9))).otherwise(spans)


def doc_span(date: Column) -> Column:
    """First to last year of a document's date; null without years or before the common era."""
    ends = lambda found: F.when(F.size(found) > 0, _span(F.array_min(found), F.array_max(found)))
    return F.when(~date.contains(BCE), F.element_at(F.transform(F.array(years(date)), ends), 1))


def entry_span(dates: Column) -> Column:
    """The span of a list of dates: of each the first two years before a colon or dash."""
    heads = F.transform(dates, lambda d: F.element_at(F.split(d, "[:—–]| - ", 2), 1))
    found = F.flatten(F.transform(heads, lambda h: F.when(F.size(years(h)) > 2, F.slice(years(h), 1, 2)).otherwise(years(h))))
    return F.when((F.size(found) > 0) & ~F.array_join(dates, " ").contains(BCE), _span(F.array_min(found), F.array_max(found)))


def overlaps(span: Column, spans: Column) -> Column:
    """Whether a span, if there is one, meets any of the spans."""
    return F.coalesce(F.exists(spans, lambda s: (span["lo"] <= s["hi"]) & (span["hi"] >= s["lo"])), F.lit(False))


#: Levels of the index of years: its largest cells have 2 ** LEVELS years.
LEVELS = 13


def cells_of(year: Column) -> Column:
    """The cells that hold a year, one for each level."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda level: F.struct(level.alias("level"), F.call_function("shiftright", year.cast("int"), level).alias("cell")))


def cover(lo: Column, hi: Column) -> Column:
    """The fewest cells that make up a span of years: two a level at most, but for the last; none if it ends before it begins."""
    cell = lambda level, of: F.array(F.struct(level.alias("level"), of.alias("cell")))
    kind = "array<struct<level: int, cell: int>>"
    none = F.array().cast(kind)
    odd = lambda x: F.pmod(x, F.lit(2)) == 1

    def up(state: Column, level: Column) -> Column:
        a, b, some = state["a"], state["b"], state["a"] <= state["b"]
        left, right = some & odd(a), some & ~odd(b) & ~(odd(a) & (a == b))
        found = F.concat(state["cells"], F.when(left, cell(level, a)).otherwise(none), F.when(right, cell(level, b)).otherwise(none))
        half = lambda x: F.call_function("shiftright", x, F.lit(1))
        return F.struct(half(a + left.cast("int")).alias("a"), F.when(some, half(b - right.cast("int"))).otherwise(half(a + left.cast("int")) - 1).alias("b"), found.cast(kind).alias("cells"))

    def last(state: Column) -> Column:
        rest = F.transform(F.sequence(state["a"], F.greatest(state["a"], state["b"])), lambda c: F.struct(F.lit(LEVELS).alias("level"), c.alias("cell")))
        return F.concat(state["cells"], F.when(state["a"] <= state["b"], rest).otherwise(none).cast(kind))

    start = F.struct(lo.cast("int").alias("a"), hi.cast("int").alias("b"), none.alias("cells"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, up, last)
