"""Text functions as column expressions: folding, terms, counts, splits and detectors."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no search terms, compared whole and folded.
STOP_WORDS = (
    "oraz przez ktore ktory tego jego jako byly byla bylo tym jest wobec tezy temat zajmij stanowisko uzasadnij swojej "
    "argumentacji uwzgledniajac wybrane trzech trzy okresie wieku zyciu powyzszej"
).split()
# Letters of a term, and the shortest word that gives one.
TERM_LETTERS, SHORTEST_WORD = 5, 4
# Stems that mark a topic as domestic (a stem of three letters cannot occur).
DOMESTIC_STEMS = ("polsk", "rzecz", "piast")
# Tags that betray unparsed reasoning.
REASONING_TAGS = ("<think>", "</think>", "<|channel>", "<channel|>")

# Words whose terms say nothing in a short question, and in a topic that is looked up in the alternate corpus.
GENERIC_SHORT = (
    "źródło tekst autor fragment wydarzenie historia historyczny Polska polski państwo polityka społeczeństwo odpowiedź uzasadnienie "
    "przedstawiony wyjaśnij podaj wskaż rozstrzygnij nazwa"
)
GENERIC_TOPIC = (
    "Zajmij stanowisko wobec powyższej tezy uzasadnij uwzględniając argumentacji aspekt polityczny społeczny gospodarczy kulturowy trzy "
    "wybrane wydarzenia panowanie okres wiek przyczyny skutki"
)


def plain(text: str) -> str:
    """Lower case, decomposed by compatibility, without combining marks: what ``fold`` gives, of a text that is known when a plan is made."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().replace("ł", "l")) if not unicodedata.combining(c))


def word_terms(words: str) -> tuple[str, ...]:
    """The terms of a few words that are known when a plan is made."""
    found = re.findall(f"[a-z]{{{SHORTEST_WORD},}}", plain(words))
    return tuple(sorted({w[:TERM_LETTERS] for w in found if w not in STOP_WORDS}))


#: Hangul syllables, which stay whole: no term holds them.
_SYLLABLES = range(0xAC00, 0xD7A4)
#: Letters beyond which an expansion is long: few are.
_LONG = 3


#: Parts of a nested class: of so many ranges, or classes of them, one is looked at, if any.
_PARTS = 8


def _ranges(letters: list[str]) -> str:
    """A class of a regular expression that holds these characters: ranges, nested so that a character meets few of them.

    A flat class tries all its ranges for every character that it does not hold; here the bounds
    of a part rule out what is in it, so that an ASCII letter costs one comparison.
    """
    codes, found = sorted(map(ord, letters)), []
    for code in codes:
        if found and found[-1][1] == code - 1:
            found[-1][1] = code
        else:
            found.append([code, code])
    parts = [(lo, hi, f"\\x{{{lo:x}}}-\\x{{{hi:x}}}") for lo, hi in found]
    while len(parts) > 1:
        groups = [parts[i : i + _PARTS] for i in range(0, len(parts), _PARTS)]
        parts = [(g[0][0], g[-1][1], f"[\\x{{{g[0][0]:x}}}-\\x{{{g[-1][1]:x}}}&&[{''.join(told for _, _, told in g)}]]") for g in groups]
    return f"[{parts[0][2]}]"


@functools.cache
def _unlike() -> str:
    """The class of all characters that become several or vanish, as one: a text is searched for it once."""
    codes = (c for c in range(0x80, sys.maxunicode + 1) if c not in _SYLLABLES and not 0xD800 <= c < 0xE000)
    return _ranges([c for c in map(chr, codes) if len(plain(c)) != 1])


@functools.cache
def _folds() -> tuple[tuple[str, str], list[tuple[str, str, list[str]]], str]:
    """Of all characters: those that become one other, as two strings; those that become several, short and long ones
    apart, as a class, a string, and strings of their first, second ... letters; and the class of those that vanish.

    A string of n-th letters is shorter than that of the characters, which go by the length of what they become: so
    ``translate`` drops those that have no n-th letter.
    """
    single, several, gone = {}, {}, []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if code in _SYLLABLES or 0xD800 <= code < 0xE000 or (p := plain(c)) == c:
            continue
        if not p:
            gone.append(c)
        elif len(p) == 1:
            single[c] = p
        else:
            several[c] = p
    kinds = []
    for long in (False, True):
        own = sorted((c for c, p in several.items() if (len(p) > _LONG) == long), key=lambda c: (-len(several[c]), c))
        nth = ["".join(several[c][i] for c in own if len(several[c]) > i) for i in range(len(several[own[0]]))]
        kinds.append((_ranges(own), "".join(own), nth))
    return ("".join(single), "".join(single.values())), kinds, _ranges(gone)


def let(value: Column, use) -> Column:
    """What ``use`` makes of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold(text: Column) -> Column:
    """Lower case, decomposed by compatibility (NFKD), without combining marks; Hangul syllables stay whole.

    One-to-one letters are translated at once; only texts that hold others are
    cut at them, which are spelled out letter by letter.
    """
    (of, to), kinds, gone = _folds()

    def spelled(out: Column) -> Column:
        for one, letters, nth in kinds:
            parts = F.regexp_extract_all(out, F.lit(f"{one}|[\\x00-\\x7F[^{one[1:]}]+"), F.lit(0))
            whole = lambda p: F.concat(*[F.translate(p, letters, told) for told in nth])  # noqa: B023, E731
            out = F.when(out.rlike(one), F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^{one}"), whole(p)).otherwise(p)), "")).otherwise(out)  # noqa: B023
        return F.regexp_replace(out, f"{gone}+", "")

    def accents(lower: Column) -> Column:
        return F.when(lower.rlike(r"[^\x00-\x7F]"), let(F.translate(lower, of, to), lambda out: F.when(out.rlike(_unlike()), spelled(out)).otherwise(out))).otherwise(lower)

    return let(F.lower(text), accents)


def terms(text: Column, without: tuple[str, ...] = ()) -> Column:
    """The sorted distinct terms of a text: folded words cut to their first letters, stop words left out.

    ``without`` are terms that are left out as well.
    """
    words = F.regexp_extract_all(fold(text), F.lit(f"[a-z]{{{SHORTEST_WORD},}}"), F.lit(0))
    words = F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))  # distinct ones
    out = F.sort_array(F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, TERM_LETTERS))))
    return F.array_except(out, F.array(*map(F.lit, without))) if without else out


def word_count(text: Column) -> Column:
    """Number of words between Unicode white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0)).cast("long")


def strip(text: Column) -> Column:
    """The text without Unicode white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    """Whether a text is null or only white space."""
    return text.isNull() | ~text.rlike(r"(?U)\S")


def has_reasoning_tags(text: Column) -> Column:
    """Whether a text holds one of the reasoning tags."""
    out = F.lit(False)
    for tag in REASONING_TAGS:
        out = out | F.coalesce(text.contains(tag), F.lit(False))
    return out


def topic_parts(question: Column) -> Column:
    """The topics of a question: what follows each numbered heading, or the whole question if there is none."""
    parts = F.split(question, r"(?m)(?U)^\s*(?:Temat\s+)?\d+[.)]\s+")
    return F.when(F.size(parts) > 1, F.slice(parts, F.lit(2), F.size(parts) - 1)).otherwise(F.array(question))


# What a question's limits and an essay look like, in folded text.
_UNIT = r"\s*(?:slow|wyraz|words)"


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def word_bounds(question: Column) -> Column:
    """Struct of the least and the most words that a question asks for; null where it names none."""
    text = fold(question)
    interval = r"(?U)\b(\d+)\s*[-–]\s*(\d+)" + _UNIT
    low = _number(text, r"(?U)(?:minimum|co najmniej|at least|min\.)\s*(\d+)" + _UNIT)
    high = _number(text, r"(?U)(?:maksymalnie|maksimum|nie wiecej niz|at most|maximum)\s*(\d+)" + _UNIT)
    return F.struct(F.coalesce(low, _number(text, interval, 1)).alias("low"), F.coalesce(high, _number(text, interval, 2)).alias("high"))


def essay_class(question: Column, max_points: Column) -> Column:
    """``essay``, ``uncertain`` or ``short``, by the question's wording and its points."""
    text = fold(F.coalesce(question, F.lit("")))
    length = text.rlike(r"(?U)\b\d{3,4}" + _UNIT)
    choice = text.rlike(r"(?U)wybierz\s+jeden|choose\s+one")
    explicit = text.rlike(r"(?U)wypracowan|\besej|\bessay")
    return (
        F.when(explicit | (length & choice), "essay")
        .when(length | F.coalesce(max_points >= 10, F.lit(False)), "uncertain")
        .otherwise("short")
    )
