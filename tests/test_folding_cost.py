"""Folding meets few ranges of its classes for a character, and its classes hold what they are made of."""

import time
import unicodedata

from lectern.functions import text as X


def _found(spark, pattern, text):
    matcher = spark._jvm.java.util.regex.Pattern.compile(pattern).matcher(text)
    start = time.perf_counter()
    found = matcher.find()
    return found, time.perf_counter() - start


def test_a_long_text_is_ruled_out_about_as_fast_as_by_one_range(spark):
    _, kinds, gone = X._folds()
    rest = "|".join([*(one for one, _, _ in kinds), gone])
    text = "zazolc gesla jazn ПРИВЕТ " * 40_000
    least = lambda pattern: min(_found(spark, pattern, text)[1] for _ in range(4))
    assert not _found(spark, rest, text)[0]
    # a flat class of some hundred ranges takes above a hundred times as long
    assert least(rest) < 40 * least(r"[\x{10FFF0}-\x{10FFFF}]")


def test_nested_classes_hold_the_same_characters(spark):
    for letters in (["a"], list("abcxyz"), [chr(c) for c in range(0x80, 0x3000, 3)], [chr(c) for c in range(0x80, 0x30000) if unicodedata.combining(chr(c))]):
        held = set(letters)
        every = "".join(map(chr, [*range(0x20, 0xD800, 1), *range(0xE000, 0x30000, 7)]))
        left = spark._jvm.java.util.regex.Pattern.compile(X._ranges(letters)).matcher(every).replaceAll("")
        assert left == "".join(c for c in every if c not in held)
