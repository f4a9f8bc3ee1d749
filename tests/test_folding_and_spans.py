"""Folding against Python's full decomposition on all characters; spans by cells against all pairs."""

import random
import re
import sys
import unicodedata

from pyspark.sql import functions as F

from lectern.functions import periods as P
from lectern.functions import text as X
from lectern.operators import retrieve


def test_every_assigned_character_folds_as_python_does(spark):
    texts = [f"ab{c}cd {c}zwanzig{c} {c * 4}" for c in map(chr, range(1, sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cn", "Cs")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    got = {r["i"]: (r["f"], r["w"]) for r in df.select("i", X.fold(F.col("t")).alias("f"), X.terms(F.col("t")).alias("w")).collect()}
    # Hangul syllables stay whole, which no term can tell; capitals that the JVM does not know are lowered by the table
    odd = [t for i, t in enumerate(texts) if got[i][0] != X.plain(t) and not 0xAC00 <= ord(t[2]) < 0xD7A4]
    assert odd == []
    assert [t for i, t in enumerate(texts) if tuple(got[i][1]) != X.word_terms(t)] == []


def test_texts_of_many_scripts_fold_as_python_does(spark):
    rng = random.Random(2)
    letters = [c for c in map(chr, range(32, 0x1FFFF)) if unicodedata.category(c)[0] in "LMNZ" and not 0xAC00 <= ord(c) < 0xD7A4 and c != "Σ"]
    texts = ["", " ", "ŁÓDŹ ﬁn", *("".join(rng.choice([rng.choice(letters), "a", "e ", "́"]) for _ in range(rng.choice([3, 40, 300]))) for _ in range(300))]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", X.fold(F.col("t")).alias("f")).collect()
    assert all(r["f"] == (None if r["t"] is None else X.plain(r["t"])) for r in rows)


def test_no_python_worker_folds(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(X.terms(F.col("t")))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow", plan)


def test_spans_meet_by_cells_as_by_all_pairs(spark):
    rng = random.Random(4)

    def span():
        lo = rng.choice([rng.randrange(-50, 50), rng.randrange(0, 2100), 1410, 1, 9999, 20000])
        return lo, lo + rng.choice([0, 0, 1, 9, 99, 100, 2000, 30000, -1])

    docs = [(i, span() if i % 9 else None) for i in range(300)] + [(1000 + i, (1400, 1500)) for i in range(200)]  # many in one century
    topics = [(k, [span() for _ in range(rng.choice([0, 1, 3]))]) for k in range(60)]
    got = retrieve.dated_pairs(spark.createDataFrame(docs, "doc_index long, span struct<lo: int, hi: int>"), spark.createDataFrame(topics, "topic_id long, spans array<struct<lo: int, hi: int>>"))
    meets = lambda a, b: a[0] <= b[1] and a[1] >= b[0] and a[0] <= a[1] and b[0] <= b[1]
    want = sorted((k, i) for k, spans in topics for i, s in docs if s and any(meets(s, x) for x in spans))
    assert sorted((r["topic_id"], r["doc_index"]) for r in got.collect()) == want


def test_a_cover_has_few_cells_and_all_years(spark):
    spans = [(a, b) for a in range(-9, 20, 4) for b in range(a - 1, a + 40)] + [(0, 50000), (1, 2000), (-30000, 30000)]
    rows = spark.createDataFrame(spans, "lo int, hi int").select("lo", "hi", P.cover(F.col("lo"), F.col("hi")).alias("c")).collect()
    for r in rows:
        years = sorted(y for c in r["c"] for y in range(c["cell"] << c["level"], c["cell"] + 1 << c["level"]))
        assert years == list(range(r["lo"], r["hi"] + 1))
        assert len(r["c"]) <= 2 * P.LEVELS + (r["hi"] - r["lo"]) // 2**P.LEVELS + 1
