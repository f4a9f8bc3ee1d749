"""Candidates are dealt out once, pairs meet documents no more, and documents that share an index are candidates each."""

import re

from lectern.functions import periods as P
from lectern.functions import text as X
from lectern.operators import context, retrieve

DOCS = "doc_index long, kind string, terms array<string>, span struct<lo: int, hi: int>, len int"
TOPICS = "topic_id long, q array<string>, spans array<struct<lo: int, hi: int>>"


def _tables(spark):
    docs = spark.createDataFrame([(1, "context", ["aaaa", "bbbb"], None, 10), (2, "context", ["aaaa"], (1500, 1500), 20), (2, "context", ["cccc"], (1000, 1000), 30), (None, "context", ["aaaa"], None, 5)], DOCS)
    return docs, spark.createDataFrame([(7, ["aaaa", "cccc"], [(1001, 1600)]), (8, ["bbbb"], [])], TOPICS)


def test_pairs_are_not_joined_with_documents_again(spark):
    docs, topics = _tables(spark)
    found = retrieve.scored(docs.filter("len < 30"), topics)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if re.search(r"Join .*doc_index", line)]
    assert {(r["topic_id"], r["doc_index"], r["len"]) for r in found.collect()} == {(7, 1, 10), (7, 2, 20), (8, 1, 10)}


def test_documents_that_share_an_index_are_candidates_once_each(spark):
    docs, topics = _tables(spark)
    found = retrieve.scored(docs, topics)
    # the copy of 1000 meets no span of the topic, nothing joins a null
    assert sorted((r["topic_id"], r["doc_index"], r["len"], r["n_common"]) for r in found.collect()) == [(7, 1, 10, 1), (7, 2, 20, 2), (8, 1, 10, 1)]
    undated = spark.createDataFrame([(7, ["aaaa", "cccc"], [])], TOPICS)
    picked = {r["topic_id"]: (r["picked"], r["used"]) for r in retrieve.pick(retrieve.scored(docs, undated), docs).collect()}
    assert sorted(picked[7][0]) == [1, 2, 2] and picked[7][1] == 10 + 20 + 30 + 3


def test_matched_terms_are_listed_for_what_was_picked_only(spark, monkeypatch):
    docs = spark.createDataFrame([(i, str(i), "t", "1500", "x" * (10 + i), ["aaaa", "bbbb"], None) for i in range(40)], "doc_index long, id string, title string, date_text string, text string, terms array<string>, span struct<lo: int, hi: int>")
    items = spark.createDataFrame([("q", "aaaa bbbb", None, None)], "id string, question string, source_text string, images array<string>")
    listed, scored = [], retrieve.scored

    def spied(docs, *args, audit=False, **options):
        if audit:
            listed.append(docs.count())
        return scored(docs, *args, audit=audit, **options)

    monkeypatch.setattr(retrieve, "scored", spied)
    monkeypatch.setattr(context, "strong", lambda found: found)
    row = context.short_context(items, docs, ()).first()
    assert listed == [retrieve.SHORT.lines] and [r["matched_terms"] for r in row["records"]] == [["aaaa", "bbbb"]] * 4


def test_texts_are_searched_for_what_folds_to_several_or_none_by_one_class(spark):
    _, kinds, gone = X._folds()
    every = "".join(map(chr, [*range(0x20, 0xD800), *range(0xE000, 0x30000, 7)]))
    removed = lambda pattern: spark._jvm.java.util.regex.Pattern.compile(pattern).matcher(every).replaceAll("")
    assert removed(X._unlike()) == removed("|".join([*(one for one, _, _ in kinds), gone]))


def test_years_are_runs_of_three_or_four_digits(spark):
    rows = spark.createDataFrame([("1 12 123 1234 12345 a1990b 0999-1001, 999999 100",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(P.years(rows["t"])).collect()] == [[123, 1234, 1990, 999, 1001, 100], [], None]
    assert [r[0] and tuple(r[0]) for r in rows.select(P.doc_span(rows["t"])).collect()] == [(100, 1990), None, None]
