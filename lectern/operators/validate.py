"""Validation rules over a run's rows: each gives violations, all together a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import has_reasoning_tags, is_blank, word_bounds, word_count
from ..sources import versions


# The messages below, which tell a run's reader what to look at.
def row_rules(answer: Column, recorded: Column, truncated: Column, finish: Column, essay: Column, question: Column) -> Column:
    """The messages that a row's rules give, in the order of the rules; a blank answer ends the list."""
    bounds, words = word_bounds(question), word_count(answer)
    low, high = bounds["low"], bounds["high"]
    stopped = F.coalesce(finish, F.lit(""))
    rules = [
        (~answer.eqNullSafe(recorded), F.lit("answer differs from records")),
        (F.coalesce(truncated, F.lit(False)) | (stopped == "length"), F.lit("truncated answer")),
        (stopped != "stop", F.lit("unexpected finish_reason")),
        (has_reasoning_tags(answer), F.lit("reasoning markers in answer")),
        (essay & F.coalesce(words < low, F.lit(False)), F.concat(words.cast("string"), F.lit(" words, minimum "), low.cast("string"))),
        (essay & F.coalesce(words > high, F.lit(False)), F.concat(words.cast("string"), F.lit(" words, maximum "), high.cast("string"))),
    ]
    told = F.array_compact(F.array(*[F.when(rule, text) for rule, text in rules]))
    return F.when(is_blank(answer), F.array(F.lit("empty answer"))).otherwise(told)


def row_violations(rows: DataFrame) -> DataFrame:
    """id, nth, message; ``rows`` has id, answer, recorded, truncated, finish_reason, essay, question."""
    found = row_rules(*map(F.col, ("answer", "recorded", "truncated", "finish_reason", "essay", "question")))
    return rows.select("id", F.posexplode(found).alias("nth", "message"))


def warnings(rows: DataFrame) -> DataFrame:
    """Essays whose question names no length, and rows that hit the token limit."""
    bounds = word_bounds(F.col("question"))
    open_end = F.col("essay") & bounds["low"].isNull() & bounds["high"].isNull()
    told = F.array_compact(F.array(
        F.when(open_end, F.lit("no explicit word limit parsed; inspect task manually")),
        F.when(F.coalesce("truncated", F.lit(False)), F.lit("token limit reached")),
        F.when(F.col("essay") & (word_count(F.col("answer")) < 300), F.lit("fewer than 300 words")),
    ))
    return rows.select("id", F.posexplode(told).alias("nth", "message"))


def with_records(answers: DataFrame, records: DataFrame, items: DataFrame, essays: DataFrame) -> DataFrame:
    """The answers (pos, id, answer) beside their records, questions, and whether they are essays: what the row rules need."""
    known = records.select("id", F.col("answer").alias("recorded"), "truncated", "finish_reason")
    asked = items.select("id", "question").withColumn("known", F.lit(True))
    rows = answers.join(known, "id", "left").join(asked, "id", "left").join(essays.select("id").distinct().withColumn("essay", F.lit(True)), "id", "left")
    return rows.withColumns({"question": F.coalesce("question", F.lit("")), "essay": F.coalesce("essay", F.lit(False)) & F.coalesce("known", F.lit(False))}).drop("known")


def run_violations(items: DataFrame, answers: DataFrame, records: DataFrame, fingerprints: DataFrame, exam_ids: DataFrame) -> DataFrame:
    """nth and message of every rule on the run as a whole: hashes, exam ids, item ids in order, coverage.

    ``fingerprints`` has one row with the exam's hash now and the run's
    (actual, recorded), ``exam_ids`` one with the answers' and the exam's
    (actual, expected); nulls are values.
    """
    hashes = fingerprints.filter(~F.col("actual").eqNullSafe(F.col("recorded"))).select(F.lit(0).alias("nth"), F.lit("Exam hash differs from the run").alias("message"))
    named = exam_ids.filter(~F.col("actual").eqNullSafe(F.col("expected"))).select(F.lit(1), F.lit("exam_id mismatch"))
    pairs = items.select("pos", F.col("id").alias("expected")).join(answers.select("pos", F.col("id").alias("actual")), "pos", "full")
    moved = pairs.filter(~F.col("expected").eqNullSafe(F.col("actual"))).limit(1).select(F.lit("x").alias("x"))
    twice = answers.groupBy("id").count().filter("count > 1").limit(1).select(F.lit("x").alias("x"))
    order = moved.union(twice).distinct().select(F.lit(2), F.lit("Missing, extra, duplicate or reordered IDs"))
    one, two = items.select("id").distinct(), records.select("id").distinct()
    apart = one.join(two, "id", "left_anti").union(two.join(one, "id", "left_anti")).limit(1)
    return reduce(DataFrame.union, [hashes, named, order, apart.select(F.lit(3), F.lit("Records do not cover the full exam"))])


def report(violations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: status, number of violations and of answers."""
    n = violations.agg(F.count("*").alias("n_errors"))
    return n.crossJoin(rows.agg(F.count("*").alias("answer_count"))).select(F.when(F.col("n_errors") == 0, "PASS").otherwise("FAIL").alias("status"), "n_errors", "answer_count")


def full_report(items: DataFrame, answers: DataFrame, records: DataFrame, essays: DataFrame, fingerprints: DataFrame, exam_ids: DataFrame) -> DataFrame:
    """One row: status, errors and warnings in order (those on the run, then row by row), answer_count and essay_ids."""
    rows = with_records(answers, records, items, essays)
    run = run_violations(items, answers, records, fingerprints, exam_ids).select(F.lit(-1).alias("pos"), "nth", "message")
    told = F.concat(F.coalesce("id", F.lit("None")), F.lit(": "), F.col("message"))
    row = row_rules(*map(F.col, ("answer", "recorded", "truncated", "finish_reason", "essay", "question")))
    by_row = rows.select("pos", "id", F.posexplode(row).alias("nth", "message")).select("pos", "nth", told.alias("message"))
    bounds = word_bounds(F.col("question"))
    open_end = rows.filter(F.col("essay") & ~is_blank(F.col("answer")) & bounds["low"].isNull() & bounds["high"].isNull())
    open_end = open_end.select("pos", F.lit(0).alias("nth"), F.concat(F.col("id"), F.lit(": no explicit word limit parsed; inspect task manually")).alias("message"))
    listed = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("pos", "nth", "message"))), lambda x: x["message"]).alias(name)
    errors, warned = run.union(by_row).agg(listed("errors")), open_end.agg(listed("warnings"))
    counted = answers.agg(F.count("*").alias("answer_count")).crossJoin(essays.agg(F.sort_array(F.collect_set("id")).alias("essay_ids")))
    return errors.crossJoin(warned).crossJoin(counted).select(F.when(F.size("errors") == 0, "PASS").otherwise("FAIL").alias("status"), "errors", "warnings", "answer_count", "essay_ids")


VIOLATIONS = "pos long, nth long, id string, message string"


def write_report(items: DataFrame, answers: DataFrame, records: DataFrame, essays: DataFrame, fingerprints: DataFrame, exam_ids: DataFrame, path: str) -> dict:
    """Writes all violations as a table (pos, nth, id, message), each file in order, and returns the report's figures.

    pos is -1 and id null for those on the run as a whole.  The figures
    (status, n_errors, answers, completed, truncated, short) are observed on
    the rows as they are written, which are read once; the table replaces an
    earlier one as a whole, and is never gathered anywhere.
    """
    seen, found = Observation(), Observation()
    rows = with_records(answers, records, items, essays)
    told = row_rules(*map(F.col, ("answer", "recorded", "truncated", "finish_reason", "essay", "question")))
    cut = F.coalesce("truncated", F.lit(False)) | F.coalesce(F.col("finish_reason") == "length", F.lit(False))
    count = lambda rule, name: F.count(F.when(rule, 1)).alias(name)
    low = word_bounds(F.col("question"))["low"]
    rows = rows.observe(
        seen, F.count("*").alias("answers"), count(~is_blank(F.col("answer")) & ~cut & F.col("recorded").isNotNull(), "completed"), count(cut, "truncated"),
        count(F.col("essay") & F.coalesce(word_count(F.col("answer")) < low, F.lit(False)), "short"),
    )
    by_row = rows.select(F.col("pos").cast("long").alias("pos"), F.col("id"), F.posexplode(told).alias("nth", "message"))
    run = run_violations(items, answers, records, fingerprints, exam_ids)
    both = by_row.select("pos", F.col("nth").cast("long").alias("nth"), "id", "message").union(run.select(F.lit(-1).cast("long"), F.col("nth").cast("long"), F.lit(None).cast("string"), "message"))
    # no exchange by range here: its sample would run the observed rows twice
    both = both.sortWithinPartitions("pos", "nth").observe(found, F.count("*").alias("n_errors"))
    versions.replace(both, path)
    figures = found.get | seen.get
    return {"status": "FAIL" if figures["n_errors"] else "PASS"} | figures
