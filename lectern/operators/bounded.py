"""Score-bounded retrieval: the picks of ``retrieve.pick`` without scoring every pair that shares a term.

The index has a block of postings for each term and weight.  A topic's blocks
are asked in the order of what they can add to a score; a document that is in
none of those asked so far cannot score more than the rest adds up to.  All
rows above that bound are known, in their order, and are folded; a topic whose
lines are full, or into whose room no document fits, is done.  The others ask
more blocks, and only for documents that still fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import overlaps
from ..functions.text import DOMESTIC_STEMS
from ..store import bounded, drop, materialize
from .retrieve import DECIMALS, DEFAULT, OVERLAP_BONUS, Budget, dated_pairs, pick, weighted_terms

#: Postings that a topic asks for in its first round, and how many times more in each later one.
ASKED, GROWTH = 64, 64
#: What rounding may add to a score.
MARGIN = 2 * 10.0**-DECIMALS
#: Name of the block of timeline documents that meet a domestic topic's periods: they need no common term.
MET = ""


def postings(docs: DataFrame, weighed: DataFrame, field_weight: Column | None = None) -> DataFrame:
    """term, weight, doc_index and len of the postings of all terms that topics ask for; a block is those of one term and weight."""
    weight = F.lit(1.0) if field_weight is None else field_weight.cast("double")
    fields = [] if field_weight is None else _fields(docs)
    terms = bounded(materialize(weighed.select("term").distinct(), "asked"))
    # postings stay where their document is, short documents first: the filters of later rounds skip most of a file
    ordered = docs.select("doc_index", "len", *fields, "terms").sortWithinPartitions("len")
    rows = ordered.select("doc_index", "len", *fields, F.explode("terms").alias("term")).join(terms, "term", "left_semi")
    rows = rows.select("term", weight.alias("weight"), "doc_index", "len")
    return materialize(rows, "postings")


def _fields(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("terms", "term", "doc_index", "span", "len", "kind")]


def _blocks(index: DataFrame, weighed: DataFrame, domestic: DataFrame) -> DataFrame:
    """topic_id, term, weight, before (postings of the blocks before this one) and rest (the most that those after it add).

    A document holds a term in one block, so the blocks after a place add the
    most of each term's that are left: the sum of what each is above its term's
    next.  The block of met periods is asked last.
    """
    sizes = index.groupBy("term", "weight").agg(F.count("*").alias("n"))
    blocks = weighed.drop("n", "df").join(sizes, "term").select("topic_id", "term", "weight", (F.col("idf") * F.col("weight")).alias("adds"), "n")
    met = domestic.select("topic_id", F.lit(MET).alias("term"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("adds"), F.lit(0).cast("long").alias("n"))
    order = Window.partitionBy("topic_id").orderBy(F.desc("adds"), F.desc("term"), "weight")
    next_of_term = F.lead("adds", 1, 0.0).over(Window.partitionBy("topic_id", "term").orderBy(F.desc("adds"), "weight"))
    blocks = blocks.union(met).withColumn("above", F.col("adds") - next_of_term)
    return blocks.select(
        "topic_id", "term", "weight", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.coalesce(F.sum("above").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)).alias("rest"),
    )


def _scored(docs: DataFrame, index: DataFrame, wanted: DataFrame, weighed: DataFrame, topics: DataFrame, bonus: float) -> DataFrame:
    """topic_id, doc_index, len and score of wanted pairs whose periods, if both have some, meet."""
    wanted = bounded(wanted)
    own = [F.col("len").cast("long").alias("len"), F.col("span.lo").alias("from"), F.col("span.hi").alias("to")]
    hits = index.select("doc_index", "term", "weight").join(wanted, "doc_index").join(weighed.select("topic_id", "term", "idf"), ["topic_id", "term"])
    hits = hits.select("topic_id", "doc_index", (F.col("idf") * F.col("weight")).alias("adds"))
    # a pair need not have a common term
    pairs = docs.select("doc_index", *own).join(wanted, "doc_index").withColumn("adds", F.lit(0.0)).unionByName(hits, allowMissingColumns=True)
    sums = pairs.groupBy("topic_id", "doc_index").agg(F.sum("adds").alias("base"), *[F.min(c).alias(c) for c in ("len", "from", "to")])
    rows = sums.join(topics.select("topic_id", "spans"), "topic_id")
    meets = overlaps(F.struct(F.col("from").alias("lo"), F.col("to").alias("hi")), F.col("spans"))
    dated = F.col("from").isNotNull() | F.col("to").isNotNull()
    rows = rows.filter(~((F.size("spans") > 0) & dated & ~meets))
    return rows.select("topic_id", "doc_index", "len", F.round(F.col("base") + F.when(meets, bonus).otherwise(0.0), DECIMALS).alias("score"))


def pick_bounded(docs: DataFrame, topics: DataFrame, budget: Budget = DEFAULT, field_weight: Column | None = None, bonus: float = OVERLAP_BONUS, domestic: bool = True, weighed: DataFrame | None = None) -> DataFrame:
    """topic_id, picked and used as ``pick`` gives them over all of ``scored``, and n_scored: the pairs that were looked at.

    ``docs`` has doc_index, len, terms, span and kind; topics without a pick
    have no row.  Equal scores are told apart by doc_index as there.  The
    topics' weighted terms may be given, as ``weighted_terms`` has them.
    """
    least = docs.agg(F.min("len")).first()[0]
    if weighed is None:
        weighed = weighted_terms(docs, topics)
    index = postings(docs, weighed, field_weight)
    home = topics.filter(F.arrays_overlap("q", F.array(*map(F.lit, DOMESTIC_STEMS))) & F.lit(domestic))
    blocks = bounded(materialize(_blocks(index, weighed, home), "blocks"))
    spans = topics.select("topic_id", F.when(F.size("spans") > 0, bonus).otherwise(0.0).alias("bonus"))
    start = blocks.select("topic_id").distinct().join(spans, "topic_id").select("topic_id", F.array().cast("array<bigint>").alias("picked"), F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("n_scored"), "bonus")
    states = materialize(start, "states")
    waiting = seen = out = None
    target, before = ASKED, 0
    while True:
        room = states.select("topic_id", (budget.chars - budget.in_test - F.col("used")).alias("room"))
        most = room.agg(F.max("room")).first()[0]
        asked = blocks.filter((F.col("before") < target) & (F.col("before") >= before))
        fits = F.col("len") <= F.col("room")
        # the most room of all is known before the index is read
        short = index if most is None else index.filter(F.col("len") <= F.lit(most).cast(index.schema["len"].dataType))
        wanted = short.join(asked, ["term", "weight"]).join(room, "topic_id").filter(fits).select("topic_id", "doc_index")
        if domestic:
            due = home.join(asked.filter(F.col("term") == MET).select("topic_id"), "topic_id", "left_semi")
            also = dated_pairs(docs.filter("kind = 'timeline'"), due).distinct().join(docs.select("doc_index", "len"), "doc_index").join(room, "topic_id").filter(fits)
            wanted = wanted.union(also.select("topic_id", "doc_index"))
        wanted = wanted.distinct() if seen is None else wanted.distinct().join(seen, ["topic_id", "doc_index"], "left_anti")
        wanted = materialize(wanted, "wanted")
        found = _scored(docs, index, wanted, weighed, topics, bonus)
        rows = materialize(found if waiting is None else found.unionByName(waiting.join(room, "topic_id").filter(fits).drop("room")), "rows")
        # what a document that was not looked at can score at most
        left = blocks.groupBy("topic_id").agg(F.min(F.when(F.col("before") < target, F.col("rest"))).alias("rest"), F.max("before").alias("last"))
        bound = left.join(spans, "topic_id").select("topic_id", F.when(F.col("last") < target, float("-inf")).otherwise(F.col("rest") + F.col("bonus") + MARGIN).alias("bound"))
        known = rows.join(bound, "topic_id")
        got = pick(known.filter("score > bound").select("topic_id", "doc_index", "score", "len"), docs, budget, states)
        counted = wanted.groupBy("topic_id").agg(F.count("*").alias("more"))
        got = got.withColumnsRenamed({"picked": "now", "used": "now_used"})
        after = states.join(got, "topic_id", "left").join(counted, "topic_id", "left").join(bound, "topic_id")
        after = after.select("topic_id", F.coalesce("now", "picked").alias("picked"), F.coalesce("now_used", "used").alias("used"), (F.col("n_scored") + F.coalesce("more", F.lit(0))).alias("n_scored"), "bonus", "bound")
        done = (F.col("bound") == float("-inf")) | (F.size("picked") >= budget.lines) | (F.col("used") + budget.in_test + F.lit(least) > budget.chars)
        after = materialize(after.withColumn("done", done), "states")
        ready = after.filter("done").filter(F.size("picked") > 0).select("topic_id", "picked", "used", "n_scored")
        out = ready if out is None else out.union(ready)
        states = after.filter("not done").drop("bound", "done")
        if not states.limit(1).count():
            drop(index)
            return out
        waiting = known.filter("score <= bound").join(states.select("topic_id"), "topic_id", "left_semi").drop("bound")
        seen = wanted if seen is None else seen.union(wanted)
        before, target = target, target * GROWTH

