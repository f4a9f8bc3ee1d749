"""Operator 5: mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1, a ramp
``target * (1 + g * (2 * t - 1))``.  Its integral is the source's cumulative
token demand, ``target * (t + g * (t * t - t))``; a document's position is the
time at which the demand reaches the document's first token in the source's
own stream, which the inverse of the integral gives in closed form.  Sorting
by range of position yields the training order.

A source's stream is its documents in a fixed pseudo-random order, repeated
as often as the target needs; the document at which the target is reached is
taken in part, so each source's taken words equal its target's whole part.
Offsets in the stream come from sums by bucket, so no source, however large,
is gathered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import apart, home
from .store import bounded, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights and ramps go round the sources in order of their names.
WEIGHTS = (5.0, 2.0, 1.0)
RAMPS = (-0.5, 0.0, 0.5)
MOST_REPEATS = 3


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _round_robin(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights=WEIGHTS, ramps=RAMPS, most: int = MOST_REPEATS) -> DataFrame:
    """Target of each source: its share of all words, at most ``most`` times its size.

    ``sizes`` has one row per source (source, source_size).  Filling up is
    solved at once: in ascending order of the share at which a source hits its
    limit, the first source that stays below it fixes the share of all others.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    limit = F.col("source_size") * most
    rows = sizes.withColumn("rank", F.row_number().over(by_name))
    rows = rows.withColumns({"weight": _round_robin(weights, F.col("rank")), "ramp": _round_robin(ramps, F.col("rank"))})
    rows = rows.withColumn("limit_at", limit / F.col("weight"))
    order = Window.orderBy("limit_at", "rank")
    rows = rows.withColumns({
        "below": F.coalesce(F.sum(limit).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "all": F.sum("source_size").over(Window.orderBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    rows = rows.withColumn("share", (F.col("all") - F.col("below")) / F.col("rest"))
    first = F.first(F.when(F.col("share") <= F.col("limit_at"), F.col("share")), ignorenulls=True)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.coalesce(first.over(whole), F.lit(0.0))
    return rows.select(
        "source", "source_size", "ramp", F.least(limit.cast("double"), share * F.col("weight")).alias("target")
    )


def _digits(rows: int) -> int:
    """Hexadecimal digits of a bucket's name: about a thousand rows a bucket, as rows grow, up to a million buckets."""
    return min(5, max(3, math.ceil(math.log(max(rows, 1) / 1000, 16))))


def allocate(docs: DataFrame, weights=WEIGHTS, ramps=RAMPS, most: int = MOST_REPEATS, row: Column | None = None) -> DataFrame:
    """What the mix takes of each document, and when.

    ``docs`` needs doc_id, source and text.  Returns one row per input row:
    doc_id, source, size, source_size, target, taken, copies (array of
    struct<position, words>: the training time of each copy and how many of
    its words are taken) and row, what ``row`` gives (null without it).  Null
    and empty texts have size 0 and are never taken; a null source is a source
    of its own; rows that share a doc_id are placed one after the other by size
    and ``row``, which of them first being open only between rows equal in all.
    """
    row = F.lit(None).cast("long") if row is None else row
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row.alias("row")), "mix-sizes").withColumn("key", key)
    rows = rows.withColumn("bucket", F.substring("key", 1, _digits(rows.count())))
    by_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    goal = targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, ramps, most)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = by_bucket.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_start"))
    named = goal.withColumnRenamed("source", "_source")
    buckets = buckets.join(named, F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "bucket_start", "source_size", "ramp", "target"
    )
    in_bucket = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    placed = placed.join(buckets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    whole = F.floor(F.col("target") + 1e-6)
    starts = [F.col("source_size") * k + F.col("bucket_start") + F.col("inner") for k in range(most)]
    parts = [F.greatest(F.lit(0), F.least(F.col("size"), whole - s)).cast("long") for s in starts]
    copies = [F.when(p > 0, F.struct(_when(s, F.col("target"), F.col("ramp")).alias("position"), p.alias("words"))) for s, p in zip(starts, parts)]
    return placed.select("doc_id", "source", "size", "source_size", "target", sum(parts[1:], parts[0]).alias("taken"), F.array_compact(F.array(*copies)).alias("copies"), "row")


def _when(start: Column, target: Column, g: Column) -> Column:
    """Time at which cumulative demand reaches ``start``: the root of g t^2 + (1 - g) t = start / target."""
    share = start / target
    curved = (F.sqrt((1 - g) * (1 - g) + 4 * g * share) - (1 - g)) / (2 * g)
    return F.when(g == 0, share).otherwise(curved)


#: Bins of training time within which copies are counted and ranked.
BINS = 4096


def training_ranks(plan: DataFrame) -> DataFrame:
    """The rows of ``allocate`` with first_position and first_rank: when the first copy comes, and as which of all copies.

    Copies go by position, then doc_id.  Ranks come from counts by bin of
    training time, so no task sees more than a bin of them.
    """
    plan = materialize(plan.withColumn("_nth", F.monotonically_increasing_id()), "mix-plan")
    copies = plan.select("_nth", "doc_id", F.explode("copies").alias("c")).select("_nth", "doc_id", "c.position", F.floor(F.col("c.position") * BINS).alias("bin"))
    sizes = copies.groupBy("bin").agg(F.count("*").alias("n"))
    # at most BINS + 1 rows
    sizes = sizes.select(F.col("bin").alias("_bin"), F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    ranked = copies.withColumn("_rank", F.row_number().over(Window.partitionBy("bin").orderBy("position", "doc_id", "_nth")))
    ranked = ranked.join(F.broadcast(sizes), F.col("bin") == F.col("_bin")).groupBy("_nth").agg(F.min("position").alias("first_position"), F.min(F.col("earlier") + F.col("_rank")).alias("first_rank"))
    return plan.join(ranked, "_nth", "left").drop("_nth")


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), n.cast("int")), "")


def curriculum_mix(docs: DataFrame, weights=WEIGHTS, ramps=RAMPS, most: int = MOST_REPEATS) -> DataFrame:
    """The rows of ``docs`` in training order, one for each copy that is taken.

    All columns of ``docs`` stay; the order is by position, then doc_id.  Of a
    copy that is taken in part the text is cut after its last word that is
    taken, so each source gives its target's whole part in words.  Rows are
    told apart by all their columns, doc_id or not; equal ones are interchangeable.
    """
    docs, back = apart(docs, "doc_id", "source", "text")
    row = F.xxhash64(*[F.to_json(c) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(c) for c, f in zip(docs.columns, docs.schema)])
    plan = allocate(docs, weights, ramps, most, row).filter(F.size("copies") > 0)
    plan = materialize(plan.select("doc_id", "row", "size", "copies"), "mix-plan")
    again = plan.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    copies = plan.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "size", F.explode("copies").alias("_c"))
    copies = copies.select("_id", "_row", F.col("_c.position").alias("_position"), F.when(F.col("_c.words") < F.col("size"), F.col("_c.words")).alias("_words"))
    rows = docs.withColumn("_key", row)
    rows = rows.dropDuplicates(["_key"]) if again else rows
    rows = rows.join(bounded(copies), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_row")))
    if "text" in docs.columns:
        rows = rows.withColumn("text", F.when(F.col("_words").isNotNull(), first_words(F.col("text"), F.col("_words"))).otherwise(F.col("text")))
    return home(rows.repartitionByRange("_position", "_id").sortWithinPartitions("_position", "_id").select(*docs.columns), back)


def op5_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    """Sizes, targets, taken words and training order of all ``documents``, sorted by range of the first copy's position."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    plan = training_ranks(allocate(docs))
    plan = plan.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.size("copies").cast("long").alias("n_copies"), F.round("first_position", 9).alias("first_position"), "first_rank")
    return plan.repartitionByRange(F.col("first_rank").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("first_rank").asc_nulls_last(), "doc_id")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sources),
shares AS (
  SELECT *, source_size * 3 / weight AS limit_at,
         (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY source_size * 3 / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM weighed),
goal AS (
  SELECT source, source_size, CASE (rank - 1) % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0::DOUBLE ELSE 0.5::DOUBLE END AS ramp,
         least((source_size * 3)::DOUBLE, weight * coalesce((SELECT arg_min(share, limit_at) FROM shares WHERE share <= limit_at), 0)) AS target
  FROM shares),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.ramp,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
copies AS (
  SELECT *, (start + k * source_size)::DOUBLE / target AS share, least(size, floor(target + 1e-6) - start - k * source_size) AS words
  FROM placed, (SELECT unnest([0, 1, 2]) AS k) WHERE least(size, floor(target + 1e-6) - start - k * source_size) > 0),
timed AS (
  SELECT doc_id, words, CASE WHEN ramp = 0 THEN share ELSE (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * share) - (1 - ramp)) / (2 * ramp) END AS position
  FROM copies),
ranked AS (SELECT *, row_number() OVER (ORDER BY position, doc_id) AS place FROM timed),
told AS (SELECT doc_id, sum(words) AS taken, count(*) AS n, min(position) AS position, min(place) AS place FROM ranked GROUP BY doc_id)
SELECT p.doc_id, size, source_size, round(target, 6) AS target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, coalesce(n, 0) AS n_copies,
       round(t.position, 9) + 0.0 AS first_position, t.place AS first_rank
FROM placed p LEFT JOIN told t ON t.doc_id = p.doc_id
"""
