"""Operator 10: n-gram Jaccard self-join with adaptive multi-match prefixes.

Each document is the set of its word shingles, as 64-bit hashes.  In any common
order of shingles, two sets of similarity t or more share at least ``l`` of the
first ``n - ceil(t n) + l`` members of each: a longer prefix asks for more
shared members.  That is used twice.

First in the order of hashes, which needs no counts: prefixes are lengthened in
proportion to the set, and only sets whose prefix has as many members in common
with other prefixes as the smallest possible partner asks for stay.  Then, for
what is left, shingles are counted exactly and put in order, rare ones first;
every document picks the ``l`` whose estimated cost is least: the postings that
its prefix meets, plus the candidates, at most postings / ``l``, that are left
to verify.

Equal sets are one class and stand for each other.  In each longer posting
list all members that share enough with one leader are first compared with it.  What is linked to the leader is
thereby connected; what is too far from it cannot, by the triangle inequality
of the Jaccard distance, link with what is linked to it.  Only the rest is
paired, so large groups of near copies never become all their pairs, and no
link between classes that are not connected otherwise is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .graph import components
from .store import bounded, drop, materialize, small_batches

#: One more shared member is asked for every so many members when prefixes go by hash.
LENGTHEN = 12
#: Members from which on a list is first compared with its leader.
LED = 8
#: Places of a document that are kept to tell in which list a pair is taken up.
PLACES = 64
#: Matches that a prefix by rarity may ask for.
MOST_MATCHES = 4


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than k words are one shingle."""
    b = tv.Bytes.of(column)
    w = tv.words(b)
    h = tv.hashes(b, w, lower=True)
    g = tv.grams(h, k, salt=k)
    out = []
    for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if j - i >= k:
            out.append(np.unique(g[i : j - k + 1]))
        elif j > i:
            out.append(tv.grams(h[i:j], j - i, salt=j - i))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def hash_prefix(members: np.ndarray, percent: int) -> np.ndarray:
    """The first members by hash, as many as share 1 + n // LENGTHEN with any linked set as large or larger."""
    n = len(members)
    return members[: n - -(-percent * n // 100) + 1 + n // LENGTHEN]


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _key(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def described(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_key (a digest of the whole set), prefix (by hash)."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text"), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.binary()), _lists([hash_prefix(s, percent) for s in sets])],
                names=["doc_id", "n_shingles", "set_key", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, prefix array<long>")


def _classes(full: DataFrame) -> tuple[DataFrame, bool, bool]:
    """set_key, first (its smallest doc_id), n, rep (a number of its own); whether a class's first row is there again, and whether rep is first.

    It is, unless rows of one doc_id have different sets.
    """
    by_doc = full.groupBy("set_key", "doc_id").agg(F.first("n_shingles").alias("n"), F.count("*").alias("again"))
    classes = by_doc.groupBy("set_key").agg(F.min(F.struct("doc_id", "again", "n")).alias("f"))
    classes = materialize(classes.select("set_key", F.col("f.doc_id").alias("first"), "f.again", "f.n"), "classes")
    told = classes.groupBy("first").agg(F.count("*").alias("sets"), F.max("again").alias("again")).agg(F.max("sets"), F.max("again")).first()
    if (told[0] or 0) <= 1:
        out = classes.withColumn("rep", F.col("first"))
        out._lectern_path = classes._lectern_path
        return out, (told[1] or 0) > 1, True
    out = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    drop(classes)
    return out, (told[1] or 0) > 1, False


def screened(full: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The classes whose hash prefix shares enough members with other prefixes to have a partner."""
    of = classes.select(F.col("set_key").alias("_key"), "first", "rep")
    reps = full.join(bounded(of), (F.col("set_key") == F.col("_key")) & (F.col("doc_id") == F.col("first")))
    posted = reps.select("rep", F.explode("prefix").alias("h"))
    # a table of its own: the join then meets no aggregate's partitioning, and a frequent shingle can be split
    often = materialize(posted.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1").select("h"), "often")
    hits = posted.join(often, "h", "left_semi").groupBy("rep").agg(F.count("*").alias("hits"))
    # a partner has at least percent of the members, and asks for a match for every LENGTHEN of them
    least = F.expr(f"1 + (({percent} * n + 99) div 100) div {LENGTHEN}")
    out = materialize(classes.join(hits, "rep").filter(F.col("hits") >= least).select("set_key", "first", "rep"), "screened")
    drop(often)
    return out


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int, again: bool) -> DataFrame:
    """rep, n and members of the wanted classes' whole sets."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text"), k)
            # a row of the same doc_id may have another text
            mine = np.array([_key(s) == key for s, key in zip(sets, batch.column("set_key").to_pylist())], dtype=bool)
            sets = [s for s, ok in zip(sets, mine) if ok]
            yield pa.RecordBatch.from_arrays([batch.column("rep").filter(pa.array(mine)), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], names=["rep", "n", "members"])

    rows = docs.join(bounded(wanted), F.col("doc_id") == F.col("first")).select("rep", "set_key", "text")
    rows = rows.mapInArrow(run, "rep long, n long, members array<long>")
    return rows.dropDuplicates(["rep"]) if again else rows


def adaptive_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """rep, n, matches, pos, h: each set's prefix in the order of exact counts, without members that no other set has.

    ``pos`` is the place in the whole set, those without partners first.
    """
    members = sets.select("rep", "n", F.explode("members").alias("h"))
    often = materialize(members.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "often")
    short = F.expr(f"n - ({percent} * n + 99) div 100")
    # counted from the end, places need no count of the members without partners
    last = Window.partitionBy("rep").orderBy(F.desc("df"), F.desc("h"))
    rows = members.join(often, "h").withColumn("pos", F.col("n") - F.row_number().over(last)).filter(F.col("pos") < short + MOST_MATCHES)
    mine = Window.partitionBy("rep")
    rows = rows.withColumn("meets", F.sum("df").over(mine.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    best, cost = F.lit(1), None
    estimates = {}
    for m in range(1, MOST_MATCHES + 1):
        postings = F.coalesce(F.max(F.when(F.col("pos") < short + m, F.col("meets"))).over(mine), F.lit(0))
        estimates[f"e{m}"] = F.when(short + m <= F.col("n"), postings + postings / m * (1 + F.col("n") / 16))
    rows = rows.withColumns(estimates)
    for m in range(1, MOST_MATCHES + 1):
        now = F.col(f"e{m}")
        best, cost = (best, now) if cost is None else (F.when(now < 0.9 * cost, m).otherwise(best), F.when(now < 0.9 * cost, now).otherwise(cost))
    rows = rows.withColumn("matches", best).filter(F.col("pos") < short + F.col("matches"))
    rows = materialize(rows.select("rep", "n", F.col("matches").cast("int").alias("matches"), F.col("pos").cast("int").alias("pos"), "h"), "postings")
    drop(often)
    return rows


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with common and union, the sizes of intersection and union."""
    ids = materialize(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "ids")
    asked = sets.join(bounded(ids), "rep", "left_semi")
    one, two = (asked.select(F.col("rep").alias(x), F.col("members").alias(f"of_{x}")) for x in "ab")
    both = pairs.join(two, "b").join(one, "a").withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    both = both.select("a", "b", "common", (F.size("of_a") + F.size("of_b") - F.col("common")).alias("union"))
    out = materialize(both, "verified")
    drop(ids)
    return out


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    ``docs`` needs doc_id (whole numbers) and text; documents link when their
    sets of k-word shingles have a Jaccard similarity of percent / 100 or more
    (k = 5 and 80 unless told otherwise; percent at least 67, so that the far
    side of the triangle inequality is not empty).  Null texts and texts
    without words have empty sets and link with nothing.  A row without doc_id
    gets no component and links with nothing; repeated rows share theirs, and
    rows of one doc_id with different texts are documents of their own.  An
    empty table gives an empty one; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(described(docs, k, percent), "prefixes")
    full = rows.filter("n_shingles > 0 and doc_id is not null")
    classes, again, named_first = _classes(full)
    wanted = screened(full, classes, percent)
    keyed = materialize(rows.select("doc_id", "n_shingles", "set_key"), "keyed")
    drop(rows)
    sets = materialize(_sets_of(docs, wanted, k, again), "sets")
    drop(wanted)
    groups, used = _components(sets, percent)
    drop(sets)
    groups = groups.withColumnRenamed("node", "rep")
    of_class = classes.join(groups, "rep", "left").select("set_key", "first", F.coalesce("component", "rep").alias("component"))
    if named_first:
        of_class = of_class.select("set_key", F.col("component").alias("component_id"))
    else:
        least = of_class.groupBy("component").agg(F.min("first").alias("component_id"))
        of_class = of_class.join(least, "component").select("set_key", "component_id")
    named = keyed.withColumn("set_key", F.when(F.col("n_shingles") > 0, F.col("set_key")))
    out = named.join(of_class, "set_key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )
    out = materialize(out, "components")
    drop(keyed, classes, *used)
    return out


def _components(sets: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(node, component) of the sets that link with others, and the written tables that it still reads."""
    posted = adaptive_prefixes(sets, percent)
    often = materialize(posted.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1").select("h"), "often")
    # what stands before a place of a prefix in no other prefix is in no set that meets it at that place:
    # ``fit`` members at most are left to share with such a set
    before = F.col("pos") - F.row_number().over(Window.partitionBy("rep").orderBy("pos")) + 1
    shared = posted.join(often, "h", "left_semi").withColumn("fit", F.col("n") - F.greatest(before, F.lit(0)))
    shared = materialize(shared, "shared")
    asked = "({p} * ({{}} + {{}}) + {h} - 1) div {h}".format(p=percent, h=100 + percent)  # common members of a linked pair
    # a member that cannot link with any size in its list leaves the list
    sizes = materialize(shared.groupBy("h").agg(F.min("n").alias("least_n"), F.count("*").alias("df")), "sizes")
    kept = shared.join(sizes, "h").filter("df > 1").withColumn("other", F.greatest("least_n", F.expr(f"({percent} * n + 99) div 100")))
    lists = materialize(kept.filter("fit >= " + asked.format("n", "other")).select("h", "rep", "n", "matches", "pos", "fit", "df"), "lists")
    drop(posted, often, shared, sizes)

    # 100 a >= percent b: as similar as asked; 100 a < far b: too far for any link with what is linked to the leader
    far = 100 - 2 * (100 - percent)
    low, high, most = F.least("n", "leader_n"), F.greatest("n", "leader_n"), F.least("fit", "leader_fit")
    led = lists.filter(F.col("df") >= LED)
    leaders = led.groupBy("h").agg(F.min(F.struct((F.col("n") - F.col("fit")).alias("lost"), "rep", "n", "matches", "fit")).alias("lead"))
    leaders = materialize(leaders.select("h", *[F.col(f"lead.{c}").alias(f"leader_{c}" if c != "rep" else "leader") for c in ("rep", "n", "matches", "fit")]), "leaders")
    led = materialize(led.join(leaders, "h"), "led")
    drop(leaders)
    first = led.filter(F.col("rep") != F.col("leader")).filter("least(fit, leader_fit) >= " + asked.format("n", "leader_n")).groupBy(F.col("leader").alias("a"), F.col("rep").alias("b")).agg(
        F.count("*").alias("shared"), F.min(F.least("matches", "leader_matches")).alias("asked")
    )
    first = materialize(first.filter("shared >= asked").select("a", "b"), "pairs")
    stars = _verified(sets, first)
    drop(first)
    linked = stars.filter(F.col("common") * 100 >= F.col("union") * percent).select("a", "b")
    groups = components(linked)
    state = (
        F.when((F.col("rep") == F.col("leader")) | (F.col("common") * 100 >= F.col("union") * percent), "linked")
        .when((low * 100 < high * far) | (most * 100 < (F.col("n") + F.col("leader_n") - most) * far) | (F.col("common") * 100 < F.col("union") * far), "far")
        .otherwise("between")
    )
    left = (
        led.join(stars.select(F.col("a").alias("leader"), F.col("b").alias("rep"), "common", "union"), ["leader", "rep"], "left")
        .withColumn("state", state)
        .unionByName(lists.filter(F.col("df") < LED).withColumn("state", F.lit("between")), allowMissingColumns=True)
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("h", "rep", "n", "matches", "pos", "fit", "state", F.coalesce("component", "rep").alias("component"))
    )
    left = materialize(left, "left")
    drop(lists, led, groups)
    # members that were not compared with their leader are "between": they meet all others, the leader too
    # a list needs pairs only if members other than those linked to its leader are left in it
    open_lists = left.groupBy("h").agg(
        F.count(F.when(F.col("state") != "linked", 1)).alias("rest"),
        F.max(F.when(F.col("state") == "between", 1)).alias("between"),
        F.min("component").alias("c1"),
        F.max("component").alias("c2"),
    ).filter("c1 < c2 and (rest > 1 or between = 1)").select("h", "between")
    open_lists = materialize(open_lists, "open-lists")
    opened = materialize(left.join(open_lists, "h"), "open")
    drop(left, open_lists)
    # a pair is taken up in the last list that both are in, as far as the kept ends of their lists tell; there the
    # number of shared places bounds, from both sides' places, what the two can have in common
    places = F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"])
    ends = opened.groupBy("rep").agg(places.alias("o")).withColumn("whole", F.size("o") <= PLACES)
    ends = ends.select("rep", "whole", F.when(F.col("whole"), F.col("o")).otherwise(F.slice("o", -PLACES, PLACES)).alias("o"))
    placed = materialize(opened.join(ends, "rep"), "placed")
    drop(opened)
    columns = ("rep", "n", "matches", "pos", "fit", "component", "state", "whole", "o")
    rest = placed.filter("state <> 'linked'").select("h", *columns)
    also = placed.filter("state = 'linked' and between = 1").select("h", *columns)
    x = rest.select("h", *[F.col(c).alias(f"{c}_x") for c in columns])
    need = asked.format("n", "n_x")
    fits = f"""component_x <> component and least(fit, fit_x) >= {need}
        and coalesce(try_element_at(array_intersect(o_x, o), -1) = h, true)
        and (not (whole and whole_x) or (size(array_intersect(o_x, o)) >= least(matches_x, matches)
          and least(n - pos, n_x - pos_x) - 1 + size(array_intersect(o_x, o)) >= {need}))"""
    within = x.join(rest, "h").filter("rep_x < rep").filter(fits)
    across = x.filter("state_x = 'between'").join(also, "h").filter(fits)
    met = within.select("rep_x", "rep").union(across.select("rep_x", "rep"))
    met = met.select(F.least("rep_x", "rep").alias("a"), F.greatest("rep_x", "rep").alias("b")).distinct()
    met = materialize(met, "pairs")
    drop(placed)
    last = _verified(sets, met)
    drop(met)
    linked = linked.union(last.filter(F.col("common") * 100 >= F.col("union") * percent).select("a", "b"))
    out = components(linked)
    drop(stars, last)
    return out, [out]


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Classes of all ``documents`` by 3-word shingles at 0.9."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_classes(docs, k=3, percent=90)


ORACLE_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)])
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM worded),
members AS (SELECT doc_id, hash(unnest(s)) AS g FROM sets),
often AS (SELECT g, count(*) AS df FROM members GROUP BY g),
ranked AS (
  SELECT m.doc_id, m.g, len(s.s) AS n, row_number() OVER (PARTITION BY m.doc_id ORDER BY o.df, m.g) AS rn
  FROM members m JOIN often o USING (g) JOIN sets s USING (doc_id)),
prefix AS (SELECT doc_id, g FROM ranked WHERE rn <= n - ceil(0.9 * n) + 1),
pairs AS (SELECT DISTINCT p.doc_id AS a, q.doc_id AS b FROM prefix p JOIN prefix q ON p.g = q.g AND p.doc_id < q.doc_id),
links AS (
  SELECT a, b FROM (
    SELECT p.a, p.b, len(list_intersect(x.s, y.s)) AS c, len(x.s) + len(y.s) AS t
    FROM pairs p JOIN sets x ON x.doc_id = p.a JOIN sets y ON y.doc_id = p.b)
  WHERE 100 * c >= 90 * (t - c)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = s.doc_id
"""
