"""Operator 8: removal of repeated word windows, by level-wise doubling.

Level 5: of every possible window the 5-word gram of least hash is taken, so
equal windows give equal grams; grams seen once drop out.  Level 10: what is
left is extended to ten words, to the right and to the left, and must be seen
twice again on the side that lies within a window.  Level 20: only windows
around survivors are hashed in full, to 96 bits, and compared over the whole
corpus.  Each level extends what repeated one level below; with the last one
no candidates are left.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .rows import apart, digest, home, numbered
from .store import bounded, drop, materialize, small_batches


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each ``width`` following values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def _windows(w: tv.Spans, k: int) -> np.ndarray:
    """Whether a window of k words starts at each word."""
    out = np.zeros(len(w.start), dtype=bool)
    ok = tv.inside(w, k)
    out[: len(ok)] = ok
    return out


def _padded(grams: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    out[: len(grams)] = grams
    return out


def seed_positions(h: np.ndarray, w: tv.Spans, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Words at which some window's least seed gram starts, and all seed grams."""
    g = tv.grams(h, seed, salt=1)
    width = window - seed + 1
    if len(h) < window:
        return np.zeros(0, np.int64), g
    least = _sliding(g, width, np.minimum)
    least = np.where(_windows(w, window)[: len(least)], least, np.uint64(0))  # windows end within their text
    pad = np.zeros(width - 1, np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    return np.flatnonzero(most[: len(g)] == g), g


def _local(w: tv.Spans, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each word, and its number within the text."""
    own = np.searchsorted(w.first, at, side="right") - 1
    return own, at - w.first[own]


def _seeds(docs: DataFrame, window: int) -> DataFrame:
    """Level-5 grams with their extensions to both sides; an extension that leaves the text is null."""
    seed = window // 4

    def run(batches):
        for batch in batches:
            w = tv.words(b := tv.Bytes.of(batch.column("text")))
            h = tv.hashes(b, w)
            at, g = seed_positions(h, w, window, seed)
            twice = _padded(tv.grams(h, 2 * seed, salt=2), len(h))
            fits = _windows(w, 2 * seed)
            own, local = _local(w, at)
            back = np.maximum(at - seed, 0)
            has_left = (local >= seed) & fits[back]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(own)),
                    batch.column("part").take(pa.array(own)),
                    pa.array(local.astype(np.int32)),
                    pa.array(g[at].view(np.int64)),
                    pa.array(twice[at].view(np.int64), mask=~fits[at]),
                    pa.array(twice[back].view(np.int64), mask=~has_left),
                ],
                names=["doc_id", "part", "pos", "g", "right", "left"],
            )

    return docs.mapInArrow(run, "doc_id long, part int, pos int, g long, right long, left long")


#: Marks of a surviving seed: its extension to the right, to the left, was seen twice.
RIGHT, LEFT = 1, 2


def marked_windows(h: np.ndarray, w: tv.Spans, at: np.ndarray, marks: np.ndarray, window: int) -> np.ndarray:
    """First words of the windows whose least seed gram survived on every side that lies within them.

    ``at`` are the words at which surviving seeds start.
    """
    seed = window // 4
    width = window - seed + 1
    ok = np.zeros(len(h), dtype=bool)
    if len(h) < window or not len(at):
        return np.flatnonzero(ok)
    g = tv.grams(h, seed, salt=1)
    least = _sliding(g, width, np.minimum)
    starts = _windows(w, window)[: len(least)]
    for back in range(width):
        need = RIGHT * (back + 2 * seed <= window) | LEFT * (back >= seed)
        chosen = at[(marks & need) == need]
        p = chosen - back
        chosen, p = chosen[p >= 0], p[p >= 0]
        chosen, p = chosen[p < len(least)], p[p < len(least)]
        ok[p[(least[p] == g[chosen]) & starts[p]]] = True
    return np.flatnonzero(ok)


def _candidates(docs: DataFrame, window: int) -> DataFrame:
    """All windows that may repeat, by two hashes; ``docs`` has the array ``seeds`` of 4 * position + marks."""

    def run(batches):
        for batch in batches:
            w = tv.words(b := tv.Bytes.of(batch.column("text")))
            seeds = batch.column("seeds")
            n = np.diff(seeds.offsets.to_numpy())
            found = seeds.flatten().to_numpy()
            at = marked_windows(tv.hashes(b, w), w, np.repeat(w.first[:-1], n) + (found >> 2), found & 3, window)
            own, local = _local(w, at)
            one, two = (tv.grams(tv.hashes(b, w, seed=s), window, salt=s) for s in (3, 4))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(own)),
                    batch.column("part").take(pa.array(own)),
                    pa.array(local.astype(np.int32)),
                    pa.array(one[at].view(np.int64)),
                    pa.array((two[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                ],
                names=["doc_id", "part", "pos", "h", "i"],
            )

    return docs.mapInArrow(run, "doc_id long, part int, pos int, h long, i int")


def later_copies(digests: DataFrame) -> DataFrame:
    """(doc_id, part): texts that come earlier as well; all their windows start earlier there."""
    place = F.struct("doc_id", "part")
    first = digests.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("digest", "first")
    first = materialize(first, "firsts")
    out = materialize(digests.join(first, "digest").filter(place > F.col("first")).select("doc_id", "part").distinct(), "copies")
    drop(first)
    return out


def repeated_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, part, windows): starts of windows of ``window`` words whose words also start a window earlier.

    Earlier is a smaller doc_id, part or, in one document, position.  The
    window is a multiple of four.  ``docs`` has whole texts without later
    copies, doc_id and text not null; repeated rows of a document count as one.
    """
    seeds = materialize(_seeds(docs, window), "seeds")
    # a table of its own: the join then meets no aggregate's partitioning, and a frequent key can be split
    often = materialize(seeds.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"), "often")
    level5 = materialize(seeds.join(often, "g", "left_semi"), "level5")
    drop(seeds, often)
    # a window holds its seed's extension to the right, to the left, or both
    sides = level5.select(
        "doc_id", "part", "pos", F.explode(F.array(F.struct(F.lit(RIGHT).alias("mark"), F.col("right").alias("x")), F.struct(F.lit(LEFT).alias("mark"), F.col("left").alias("x")))).alias("s")
    )
    sides = sides.select("doc_id", "part", "pos", "s.mark", "s.x").filter("x is not null")
    # the two sides of one place are different strings unless the text repeats itself, which counts as twice
    twice = materialize(sides.groupBy("x").agg(F.count("*").alias("n")).filter("n > 1").select("x"), "twice")
    level10 = sides.join(twice, "x", "left_semi").groupBy("doc_id", "part", "pos").agg(F.bit_or("mark").alias("marks"))
    level10 = level10.groupBy("doc_id", "part").agg(F.collect_set(F.col("pos").cast("long") * 4 + F.col("marks")).alias("seeds"))
    level10 = materialize(level10, "level10")
    drop(level5, twice)
    found = materialize(_candidates(docs.join(level10, ["doc_id", "part"]).select("doc_id", "part", "text", "seeds"), window), "windows")
    drop(level10)
    place = F.struct("doc_id", "part", "pos")
    first = materialize(found.groupBy("h", "i").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("h", "i", "first"), "firsts")
    again = found.join(first, ["h", "i"]).filter(place > F.col("first"))
    out = materialize(again.groupBy("doc_id", "part").agg(F.collect_set("pos").alias("windows")), "again")
    drop(found, first)
    return out


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """Adds n_words, n_removed and kept_text to ``docs`` (doc_id, text).

    Every word that a repeated window covers goes; the kept words are joined
    by one space.  Documents with equal texts are compared once: all windows of
    the later ones start earlier in the first.  A row with null or blank text keeps nothing and removes
    nothing; rows without doc_id keep all their words.  Repeated rows of a
    document count as one; different texts under one doc_id are documents of
    their own, one after the other by their digests.  Windows are told apart by
    96 bits of multilinear hashes.  Other columns stay; columns named as the
    new ones are replaced.
    """
    small_batches(docs.sparkSession)
    new = ["n_words", "n_removed", "kept_text"]
    docs, back = apart(docs.drop(*new), "doc_id", "text")
    keyed, digests = numbered(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    copies = later_copies(digests)
    several = bool(digests.filter("part > 0").limit(1).count())
    keyed = keyed.filter("text is not null")
    unique = keyed.join(bounded(copies), ["doc_id", "part"], "left_anti")
    spans = repeated_windows(unique, window).withColumn("_copy", F.lit(False))
    spans = spans.unionByName(copies.withColumn("_copy", F.lit(True)), allowMissingColumns=True)
    if several:
        spans = spans.join(digests.distinct(), ["doc_id", "part"])
    spans = spans.withColumnsRenamed({"doc_id": "_doc", "windows": "_windows", "digest": "_sum"}).drop("part")
    names = docs.columns
    on = F.col("doc_id").cast("long") == F.col("_doc")
    rows = docs.select(*names).withColumn("_digest", digest(F.col("text"))) if several else docs.select(*names)
    rows = rows.join(spans, on & (F.col("_digest") == F.col("_sum")) if several else on, "left").select(*names, "_windows", "_copy")
    schema = docs.select(*names).schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")

    def run(batches):
        for batch in batches:
            w = tv.words(b := tv.Bytes.of(batch.column("text")))
            spans = batch.column("_windows")
            n = np.diff(spans.offsets.to_numpy())
            at = np.repeat(w.first[:-1], n) + spans.flatten().to_numpy()
            mark = np.zeros(len(w.start) + window + 1, np.int64)
            np.add.at(mark, at, 1)
            np.add.at(mark, at + window, -1)
            n = tv.counts(w)
            copy = np.array([x is True for x in batch.column("_copy").to_pylist()], dtype=bool) & (n >= window)
            gone = (np.cumsum(mark)[: len(w.start)] > 0) | np.repeat(copy, n)
            removed = np.concatenate([[0], np.cumsum(gone)])[w.first]
            kept = []
            for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                # one copy of the text's bytes in which all but kept words and one space after each is cut out
                s, e = w.start[i:j][~gone[i:j]], w.end[i:j][~gone[i:j]]
                if not len(s):
                    kept.append("")
                    continue
                size = e - s + 1
                ends = np.cumsum(size)
                index = np.repeat(s - ends + size, size) + np.arange(ends[-1])
                index[ends - 1] = e - 1
                out = b.data[index]
                out[ends - 1] = 32
                kept.append(out[:-1].tobytes().decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(tv.counts(w).astype(np.int64)), pa.array(np.diff(removed).astype(np.int64)), pa.array(kept, pa.string())],
                names=[*names, *new],
            )

    return home(rows.select(*names, "_windows", "_copy").mapInArrow(run, schema), back)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Windows of 20 words over all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH worded AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos, len(w) AS n FROM worded),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS pos FROM worded WHERE len(w) >= 20),
windows AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos+19], ' ')) AS h FROM starts),
again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS rn FROM windows) WHERE rn > 1),
marked AS (
  SELECT x.doc_id, x.pos, x.word, max(a.pos) OVER (PARTITION BY x.doc_id ORDER BY x.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words x LEFT JOIN again a ON a.doc_id = x.doc_id AND a.pos = x.pos),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM worded d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
