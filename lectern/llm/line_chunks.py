"""Operator 7: line dedup by rolling chunks of lines.

A rolling hash sees every two following lines, so each border depends on the
lines at it alone and equal passages are cut alike wherever they stand.  Every
chunk that occurs earlier in the corpus, by (doc_id, place), leads to its first
occurrence; chunks that overlap there as they do here are joined to one run,
which so reaches as far in both directions as the lines are equal.  Runs are
removed once their bytes, by SHA-256, are the first occurrence's: of a
repeated passage of two lines or more, all lines go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .rows import apart, digest, home, numbered
from .store import bounded, drop, materialize, small_batches

#: Lines of a chunk, which the rolling hash sees: the shortest passage that can be removed.
ROLLING = 2
#: What tells documents apart.
ID = ("doc_id", "part")


def _chunks(b: tv.Bytes) -> tuple[tv.Spans, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of a batch, the first line of each chunk, one past its last, and the text that it is of."""
    parts = tv.lines(b)
    start = np.flatnonzero(tv.inside(parts, ROLLING))
    return parts, start, start + ROLLING, tv.owners(parts)[start]


def _keys(docs: DataFrame) -> DataFrame:
    """All chunks: doc_id, part, line (its first), and two hashes of its bytes."""

    def run(batches):
        for batch in batches:
            b = tv.Bytes.of(batch.column("text"))
            parts, start, stop, own = _chunks(b)
            whole = tv.Spans(parts.start[start], parts.end[stop - 1], parts.first)
            one, two = (tv.hashes(b, whole, seed=s) for s in (5, 6))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(own)) for c in ID), pa.array((start - parts.first[own]).astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                names=[*ID, "line", "h", "i"],
            )

    return docs.mapInArrow(run, "doc_id long, part int, line int, h long, i long")


def _texts(docs: DataFrame) -> DataFrame:
    """SHA-256 of the bytes of wanted runs; ``docs`` has the array ``wanted`` of struct<line, lines>."""

    def run(batches):
        for batch in batches:
            b = tv.Bytes.of(batch.column("text"))
            parts = tv.lines(b)
            wanted = batch.column("wanted")
            own = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            flat = wanted.flatten()
            line, n = (np.asarray(flat.field(x)) for x in ("line", "lines"))
            first = parts.first[own] + line
            told = [hashlib.sha256(b.data[s:e]).digest() for s, e in zip(parts.start[first].tolist(), parts.end[first + n - 1].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(own)) for c in ID), pa.array(line), pa.array(n), pa.array(told, pa.binary())], names=[*ID, "line", "lines", "told"])

    return docs.mapInArrow(run, "doc_id long, part int, line int, lines int, told binary")


def _runs(again: DataFrame) -> DataFrame:
    """Chunks joined to runs that repeat one run of an earlier place: doc_id, part, line, lines, of (the earlier document), at."""
    again = again.withColumn("shift", F.col("at") - F.col("line"))
    # following lines less their rank are one number; repeated rows share a rank
    island = F.col("line") - F.dense_rank().over(Window.partitionBy(*ID, "of", "shift").orderBy("line"))
    runs = again.withColumn("island", island).groupBy(*ID, "of", "shift", "island").agg(F.min("line").alias("line"), (F.max("line") - F.min("line") + ROLLING).alias("lines"))
    return runs.select(*ID, "line", "lines", "of", (F.col("line") + F.col("shift")).alias("at"))


def repeated_chunks(keyed: DataFrame) -> DataFrame:
    """(doc_id, part, gone): of each document the runs to remove, as structs of first line and lines; ``keyed`` as ``numbered`` gives it."""
    keyed = keyed.filter("text is not null")
    keys = materialize(_keys(keyed), "chunks")
    spot = F.struct(*ID, "line")
    first = keys.groupBy("h", "i").agg(F.min(spot).alias("f"), F.max(spot).alias("l")).filter("f <> l")
    # a table of its own: the join then meets no aggregate's partitioning, and a frequent chunk can be split
    first = materialize(first.select("h", "i", F.struct(*[F.col(f"f.{c}") for c in ID]).alias("of"), F.col("f.line").alias("at")), "firsts")
    again = keys.join(first, ["h", "i"]).filter(spot != F.struct(*[F.col(f"of.{c}") for c in ID], F.col("at").alias("line"))).select(*ID, "line", "of", "at")
    runs = materialize(_runs(again), "runs")
    place = F.struct("line", "lines")
    places = runs.select(*ID, "line", "lines").union(runs.select("of.doc_id", "of.part", "at", "lines").distinct())
    wanted = materialize(places.groupBy(*ID).agg(F.collect_set(place).alias("wanted")), "wanted")
    narrow = bounded(wanted.select(*ID))
    # only texts with wanted runs travel to them
    texts = materialize(_texts(keyed.join(narrow, [*ID], "left_semi").join(wanted, [*ID])).distinct(), "texts")
    firsts = texts.select(F.struct(*ID).alias("of"), F.col("line").alias("at"), "lines", F.col("told").alias("first_told"))
    later = runs.join(texts, [*ID, "line", "lines"]).join(firsts, ["of", "at", "lines"])
    out = materialize(later.filter("told = first_told").groupBy(*ID).agg(F.collect_set(place).alias("gone")), "gone")
    drop(keys, first, runs, wanted, texts)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` (doc_id, text), text without repeated runs of lines, and n_lines and n_removed.

    Lines are what stands between line feeds.  Null texts stay null and empty
    ones empty, with no lines; a text all of whose lines are removed becomes
    empty.  Rows without doc_id stay as they are; repeated rows of a document
    count as one and are cut alike, different texts under one doc_id are
    documents of their own, one after the other by their digests.  Columns
    named as the new ones are replaced; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    new = ["n_lines", "n_removed"]
    docs, back = apart(docs.drop(*new), "doc_id", "text")
    names = [c for c in docs.columns if c not in new]
    keyed, digests = numbered(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    gone = repeated_chunks(keyed)
    several = bool(digests.filter("part > 0").limit(1).count())
    if several:
        gone = gone.join(digests.distinct(), [*ID])
    else:
        gone = bounded(gone)
    gone = gone.withColumnsRenamed({"doc_id": "_doc", "gone": "_gone", "digest": "_sum"}).drop("part")
    on = F.col("doc_id").cast("long") == F.col("_doc")
    rows = docs.select(*names).withColumn("_digest", digest(F.col("text"))) if several else docs.select(*names)
    rows = rows.join(gone, on & (F.col("_digest") == F.col("_sum")) if several else on, "left").select(*names, "_gone")
    schema = docs.select(*names).schema.add("n_lines", "long").add("n_removed", "long")

    def run(batches):
        for batch in batches:
            b = tv.Bytes.of(batch.column("text"))
            parts = tv.lines(b)
            lost = np.zeros(len(parts.start) + 1, np.int64)
            marks = batch.column("_gone")
            own = np.repeat(np.arange(batch.num_rows), np.diff(marks.offsets.to_numpy()))
            flat = marks.flatten()
            line, n = (np.asarray(flat.field(x)) for x in ("line", "lines"))
            first = parts.first[own] + line
            np.add.at(lost, first, 1)
            np.add.at(lost, first + n, -1)
            lost = np.cumsum(lost)[:-1] > 0
            removed = np.diff(np.concatenate([[0], np.cumsum(lost)])[parts.first])
            texts = batch.column("text").to_pylist()
            for k in np.flatnonzero(removed).tolist():
                i, j = int(parts.first[k]), int(parts.first[k + 1])
                kept = np.flatnonzero(~lost[i:j]) + i
                texts[k] = b"\n".join(b.data[s:e].tobytes() for s, e in zip(parts.start[kept].tolist(), parts.end[kept].tolist())).decode("utf-8")
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tv.counts(parts)), pa.array(removed)], names=[*names, *new])

    return home(rows.mapInArrow(run, schema), back)


def op7_line_chunks(spark, sf_dir: str) -> DataFrame:
    """Lines of all ``documents`` that are left without repeated chunks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH lined AS (SELECT doc_id, text, CASE WHEN text IS NULL OR text = '' THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS l FROM documents),
pairs AS (SELECT doc_id, l, unnest(range(1, len(l))) AS pos FROM lined WHERE len(l) > 1),
again AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY md5(l[pos] || chr(10) || l[pos + 1]) ORDER BY doc_id, pos) AS rn FROM pairs) WHERE rn > 1),
lost AS (SELECT doc_id, pos FROM again UNION SELECT doc_id, pos + 1 FROM again),
each AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM lined),
kept AS (
  SELECT e.doc_id, count(x.pos) AS n_removed, coalesce(string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (x.pos IS NULL), '') AS t
  FROM each e LEFT JOIN lost x ON x.doc_id = e.doc_id AND x.pos = e.pos GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(d.l) AS BIGINT) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, CAST(length(coalesce(k.t, d.text)) AS BIGINT) AS n_chars, sha256(coalesce(k.t, d.text)) AS kept_sha256
FROM lined d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
