"""Operator 11: fill-in-middle transformation of training texts.

A text is decoded to an array of its code points.  Where a character that is no
white space is followed by white space, a unit ends: one comparison of
neighbours' classes and ``flatnonzero`` give all borders at once.  Two ranks,
drawn from a digest of the document's id, choose the borders at which prefix
and middle end; the pieces are slices of the array, encoded again and put
behind their marks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import small_batches

#: Marks of the pieces; a text that holds one of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Share of texts that are cut at all, and of those that tell their suffix first, in percent.
RATE, SUFFIX_FIRST = 50, 80
NEW = ("n", "form", "prefix_chars", "middle_chars", "output")


def borders(points: np.ndarray) -> np.ndarray:
    """Where each unit ends: white space with the word after it, or what white space is left at the end."""
    space = (points == 32) | (points >= 9) & (points <= 13)
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    return np.append(ends, len(points)) if len(points) else ends


def drawn(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits from the digest of seed and id; a null id counts as empty."""
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(told[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: str, numbers: list[int], rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), and the output."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = borders(points)
    n = len(ends)
    a, b, cut, order = numbers
    if not text or cut % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    one, two = (0 if rank == 0 else int(ends[rank - 1]) for rank in sorted((a % (n + 1), b % (n + 1))))
    prefix, middle, suffix = (points[i:j].tobytes().decode("utf-32-le") for i, j in ((0, one), (one, two), (two, len(points))))
    if order % 100 < suffix_first:
        return n, "spm", one, two - one, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", one, two - one, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """All columns of ``docs`` (doc_id, text), and n, form, prefix_chars, middle_chars and output.

    The last four describe the transformed text, n how many units the text has.
    A null or empty text has no units and is plain with an empty output; a text
    of white space is one unit.  Rows with one doc_id are cut by the same
    numbers, each at its own borders, so equal rows fare alike; a null doc_id
    counts as empty.  Columns named as the new ones are replaced; an empty
    table gives an empty one.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in NEW]
    kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()

    def run(batches):
        for batch in batches:
            ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
            made = [transformed(text or "", drawn(key, seed), rate, suffix_first) for key, text in zip(ids, texts)]
            new = [pa.array([row[i] for row in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], names=[*names, *NEW])

    schema = docs.select(*names).schema
    for name, kind in zip(NEW, ("long", "string", "long", "long", "string")):
        schema = schema.add(name, kind)
    return docs.select(*names).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text of which an output was made, from output and form alone: no piece holds a mark."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Form, pieces and digests of all ``documents``, transformed and restored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fill_in_middle(docs)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


ORACLE_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || k[1:8] AS BIGINT) AS h1, CAST('0x' || k[9:16] AS BIGINT) AS h2,
         CAST('0x' || k[17:24] AS BIGINT) AS h3, CAST('0x' || k[25:32] AS BIGINT) AS h4 FROM cut),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
pieces AS (
  SELECT *, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:n], '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM pieces
"""
