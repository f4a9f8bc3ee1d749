"""Operator 3: embedding near-dedup by a pivot-permutation index.

Every vector is described by its nearest reference points (pivots), nearest
first.  Inverted lists by (label, pivot) hold the vectors that have the pivot
among their nearest; vectors that share enough pivots are compared by cosine
in double precision.  A pair is looked at in the list of its smallest shared
pivot only, so counts need no pair to be written.  Long lists are dealt out in
blocks, and each pair of blocks is one task's array product; a task returns
counts and a spanning forest of the links that it found, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .store import drop, materialize

#: Vectors that may be looked at to choose pivots, and so the most pivots: the sample's documented bound.
SAMPLE = 16384
#: Nearest pivots that describe a vector, and how many of them two candidates share.
NEAREST, SHARED = 8, 2
#: Vectors of a block, and those that are held against all pivots at once.
BLOCK = 512
HELD = 256


def n_pivots(n: int) -> int:
    """Pivots for n vectors: about their square root, so lists stay short as data grow."""
    return min(SAMPLE, max(64, 2 ** round(math.log2(math.sqrt(max(n, 1))))))


def _unit(column: pa.Array) -> np.ndarray:
    n = len(column)
    return _scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is divided out first, so squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-323)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pivots(sample: list[list[float]], dims: int, m: int) -> np.ndarray:
    """m unit vectors: those of the sample that have this many dimensions, then random ones."""
    own = [v for v in sample if len(v) == dims][:m]
    drawn = np.random.default_rng(dims).standard_normal((m - len(own), dims))
    return _scaled(np.concatenate([np.asarray(own, dtype=np.float64).reshape(-1, dims), drawn]))


def _described(vectors: DataFrame, sample: list[list[float]], m: int) -> DataFrame:
    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.diff(batch.column("embedding").offsets.to_numpy())
            for dims in np.unique(sizes).tolist():
                part = pa.table([*batch.columns], names=batch.schema.names).filter(pa.array(sizes == dims)).combine_chunks()
                if dims not in known:
                    known[dims] = _pivots(sample, dims, m)
                x, k = _unit(part.column("embedding").combine_chunks()), min(NEAREST, m)
                order = np.concatenate([np.argsort(-(x[i : i + HELD] @ known[dims].T), axis=1, kind="stable")[:, :k] for i in range(0, len(x), HELD)]).astype(np.int32)
                ends = pa.array(np.arange(0, order.size + 1, k, dtype=np.int32))
                out = part.append_column("pivots", pa.ListArray.from_arrays(ends, pa.array(order.ravel())))
                yield from out.to_batches()

    schema = T.StructType([*vectors.schema.fields, T.StructField("pivots", T.ArrayType(T.IntegerType()))])
    return vectors.mapInArrow(run, schema)


def _hot(pivots: np.ndarray, names: np.ndarray) -> np.ndarray:
    """One row per vector with 1 for each of its pivots."""
    out = np.zeros((len(pivots), len(names)), np.float32)
    out[np.arange(len(pivots))[:, None], np.searchsorted(names, pivots)] = 1
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches by the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compared(cosine: float):
    """Compares the two blocks of one cell of a list."""

    def work(key, table):
        pivot = key[1].as_py()
        order = np.argsort(table["rep"].to_numpy(), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        rep, mult = table["rep"].to_numpy(), table["copies"].to_numpy()
        side = table["block"].to_numpy()
        x = _unit(table["embedding"].combine_chunks())
        p = table["pivots"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        hot = _hot(p, names := np.unique(p))
        earlier = names < pivot
        i, j = key[2].as_py(), key[3].as_py()
        one, two = np.flatnonzero(side == i), np.flatnonzero(side == j)
        linked = (hot[one] @ hot[two].T >= SHARED) & (hot[one][:, earlier] @ hot[two][:, earlier].T == 0)
        if i == j:
            linked &= one[:, None] < two[None, :]
        a, b = np.nonzero(linked)
        a, b = one[a], two[b]
        links, ends = np.zeros(len(rep), np.int64), []
        for s in range(0, len(a), 1 << 16):
            u, v = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
            good = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
            u, v = u[good], v[good]
            np.add.at(links, u, mult[v])
            np.add.at(links, v, mult[u])
            ends.append((u, v))
        a = np.concatenate([u for u, _ in ends]) if ends else np.zeros(0, np.int64)
        b = np.concatenate([v for _, v in ends]) if ends else np.zeros(0, np.int64)
        root = _roots(len(rep), a, b)
        some = links > 0
        return pa.table({"rep": rep[some], "links": links[some], "root": rep[root][some]})

    return work


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``vectors`` has vec_id, embedding and label; other columns are ignored.
    Only vectors of equal, non-null labels and equal length are compared.
    Vectors that are null, empty or zero, or hold null or non-finite numbers,
    and rows without vec_id, link with nothing.  Equal vectors are one class:
    they link with each other and count as many times as they occur.  Rows that
    share a vec_id have each the links of their own vector; their component is
    one where a link joins them.  An empty table gives an empty one.
    """
    # single precision stays as it is on the way, which loses nothing: products are in double precision
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), "label")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    fit = rows.filter(sound)
    classes = fit.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes, "vectors")
    # classes go by their smallest vec_id, unless two have the same
    shared = bool(classes.groupBy("rep").count().filter("count > 1").limit(1).count())
    classes = classes.withColumn("least", F.col("rep"))
    if shared:
        classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    m = n_pivots(classes.count())
    sample = [r[0] for r in classes.orderBy(F.xxhash64("embedding", "label"), "rep").limit(m).select("embedding").collect()]
    described = materialize(_described(classes, sample, m), "described")
    posted = described.select("label", F.size("embedding").alias("dims"), F.explode("pivots").alias("pivot"), "rep", "copies", "embedding", "pivots")
    lists = posted.groupBy("label", "pivot", "dims").agg(F.count("*").alias("n")).filter("n > 1").select("label", "pivot", "dims", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = posted.join(lists, ["label", "pivot", "dims"]).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    found = dealt.select("label", "pivot", "i", "j", "dims", "rep", "copies", "embedding", "pivots", "block").groupBy("label", "pivot", "i", "j", "dims")
    found = materialize(found.applyInArrow(_compared(cosine), "rep long, links long, root long"), "found")
    groups = components(found, "rep", "root").withColumnRenamed("node", "rep")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = classes.join(counted, "rep", "left").join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    if shared:
        of_class = of_class.join(of_class.groupBy("component").agg(F.min("least").alias("smallest")), "component").withColumn("component", F.col("smallest"))
    of_class = of_class.select(
        F.col("label").alias("_label"), F.col("embedding").alias("_embedding"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component",
    )
    drop(described)
    # each row by its own vector: rows that share a vec_id have links of their own
    members = fit.join(of_class, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding"))).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.filter(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return members.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all ``embeddings`` at cosine 0.93."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE fit AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM fit x JOIN fit y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
groups AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, g.component_id, e.vec_id = g.component_id AS kept
FROM embeddings e JOIN groups g ON g.a = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
"""
