"""Operator 12: centroid clustering by delta Lloyd.

Assignments (with the distance to the owner) and the centroids' sums are
written tables.  A round looks at what has changed since the last one: a vector
whose owner stayed where it was is compared with the centroids that moved, as
the others were no nearer before; a vector whose owner moved is compared with
all.  Vectors that change hands are added to one sum and taken off another, so
only those meet in the aggregate, as signed integers; all arithmetic is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop, materialize

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
#: Absolute value below which a scaled component must be: distances then fit 64 bits.
LARGEST = 1 << 28
#: Vectors that are held against centroids at once.
HELD = 4096
_STATE = "vec_id long, v array<int>, cluster int, was int, distance long"


def integers(embedding: Column, dims: int = DIMS, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null unless there are ``dims`` of them, all finite.  One that is too large is an error."""
    finite = (F.size(embedding) == dims) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.floor(x.cast("double") * scale)
    fits = lambda y: F.when(F.abs(y) < LARGEST, y.cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int"))
    return F.when(F.coalesce(finite, F.lit(False)), F.transform(F.transform(embedding, whole), fits))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of whole vectors, exact: by floating products where all sums are below 2^53."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * largest**2 < 1 << 53 else np.int64
    a, b = x.astype(kind), centroids.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)


def reassigned(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after some centroids moved; owner -1 has none yet.  Ties go to the smaller number."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | moved[owner]
    for rows, against in ((np.flatnonzero(lost), np.arange(len(centroids))), (np.flatnonzero(~lost), np.flatnonzero(moved))):
        for i in range(0, len(rows) if len(against) else 0, HELD):
            part = rows[i : i + HELD]
            d = distances(x[part], centroids[against])
            best = d.argmin(1)
            near, number = d[np.arange(len(part)), best], against[best]
            # an owner that stayed is kept unless a moved centroid is nearer, or as near with a smaller number
            better = (owner[part] < 0) | moved[owner[part]] | (near < distance[part]) | (near == distance[part]) & (number < owner[part])
            owner[part[better]], distance[part[better]] = number[better], near[better]
    return owner, distance


def _assigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            v = batch.column("v")
            x = v.flatten().to_numpy().reshape(len(v), -1)
            was = batch.column("cluster").to_numpy()
            owner, distance = reassigned(x, was, batch.column("distance").to_numpy(), centroids, moved)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), v, pa.array(owner.astype(np.int32)), pa.array(was), pa.array(distance)], names=["vec_id", "v", "cluster", "was", "distance"])

    return state.select("vec_id", "v", "cluster", "distance").mapInArrow(run, _STATE)


def _transfers(state: DataFrame, dims: int) -> DataFrame:
    """cluster, n and total: what the vectors that changed hands bring and take; a row for each cluster and task at most is shuffled."""
    changed = state.filter("cluster <> was")
    come = changed.select("cluster", F.lit(1).alias("sign"), "v")
    go = changed.filter("was >= 0").select(F.col("was").alias("cluster"), F.lit(-1).alias("sign"), "v")
    signed = [F.sum(F.col("sign").cast("long") * F.col("v")[i]) for i in range(dims)]
    return come.union(go).groupBy("cluster").agg(F.sum("sign").alias("n"), F.array(*signed).alias("total"))


def delta_lloyd(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), centroid (its cluster's), cluster_inertia, inertia.

    ``vectors`` has vec_id and embedding; other columns are ignored.  Vectors
    that are null, have another number of components, or hold null or
    non-finite ones are left out; the others are floored to whole numbers.
    Centroids start as the vectors whose ids have the least digests; rows that
    share one go by their components, and rows without vec_id count as an empty
    one.  With fewer vectors than centroids there are as many clusters as
    vectors; an empty table gives an empty one.  A component beyond
    2^28 / scale is an error, as its distances would not fit their column.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), dims, scale).alias("v")).filter("v is not null")
    kept = kept.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(-1).alias("was"), F.lit(0).cast("long").alias("distance"))
    state = materialize(kept, "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = state.orderBy(key, "v").limit(clusters).select("v").collect()  # as many rows as there are centroids
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)
    moved = np.ones(len(centroids), bool)
    sums = None
    for nth in range(rounds + 1):
        before, state = state, materialize(_assigned(state, centroids, moved), "assigned")
        drop(before)
        if nth == rounds:
            break
        found = _transfers(state, dims)
        if sums is not None:
            both = sums.union(found)
            found = both.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total"))
        before, sums = sums, materialize(found, "sums")
        if before is not None:
            drop(before)
        last = centroids.copy()
        for r in sums.filter("n > 0").collect():  # a row for each centroid
            centroids[r["cluster"]] = np.array(r["total"], np.int64) // r["n"]
        moved = (centroids != last).any(1)
        if not moved.any():
            break
    drop(*[sums] if sums is not None else [])
    told = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    told = told.crossJoin(F.broadcast(told.agg(F.sum("cluster_inertia").alias("inertia")))).withColumnRenamed("cluster", "_cluster")
    final = spark.createDataFrame([(i, c) for i, c in enumerate(centroids.tolist())], "_number int, centroid array<long>")
    told = told.join(F.broadcast(final), F.col("_cluster") == F.col("_number"))
    # as many rows as there are centroids
    return state.join(F.broadcast(told), F.col("cluster") == F.col("_cluster")).select("vec_id", "cluster", "distance", "centroid", "cluster_inertia", "inertia")


def op12_delta_lloyd(spark, sf_dir: str) -> DataFrame:
    """Clusters, distances and inertia of all ``embeddings``."""
    out = delta_lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def _oracle() -> str:
    """Each round as two tables: the nearest centroid of each vector, and the floored means."""
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(
            f"near{r} AS (SELECT x.row, arg_min(c.k, (list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.k)) AS k FROM kept x, c{r} c GROUP BY x.row)"
        )
        if r < ROUNDS:
            rounds.append(
                f"sums{r} AS (SELECT k, list(m ORDER BY i) AS v FROM (SELECT n.k, i, CAST(floor(sum(v[i])::DOUBLE / count(*)) AS BIGINT) AS m FROM near{r} n JOIN kept x ON x.row = n.row, (SELECT unnest(range(1, {DIMS + 1})) AS i) GROUP BY n.k, i) GROUP BY k)"
            )
            rounds.append(f"c{r + 1} AS (SELECT c.k, coalesce(s.v, c.v) AS v FROM c{r} c LEFT JOIN sums{r} s ON s.k = c.k)")
    each = ",\n".join(rounds)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {CLUSTERS})),
{each},
far AS (
  SELECT x.vec_id, n.k, c.v AS c, CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance
  FROM near{ROUNDS} n JOIN kept x ON x.row = n.row JOIN c{ROUNDS} c ON c.k = n.k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM far
"""


ORACLE_SQL = _oracle()
