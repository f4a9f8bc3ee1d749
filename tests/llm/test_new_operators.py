"""Small tests of fill-in-middle and centroid clustering against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import centroids, fim

ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, " one two\x0b"), (6, "x y z \xe9 \U0001f600 w"), (None, "a b c d e f g h"), (7, "one"), (7, "one"), (7, "two three"), (8, "word " * 30000), (9, "a <P> b"), (10, "a < P> <S"), (11, " a  b")]


def plain_fim(key, text):
    text = text or ""
    units = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    told = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(told[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_equals_plain_python_and_round_trips(spark):
    rng = random.Random(5)
    alphabet = ["a", "b", "\xe9", "中", "\U0001f600", " ", "\n", "\t", "\x0c", "\xa0", "<", "P", ">"]
    rows = ODD + [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 3, 20, 80])))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("form", "output", "n", "parts", "made"):
        df = df.withColumn(name, F.lit("mine"))
    got = fim.fill_in_middle(df).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r["parts"] for r in got} == {"mine"}
    for r in got:
        assert tuple(r[c] for c in fim.NEW) == plain_fim(r["doc_id"], r["text"])
        assert r["again"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def plain_lloyd(rows, clusters, rounds, dims, scale=256):
    kept = [(k, [int(np.floor(scale * float(x))) for x in v]) for k, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in order[:clusters]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        owner = [min((dist(v, c), k) for k, c in enumerate(middle)) for _, v in kept]
        if r < rounds:
            for k in range(len(middle)):
                if mine := [v for (_, v), o in zip(kept, owner) if o[1] == k]:
                    middle[k] = [sum(x) // len(mine) for x in zip(*mine)]
    inertia = {}
    for d, k in owner:
        inertia[k] = inertia.get(k, 0) + d
    return sorted((repr(key), k, d, middle[k], inertia[k], sum(inertia.values())) for (key, _), (d, k) in zip(kept, owner))


@pytest.mark.parametrize("clusters,rounds,n", [(5, 4, 300), (40, 5, 120), (7, 3, 4), (3, 0, 50)])
def test_delta_lloyd_equals_plain_python(spark, clusters, rounds, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(n)]
    rows += [(None, rows[0][1]), (1, rows[2][1]), (1, rows[2][1]), (n, None), (n + 1, [1.0] * 5), (n + 2, [None] + [1.0] * 5), (n + 3, [float("nan")] * 6), (n + 4, [float("inf")] + [0.0] * 5), (n + 5, [])]
    rows += [(1000 + i, [0.25] * 6) for i in range(n)]  # a third are one vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit("mine"), "cluster": F.lit("mine"), "label": F.lit(None).cast("int")})
    got = centroids.delta_lloyd(df, clusters, rounds, 6)
    assert sorted((repr(r["vec_id"]), r["cluster"], r["distance"], r["centroid"], r["cluster_inertia"], r["inertia"]) for r in got.collect()) == plain_lloyd(rows, clusters, rounds, 6)


def test_delta_lloyd_of_nothing_and_of_large_components(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<double>")
    assert centroids.delta_lloyd(df).count() == 0
    assert centroids.delta_lloyd(df.limit(0)).count() == 0
    far = np.array([[1 << 27, -(1 << 27)]], np.int64)
    assert centroids.distances(far, -far).tolist() == [[2 * (1 << 28) ** 2]]
    with pytest.raises(Exception, match="too large"):
        centroids.delta_lloyd(spark.createDataFrame([(1, [1e300] * 64)], "vec_id long, embedding array<double>")).count()


def test_only_moved_centroids_are_compared_where_the_owner_stayed(monkeypatch):
    seen = []
    whole = centroids.distances
    monkeypatch.setattr(centroids, "distances", lambda x, c: seen.append((len(x), len(c))) or whole(x, c))
    rng = np.random.default_rng(1)
    x, middle = rng.integers(-9, 9, (50, 4)), rng.integers(-9, 9, (6, 4))
    owner, distance = centroids.reassigned(x, np.full(50, -1), np.zeros(50, np.int64), middle, np.ones(6, bool))
    later = middle.copy()
    later[2] += 3
    seen.clear()
    again = centroids.reassigned(x, owner, distance, later, np.arange(6) == 2)
    lost = int((owner == 2).sum())
    assert sorted(seen) == sorted([(lost, 6), (50 - lost, 1)])
    d = whole(x, later)
    assert again[0].tolist() == d.argmin(1).tolist() and again[1].tolist() == d.min(1).tolist()
