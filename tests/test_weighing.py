"""Pairs are added up where their row is, without a shuffle, and are those of the join."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import retrieve, weighing


def _world(spark, seed, key="long"):
    rng = random.Random(seed)
    stems = [f"t{i:02}" for i in range(60)]
    some = lambda n: sorted(set(rng.choices(stems, [1 / (k + 1) for k in range(60)], k=n)))
    docs = [(i, "context", None if i % 50 == 3 else some(rng.choice([0, 1, 4, 30])) + ([None] if i % 31 == 0 else []), rng.choice([None, (1000, 1100), (1400, 1500)]), rng.choice([15, 300])) for i in range(500)]
    topics = [(str(k) if key == "string" else k, some(rng.choice([0, 1, 3, 25])), rng.choice([[], [(1410, 1410)]])) for k in range(40)]
    docs = spark.createDataFrame(docs, "doc_index long, kind string, terms array<string>, span struct<lo: int, hi: int>, len int").repartition(3)
    return docs, spark.createDataFrame(topics, f"topic_id {key}, q array<string>, spans array<struct<lo: int, hi: int>>")


def _rows(df):
    return sorted((r["topic_id"], r["doc_index"], r["n_common"], r["least_df"], r["n"], r["len"], round(r["score"], 5)) for r in df.collect())


@pytest.mark.parametrize("at_once,key", [(1 << 20, "long"), (7, "string"), (40, "long")])
def test_same_candidates_as_by_the_join(spark, monkeypatch, at_once, key):
    docs, topics = _world(spark, at_once, key)
    monkeypatch.setattr(weighing, "AT_ONCE", at_once)
    got = _rows(retrieve.scored(docs, topics))
    monkeypatch.setattr(retrieve, "small", lambda table: False)
    assert got == _rows(retrieve.scored(docs, topics)) and len(got) > 1000


def test_pairs_are_not_dealt_out(spark, tmp_path):
    docs, topics = _world(spark, 5)
    docs.write.parquet(path := f"file://{tmp_path}/docs")
    plan = retrieve.scored(spark.read.parquet(path), topics, domestic=False)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and not re.search(r"hashpartitioning\(topic_id#\w+, doc_index", plan)


def test_no_topics_no_terms_no_documents(spark):
    docs, topics = _world(spark, 6)
    assert retrieve.scored(docs, topics.limit(0)).count() == 0
    assert retrieve.scored(docs.limit(0), topics).count() == 0
    assert retrieve.scored(docs, topics.withColumn("q", F.array(F.lit("none")))).count() == 0
