"""JSON lines go to files in proportion to the rows' bytes, in the order of doc_id; blank texts are told by their first letter."""

import glob
import json

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.plans import run_queries


def test_larger_tables_get_more_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(run_queries, "SMALL", 1 << 12)
    spark.range(500).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text")).write.parquet(source := f"{tmp_path}/rows")
    run_queries._write_lines(spark.read.parquet(source), path := f"{tmp_path}/lines", 7)
    files = sorted(glob.glob(f"{path}/part-*"))
    assert len(files) > 3
    told = [[json.loads(line)["text"] for line in open(f) if line.strip()] for f in files]
    assert [t for part in told for t in part] == [r["text"] for r in spark.read.parquet(source).orderBy("doc_id").collect()]


def test_blank_texts_are_white_space_alone(spark):
    texts = [None, "", " ", " \t\n 　 \x85", "a", "  a  ", "​", " " * 50_000 + "x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.is_blank(F.col("t")).alias("b")).collect()
    assert [r["b"] for r in sorted(rows)] == [True, True, True, True, False, False, False, False]
