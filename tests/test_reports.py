"""A run's figures in the pass that writes its violations, and runs that are held to their files."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import validate
from lectern.sources import manifest, sinks, versions


def run(spark, answers):
    items = spark.createDataFrame([(i, str(i), "Write an essay of at least 3 words." if i % 2 else "q") for i in range(len(answers))], "pos int, id string, question string")
    rows = spark.createDataFrame([(i, str(i), a) for i, a in enumerate(answers)], "pos int, id string, answer string")
    known = rows.select("id", "answer", (F.col("pos") == 2).alias("truncated"), F.when(F.col("pos") == 2, "length").otherwise("stop").alias("finish_reason"))
    pair = lambda a, b, name: spark.createDataFrame([(a, b)], f"actual string, {name} string")
    return items, rows, known, items.filter("pos % 2 = 1"), pair("h", "h", "recorded"), pair("e", "e", "expected")


def test_figures_are_those_of_the_rows(spark, tmp_path):
    path = str(tmp_path / "report")
    bad = run(spark, ["fine", "two words", "cut off", "now three words", " ", None])
    assert validate.write_report(*bad, path) == {"status": "FAIL", "n_errors": 5, "answers": 6, "completed": 3, "truncated": 1, "short": 2}
    got = versions.read(spark, path, validate.VIOLATIONS).orderBy("pos", "nth").collect()
    assert [(r["pos"], r["id"], r["message"]) for r in got] == [(1, "1", "2 words, minimum 3"), (2, "2", "truncated answer"), (2, "2", "unexpected finish_reason"), (4, "4", "empty answer"), (5, "5", "empty answer")]
    good = run(spark, ["fine", "now there are four"])
    assert validate.write_report(*good, path) == {"status": "PASS", "n_errors": 0, "answers": 2, "completed": 2, "truncated": 0, "short": 0}
    assert versions.read(spark, path, validate.VIOLATIONS).count() == 0
    none = [df.limit(0) for df in good[:4]]
    assert validate.write_report(*none, *good[4:], path)["answers"] == 0


def test_a_run_with_one_changed_byte_is_refused(spark, tmp_path):
    folder, path = tmp_path / "corpus", str(tmp_path / "run")
    (folder / "sub").mkdir(parents=True)
    for n in range(20):
        (folder / ("sub" if n % 2 else ".") / f"f{n}.txt").write_bytes(b"text %d" % n)
    config = spark.createDataFrame([(0.0, None, 3)], "temperature double, revision string, tokens int")
    files = lambda: manifest.fingerprints(spark, str(folder))
    first = manifest.begin(config, files(), path)
    assert first.collect() == manifest.begin(config, files().repartition(7), path).collect()
    assert manifest.read_configuration(spark, path, first.schema).first()["tokens"] == 3
    (folder / "sub/f3.txt").write_bytes(b"text 4")
    with pytest.raises(ValueError, match=r"sub/f3.txt \(altered\)$"):
        manifest.begin(config, files(), path)
    (folder / "sub/f3.txt").unlink()
    with pytest.raises(ValueError, match=r"sub/f3.txt \(removed\)$"):
        manifest.begin(config, files(), path)
    (folder / "sub/f3.txt").write_bytes(b"text 3")
    with pytest.raises(ValueError, match="choose another folder$"):
        manifest.begin(config.withColumn("tokens", F.lit(4)), files(), path)
    assert manifest.begin(config, files(), path).count() == 1


def test_a_tree_digest_tells_names_and_texts_apart(spark):
    df = lambda rows: spark.createDataFrame(rows, "name string, bytes long, sha256 string")
    told = {manifest.tree_digest(df(rows)) for rows in ([("a", 1, "x"), ("b", 1, "y")], [("a", 1, "y"), ("b", 1, "x")], [("a", 1, "x")], [("a b", 1, "x"), ("b", 1, "y")], [])}
    assert len(told) == 5
    assert manifest.tree_digest(df([("b", 1, "y"), ("a", 1, "x")])) in told
