"""The sink of exactly named files: names, bytes, and what a failed job leaves."""

import os

import pytest
from pyspark.sql import functions as F

from lectern.sources import sinks


def frame(spark, rows):
    return spark.createDataFrame(rows, "name string, body string").repartition(3)


def test_files_have_the_names_and_bytes_of_the_rows(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = {"a.json": '{"x": "ł"}', "b.txt": "", "c d.txt": "line\nno feed", "ł.txt": "x" * 100_000} | {f"n{i}": str(i) for i in range(50)}
    sinks.write_named(frame(spark, [*rows.items(), ("null.txt", None)]), folder)
    found = {n: open(f"{folder}/{n}", encoding="utf-8", newline="").read() for n in os.listdir(folder)}
    assert found == rows | {"null.txt": ""}
    sinks.write_named(frame(spark, [("a.json", "new")]), f"file://{folder}")
    assert open(f"{folder}/a.json").read() == "new" and len(os.listdir(folder)) == len(rows) + 1
    sinks.write_named(frame(spark, []), str(tmp_path / "none"))


@pytest.mark.parametrize("bad", ["../out.txt", "", None, "a/b", "n1"])
def test_a_job_that_fails_leaves_no_file(spark, tmp_path, bad):
    folder = tmp_path / "out"
    folder.mkdir()
    (folder / "kept").write_text("k")
    with pytest.raises(Exception, match="name"):
        sinks.write_named(frame(spark, [(f"n{i}", "x") for i in range(20)] + [(bad, "y")]), str(folder))
    assert os.listdir(folder) == ["kept"]


def test_only_items_with_a_context_are_audited(spark, tmp_path):
    rows = spark.createDataFrame([("1", "p", "c"), ("2", "p", ""), ("3", "p", None)], "id string, payload string, context string")
    sinks.write_audits(rows, str(tmp_path / "a"))
    name = rows.filter("id = '1'").select(sinks.audit_name(F.col("id"))).first()[0]
    assert os.listdir(tmp_path / "a") == [name] and len(name) == len("essay-request-.json") + 12


def test_empty_files_are_read_back(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = {"a.json": '{"x": "ł"}', "empty.txt": "", "none.txt": ""} | {f"n{i}": str(i) for i in range(20)}
    sinks.write_named(frame(spark, [*rows.items()]), folder)
    (tmp_path / "out" / ".hidden").write_text("h")
    found = {r["name"]: bytes(r["content"]).decode("utf-8") for r in sinks.read_named(spark, f"file://{folder}").collect()}
    assert found == rows
    sinks.write_named(frame(spark, []), str(tmp_path / "nothing"))
    assert sinks.read_named(spark, str(tmp_path / "nothing")).count() == 0
