"""Structured Streaming run of the responder over a folder of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.infer import respond
from ..operators.ledger import pending
from ..sources import versions

#: Rows of the log: what was asked in which batch, and how it went.
OUTCOME = "id string, answer string, seconds double, finish_reason string, error string, raw string, status string, truncated boolean, word_count long, nth long"
#: Batches of the log beyond which they are written as one.
BATCHES = 64


def add_outcomes(got: DataFrame, log: str, run: str, number: int) -> bool:
    """Commits what ``respond`` gives for a batch of a run: all of its rows or none."""
    spark = got.sparkSession
    nth = len(versions.parts(spark, log) or ())
    names = [c.split()[0] for c in OUTCOME.split(", ")]
    done = versions.commit(got.withColumns({"nth": F.lit(nth).cast("long"), "word_count": F.col("word_count").cast("long")}).select(names), log, run, number)
    if nth > BATCHES:
        versions.compact(spark, log, OUTCOME)
    return done


def outcomes(spark: SparkSession, log: str) -> tuple[DataFrame, DataFrame]:
    """The ledger, one row for each id that succeeded, and the quarantine: the last failure of each other id."""
    rows = versions.read(spark, log, OUTCOME)
    good = rows.filter("status = 'ok'")
    bad = rows.filter("status <> 'ok'").join(good.select("id"), "id", "left_anti")
    last = bad.groupBy("id").agg(F.max_by(F.struct(*[c for c in bad.columns if c != "id"]), "nth").alias("r"))
    return good, last.select("id", "r.*").select(*bad.columns)


def answer_new(spark: SparkSession, requests: str, log: str, checkpoint: str, responder, slots: int) -> StreamingQuery:
    """Answers all requests (Parquet: id, payload) that are there and were not answered by an earlier run, then ends.

    Each id has one record, in the ledger or in the quarantine: within a run
    (a checkpoint) the stream's state lets an id pass once, a batch is
    committed as a whole under the run's and its own number, and one that runs
    again finds it there or nothing of it.  Failed ids are asked again by a
    run with a new checkpoint.
    """

    def batch(rows: DataFrame, number: int) -> None:
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if versions.committed(spark, log, run, number):
            rows.write.format("noop").mode("overwrite").save()  # the stream's state still takes the batch in
            return
        done = versions.read(spark, log, OUTCOME, but=run).filter("status = 'ok'")
        add_outcomes(respond(pending(rows, done), responder, slots), log, run, number)

    stream = spark.readStream.schema("id string, payload string").parquet(requests).dropDuplicates(["id"])
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
