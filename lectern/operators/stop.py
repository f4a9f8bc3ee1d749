"""Runs that end with the first answer that is not sound; what was answered until then stays."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources import versions
from ..store import drop, materialize
from ..streaming.ledger import OUTCOME, add_outcomes
from .infer import respond
from .ledger import pending

#: Requests of one job: so many, for each lane, may be under way when an answer turns out not to be sound.
AHEAD = 16


class Unsound(RuntimeError):
    """An answer on which nothing may be built."""


def ask_until_unsound(requests: DataFrame, responder, log: str, lanes: int = 1, ahead: int = AHEAD, ready: Callable[[], object] | None = None) -> int:
    """Asks requests (pos, id, payload) in the order of pos and commits every job's outcomes to the log; returns how many were asked.

    Requests with an answer in the log are skipped.  Jobs of ``ahead`` requests
    run in ``lanes`` at a time; a job ends behind its first unsound answer.  An
    observed count tells of it as the job's rows are written; jobs under way in
    other lanes are then interrupted by their tag, none is begun any more, and
    ``Unsound`` names the item.  Interrupted requests have no outcome and are
    asked again by the next run.  With one lane exactly the requests up to the
    first unsound answer are asked.  ``ready`` (``infer.health``, say) is called
    before anything is asked; what it raises ends the run.  An id should occur
    once.
    """
    if ready is not None:
        ready()
    spark = requests.sparkSession
    run, tag = uuid.uuid4().hex, f"lectern-{uuid.uuid4().hex}"
    left = pending(requests.select("pos", "id", "payload"), versions.read(spark, log, OUTCOME).filter("status = 'ok'"))
    left = materialize(left.repartitionByRange("pos").sortWithinPartitions("pos"), "requests")
    borders = _borders(left, ahead)
    stopped, commits, counted = threading.Event(), threading.Lock(), []
    found: list[str] = []

    def job(number: int) -> None:
        if stopped.is_set():
            return
        spark.addTag(tag)
        try:
            rows = left.filter((F.col("pos") >= borders[number]) & (F.col("pos") < borders[number + 1]) if number + 1 < len(borders) else F.col("pos") >= borders[number])
            seen = Observation()
            bad = F.col("status") != "ok"
            got = respond(rows, responder, 1, until=True, order="pos").observe(seen, F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("bad"), F.max(F.when(bad, F.concat_ws(": ", "id", "status"))).alias("first"))
            got = materialize(got, "outcomes")
            with commits:  # one writer at a time
                add_outcomes(got, log, run, number)
            told = seen.get
            counted.append(told["n"])
            if told["bad"]:
                found.append(told["first"])
                stopped.set()
                spark.interruptTag(tag)
            drop(got)
        except Exception:
            if not stopped.is_set():
                stopped.set()
                raise
        finally:
            spark.removeTag(tag)

    with ThreadPoolExecutor(lanes) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(job), number) for number in range(len(borders))]:
            done.result()
    drop(left)
    if found:
        raise Unsound(f"item {found[0]}")
    return sum(counted)


def _borders(rows: DataFrame, ahead: int) -> list:
    """The first pos of each job: of each piece of the written table, every so many rows."""
    piece = F.spark_partition_id()
    nth = F.monotonically_increasing_id() - F.shiftleft(piece.cast("long"), 33)
    return [r["pos"] for r in rows.select("pos", nth.alias("nth")).filter(F.col("nth") % ahead == 0).select("pos").orderBy("pos").collect()]
