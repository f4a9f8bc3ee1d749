"""Batch answering: a pluggable responder over partitions, with failures as rows.

A responder is a callable that takes a list of payloads (dicts) and returns as
many responses: dicts with answer, finish_reason and usage, or an error.  A
task that is run again asks again, so responders must not mind repeated ids.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import REASONING_TAGS, has_reasoning_tags, is_blank, strip, word_count
from ..plans.prompt import part, without_last
from ..store import materialize

OUT = "id string, answer string, seconds double, finish_reason string, error string, raw string"


# The characters of an error's text that are kept; Unicode's white space.
ERROR_TEXT = 3000
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def health(base: str, timeout: int = 10, ask=None) -> dict:
    """The server's status; one other than ok is an error, as nothing should then be asked."""
    if ask is None:
        from urllib.request import urlopen

        def ask(url):
            with urlopen(url, timeout=timeout) as reply:
                return json.load(reply)

    found = ask(base.rstrip("/") + "/health")
    if found.get("status") != "ok":
        raise RuntimeError(f"server not ready: {found}")
    return found


def http_responder(base: str, route: str = "/v1/chat/completions", timeout: int = 1800, tries: int = 1, wait: float = 1.0, longest: float = 60.0) -> Callable[[list[dict]], list[dict]]:
    """Posts each payload to a chat server; what fails, in whatever way, is an answer with an error, cut to its first characters.

    A server that is busy (429), fails (5xx) or cannot be reached is asked
    again, ``tries`` times in all, after a wait that doubles up to ``longest``
    seconds, or as long as it asks for.  The digest of a payload goes along as
    the request's key, so that a server can tell a repeated one.
    """

    def once(payload: dict) -> tuple[dict, bool, float]:
        """The response, whether asking again may help, and how long the server asks to wait."""
        from http.client import HTTPException
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        body = json.dumps(payload).encode()
        request = Request(base.rstrip("/") + route, body, {"Content-Type": "application/json", "Idempotency-Key": hashlib.sha256(body).hexdigest()})
        try:
            with urlopen(request, timeout=timeout) as reply:
                got = json.load(reply)
            choice = got["choices"][0]
            return {"answer": choice["message"].get("content"), "finish_reason": choice.get("finish_reason"), "raw": json.dumps(got)}, False, 0.0
        except HTTPError as error:
            told = error.headers.get("Retry-After", "")
            return {"error": error.read().decode("utf-8", "replace")[:ERROR_TEXT]}, error.code == 429 or error.code >= 500, float(told) if told.isdigit() else 0.0
        except (OSError, HTTPException) as error:  # no connection, a timeout
            return {"error": f"{type(error).__name__}: {error}"[:ERROR_TEXT]}, True, 0.0
        except (ValueError, LookupError) as error:  # no JSON, no choice
            return {"error": f"{type(error).__name__}: {error}"[:ERROR_TEXT]}, False, 0.0

    def ask(payloads: list[dict]) -> list[dict]:
        out = []
        for payload in payloads:
            for nth in range(tries):
                got, again, asked = once(payload)
                if not again or nth + 1 == tries:
                    break
                time.sleep(min(longest, max(asked, wait * 2**nth)))
            out.append(got)
        return out

    return ask


def respond(requests: DataFrame, responder: Callable[[list[dict]], list[dict]], slots: int, in_flight: int = 1, until: bool = False, order: str | None = None) -> DataFrame:
    """Adds to each request (id, payload as JSON) its answer, seconds, finish_reason, truncated, word_count, status.

    At most ``slots`` tasks ask at once, each with ``in_flight`` requests under
    way; the next is sent as one comes back.  Blank answers, answers with
    reasoning tags and errors have a status other than ``ok`` and keep the raw
    response.  With ``until`` a task asks in the given order, one by one, and
    nothing behind its first answer that is not ``ok``.
    """

    def ask(payload: str) -> tuple:
        began = time.monotonic()
        got = responder([json.loads(payload)])[0]
        error = got.get("error")
        return got.get("answer"), round(time.monotonic() - began, 2), got.get("finish_reason"), error and error[:ERROR_TEXT], got.get("raw")

    def unsound(answer: str | None, error: str | None) -> bool:
        return error is not None or not (answer or "").strip(WHITE) or any(tag in answer for tag in REASONING_TAGS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                rows = []
                for key, got in zip(batch["id"], map(ask, batch["payload"]) if until or in_flight == 1 else pool.map(ask, batch["payload"])):
                    rows.append((key, *got))
                    if until and unsound(got[0], got[3]):
                        break
                yield pd.DataFrame(rows, columns=["id", "answer", "seconds", "finish_reason", "error", "raw"])
                if until and rows and unsound(rows[-1][1], rows[-1][4]):
                    return

    dealt = requests.repartition(slots, "id")
    rows = (dealt.sortWithinPartitions(order) if order else dealt).select("id", "payload").mapInPandas(run, OUT)
    answer = F.col("answer")
    status = F.when(F.col("error").isNotNull(), "error").when(is_blank(answer), "empty").when(has_reasoning_tags(answer), "tags").otherwise("ok")
    return rows.withColumns({"status": status, "answer": strip(answer), "truncated": F.coalesce(F.col("finish_reason") == "length", F.lit(False)), "word_count": word_count(answer)})


def sound(rows: DataFrame, stopped: bool = True) -> Column:
    """Whether a first answer may be built on: not blank, no tags, no error and, for plans, ended by itself."""
    return (F.col("status") == "ok") & (F.coalesce(F.col("finish_reason") == "stop", F.lit(False)) if stopped else F.lit(True))


def two_stage(requests: DataFrame, eligible: DataFrame, responder, slots: int, first: str, follow: str) -> tuple[DataFrame, DataFrame]:
    """Eligible ids get a first request with ``first`` as system text; its answer and ``follow`` are added to theirs.

    ``requests`` has id and messages (array of struct<role, content>, the
    system text first).  Returns the second stage's requests with the seconds of
    the first, and the quarantine: items whose first answer is not sound, with
    their raw responses.
    """
    ask = requests.join(eligible.select("id"), "id", "left_semi")
    system = F.array(F.struct(F.lit("system").alias("role"), F.lit(first).alias("content")))
    extra = F.concat(system, F.slice("messages", F.lit(2), F.greatest(F.size("messages") - 1, F.lit(0))))
    plans = materialize(respond(ask.select("id", F.to_json(F.struct(extra.alias("messages"))).alias("payload")), responder, slots), "plans")
    good = plans.filter(sound(plans)).select("id", F.col("answer").alias("plan"), F.col("seconds").alias("first_seconds"))
    longer = F.concat("messages", F.array(F.struct(F.lit("assistant").alias("role"), F.col("plan").alias("content")), F.struct(F.lit("user").alias("role"), F.lit(follow).alias("content"))))
    done = ask.join(good, "id").select("id", longer.alias("messages"), "first_seconds")
    rest = requests.join(eligible.select("id"), "id", "left_anti").select("id", "messages", F.lit(None).cast("double").alias("first_seconds"))
    return rest.union(done), plans.filter(~sound(plans))


def observe(requests: DataFrame, responder, slots: int, system: str, ask_for: str, before: str, after: str) -> tuple[DataFrame, DataFrame]:
    """Questions with images get a request on the images alone; what it tells is added to their content.

    ``requests`` has id, essay, images (an array) and parts; essays and items
    without images pass.  Returns id and parts, and the quarantine.
    """
    eligible = F.coalesce(F.size("images") > 0, F.lit(False)) & ~F.col("essay")
    asked = requests.filter(eligible)
    only = F.concat(without_last(F.col("parts")), F.array(part("text", F.lit(ask_for))))
    notes = respond(asked.select("id", F.to_json(F.struct(F.lit(system).alias("system"), only.alias("content"))).alias("payload")), responder, slots)
    notes = materialize(notes, "observations")
    good = notes.filter(sound(notes, False)).select("id", F.col("answer").alias("notes"))
    told = F.concat("parts", F.array(part("text", F.concat(F.lit(before), F.col("notes"), F.lit(after)))))
    done = asked.join(good, "id").select("id", told.alias("parts"))
    return requests.filter(~eligible).select("id", "parts").union(done), notes.filter(~sound(notes, False))


def total_seconds(records: DataFrame) -> DataFrame:
    """Adds total_seconds, to two digits: both stages' where there were two, else null."""
    return records.withColumn("total_seconds", F.round(F.col("seconds") + F.col("first_seconds"), 2))


def require_sound(rows: DataFrame) -> DataFrame:
    """The rows, if all of them succeeded; otherwise an error that names one that did not."""
    bad = rows.filter("status <> 'ok'").select("id", "status").limit(1).collect()
    if bad:
        raise RuntimeError(f"item {bad[0]['id']} is not completed: {bad[0]['status']}")
    return rows
