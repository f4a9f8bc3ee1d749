"""Runs that are cut off, repeated or stopped: tables replaced as a whole, batches that count once, first unsound answers, busy servers."""

import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lectern.operators import infer, stop
from lectern.sources import corpus, sinks, versions
from lectern.streaming import ledger as streaming


class Killed(Exception):
    pass


def killed(*_):
    raise Killed


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    one, two = spark.range(5).toDF("id"), spark.range(7).toDF("id")
    assert versions.read(spark, path, one.schema).count() == 0 and versions.parts(spark, path) is None
    versions.replace(one, path)
    with monkeypatch.context() as m:
        m.setattr(versions, "_rename", killed)  # all is written but the last step
        with pytest.raises(Killed):
            versions.replace(two, path)
        assert versions.read(spark, path, one.schema).count() == 5
        m.setattr(versions, "_swap", killed)
        with pytest.raises(Killed):
            versions.replace(two, path)
    held = versions.read(spark, path, one.schema)
    versions.replace(two, path)
    assert held.count() == 5, "a reader keeps what it has resolved until the change after the next"
    assert versions.read(spark, path, one.schema).count() == 7
    versions.replace(one, path)
    versions.replace(one, path)
    assert len(os.listdir(f"{path}/{versions.PARTS}")) <= 3
    versions.withdraw(spark, path)
    assert not os.path.exists(path)
    versions.withdraw(spark, path)


def test_readers_find_what_the_sinks_have_replaced(spark, tmp_path):
    path = str(tmp_path / "exam")
    for n in (2, 3):
        rows = [("e", [(str(i), "q", "", "", 1.0, None) for i in range(n)])]
        sinks.write_json(spark.createDataFrame(rows, corpus.EXAM), path)
        assert corpus.exam_items(spark, path).count() == n


def outcome(spark, ids, status="ok"):
    return spark.createDataFrame([(i, f"a{i}", 0.1, "stop", None, None, status, False, 1) for i in ids], streaming.OUTCOME.removesuffix(", nth long"))


def test_a_batch_counts_once_whenever_its_writer_dies(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    assert streaming.add_outcomes(outcome(spark, "ab"), log, "r", 0)
    with monkeypatch.context() as m:
        m.setattr(versions, "_rename", killed)
        with pytest.raises(Killed):
            streaming.add_outcomes(outcome(spark, "cd"), log, "r", 1)
    good, _ = streaming.outcomes(spark, log)
    assert sorted(r["id"] for r in good.collect()) == ["a", "b"]
    assert streaming.add_outcomes(outcome(spark, "cd"), log, "r", 1)
    assert not streaming.add_outcomes(outcome(spark, "cd"), log, "r", 1), "the same batch again"
    assert streaming.add_outcomes(outcome(spark, "ef", "empty"), log, "s", 0), "another run's numbers are its own"
    assert versions.compact(spark, log, streaming.OUTCOME) == 3 and versions.compact(spark, log, streaming.OUTCOME) == 1
    assert not streaming.add_outcomes(outcome(spark, "ab"), log, "r", 0) and not streaming.add_outcomes(outcome(spark, "ef"), log, "s", 0)
    assert streaming.add_outcomes(outcome(spark, "e"), log, "s", 1)
    good, bad = streaming.outcomes(spark, log)
    assert sorted(r["id"] for r in good.collect()) == list("abcde") and [r["id"] for r in bad.collect()] == ["f"]


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_stream_that_dies_in_a_batch_goes_on_with_one_record_for_each_id(spark, tmp_path, monkeypatch, when):
    requests, log, check = (str(tmp_path / x) for x in ("requests", "log", "check"))
    rows = spark.createDataFrame([(str(i), json.dumps({"x": "" if i % 4 == 0 else f"text {i}"})) for i in range(20)], "id string, payload string")
    rows.union(rows.limit(5)).write.parquet(requests)
    answer = lambda ps: [{"answer": p["x"], "finish_reason": "stop", "raw": "r"} for p in ps]
    whole = versions._swap

    def swap(spark, path, now):
        if when == "after":
            whole(spark, path, now)
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(versions, "_swap", swap)
        with pytest.raises(Exception, match="Killed"):
            streaming.answer_new(spark, requests, log, check, answer, 2).awaitTermination()
    streaming.answer_new(spark, requests, log, check, answer, 2).awaitTermination()
    good, bad = streaming.outcomes(spark, log)
    assert sorted(int(r["id"]) for r in good.collect()) == [i for i in range(20) if i % 4]
    assert sorted(int(r["id"]) for r in bad.collect()) == [0, 4, 8, 12, 16]


def counting(folder, bad):
    """A responder that leaves a file for each call and fails at some texts."""

    def ask(payloads):
        n = payloads[0]["n"]
        open(f"{folder}/{n}-{time.monotonic_ns()}", "w").close()
        time.sleep(0.01)
        return [{"error": "broken"} if n in bad else {"answer": f"a{n}", "finish_reason": "stop"}]

    return ask


def items(spark, n):
    return spark.createDataFrame([(i, str(i), json.dumps({"n": i})) for i in range(n)], "pos int, id string, payload string").repartition(3)


def test_one_lane_asks_nothing_behind_the_first_unsound_answer(spark, tmp_path):
    calls, log = tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()
    with pytest.raises(stop.Unsound, match="item 13: error"):
        stop.ask_until_unsound(items(spark, 40), counting(calls, {13, 20}), log, ahead=5)
    assert sorted(int(n.split("-")[0]) for n in os.listdir(calls)) == list(range(14))
    good, bad = streaming.outcomes(spark, log)
    assert sorted(int(r["id"]) for r in good.collect()) == list(range(13)) and [r["id"] for r in bad.collect()] == ["13"]
    # the next run asks what has no answer yet, and only that
    assert stop.ask_until_unsound(items(spark, 40), counting(calls, set()), log, ahead=5) == 27
    assert len(os.listdir(calls)) == 14 + 27
    good, bad = streaming.outcomes(spark, log)
    assert good.count() == 40 and bad.count() == 0
    assert stop.ask_until_unsound(items(spark, 40), counting(calls, set()), log) == 0


def test_lanes_stop_together_and_keep_what_was_answered(spark, tmp_path):
    calls, log = tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()
    with pytest.raises(stop.Unsound, match="item 6"):
        stop.ask_until_unsound(items(spark, 200), counting(calls, {6}), log, lanes=3, ahead=4)
    asked = len(os.listdir(calls))
    assert 7 <= asked < 100, "the lanes' jobs under way at most, not the rest"
    good, bad = streaming.outcomes(spark, log)
    assert [r["id"] for r in bad.collect()] == ["6"] and {"4", "5"} <= {r["id"] for r in good.collect()}
    assert stop.ask_until_unsound(items(spark, 0), counting(calls, set()), log) == 0


@pytest.fixture
def server():
    """A chat server that is busy, fails or is slow as the text says; it counts what is under way at once."""
    state = {"now": 0, "most": 0, "seen": {}}
    lock = threading.Lock()

    class Chat(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
                keys = state["seen"].setdefault(body["text"], [])
                keys.append(self.headers["Idempotency-Key"])
                nth = len(keys)
            time.sleep(0.05)
            kind = body["text"].split("-")[0]
            code = 429 if kind == "busy" and nth < 3 else 503 if kind == "down" else 400 if kind == "bad" else 200
            told = json.dumps({"choices": [{"message": {"content": body["text"]}, "finish_reason": "stop"}]} if code == 200 and kind != "odd" else {"error": kind}).encode()
            with lock:
                state["now"] -= 1
            self.send_response(code)
            self.send_header("Content-Length", str(len(told)))
            self.end_headers()
            self.wfile.write(told)

        def do_GET(self):
            told = json.dumps({"status": "ok" if state.get("up") else "loading"}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(told)))
            self.end_headers()
            self.wfile.write(told)

        def log_message(self, *_):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", state
    httpd.shutdown()


def test_a_busy_server_is_asked_again_within_bounds(spark, server):
    base, state = server
    texts = [f"{kind}-{i}" for i in range(6) for kind in ("fine", "busy", "down", "bad", "odd")]
    rows = spark.createDataFrame([(t, json.dumps({"text": t})) for t in texts], "id string, payload string")
    got = infer.respond(rows, infer.http_responder(base, timeout=10, tries=4, wait=0.01), 2, in_flight=3).collect()
    by = {r["id"]: r for r in got}
    assert len(got) == 30 and all((r["status"] == "ok") == (r["id"].split("-")[0] in ("fine", "busy")) for r in got)
    assert by["busy-1"]["answer"] == "busy-1" and "down" in by["down-0"]["error"]
    asked = {t.split("-")[0]: {len(k) for s, k in state["seen"].items() if s.startswith(t.split("-")[0])} for t in texts}
    assert asked == {"fine": {1}, "busy": {3}, "down": {4}, "bad": {1}, "odd": {1}}
    assert all(len(set(keys)) == 1 for keys in state["seen"].values()) and len({k[0] for k in state["seen"].values()}) == 30
    assert 2 <= state["most"] <= 6


def test_a_run_begins_once_the_server_is_ready(spark, tmp_path, server):
    base, state = server
    rows = spark.createDataFrame([(0, "a", json.dumps({"text": "fine-a"})), (1, "b", json.dumps({"text": "bad-b"}))], "pos int, id string, payload string")
    begin = lambda: stop.ask_until_unsound(rows, infer.http_responder(base, timeout=10), str(tmp_path / "log"), ready=lambda: infer.health(base))
    with pytest.raises(RuntimeError, match="not ready"):
        begin()
    assert state["seen"] == {}
    state["up"] = True
    with pytest.raises(stop.Unsound, match="item b: error"):
        begin()
    good, bad = streaming.outcomes(spark, str(tmp_path / "log"))
    assert [r["answer"] for r in good.collect()] == ["fine-a"] and [r["id"] for r in bad.collect()] == ["b"]
