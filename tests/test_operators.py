import collections
import json
import math
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import context, images, infer, ledger, retrieve, run, validate
from lectern.plans import prompt
from lectern.sources import corpus, sinks
from lectern.streaming import ledger as streaming


def first_fit(rows, budget):
    used, out = 0, []
    for _, index, n in sorted((-s, i, n) for i, s, n in rows):
        if len(out) < budget.lines and used + n + budget.in_test <= budget.chars:
            out.append(index)
            used += n + budget.in_sum
    return out, used


@pytest.mark.parametrize("budget", [retrieve.DEFAULT, retrieve.SHORT, retrieve.WEIGHTED])
def test_pick_is_the_whole_first_fit_scan(spark, budget, monkeypatch):
    monkeypatch.setattr(retrieve, "ROUND_ROWS", 7)
    rng = random.Random(5)
    rows = [(t, i, round(rng.random(), 2), rng.choice([30, 200, 900, 3000, 4000, 9000])) for t in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "topic_id long, doc_index long, score double, len long")
    lengths = {}
    for _, i, _, n in rows:
        lengths.setdefault(i, n)
    known = spark.createDataFrame(list(lengths.items()), "doc_index long, len long")
    got = {r["topic_id"]: (r["picked"], r["used"]) for r in retrieve.pick(df.drop("len"), known, budget).collect()}
    for t in range(4):
        assert got[t] == first_fit([(i, s, lengths[i]) for tt, i, s, _ in rows if tt == t], budget)


def test_pick_golden_lengths(spark):
    df = spark.createDataFrame([(1, 1, 3.0), (1, 2, 2.0), (1, 3, 1.0)], "topic_id long, doc_index long, score double")
    lengths = spark.createDataFrame([(1, 3000), (2, 2000), (3, 900)], "doc_index long, len long")
    assert retrieve.pick(df, lengths).first()["picked"] == [1, 3]
    assert retrieve.pick(df.limit(0), lengths).count() == 0


def test_scores_and_period_rules(spark):
    docs = spark.createDataFrame(
        [(0, "timeline", ["aaaa", "bbbb"], (1000, 1010)), (1, "context", ["aaaa"], None), (2, "context", ["aaaa"], (1500, 1500)), (3, "timeline", ["zzzz"], (1005, 1005))],
        "doc_index long, kind string, terms array<string>, span struct<lo: int, hi: int>",
    )
    topics = spark.createDataFrame([(7, ["aaaa", "polsk"], [(1001, 1100)])], "topic_id long, q array<string>, spans array<struct<lo: int, hi: int>>")
    got = {r["doc_index"]: r["score"] for r in retrieve.scored(docs, topics).collect()}
    idf = math.log(1 + 4 / 4)
    assert got == {0: round(idf + 2, 6), 1: round(idf, 6), 3: 2.0}


def test_diverse_prefers_uncovered_terms(spark):
    docs = spark.createDataFrame([(0, ["aaaa", "bbbb"], 10), (1, ["aaaa", "bbbb"], 10), (2, ["cccc"], 10), (3, ["xxxx"], 4000)], "doc_index long, terms array<string>, len int").withColumn("span", F.lit(None).cast("struct<lo: int, hi: int>")).withColumn("kind", F.lit("context"))
    topics = spark.createDataFrame([(1, ["aaaa", "bbbb", "cccc", "xxxx"], [])], "topic_id long, q array<string>, spans array<struct<lo: int, hi: int>>")
    found = retrieve.scored(docs, topics)
    small = retrieve.Budget(chars=23, in_test=1, in_sum=1, lines=18)
    assert retrieve.pick_diverse(found, docs, topics, small).first()["picked"] == [0, 2]


def test_corpus_order_and_optional_source(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id":"a","date_text":"1003","event_text":"Bitwa","section_path":"S"}\n\n{"id":"b","date_text":"","event_text":"x"}\n{"id":"c","date_text":"1015–1018","event_text":"Wojna","section_path":"S"}\n', encoding="utf-8")
    (tmp_path / "n.jsonl").write_text('{"id":"n1","title":"T","years":[900,950],"tags":["Gniezno"],"text":"tekst"}\n', encoding="utf-8")
    time, note = corpus.timeline(spark, str(tmp_path / "t.jsonl")), corpus.notes(spark, str(tmp_path / "n.jsonl"))
    both = corpus.load_corpus(time, note).orderBy("doc_index").collect()
    assert [(r["doc_index"], r["id"], r["kind"]) for r in both] == [(0, "a", "timeline"), (1, "c", "timeline"), (2, "n1", "context")]
    assert tuple(both[1]["span"]) == (1015, 1018) and tuple(both[2]["span"]) == (900, 950) and "gniez" in both[2]["terms"]
    assert corpus.load_corpus(None, note).count() == 1


def test_kb_constraints(spark, tmp_path):
    path = tmp_path / "kb.jsonl"
    path.write_text('{"id":"1","tytul":"A","tekst":"x"}\n{"id":"1","tytul":"B","tekst":"y"}\n')
    with pytest.raises(ValueError, match="duplicate"):
        corpus.knowledge_base(spark, str(path))
    path.write_text('{"id":"1","tytul":"A","tekst":" "}\n')
    with pytest.raises(ValueError, match="missing"):
        corpus.knowledge_base(spark, str(path))


def test_exam_records_and_paths(spark, tmp_path):
    exam = tmp_path / "exam.json"
    exam.write_text(json.dumps({"exam_id": "e", "items": [{"id": "11.10", "question": "q"}, {"id": "2", "question": "r", "max_points": 3}]}, indent=2))
    items = corpus.exam_items(spark, str(exam))
    assert [r["id"] for r in items.orderBy("pos").collect()] == ["11.10", "2"]
    (tmp_path / "records.json").write_text(json.dumps({"2": {"answer": "a", "word_count": 1, "usage": {"total_tokens": 5}}}))
    records = corpus.records(spark, str(tmp_path / "records.json"))
    assert records.first()["usage"]["total_tokens"] == 5
    assert corpus.records(spark, str(tmp_path / "none.json")).count() == 0
    assert [r["answer"] for r in ledger.export(items, records).orderBy("pos").collect()] == ["", "a"]
    assert [r["id"] for r in ledger.pending(items, records).collect()] == ["11.10"]
    with pytest.raises(ValueError):
        corpus.contained("/root/exam", "../x")
    assert corpus.contained("/root/exam", "a/../b.png") == "/root/exam/b.png"


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"abc")
    files = corpus.binaries(spark, [str(tmp_path / "a.png")]).withColumn("path", F.lit("a.png"))
    items = spark.createDataFrame([("1", [("a.png", None)]), ("2", [("a.png", "bad")])], "id string, images array<struct<path: string, sha256: string>>")
    assert {r["id"]: r["ok"] for r in corpus.verified_images(items, files).collect()} == {"1": True, "2": False}
    assert files.select(images.data_url(F.col("content"), F.col("path")).alias("u")).first()["u"] == "data:image/png;base64,YWJj"
    assert images.crop_boxes(500, 1000) == [(0, 0, 300, 600), (200, 0, 500, 600), (0, 400, 300, 1000), (200, 400, 500, 1000)]
    assert images.crop_boxes(499, 1000) == []


def test_validation_and_publishing(spark, tmp_path):
    items = spark.createDataFrame([(0, "1"), (1, "2")], "pos int, id string")
    answers = spark.createDataFrame([(0, "1", "a"), (1, "2", "b")], "pos int, id string, answer string")
    records = answers.select("id", "answer")
    pair = lambda *given: spark.createDataFrame([given], "actual string, {} string".format("recorded" if len(given[0] or "") == 4 else "expected"))
    same, other, exam, odd = pair("abcd", "abcd"), pair("abcd", "efgh"), pair("e", "e"), pair("e", None)
    assert validate.run_violations(items, answers, records, same, exam).count() == 0
    assert [r["message"] for r in validate.run_violations(items, answers.withColumn("id", F.lit("1")), records.limit(1), same, odd).orderBy("nth").collect()] == [
        "exam_id mismatch", "Missing, extra, duplicate or reordered IDs", "Records do not cover the full exam",
    ]
    out = str(tmp_path / "answers")
    assert sinks.publish(answers, validate.run_violations(items, answers, records, same, exam), out)
    assert sinks.read_json(spark, out, answers.schema).count() == 2
    assert not sinks.publish(answers, validate.run_violations(items, answers, records, other, exam), out)
    assert not (tmp_path / "answers").exists()


def test_prompt_and_two_stages(spark):
    df = spark.createDataFrame([("1", "at most 5 words", "s", True), ("2", "q", None, False), ("3", "bad", "s", True)], "id string, question string, source string, essay boolean")
    parts = prompt.parts(F.col("question"), F.col("source"), F.lit("f"), F.col("essay"), F.lit("ctx"))
    rows = df.select("id", parts.alias("p"), prompt.payload(F.lit("sys"), parts, F.col("essay")).alias("j")).orderBy("id").collect()
    assert len(rows[0]["p"]) == 2 and prompt.Wording.bounded_essay in rows[0]["p"][0]["text"] and len(rows[1]["p"]) == 1
    assert json.loads(rows[0]["j"])["max_tokens"] == 3072
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    asked = df.select("id", F.array(message("system", F.lit("write")), message("user", F.col("question"))).alias("messages"))
    plan = lambda ps: [{"answer": f"{p['messages'][0]['content']} of {p['messages'][1]['content']}", "finish_reason": "length" if p["messages"][1]["content"] == "bad" else "stop", "raw": "r"} for p in ps]
    done, refused = infer.two_stage(asked, df.filter("essay"), plan, 2, "make a plan", "now write")
    done = {r["id"]: r for r in done.collect()}
    assert [(m["role"], m["content"]) for m in done["1"]["messages"]] == [("system", "write"), ("user", "at most 5 words"), ("assistant", "make a plan of at most 5 words"), ("user", "now write")]
    assert len(done["2"]["messages"]) == 2 and done["2"]["first_seconds"] is None and done["1"]["first_seconds"] >= 0
    assert [r["id"] for r in refused.collect()] == ["3"] and set(done) == {"1", "2"}


def test_what_fails_to_answer_is_a_row(spark):
    got = infer.http_responder("http://127.0.0.1:9", timeout=1)([{}])
    assert "error" in got[0] and len(got[0]["error"]) <= infer.ERROR_TEXT
    rows = infer.respond(spark.createDataFrame([("1", "{}")], "id string, payload string"), infer.http_responder("http://127.0.0.1:9", timeout=1), 1)
    assert rows.first()["status"] == "error"
    with pytest.raises(RuntimeError, match="not completed"):
        infer.require_sound(rows)
    assert infer.health("http://x/", ask=lambda url: {"status": "ok", "url": url})["url"] == "http://x/health"
    with pytest.raises(RuntimeError, match="not ready"):
        infer.health("http://x", ask=lambda url: {"status": "loading"})


def test_parameters_and_choices(spark):
    given = run.Parameters.of({"max_tokens": "9", "essay_ids": "1 2", "validate_only": "true", "temperature": "0.5"})
    assert given.max_tokens == 9 and given.essay_ids == ("1", "2") and given.validate_only and given.temperature == 0.5
    with pytest.raises(ValueError, match="choose"):
        run.Parameters.of({"no_essays": "true", "essay_ids": "1"})
    with pytest.raises(ValueError, match="unknown"):
        run.Parameters.of({"tokens": "1"})
    spark.conf.set("spark.lectern.max_tokens", "77")
    assert run.Parameters.of_session(spark).max_tokens == 77
    spark.conf.unset("spark.lectern.max_tokens")
    items = spark.createDataFrame([("1", "Write an essay.", 1.0), ("2", "Name it.", 12.0), ("3", "Name it.", 1.0)], "id string, question string, max_points double")
    with pytest.raises(ValueError, match="ambiguous essays: 2"):
        run.choose_essays(items)
    assert [r["id"] for r in run.choose_essays(items.filter("id <> '2'")).collect()] == ["1"]
    assert run.choose_essays(items, run.Parameters(no_essays=True)).count() == 0
    assert [r["id"] for r in run.choose_essays(items, run.Parameters(essay_ids=("2",))).collect()] == ["2"]
    with pytest.raises(ValueError, match="unknown essay ids: 9"):
        run.choose_essays(items, run.Parameters(essay_ids=("9",)))
    assert sorted(r["id"] for r in run.select_items(items, run.Parameters(ids=("3", "1", "3"))).collect()) == ["1", "3"]
    with pytest.raises(ValueError, match="unknown ids"):
        run.select_items(items, run.Parameters(ids=("7",)))
    one = spark.createDataFrame([(1, None)], "a int, b string")
    run.check_same(one, one)
    with pytest.raises(ValueError, match="changed"):
        run.check_same(one, one.withColumn("b", F.lit("x")))


def test_load_order_is_that_of_files_and_places(spark, tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    want = []
    for n in range(6):  # later files are larger: Spark packs the largest pieces first
        names = [f"{n}-{k}" for k in range(3 + 400 * n)]
        want += names
        (root / f"part-{n}.jsonl").write_text("".join(json.dumps({"id": x, "title": "t", "text": "y" * n}) + "\n" for x in names))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    got = corpus.load_corpus(None, corpus.notes(spark, str(root))).orderBy("doc_index").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["id"] for r in got] == want and [r["doc_index"] for r in got] == list(range(len(want)))


def test_side_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"123")
    (tmp_path / "b" / "x.bin").write_bytes(b"12345")
    (tmp_path / "note.txt").write_text(" told \n")
    found = {r["name"]: r["bytes"] for r in corpus.inventory(spark, ["a/x.bin", "b/x.bin", "c/x.bin"], str(tmp_path)).collect()}
    assert found == {"a/x.bin": 3, "b/x.bin": 5, "c/x.bin": None}
    assert corpus.optional_text(spark, str(tmp_path / "note.txt")) == "told" and corpus.optional_text(spark, str(tmp_path / "none.txt")) is None
    (tmp_path / "a" / "out").symlink_to("/etc")
    with pytest.raises(ValueError):
        corpus.contained(str(tmp_path / "a"), "out/passwd")
    assert corpus.contained("hdfs://n/exam", "a/../b.png") == "hdfs://n/exam/b.png"
    with pytest.raises(ValueError):
        corpus.contained("hdfs://n/exam", "../b.png")
    assert list(sinks.tee(["one\n", "two\n"], str(tmp_path / "log"))) == ["one\n", "two\n"] and (tmp_path / "log").read_text() == "one\ntwo\n"
    sinks.pack(str(tmp_path / "a"), str(tmp_path / "a.tar.gz"))
    with tarfile.open(tmp_path / "a.tar.gz") as tar:
        assert "a/x.bin" in tar.getnames()


def test_diverse_passes_give_what_one_scan_gives(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"t{i:03}x" for i in range(60)]
    docs = [(i, sorted(rng.sample(vocabulary, rng.randrange(3, 25))), rng.choice([40, 90, 200, 700])) for i in range(400)]
    asked = [(t, sorted(rng.sample(vocabulary, 12)), []) for t in range(5)]
    frame = spark.createDataFrame(docs, "doc_index long, terms array<string>, len int").withColumn("span", F.lit(None).cast("struct<lo: int, hi: int>")).withColumn("kind", F.lit("context"))
    topics = spark.createDataFrame(asked, "topic_id long, q array<string>, spans array<struct<lo: int, hi: int>>")
    found = retrieve.scored(frame, topics).select("topic_id", "doc_index", "score").cache()
    scores = {(r["topic_id"], r["doc_index"]): r["score"] for r in found.collect()}
    monkeypatch.setattr(retrieve, "RIVALS", 4)
    monkeypatch.setattr(retrieve, "RARE", 1)
    budget = retrieve.Budget(1500, 1, 1, 9)
    got = {r["topic_id"]: r["picked"] for r in retrieve.pick_diverse(found, frame, topics, budget).collect()}
    df = collections.Counter(t for _, terms, _ in docs for t in terms)
    for topic, q, _ in asked:
        picked, used, covered, chosen = [], 0, set(), []
        while len(picked) < budget.lines:
            best = None
            for i, terms, size in docs:
                if i in picked or (topic, i) not in scores or used + size + 1 > budget.chars:
                    continue
                gain = sum(math.log(1 + len(docs) / (1 + df[t])) for t in sorted(set(terms) & set(q) - covered))
                like = max((len(set(terms) & c) / len(set(terms) | c) for c in chosen), default=0)
                key = (round(scores[topic, i] + gain - 3 * like, 6), -i)
                best = max(best or key, key)
            if best is None:
                break
            i = -best[1]
            picked.append(i)
            used += docs[i][2] + 1
            covered |= set(docs[i][1]) & set(q)
            chosen.append(set(docs[i][1]))
        assert got[topic] == picked


def test_streaming_ledger_runs_twice_as_once(spark, tmp_path):
    requests = str(tmp_path / "requests")
    spark.createDataFrame([("1", '{"x": "hello"}'), ("2", '{"x": ""}'), ("1", '{"x": "hello"}')], "id string, payload string").write.parquet(requests)
    answer = lambda ps: [{"answer": p["x"], "finish_reason": "stop", "raw": "r"} for p in ps]
    log = str(tmp_path / "log")
    for n in range(2):
        streaming.answer_new(spark, requests, log, str(tmp_path / f"check{n}"), answer, 2).awaitTermination()
    good, bad = streaming.outcomes(spark, log)
    assert [r["id"] for r in good.collect()] == ["1"]
    assert [(r["id"], r["status"], r["nth"]) for r in bad.collect()] == [("2", "empty", 1)]


def test_contexts_of_odd_questions(spark):
    docs = spark.createDataFrame(
        [(0, "a", "timeline", "Title", "1003", "Bitwa pod murami", ["bitwa", "muram"], (1003, 1003)), (1, "b", "context", "Other", "", "Wojna domowa", ["domow", "wojna"], None)],
        "doc_index long, id string, kind string, title string, date_text string, text string, terms array<string>, span struct<lo: int, hi: int>",
    )
    items = spark.createDataFrame([("1", "1. Bitwa w XI wieku\n2. nic"), ("2", ""), ("3", None), ("4", "Bitwa w XV wieku i wojna")], "id string, question string")
    text, told = context.essay_context(items, docs)
    got = {r["id"]: r["context"] for r in text.collect()}
    s = context.Sections()
    assert got["1"] == f"{s.header}{s.heading}1:\n[a] Title | 1003 | Bitwa pod murami\n\n{s.heading}2:\n{s.nothing}"
    assert got["2"] == f"{s.header}{s.heading}1:\n{s.nothing}" and got["4"] == f"{s.header}{s.heading}1:\n[b] Other |  | Wojna domowa"
    audit = {(r["id"], r["topic_no"]): r for r in told.collect()}
    assert audit["1", 1]["periods"] == [[1001, 1100]] and [r["id"] for r in audit["1", 1]["records"]] == ["a"] and audit["1", 2]["records"] == []
    assert "terms" not in audit["1", 1]["records"][0].asDict()
    none, empty = context.essay_context(items, docs.limit(0))
    assert none.count() == text.count() and all(r["records"] == [] for r in empty.collect())
    short = items.select("id", "question", F.lit("murami").alias("source_text"), F.when(F.col("id") == "4", F.array(F.lit("x.png"))).alias("images"))
    found = {r["id"]: r for r in context.short_context(short, docs).collect()}
    assert found["1"]["reason"] == "matched" and found["1"]["records"][0]["matched_terms"] == ["bitwa", "muram"] and found["1"]["context"].endswith("\n1003 | Bitwa pod murami")
    assert found["4"]["reason"] == "image_question_unchanged" and found["2"]["reason"] == "no_strong_lexical_match" and found["2"]["context"] == ""
