"""The registered queries of a whole run: sources, contexts, prompts, answering, validation and sinks, each with its DuckDB twin.

What a run reads from files is first written from the driver's tables into the
shared folder, in the run's own formats, and read back through the sources.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions import png
from ..functions import text as X
from ..operators import context, images, infer, ledger, run, validate
from ..operators.stop import Unsound, ask_until_unsound
from ..sources import corpus, manifest, sinks, versions
from ..store import materialize, scratch
from ..streaming.ledger import OUTCOME, add_outcomes, answer_new, outcomes
from . import prompt
from .queries import SMALL, _LINE, _documents, _sql_fold, _sql_picked, _sql_scored, _sql_terms, _sql_years, _table

GENERIC = X.word_terms(X.GENERIC_SHORT + " thand ofthe onthe there")
W, S = prompt.Wording(), context.Sections()


def _digest(text) -> "F.Column":
    return F.sha2(F.coalesce(text, F.lit("")), 256)


# --- sources ---


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.col("item_id").cast("string").alias("id"), "text")


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of two topics each: every two following items of the benchmark under numbered headings."""
    rows = _table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 2).cast("long").alias("k"), (F.col("item_id") % 2).alias("no"), "text")
    rows = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("no", "text"))).alias("t"))
    part = lambda x: F.concat((x["no"] + 1).cast("string"), F.when(x["no"] == 0, ". ").otherwise(") "), x["text"])
    return rows.select(F.col("k").cast("string").alias("id"), F.concat(F.lit("Choose one:\n"), F.array_join(F.transform("t", part), "\n")).alias("question"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with limits of all kinds: pos, id, question, max_points, source_text."""
    kind = F.col("pos") % 4
    limit = F.when(kind == 0, "Write an essay of at least 40 words.").when(kind == 1, "Choose one; at most 300 words.").when(kind == 2, "Answer in 10-25 words: 120 words are too many.").otherwise("Name it.")
    return _benchmark(spark, sf_dir).select("pos", "id", limit.alias("question"), F.when(F.col("pos") % 5 == 0, 12.0).otherwise(2.0).alias("max_points"), F.col("text").alias("source_text"))


_KIND_SQL = "CASE item_id % 4 WHEN 0 THEN 'Write an essay of at least 40 words.' WHEN 1 THEN 'Choose one; at most 300 words.' WHEN 2 THEN 'Answer in 10-25 words: 120 words are too many.' ELSE 'Name it.' END"


def exam_scan(spark, sf_dir):
    """The exam as one JSON document, written and read."""
    rows = _questions(spark, sf_dir)
    image = F.struct(F.concat(F.lit("img/"), F.col("id"), F.lit(".png")).alias("path"), _digest(F.col("source_text")).alias("sha256"))
    item = F.struct("pos", F.struct("id", "question", "source_text", "max_points", F.when(F.col("pos") % 3 == 0, F.array(image)).alias("images")).alias("item"))
    exam = rows.agg(F.lit("exam-1").alias("exam_id"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias("items"))
    sinks.write_json(exam, path := scratch(spark, "exam"))
    out = corpus.exam_items(spark, path)
    return out.select("exam_id", F.col("pos").cast("long").alias("pos"), "id", "question", "max_points", _digest(F.col("source_text")).alias("source_sha256"), F.coalesce(F.size("images"), F.lit(0)).cast("long").alias("n_images"), F.element_at("images.path", 1).alias("image"))


#: Files of a small table's JSON lines; larger ones get more, as many as their bytes ask for.
LEAST_FILES = 3


def _write_lines(rows: DataFrame, path: str, blank: int) -> None:
    """JSON lines of rows in the order of doc_id, in several files, with a blank line after some."""
    files = max(LEAST_FILES, int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // (SMALL >> 3))
    body = F.to_json(F.struct(*[c for c in rows.columns if c != "doc_id"]))
    lines = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id").select("doc_id", body.alias("value"))
    lines.select(F.explode(F.when(F.col("doc_id") % blank == 0, F.array("value", F.lit("  "))).otherwise(F.array("value"))).alias("value")).write.text(path)


def corpus_load(spark, sf_dir):
    """Timeline rows and notes as JSON lines in several files, read and numbered in their order."""
    docs = _table(spark, sf_dir, "documents")
    n = F.col("doc_id") % 10
    date = F.when(n == 2, "").when(n == 4, F.concat((1000 + F.col("doc_id") % 900).cast("string"), F.lit("–1999"))).when(n == 6, "753 p.n.e.").when(n == 8, "brak daty")
    first = docs.filter("doc_id % 2 = 0").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("source").alias("section_path"), date.alias("date_text"), F.col("text").alias("event_text"))
    years = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1500), 1500 + F.col("doc_id") % 400))
    second = docs.filter("doc_id % 2 = 1").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), years.alias("years"), F.array("lang", F.lit("marked")).alias("tags"), "text")
    paths = scratch(spark, "timeline"), scratch(spark, "notes")
    for rows, path in zip((first, second), paths):
        _write_lines(rows, path, 7)
    out = corpus.load_corpus(corpus.timeline(spark, paths[0]), corpus.notes(spark, paths[1]))
    return out.select("doc_index", "kind", "id", "title", "date_text", F.col("span.lo").cast("long").alias("lo"), F.col("span.hi").cast("long").alias("hi"), F.size("terms").cast("long").alias("n_terms"), _digest(F.col("text")).alias("sha256"))


def _kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alternate corpus, written as JSON lines and read back, with doc_index."""
    docs = _table(spark, sf_dir, "documents").filter(~X.is_blank(F.col("text")))
    dates = F.when(F.col("doc_id") % 3 == 0, F.array(F.concat((1000 + F.col("doc_id") % 900).cast("string"), F.lit(" i "), (1100 + F.col("doc_id") % 800).cast("string"), F.lit(": potem 1990")), F.lit("styczeń"))).otherwise(F.array(F.lit("nieznana")))
    rows = docs.select(
        "doc_id", F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Title of "), "source").alias("tytul"), F.col("text").alias("tekst"), F.col("lang").alias("dzial"), dates.alias("daty"),
        F.array(F.concat(F.lit("thand "), "source")).alias("postacie"), F.array(F.struct(F.lit("ontion").alias("termin"))).alias("pojecia"),
    )
    _write_lines(rows, path := scratch(spark, "kb"), 5)
    return materialize(corpus.load_corpus(corpus.knowledge_base(spark, path), None), "kb")


def kb_scan(spark, sf_dir):
    """Records of the alternate corpus with their fields' terms and spans."""
    out = _kb(spark, sf_dir)
    joined = lambda c: F.array_join(c, " ")
    return out.select("doc_index", "id", "title", joined("title_terms").alias("title_terms"), joined("meta_terms").alias("meta_terms"), F.size("terms").cast("long").alias("n_terms"), F.col("span.lo").cast("long").alias("lo"), F.col("span.hi").cast("long").alias("hi"))


def records_scan(spark, sf_dir):
    """The ledger as one JSON object by id, written and read; an absent one gives no rows."""
    rows = _benchmark(spark, sf_dir)
    usage = F.struct((F.col("pos") * 3).cast("int").alias("total_tokens"), F.struct(F.col("pos").cast("int").alias("cached_tokens")).alias("prompt_tokens_details"))
    record = F.struct(F.col("text").alias("answer"), F.lit("stop").alias("finish_reason"), F.when(F.col("pos") % 2 == 0, usage).alias("usage"))
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", record)))).alias("value")).coalesce(1).write.text(path := scratch(spark, "records"))
    found = corpus.records(spark, path).unionByName(corpus.records(spark, path + "-absent"))
    return found.select("id", _digest(F.col("answer")).alias("sha256"), "finish_reason", F.coalesce("usage.total_tokens", F.lit(0)).cast("long").alias("tokens"), F.coalesce("usage.prompt_tokens_details.cached_tokens", F.lit(0)).cast("long").alias("cached"))


def _files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with one file for each item of the benchmark, in a subfolder by its id."""
    _benchmark(spark, sf_dir).select("id", F.col("text").alias("value")).write.partitionBy("id").option("lineSep", "\n").text(path := scratch(spark, "files"))
    return path


def _item_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.binaries(spark, [corpus.contained(_files(spark, sf_dir), "id=*")])
    return found.withColumn("path", F.concat(F.lit("img/"), F.regexp_extract("path", r"/id=([^/]+)/", 1), F.lit(".gif")))


def images_verified(spark, sf_dir):
    """Images beside their files, whose checksums hold, do not hold, or were not named; and those without a file."""
    files = _item_files(spark, sf_dir)
    rows = _benchmark(spark, sf_dir)
    told = F.when(F.col("pos") % 3 == 0, F.sha2("id", 256)).when(F.col("pos") % 3 == 1, F.sha2(F.concat("text", F.lit("\n")), 256)).otherwise("")
    image = lambda path, sha: F.struct(path.alias("path"), sha.alias("sha256"))
    items = rows.select("id", F.array(image(F.concat(F.lit("img/"), F.col("id"), F.lit(".gif")), told), image(F.concat(F.lit("lost/"), F.col("id")), F.lit(None).cast("string"))).alias("images"))
    out = corpus.verified_images(items, files)
    return out.select("id", F.col("nth").cast("long").alias("nth"), "path", "ok", F.sha2(images.data_url(F.col("content"), F.col("path")), 256).alias("url_sha256"))


def file_inventory(spark, sf_dir):
    """Bytes of expected files, absent ones null, and all together."""
    root = _files(spark, sf_dir)
    names = [r["name"] for r in corpus.binaries(spark, [f"{root}/id=*"]).select(F.regexp_extract("path", r"/(id=[^/]+/[^/]+)$", 1).alias("name")).collect()]
    found = corpus.inventory(spark, [*names, "absent/file.bin", "absent/other.bin"], root)
    rows = found.select(F.regexp_replace("name", "/part-.*", "").alias("name"), "bytes")
    return rows.union(corpus.total_bytes(found).select(F.lit("all").alias("name"), "bytes"))


ENDINGS = ("png", "jpg", "JPEG", "gif", "webp", "bmp", "svg", "tiff", "tif", "xyz", "")


def mime_types(spark, sf_dir):
    """Media types by ending, the default for others."""
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % len(ENDINGS) + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", images.mime(F.concat(F.lit("a/b."), ending)).alias("mime"))


def crop_boxes(spark, sf_dir):
    """Boxes of the crops that images of many sizes would get."""
    sizes = _table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2000 + 1).cast("int").alias("w"), (F.col("n_chars") * 7 % 1500 + 1).cast("int").alias("h"))
    boxes = images.crop_columns(F.col("w"), F.col("h"), F.col("doc_id") % 7 == 0, F.col("doc_id") % 5)
    return sizes.select("doc_id", F.array_join(F.transform(boxes, lambda b: F.array_join(b.cast("array<string>"), ",")), " ").alias("boxes"))


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each item, 500 by 500 pixels, whose bytes repeat the digest of its text."""

    @F.pandas_udf("binary")
    def drawn(digests: pd.Series) -> pd.Series:
        return digests.map(lambda d: png.encode(np.resize(np.frombuffer(d.encode(), np.uint8), 500 * 500 * 3).reshape(500, 500, 3)))

    rows = _benchmark(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "id")
    return rows.select("id", F.concat("id", F.lit(".png")).alias("path"), drawn(F.sha2("text", 256)).alias("content"))


def images_cropped(spark, sf_dir):
    """The crops of each item's image, by the digest of their pixels."""

    @F.pandas_udf("string")
    def pixels(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: hashlib.sha256(png.decode(c).tobytes()).hexdigest())

    out = images.crops(_pictures(spark, sf_dir))
    return out.select("id", F.col("nth").cast("long").alias("nth"), F.array_join(F.col("box").cast("array<string>"), ",").alias("box"), pixels("content").alias("sha256"), F.col("error").isNull().alias("ok"))


# --- contexts ---


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return materialize(docs.select(
        F.col("doc_id").alias("doc_index"), F.col("doc_id").cast("string").alias("id"), F.lit("context").alias("kind"), F.col("source").alias("title"), F.col("lang").alias("date_text"), "text",
        X.terms(F.col("text")).alias("terms"), P.doc_span(F.col("text")).alias("span"),
    ), "dated")


def context_essay(spark, sf_dir):
    """The whole context of questions with two topics each."""
    text, _ = context.essay_context(_paired(spark, sf_dir), _dated(spark, sf_dir))
    return text.select("id", F.length("context").cast("long").alias("n_chars"), _digest(F.col("context")).alias("sha256"))


def context_audit(spark, sf_dir):
    """The audit of the same retrieval, written as JSON beside the contexts and read again."""
    text, told = context.essay_context(_paired(spark, sf_dir), _dated(spark, sf_dir))
    sinks.write_contexts(text, told, path := scratch(spark, "contexts"))
    read = sinks.read_json(spark, f"{path}/retrieval", told.schema)
    lines = F.transform("records", lambda r: F.concat_ws("|", r["id"], r["title"], r["date_text"]))
    return read.select("id", F.col("topic_no").cast("long").alias("topic_no"), _digest(F.col("topic")).alias("topic_sha256"), F.array_join(F.transform("periods", lambda p: F.array_join(p.cast("array<string>"), "-")), " ").alias("periods"), F.size("records").cast("long").alias("n_records"), F.array_join(lines, " ").alias("records"))


def context_short(spark, sf_dir):
    """Short questions: lines of date and text, matched terms and scores; items with images are left as they are."""
    rows = _benchmark(spark, sf_dir)
    shown = F.when(F.col("pos") % 5 == 0, F.array(F.lit("map.png"))).when(F.col("pos") % 5 == 1, F.array().cast("array<string>"))
    items = rows.select("id", F.lit("Which?").alias("question"), F.col("text").alias("source_text"), shown.alias("images"))
    out = context.short_context(items, _dated(spark, sf_dir), GENERIC)
    told = F.transform("records", lambda r: F.concat_ws(":", r["id"], F.array_join(r["matched_terms"], ",")))
    return out.select("id", "reason", _digest(F.col("context")).alias("sha256"), F.array_join(told, " ").alias("records"), F.round(F.aggregate("records", F.lit(0.0), lambda n, r: n + r["score"]), 3).alias("score_sum"))


def context_kb(spark, sf_dir):
    """The alternate corpus: weighted terms, records in the order of picking, raw scores in the audit."""
    text, told = context.kb_context(_paired(spark, sf_dir), _kb(spark, sf_dir), GENERIC)
    lines = F.transform("records", lambda r: F.concat_ws(":", r["id"], F.array_join(r["matched_terms"], ",")))
    shown = told.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("topic_no", F.array_join(lines, " ").alias("l"), F.element_at("records.score", 1).alias("s")))), lambda x: F.concat_ws(" ", x["l"], F.format_number(x["s"], 3))), "\n").alias("audit"))
    return text.join(shown, "id").select("id", _digest(F.col("context")).alias("sha256"), "audit")


# --- prompts and runs ---


def prompt_payloads(spark, sf_dir):
    """Whole requests: system text by the task's limits, parts in both orders, sampling."""
    rows = _questions(spark, sf_dir).withColumn("essay", F.col("pos") % 2 == 0)
    content = prompt.parts(F.col("question"), F.col("source_text"), F.lit("List"), F.col("essay"), F.when(F.col("pos") % 3 == 0, F.lit("help")), question_first=True)
    return rows.select("id", F.sha2(prompt.payload(prompt.system_text(F.col("question"), F.col("essay")), content, F.col("essay")), 256).alias("sha256"), F.size(prompt.without_last(content)).cast("long").alias("n_before_last"))


def essays_chosen(spark, sf_dir):
    """Items of a run with what their wording makes them, and those that are essays as told by their ids."""
    rows = _questions(spark, sf_dir)
    told = run.Parameters.of({"essay_ids": " ".join(r["id"] for r in rows.filter("pos % 4 = 0").select("id").collect())})
    essays = run.choose_essays(rows, told).withColumn("essay", F.lit(True))
    return run.select_items(run.classified(rows), run.Parameters()).join(essays, "id", "left").select("id", "kind", F.coalesce("essay", F.lit(False)).alias("essay"))


def run_rehearsal(spark, sf_dir):
    """What a run would do: which items are essays, their context, and whether their images hold."""
    rows = _questions(spark, sf_dir)
    essays = rows.filter("pos % 4 = 0").select("id")
    contexts = rows.select("id", F.concat("source_text", F.lit("\n")).alias("context"))
    shown = rows.filter("pos % 3 = 0").select("id", F.explode(F.array(F.lit(True), F.col("pos") % 2 == 0)).alias("ok"))
    return run.rehearse(rows, essays, contexts, shown)


def config_compare(spark, sf_dir):
    """Configurations of a run against the one that it began with, by hash of the table's texts."""
    docs = _table(spark, sf_dir, "documents")
    config = docs.agg(F.sha2(F.concat(F.min("text"), F.max("text")), 256).alias("corpus_sha256"), F.lit(0.0).alias("temperature"), F.lit(None).cast("string").alias("revision"))
    changed = config.withColumn("temperature", F.lit(0.1))
    named = lambda name, other: ledger.same_run(config, other).select(F.lit(name).alias("run"), "equal")
    return named("same", config.select("revision", "temperature", "corpus_sha256")).union(named("changed", changed)).union(named("null", config.withColumn("revision", F.lit("r1"))))


def _respond(payloads):
    """Answers by what is asked: sound ones, blank ones, ones with tags, cut ones and errors."""
    out = []
    for p in payloads:
        words = (p.get("content") or p["messages"][-1]["content"]).split()
        kind = sum(map(len, words)) % 5
        answer = " ".join(words[:4])
        if kind == 0:
            out.append({"error": "busy " * 1000})
        else:
            out.append({"answer": ("", "  ", f" {answer}\n", f"<think>{answer}", answer)[kind], "finish_reason": "length" if kind == 4 else "stop", "raw": "{}"})
    return out


def responder_outcomes(spark, sf_dir):
    """Failures as rows: what goes to the ledger and what to the quarantine."""
    rows = _benchmark(spark, sf_dir).select("id", F.to_json(F.struct(F.col("text").alias("content"))).alias("payload"))
    got = materialize(infer.respond(rows, _respond, 4), "answers")
    good, bad = sinks.split_quarantine(got)
    columns = ["id", "answer", "status", "truncated", F.length("error").cast("long").alias("error_chars")]
    return good.select(F.lit("ledger").alias("side"), *columns).union(bad.select(F.lit("quarantine").alias("side"), *columns))


def ledger_stream(spark, sf_dir):
    """The ledger as a stream in two runs: what the first has answered, the second does not ask again."""
    rows = _benchmark(spark, sf_dir).select("id", "pos", F.to_json(F.struct(F.col("text").alias("content"))).alias("payload"))
    root = scratch(spark, "stream")
    for part in (rows.filter("pos % 2 = 0"), rows):
        part.select("id", "payload").write.mode("append").parquet(f"{root}/requests")
        answer_new(spark, f"{root}/requests", f"{root}/log", f"{root}/checkpoint", _respond, 2).awaitTermination()
    good, _ = outcomes(spark, f"{root}/log")
    return good.groupBy("id").agg(F.count("*").alias("n"), F.max("answer").alias("answer"))


def ledger_replayed(spark, sf_dir):
    """Batches that come twice, one of them after the log was compacted: one record for each id, on one side."""
    rows = _benchmark(spark, sf_dir).select("id", "pos", F.to_json(F.struct(F.col("text").alias("content"))).alias("payload"))
    log = scratch(spark, "log")
    for nth, number in enumerate((0, 1, 1, 0, 2, 2)):
        got = infer.respond(rows.filter(F.col("pos") % 3 == number), _respond, 2)
        add_outcomes(got.drop("nth"), log, "run", number)
        if nth == 2:
            versions.compact(spark, log, OUTCOME)
    good, bad = outcomes(spark, log)
    return good.select("id", F.lit("ledger").alias("side"), "answer").union(bad.select("id", F.lit("quarantine"), "answer"))


def _rarely(payloads):
    """A server that fails at texts of some lengths only."""
    words = payloads[0]["content"].split()
    return [{"error": "busy"} if sum(map(len, words)) % 23 == 0 else {"answer": " ".join(words[:4]), "finish_reason": "stop", "raw": "{}"}]


def run_stops(spark, sf_dir):
    """A run that ends with its first answer that is not sound: what was answered before, and that one."""
    rows = _benchmark(spark, sf_dir).select("pos", "id", F.to_json(F.struct(F.col("text").alias("content"))).alias("payload"))
    log, told = scratch(spark, "stops"), "whole"
    try:
        ask_until_unsound(rows, _rarely, log)
    except Unsound as error:
        told = str(error)
    good, bad = outcomes(spark, log)
    both = good.select("id", F.lit("ledger").alias("side"), "answer").union(bad.select("id", F.lit("quarantine"), "answer"))
    return both.withColumn("told", F.lit(told))


def tables_replaced(spark, sf_dir):
    """A table that was replaced, and whose next writer died before its rows counted."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", _digest(F.col("text")).alias("sha256"))
    path = scratch(spark, "replaced")
    versions.replace(docs.filter("doc_id % 3 = 0"), path)
    versions.replace(docs.filter("doc_id % 2 = 0"), path)
    docs.filter("doc_id % 5 = 0").write.parquet(f"{path}/{versions.PARTS}/unfinished")
    return versions.read(spark, path, docs.schema)


def plan_then_write(spark, sf_dir):
    """Two calls for essays: a plan, then the request that holds it; refused plans go to the quarantine."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    rows = _benchmark(spark, sf_dir).select("pos", "id", F.array(message("system", F.lit("write")), message("user", F.col("text"))).alias("messages"))
    done, refused = infer.two_stage(rows.select("id", "messages"), rows.filter("pos % 2 = 0"), _respond, 4, "plan", "Now write.")
    joined = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "\n")
    done = done.select("id", F.lit("asked").alias("stage"), _digest(joined).alias("sha256"), F.size("messages").cast("long").alias("n"), F.col("first_seconds").isNotNull().alias("timed"))
    return done.union(refused.select("id", F.col("status"), F.lit(None).cast("string"), F.lit(0).cast("long"), F.lit(False)))


def stage_artefacts(spark, sf_dir):
    """Requests, raw responses and texts of a first call as files by item, written and read back, empty ones too."""
    rows = _benchmark(spark, sf_dir).select("id", F.to_json(F.struct(F.col("text").alias("content"))).alias("payload"))
    got = infer.respond(rows, _respond, 4).select("id", "raw", "answer").join(rows, "id")
    sinks.write_stage(got, path := scratch(spark, "stage"), "essay-plan-")
    return _named(spark, path)


def _named(spark: SparkSession, path: str) -> DataFrame:
    return sinks.read_named(spark, path).select("name", F.sha2("content", 256).alias("sha256"))


#: Letters that decompose to one or more others, beyond Latin ones with accents, and what they are folded to.
DECOMPOSED = ("ﬁnał", "ＦＵＬＬ", "𝔘𝔫𝔦𝔠𝔬𝔡𝔢", "㎏㏒", "Ⅷ", "Ǆungla", "x̂ŷ", "①②", "ｶﾞ", "ﷺ")


def folded_exactly(spark, sf_dir):
    """The folding of all texts, each with a word of letters beyond Latin ones."""
    odd = F.element_at(F.array(*map(F.lit, DECOMPOSED)), (F.col("doc_id") % len(DECOMPOSED) + 1).cast("int"))
    rows = _documents(spark, sf_dir).select("doc_id", F.concat("text", F.lit(" "), odd).alias("text"))
    return rows.select("doc_id", _digest(X.fold(F.col("text"))).alias("sha256"))


def observe_then_answer(spark, sf_dir):
    """Two calls for items with images: notes on the images alone, then added to the content."""
    rows = _benchmark(spark, sf_dir)
    shown = F.when(F.col("pos") % 3 == 0, F.array(F.struct(F.lit("a.png").alias("path"), F.lit("data:x").alias("url"))))
    essay = F.col("pos") % 2 == 1
    rows = rows.select("id", "pos", essay.alias("essay"), shown.alias("images"), prompt.parts(F.lit("Q"), F.col("text"), F.lit(""), essay, F.lit(""), F.coalesce(shown, F.array().cast("array<struct<path: string, url: string>>"))).alias("parts"))

    def notes(payloads):
        return [{"answer": f"seen {len(p['content'])} {p['content'][0]['text']}", "finish_reason": "length"} for p in payloads]

    done, refused = infer.observe(rows, notes, 4, "look", "List what you see.", "NOTES:\n", "\nCheck them.")
    out = done.select("id", F.size("parts").cast("long").alias("n"), F.element_at("parts.text", -1).alias("last"))
    return out.unionByName(refused.select("id", F.lit(-1).cast("long").alias("n"), "status").withColumnRenamed("status", "last")).select("id", "n", _digest(F.col("last")).alias("last_sha256"))


def stage_seconds(spark, sf_dir):
    """Seconds of both stages together, null where there was one."""
    rows = _table(spark, sf_dir, "events").select("event_id", (F.round(F.col("event_id") % 400) / 4).alias("seconds"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 7 / 4).alias("first_seconds"))
    return infer.total_seconds(rows).select("event_id", "total_seconds")


# --- validation and sinks ---


def _run(spark: SparkSession, sf_dir: str):
    """A run with faults of every kind: items, answers, records and essays."""
    rows = _benchmark(spark, sf_dir)
    items = _questions(spark, sf_dir)
    n = F.col("pos")
    answers = rows.select("pos", F.when(n == 3, "x").otherwise(F.col("id")).alias("id"), F.when(n % 9 == 0, " ").when(n % 7 == 0, F.concat(F.lit("<think>"), "text")).otherwise(F.col("text")).alias("answer"))
    known = rows.filter(n != 5).select("id", F.when(n % 11 == 0, "other").when(n % 7 == 0, F.concat(F.lit("<think>"), "text")).otherwise(F.col("text")).alias("answer"), (n % 13 == 0).alias("truncated"), F.when(n % 17 != 0, F.when(n % 13 == 0, "length").otherwise("stop")).alias("finish_reason"))
    return items, answers, known, items.filter("pos % 2 = 0 or pos % 4 = 3")


def run_report(spark, sf_dir):
    """The validation of a run with its lists of errors and warnings."""
    items, answers, known, essays = _run(spark, sf_dir)
    hashes = items.agg(F.sha2(F.min("source_text"), 256).alias("actual")).withColumn("recorded", F.sha2(F.lit("drift"), 256))
    ids = spark.range(1).select(F.lit("exam-1").alias("actual"), F.lit("exam-2").alias("expected"))
    out = validate.full_report(items, answers, known, essays, hashes, ids)
    return out.select("status", F.size("errors").cast("long").alias("n_errors"), F.size("warnings").cast("long").alias("n_warnings"), F.array_join(F.slice("errors", 1, 4), "\n").alias("first_errors"), _digest(F.array_join("errors", "\n")).alias("errors_sha256"), _digest(F.array_join("warnings", "\n")).alias("warnings_sha256"), "answer_count", F.array_join("essay_ids", " ").alias("essay_ids"))


def answers_sound(spark, sf_dir):
    """A run over chosen ids whose exported answers, written and read, break no rule."""
    chosen = run.select_items(_questions(spark, sf_dir), run.Parameters.of({"ids": " ".join(map(str, range(0, 40, 3)))}))
    place = F.row_number().over(Window.orderBy("pos")) - 1  # as many rows as ids were told
    items = chosen.withColumn("pos", place)
    answer = F.struct("pos", F.struct("id", F.col("source_text").alias("answer")).alias("a"))
    out = items.agg(F.lit("exam-1").alias("exam_id"), F.transform(F.array_sort(F.collect_list(answer)), lambda x: x["a"]).alias("answers"))
    sinks.write_json(out, path := scratch(spark, "answers"))
    read = corpus.answers(spark, path)
    known = items.select("id", F.col("source_text").alias("answer"), F.lit(False).alias("truncated"), F.lit("stop").alias("finish_reason"))
    digest = items.agg(F.sha2(F.max("source_text"), 256).alias("actual"))
    ids = read.select(F.col("exam_id").alias("actual"), F.lit("exam-1").alias("expected")).limit(1)
    whole = validate.full_report(items, read, known, run.choose_essays(items, run.Parameters(no_essays=True)), digest.withColumn("recorded", F.col("actual")), ids)
    told = whole.select("status", F.size("errors").cast("long").alias("n_errors"), "answer_count")
    return read.select("exam_id", F.col("pos").cast("long").alias("pos"), "id", _digest(F.col("answer")).alias("sha256")).crossJoin(F.broadcast(told))


def report_written(spark, sf_dir):
    """The same run's violations as a table, with the figures that were observed as it was written."""
    items, answers, known, essays = _run(spark, sf_dir)
    hashes = items.agg(F.sha2(F.min("source_text"), 256).alias("actual")).withColumn("recorded", F.sha2(F.lit("drift"), 256))
    ids = spark.range(1).select(F.lit("exam-1").alias("actual"), F.lit("exam-2").alias("expected"))
    figures = validate.write_report(items, answers, known, essays, hashes, ids, path := scratch(spark, "report"))
    shown = " ".join(f"{k}={figures[k]}" for k in ("status", "n_errors", "answers", "completed", "truncated", "short"))
    return versions.read(spark, path, validate.VIOLATIONS).withColumn("figures", F.lit(shown))


def run_manifest(spark, sf_dir):
    """Fingerprints of a run's files, and whether the run goes on with them, with one altered, and with one more."""
    rows = _benchmark(spark, sf_dir)
    root = scratch(spark, "manifest")
    sinks.write_named(rows.select(F.concat("id", F.lit(".txt")).alias("name"), F.col("text").alias("body")), f"{root}/corpus")
    config = spark.range(1).select(F.lit(0.0).alias("temperature"))
    files = manifest.fingerprints(spark, f"{root}/corpus")
    told = [manifest.begin(config, files, f"{root}/run").first()["corpus_sha256"]]
    for change in (None, F.col("pos") == 0, F.col("pos") < 0):
        if change is not None:
            body = rows.filter(change).select(F.concat("id", F.lit(".txt")).alias("name"), F.concat("text", F.lit("!")).alias("body"))
            sinks.write_named(body if body.limit(1).count() else spark.createDataFrame([("more.txt", "x")], "name string, body string"), f"{root}/corpus")
        try:
            manifest.begin(config, manifest.fingerprints(spark, f"{root}/corpus"), f"{root}/run")
            told.append("same")
        except ValueError as error:
            told.append(str(error).split("; ", 1)[1])
    return versions.read(spark, f"{root}/run/files", manifest.FILES).withColumn("told", F.lit(" | ".join(told)))


def answer_warnings(spark, sf_dir):
    """Warnings while a run goes on: no limit told, the token limit reached, an essay that is short."""
    items, answers, known, essays = _run(spark, sf_dir)
    return validate.warnings(validate.with_records(answers, known, items, essays)).select("id", F.col("nth").cast("long").alias("nth"), "message")


def publish_answers(spark, sf_dir):
    """Answers in the order of the exam, published as there is no violation, and withdrawn once there is one."""
    rows = _benchmark(spark, sf_dir)
    answers = ledger.export(rows.select("pos", "id"), rows.filter("pos % 3 <> 0").select("id", F.col("text").alias("answer"))).orderBy("pos")
    none = spark.createDataFrame([], "message string")
    kept, gone = scratch(spark, "published"), scratch(spark, "withdrawn")
    done = [sinks.publish(answers, none, kept), sinks.publish(answers, none, gone), sinks.publish(answers, spark.createDataFrame([("bad",)], "message string"), gone)]
    left = corpus.optional_text(spark, gone)
    told = f"{done} {left}"
    return sinks.read_json(spark, kept, "pos long, id string, answer string").select("pos", "id", _digest(F.col("answer")).alias("sha256"), F.lit(told).alias("told"))


def request_audits(spark, sf_dir):
    """One file for each request with a context, named by its id's digest, written and read back."""
    context = F.when(F.col("pos") % 4 == 0, "help").when(F.col("pos") % 4 == 1, "").when(F.col("pos") % 4 == 2, F.col("text"))
    rows = _benchmark(spark, sf_dir).select("id", F.to_json(F.struct("id", "text")).alias("payload"), context.alias("context"))
    sinks.write_audits(rows, path := scratch(spark, "audits"))
    return _named(spark, path)


# --- DuckDB ---

_DATED = "CASE WHEN contains(text, 'p.n.e.') THEN []::INTEGER[] ELSE {} END".format(_sql_years("text"))
_WORDS = r"len(regexp_extract_all({}, '[^\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'))"
_PARTS = f"""
lines AS (SELECT p.topic_id, string_agg({_LINE}, chr(10) ORDER BY c.doc_id) AS c FROM (SELECT topic_id, unnest(ids) AS doc_id FROM picked) p JOIN documents c USING (doc_id) GROUP BY p.topic_id),
sections AS (SELECT item_id // 2 AS k, item_id % 2 AS no, '{S.heading}' || (item_id % 2 + 1) || ':' || chr(10) || coalesce(l.c, '{S.nothing}') AS t FROM benchmark b LEFT JOIN lines l ON l.topic_id = b.item_id)"""
_HEADER = S.header.replace("\n", "' || chr(10) || '")
_GENERIC_SQL = ", ".join(f"'{t}'" for t in GENERIC)
_TOPICS_LESS = f"SELECT item_id AS topic_id, list_filter({_sql_terms('text')}, lambda t: NOT list_contains([{_GENERIC_SQL}], t)) AS q, {_sql_years('text')} AS ys FROM benchmark"
_SHORT_TOPICS = f"SELECT item_id AS topic_id, list_filter({_sql_terms("'Which? ' || text")}, lambda t: NOT list_contains([{_GENERIC_SQL}], t)) AS q, {_sql_years('text')} AS ys FROM benchmark WHERE item_id % 5 <> 0"
_KB_DOCS = r"(SELECT * FROM documents WHERE regexp_matches(text, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'))"
_KB_TITLE, _KB_META = "'Title of ' || {p}source || ' ' || {p}lang", "'thand ' || {p}source || ' ontion'"
_KB_TERMS = _sql_terms("{} || ' ' || text || ' ' || {}".format(_KB_TITLE.format(p=""), _KB_META.format(p="")))
_KB_WEIGHT = f"CASE WHEN list_contains({_sql_terms(_KB_TITLE.format(p='h.'))}, h.term) THEN 3 WHEN list_contains({_sql_terms(_KB_META.format(p='h.'))}, h.term) THEN 2 ELSE 1 END"
_KB_YEARS = "CASE WHEN doc_id % 3 = 0 THEN [CAST(1000 + doc_id % 900 AS INTEGER), CAST(1100 + doc_id % 800 AS INTEGER)] ELSE []::INTEGER[] END"
_KB_LINE = "'[' || doc_id || '] Title of ' || source || chr(10) || text"
_ANSWERED = """
told AS (SELECT item_id, string_split_regex(trim(text, chr(32) || chr(10) || chr(9)), '\\s+') AS w FROM benchmark),
answered AS (SELECT item_id, array_to_string(w[1:4], ' ') AS a, CAST(list_sum(list_transform(w, lambda x: len(x))) % 5 AS INTEGER) AS kind FROM told)"""
_SYSTEM = f"CASE WHEN item_id % 2 = 1 THEN '{W.system}' WHEN item_id % 4 = 0 OR item_id % 4 = 2 THEN '{W.essay_system.replace(W.length, W.bounded_length)}' END"
_RULE = f"CASE WHEN item_id % 2 = 1 THEN '{W.short}' ELSE '{W.bounded_essay}' END"
_Q = f"(SELECT item_id, text, {_KIND_SQL} AS question FROM benchmark)"

_REPORTED = f"""rows AS (
  SELECT item_id AS n, CASE WHEN item_id = 3 THEN 'x' ELSE CAST(item_id AS VARCHAR) END AS id, CASE WHEN item_id % 9 = 0 THEN ' ' WHEN item_id % 7 = 0 THEN '<think>' || text ELSE text END AS answer, item_id % 4 AS kind FROM benchmark),
full_rows AS (SELECT r.*, k.item_id IS NOT NULL AS known, CASE WHEN k.item_id % 11 = 0 THEN 'other' WHEN k.item_id % 7 = 0 THEN '<think>' || k.text ELSE k.text END AS recorded, coalesce(k.item_id % 13 = 0, FALSE) AS cut,
    CASE WHEN k.item_id % 17 <> 0 THEN CASE WHEN k.item_id % 13 = 0 THEN 'length' ELSE 'stop' END END AS finish, {_WORDS.format('answer')} AS words,
    id <> 'x' AND (n % 2 = 0 OR n % 4 = 3) AS essay
  FROM rows r LEFT JOIN (SELECT * FROM benchmark WHERE item_id <> 5) k ON CAST(k.item_id AS VARCHAR) = r.id),
told AS (SELECT n, id, CASE WHEN n % 9 = 0 THEN ['empty answer'] ELSE list_filter([
    CASE WHEN answer IS DISTINCT FROM recorded THEN 'answer differs from records' END, CASE WHEN cut OR coalesce(finish, '') = 'length' THEN 'truncated answer' END, CASE WHEN coalesce(finish, '') <> 'stop' THEN 'unexpected finish_reason' END,
    CASE WHEN contains(answer, '<think>') THEN 'reasoning markers in answer' END,
    CASE WHEN essay AND kind = 0 AND words < 40 THEN words || ' words, minimum 40' WHEN essay AND kind = 2 AND words < 10 THEN words || ' words, minimum 10' END,
    CASE WHEN essay AND kind = 2 AND words > 25 THEN words || ' words, maximum 25' END], lambda m: m IS NOT NULL) END AS m FROM full_rows),
listed AS (
  SELECT -1 AS n, unnest([0, 1, 2, 3]) AS nth, unnest(['Exam hash differs from the run', 'exam_id mismatch', 'Missing, extra, duplicate or reordered IDs', 'Records do not cover the full exam']) AS m
  UNION ALL SELECT n, unnest(range(len(m))), id || ': ' || unnest(m) FROM told)"""

ORACLE_SQL = {
    "exam_scan": f"""SELECT 'exam-1' AS exam_id, item_id AS pos, CAST(item_id AS VARCHAR) AS id, {_KIND_SQL} AS question, CASE WHEN item_id % 5 = 0 THEN 12.0::DOUBLE ELSE 2.0::DOUBLE END AS max_points, sha256(text) AS source_sha256,
  CAST(CASE WHEN item_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_images, CASE WHEN item_id % 3 = 0 THEN 'img/' || item_id || '.png' END AS image FROM benchmark""",
    "corpus_load": f"""WITH a AS (
  SELECT 0 AS part, doc_id, 'timeline' AS kind, source AS title, CASE doc_id % 10 WHEN 4 THEN (1000 + doc_id % 900) || '–1999' WHEN 6 THEN '753 p.n.e.' WHEN 8 THEN 'brak daty' END AS date_text,
    CASE WHEN doc_id % 10 = 4 THEN 1000 + doc_id % 900 END AS lo, CASE WHEN doc_id % 10 = 4 THEN 1999 END AS hi, len({_sql_terms("source || ' ' || text")}) AS n_terms, sha256(text) AS sha256
  FROM documents WHERE doc_id % 10 IN (4, 6, 8)
  UNION ALL SELECT 1, doc_id, 'context', source, '', CASE WHEN doc_id % 3 = 0 THEN 1500 END, CASE WHEN doc_id % 3 = 0 THEN 1500 + doc_id % 400 END, len({_sql_terms("source || ' ' || text || ' ' || lang || ' marked'")}), sha256(text)
  FROM documents WHERE doc_id % 2 = 1)
SELECT row_number() OVER (ORDER BY part, doc_id) - 1 AS doc_index, kind, CAST(doc_id AS VARCHAR) AS id, title, date_text, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, CAST(n_terms AS BIGINT) AS n_terms, sha256 FROM a""",
    "kb_scan": f"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_index, CAST(doc_id AS VARCHAR) AS id, 'Title of ' || source AS title, array_to_string({_sql_terms(_KB_TITLE.format(p=''))}, ' ') AS title_terms,
  array_to_string({_sql_terms(_KB_META.format(p=''))}, ' ') AS meta_terms, CAST(len({_KB_TERMS}) AS BIGINT) AS n_terms, CAST(list_min({_KB_YEARS}) AS BIGINT) AS lo, CAST(list_max({_KB_YEARS}) AS BIGINT) AS hi FROM {_KB_DOCS}""",
    "records_scan": "SELECT CAST(item_id AS VARCHAR) AS id, sha256(text) AS sha256, 'stop' AS finish_reason, CASE WHEN item_id % 2 = 0 THEN item_id * 3 ELSE 0 END AS tokens, CASE WHEN item_id % 2 = 0 THEN item_id ELSE 0 END AS cached FROM benchmark",
    "images_verified": """SELECT CAST(item_id AS VARCHAR) AS id, CAST(nth AS BIGINT) AS nth, CASE nth WHEN 0 THEN 'img/' || item_id || '.gif' ELSE 'lost/' || item_id END AS path, nth = 0 AND item_id % 3 <> 0 AS ok,
  CASE WHEN nth = 0 THEN sha256('data:image/gif;base64,' || base64(encode(text || chr(10)))) END AS url_sha256 FROM benchmark, (SELECT unnest([0, 1]) AS nth)""",
    "file_inventory": """SELECT 'id=' || item_id AS name, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS bytes FROM benchmark UNION ALL SELECT unnest(['absent/file.bin', 'absent/other.bin']), NULL
UNION ALL SELECT 'all', CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) FROM benchmark""",
    "mime_types": "SELECT page_id, ['image/png', 'image/jpeg', 'image/jpeg', 'image/gif', 'image/webp', 'image/bmp', 'image/svg+xml', 'image/tiff', 'image/tiff', 'image/png', 'image/png'][page_id % 11 + 1] AS mime FROM pages",
    "crop_boxes": """WITH s AS (SELECT doc_id, n_chars % 2000 + 1 AS w, n_chars * 7 % 1500 + 1 AS h FROM documents), c AS (SELECT *, (3 * w + 4) // 5 AS x, (3 * h + 4) // 5 AS y FROM s)
SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <= 3 AND least(w, h) >= 500 THEN concat('0,0,', x, ',', y, ' ', w - x, ',0,', w, ',', y, ' 0,', h - y, ',', x, ',', h, ' ', w - x, ',', h - y, ',', w, ',', h) ELSE '' END AS boxes FROM c""",
    "context_essay": f"""WITH RECURSIVE {_sql_scored(years=_DATED)}, {_sql_picked(4000, 0, 1, 18)}, {_PARTS},
whole AS (SELECT k, '{_HEADER}' || string_agg(t, chr(10) || chr(10) ORDER BY no) AS c FROM sections GROUP BY k)
SELECT CAST(k AS VARCHAR) AS id, CAST(length(c) AS BIGINT) AS n_chars, sha256(c) AS sha256 FROM whole""",
    "context_audit": f"""WITH RECURSIVE {_sql_scored(years=_DATED)}, {_sql_picked(4000, 0, 1, 18)},
rows AS (SELECT p.topic_id, count(*) AS n, string_agg(c.doc_id || '|' || c.source || '|' || c.lang, ' ' ORDER BY c.doc_id) AS r FROM (SELECT topic_id, unnest(ids) AS doc_id FROM picked) p JOIN documents c USING (doc_id) GROUP BY p.topic_id)
SELECT CAST(item_id // 2 AS VARCHAR) AS id, item_id % 2 + 1 AS topic_no, sha256(text || CASE WHEN item_id % 2 = 0 AND item_id + 1 IN (SELECT item_id FROM benchmark) THEN chr(10) ELSE '' END) AS topic_sha256,
  CASE WHEN len(t.ys) > 0 THEN list_min(t.ys) || '-' || list_max(t.ys) ELSE '' END AS periods, coalesce(r.n, 0) AS n_records, coalesce(r.r, '') AS records
FROM benchmark b JOIN topics t ON t.topic_id = b.item_id LEFT JOIN rows r ON r.topic_id = b.item_id""",
    "context_short": f"""WITH RECURSIVE {_sql_scored(bonus='0', match='n_common >= 2 AND least_df <= greatest(2, 0.03 * (SELECT count(*) FROM corpus))', line="lang || ' | ' || text", topics=_SHORT_TOPICS, years=_DATED)}, {_sql_picked(1600, 1, 1, 4)},
taken AS (SELECT topic_id, unnest(ids) AS doc_id, unnest(range(len(ids))) AS nth FROM picked),
told AS (SELECT t.topic_id, string_agg(d.lang || ' | ' || d.text, chr(10) ORDER BY nth) AS c, string_agg(d.doc_id || ':' || array_to_string(s.matched, ','), ' ' ORDER BY nth) AS r, round(sum(round(s.score, 4)), 3) AS n
  FROM taken t JOIN documents d USING (doc_id) JOIN scored s ON s.topic_id = t.topic_id AND s.doc_id = t.doc_id GROUP BY t.topic_id)
SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN item_id % 5 = 0 THEN 'image_question_unchanged' WHEN c IS NULL THEN 'no_strong_lexical_match' ELSE 'matched' END AS reason,
  sha256(coalesce('{S.rule}' || chr(10) || c, '')) AS sha256, coalesce(r, '') AS records, coalesce(n, 0.0) AS score_sum FROM benchmark b LEFT JOIN told t ON t.topic_id = b.item_id""",
    "context_kb": f"""WITH RECURSIVE {_sql_scored(weight=_KB_WEIGHT, line=_KB_LINE, topics=_TOPICS_LESS, years=_KB_YEARS, docs=_KB_DOCS, terms=_KB_TERMS)}, {_sql_picked(8500, 2, 2, 5)},
taken AS (SELECT topic_id, unnest(ids) AS doc_id, unnest(range(len(ids))) AS nth FROM picked),
told AS (SELECT t.topic_id, string_agg({_KB_LINE}, chr(10) || chr(10) ORDER BY nth) AS c, string_agg(d.doc_id || ':' || array_to_string(s.matched, ','), ' ' ORDER BY nth) AS r, arg_min(s.score, nth) AS n
  FROM taken t JOIN documents d USING (doc_id) JOIN scored s ON s.topic_id = t.topic_id AND s.doc_id = t.doc_id GROUP BY t.topic_id),
sections AS (SELECT item_id // 2 AS k, item_id % 2 AS no, '{S.heading}' || (item_id % 2 + 1) || ':' || chr(10) || coalesce(c, '{S.nothing}') AS t, concat_ws(' ', coalesce(r, ''), format('{{:.3f}}', n)) AS r FROM benchmark b LEFT JOIN told ON topic_id = item_id)
SELECT CAST(k AS VARCHAR) AS id, sha256('{_HEADER}' || string_agg(t, chr(10) || chr(10) ORDER BY no)) AS sha256, string_agg(r, chr(10) ORDER BY no) AS audit FROM sections GROUP BY k""",
    "prompt_payloads": f"""WITH p AS (SELECT item_id, {_SYSTEM} AS system, '{W.task}' || chr(10) || question AS first,
    concat('{W.sources}', chr(10), text, chr(10), chr(10), '{W.task}', chr(10), question, chr(10), chr(10), '{W.form}', chr(10), 'List', chr(10), chr(10), {_RULE}) AS body, item_id % 6 = 0 AS helped FROM {_Q})
SELECT CAST(item_id AS VARCHAR) AS id, sha256(concat('{{"model":"model","system":', to_json(system), ',"content":[{{"type":"text","text":', to_json(first), '}},{{"type":"text","text":', to_json(body), '}}',
    CASE WHEN helped THEN concat(',{{"type":"text","text":', to_json('{W.help}' || chr(10) || 'help'), '}}') ELSE '' END, '],"temperature":0.0,"top_p":0.95,"top_k":64,"seed":42,"max_tokens":', CASE WHEN item_id % 2 = 0 THEN 3072 ELSE 768 END, '}}')) AS sha256,
  CAST(CASE WHEN helped THEN 2 ELSE 1 END AS BIGINT) AS n_before_last FROM p""",
    "essays_chosen": "SELECT CAST(item_id AS VARCHAR) AS id, CASE item_id % 4 WHEN 0 THEN 'essay' WHEN 1 THEN 'essay' WHEN 2 THEN 'uncertain' ELSE CASE WHEN item_id % 5 = 0 THEN 'uncertain' ELSE 'short' END END AS kind, item_id % 4 = 0 AS essay FROM benchmark",
    "run_rehearsal": "SELECT CAST(item_id AS VARCHAR) AS id, item_id % 4 = 0 AS essay, CASE WHEN item_id % 4 = 0 THEN length(text) + 1 ELSE 0 END AS context_chars, CASE WHEN item_id % 3 = 0 THEN 2 ELSE 0 END AS n_images, item_id % 3 <> 0 OR item_id % 2 = 0 AS ready FROM benchmark",
    "config_compare": "WITH c AS (SELECT sha256(min(text) || max(text)) AS h, 0.0 AS t, NULL::VARCHAR AS r FROM documents) SELECT 'same' AS run, h = h AND t = t AND r IS NOT DISTINCT FROM r AS equal FROM c UNION ALL SELECT 'changed', t = 0.1 FROM c UNION ALL SELECT 'null', r IS NOT DISTINCT FROM 'r1' FROM c",
    "responder_outcomes": f"""WITH {_ANSWERED}
SELECT CASE WHEN kind IN (2, 4) THEN 'ledger' ELSE 'quarantine' END AS side, CAST(item_id AS VARCHAR) AS id, CASE kind WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 3 THEN '<think>' || a ELSE a END AS answer,
  ['error', 'empty', 'ok', 'tags', 'ok'][kind + 1] AS status, kind = 4 AS truncated, CASE WHEN kind = 0 THEN 3000 END AS error_chars FROM answered""",
    "ledger_stream": f"WITH {_ANSWERED} SELECT CAST(item_id AS VARCHAR) AS id, 1 AS n, a AS answer FROM answered WHERE kind IN (2, 4)",
    "plan_then_write": f"""WITH {_ANSWERED}
SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN item_id % 2 = 1 OR kind = 2 THEN 'asked' ELSE ['error', 'empty', '', 'tags', 'ok'][kind + 1] END AS stage,
  CASE WHEN item_id % 2 = 1 THEN sha256('system:write' || chr(10) || 'user:' || text) WHEN kind = 2 THEN sha256('system:write' || chr(10) || 'user:' || text || chr(10) || 'assistant:' || a || chr(10) || 'user:Now write.') END AS sha256,
  CAST(CASE WHEN item_id % 2 = 1 THEN 2 WHEN kind = 2 THEN 4 ELSE 0 END AS BIGINT) AS n, item_id % 2 = 0 AND kind = 2 AS timed FROM answered JOIN benchmark USING (item_id)""",
    "stage_artefacts": f"""WITH {_ANSWERED}, files AS (
  SELECT item_id, '-request.json' AS e, concat('{{"content":', to_json(text), '}}') AS body FROM benchmark UNION ALL SELECT item_id, '-response.json', '{{}}' FROM answered WHERE kind <> 0
  UNION ALL SELECT item_id, '.txt', CASE kind WHEN 1 THEN '' WHEN 3 THEN '<think>' || a ELSE a END FROM answered WHERE kind <> 0)
SELECT 'essay-plan-' || substr(sha256(CAST(item_id AS VARCHAR)), 1, 12) || e AS name, sha256(body) AS sha256 FROM files""",
    "folded_exactly": f"SELECT doc_id, sha256({_sql_fold('text')} || ' ' || [{', '.join(repr(X.plain(w)) for w in DECOMPOSED)}][doc_id % {len(DECOMPOSED)} + 1]) AS sha256 FROM documents",
    "observe_then_answer": f"""SELECT CAST(item_id AS VARCHAR) AS id, CAST(CASE WHEN item_id % 3 <> 0 THEN 1 WHEN item_id % 2 = 1 THEN 3 ELSE 4 END AS BIGINT) AS n, sha256(CASE WHEN item_id % 3 = 0 AND item_id % 2 = 0 THEN concat('NOTES:', chr(10), 'seen 3 {W.image}a.png', chr(10), 'Check them.')
  ELSE concat('{W.sources}', chr(10), text, chr(10), chr(10), '{W.task}', chr(10), 'Q', chr(10), chr(10), '{W.form}', chr(10), '', chr(10), chr(10), CASE WHEN item_id % 2 = 1 THEN '{W.essay}' ELSE '{W.short}' END) END) AS last_sha256 FROM benchmark""",
    "stage_seconds": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round((event_id % 400) / 4.0::DOUBLE + (event_id % 7) / 4.0::DOUBLE, 2) END AS total_seconds FROM events",
    "run_report": f"""WITH {_REPORTED},
errors AS (SELECT list(m ORDER BY n, nth) AS e FROM listed),
warned AS (SELECT coalesce(list(id || ': no explicit word limit parsed; inspect task manually' ORDER BY n), []) AS w FROM full_rows WHERE essay AND kind = 3 AND n % 9 <> 0)
SELECT 'FAIL' AS status, CAST(len(e) AS BIGINT) AS n_errors, CAST(len(w) AS BIGINT) AS n_warnings, array_to_string(e[1:4], chr(10)) AS first_errors, sha256(array_to_string(e, chr(10))) AS errors_sha256, sha256(array_to_string(w, chr(10))) AS warnings_sha256,
  (SELECT count(*) FROM benchmark) AS answer_count, (SELECT string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY CAST(item_id AS VARCHAR)) FROM benchmark WHERE item_id % 2 = 0 OR item_id % 4 = 3) AS essay_ids FROM errors, warned""",
    "images_cropped": """WITH d AS (SELECT CAST(item_id AS VARCHAR) AS id, repeat(sha256(text), 25) AS t FROM benchmark),
boxes(nth, x, y, w) AS (VALUES (0, 0, 0, 500), (1, 0, 0, 300), (2, 200, 0, 300), (3, 0, 200, 300), (4, 200, 200, 300)),
rows AS (SELECT d.id, nth, x, y, w, r, substr(t, (r * 1500 + 3 * x) % 64 + 1, 3 * w) AS line FROM d, boxes, (SELECT unnest(range(500)) AS r) WHERE r >= y AND r < y + w)
SELECT id, CAST(nth AS BIGINT) AS nth, CASE WHEN nth > 0 THEN concat_ws(',', x, y, x + w, y + w) END AS box, sha256(string_agg(line, '' ORDER BY r)) AS sha256, TRUE AS ok FROM rows GROUP BY ALL""",
    "answers_sound": """SELECT 'exam-1' AS exam_id, row_number() OVER (ORDER BY item_id) - 1 AS pos, CAST(item_id AS VARCHAR) AS id, sha256(text) AS sha256, 'PASS' AS status, CAST(0 AS BIGINT) AS n_errors, count(*) OVER () AS answer_count
FROM benchmark WHERE item_id < 40 AND item_id % 3 = 0""",
    "report_written": f"""WITH {_REPORTED}, figures AS (
  SELECT concat('status=FAIL n_errors=', (SELECT count(*) FROM listed), ' answers=', count(*), ' completed=', count(*) FILTER (n % 9 <> 0 AND NOT cut AND coalesce(finish, '') <> 'length' AND recorded IS NOT NULL),
    ' truncated=', count(*) FILTER (cut OR coalesce(finish, '') = 'length'), ' short=', count(*) FILTER (essay AND (kind = 0 AND words < 40 OR kind = 2 AND words < 10))) AS figures FROM full_rows)
SELECT -1 AS pos, nth, NULL AS id, m AS message, figures FROM listed, figures WHERE n = -1
UNION ALL SELECT n, nth, id, m, figures FROM (SELECT n, unnest(range(len(m))) AS nth, id, unnest(m) AS m FROM told), figures""",
    "run_manifest": f"""WITH files AS (SELECT concat(item_id, '.txt') AS name, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM benchmark),
parts AS (SELECT substr(sha256(name), 1, {manifest.DIGITS}) AS part, sha256(string_agg(sha256 || ' ' || name, chr(10) ORDER BY name)) AS s FROM files GROUP BY part),
root AS (SELECT sha256(string_agg(s || ' ' || part, chr(10) ORDER BY part)) AS r FROM parts)
SELECT name, bytes, sha256, r || ' | same | 0.txt (altered) | 0.txt (altered); more.txt (added)' AS told FROM files, root""",
    "answer_warnings": f"""WITH rows AS (SELECT item_id AS n, CASE WHEN item_id = 3 THEN 'x' ELSE CAST(item_id AS VARCHAR) END AS id, item_id <> 3 AND (item_id % 2 = 0 OR item_id % 4 = 3) AS essay, item_id <> 5 AND item_id <> 3 AND item_id % 13 = 0 AS cut,
  {_WORDS.format("CASE WHEN item_id % 9 = 0 THEN ' ' WHEN item_id % 7 = 0 THEN '<think>' || text ELSE text END")} AS words FROM benchmark),
told AS (SELECT id, list_filter([CASE WHEN essay AND n % 4 = 3 THEN 'no explicit word limit parsed; inspect task manually' END, CASE WHEN cut THEN 'token limit reached' END, CASE WHEN essay AND words < 300 THEN 'fewer than 300 words' END], lambda m: m IS NOT NULL) AS m FROM rows)
SELECT id, unnest(range(len(m))) AS nth, unnest(m) AS message FROM told""",
    "ledger_replayed": f"WITH {_ANSWERED} SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN kind IN (2, 4) THEN 'ledger' ELSE 'quarantine' END AS side, CASE kind WHEN 1 THEN '' WHEN 2 THEN a WHEN 3 THEN '<think>' || a WHEN 4 THEN a END AS answer FROM answered",
    "run_stops": f"""WITH {_ANSWERED.replace('% 5', '% 23')}, bad AS (SELECT min(item_id) AS first FROM answered WHERE kind = 0)
SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN kind = 0 THEN 'quarantine' ELSE 'ledger' END AS side, CASE WHEN kind <> 0 THEN a END AS answer, coalesce('item ' || first || ': error', 'whole') AS told
FROM answered, bad WHERE item_id <= coalesce(first, item_id)""",
    "tables_replaced": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 2 = 0",
    "publish_answers": "SELECT item_id AS pos, CAST(item_id AS VARCHAR) AS id, sha256(CASE WHEN item_id % 3 <> 0 THEN text ELSE '' END) AS sha256, '[True, True, False] None' AS told FROM benchmark",
    "request_audits": """SELECT 'essay-request-' || substr(sha256(CAST(item_id AS VARCHAR)), 1, 12) || '.json' AS name, sha256(concat('{"id":"', item_id, '","text":', to_json(text), '}')) AS sha256 FROM benchmark WHERE item_id % 4 IN (0, 2)""",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
