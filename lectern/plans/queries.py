"""The registered queries of the retrieval and batch-answering operators, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions import text as X
from ..operators import infer, ledger, retrieve, validate
from ..operators.bounded import pick_bounded
from ..store import materialize
from . import prompt

#: Roman numbers of the centuries, for topics made of a table's rows.
CENTURIES = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX XXI".split()
#: Questions with limits of many kinds; rows of a table take them in turn, with a number of their own.
QUESTIONS = (
    "Napisz wypracowanie, minimum {n} słów.", "Wybierz jeden temat. 200–{n} słów", "at most {n} words about it", "Podaj dwie cechy.", "Podaj nazwę", "nie więcej niż {n} słów",
    "", "Write an ESSAY of at least {n} words", "choose one: maximum {n} words, min. 120 wyrazów", "{n}-900 wyrazów", "Co najmniej {n} slow",
)
#: Bytes of a table that is dealt out before much is done with it.
SMALL = 64 << 20
ROMANS = ["XI", "XIX", "IV", "XC", "XXI", "MD", "", "xiv", "CXLIX"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(array) -> "F.Column":
    return F.array_join(array, " ")


def _spans(array):
    return F.array_join(F.transform(array, lambda s: F.concat_ws("-", s["lo"], s["hi"])), " ")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out to all cores where they come in few pieces."""
    docs = _table(spark, sf_dir, "documents")
    if int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SMALL:
        return docs.repartition(spark.sparkContext.defaultParallelism)
    return docs


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a corpus: load order by doc_id, the source as title, the language as date; one scan, written once."""
    years = X.let(P.years(F.col("text")), lambda y: F.when(F.size(y) > 0, F.struct(F.array_min(y).alias("lo"), F.array_max(y).alias("hi"))))
    return materialize(_documents(spark, sf_dir).select(
        F.col("doc_id").alias("doc_index"), F.lit("context").alias("kind"), "source", "lang", X.terms(F.col("text")).alias("terms"), years.alias("span"), F.length(_line()).alias("len"),
    ), "corpus")


def _line():
    return F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), F.col("source"), F.lit(" | "), F.col("lang"), F.lit(" | "), F.col("text"))


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "benchmark")
    return rows.select(F.col("item_id").alias("topic_id"), X.terms(F.col("text")).alias("q"), P.periods(F.col("text")).alias("spans"))


def _candidates(spark, sf_dir, **options):
    docs, topics = _corpus(spark, sf_dir), _topics(spark, sf_dir)
    return docs, topics, retrieve.scored(docs, topics, **options)


def terms_per_doc(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", X.terms(F.col("text")).alias("t"))
    docs = materialize(docs, "terms")
    return docs.select("doc_id", F.size("t").cast("long").alias("n_terms"), _joined(F.col("t")).alias("terms"))


def term_document_frequency(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(X.terms(F.col("text")).alias("terms"))
    return retrieve.term_df(materialize(docs, "terms"))


def idf_scores(spark, sf_dir):
    _, _, found = _candidates(spark, sf_dir)
    return found.select(F.col("topic_id").alias("item_id"), F.col("doc_index").alias("doc_id"), "score", F.col("n_common"))


def retrieve_ranked(spark, sf_dir):
    _, _, found = _candidates(spark, sf_dir)
    return retrieve.ranked(found, 10).select(F.col("topic_id").alias("item_id"), F.col("doc_index").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def retrieve_budgeted(spark, sf_dir):
    docs, _, found = _candidates(spark, sf_dir)
    picks = retrieve.pick(found, docs)
    return picks.select(F.col("topic_id").alias("item_id"), _joined(F.col("picked")).alias("picked"), F.size("picked").cast("long").alias("n_picked"), "used")


def retrieve_context_text(spark, sf_dir):
    docs, topics, found = _candidates(spark, sf_dir)
    lines = _table(spark, sf_dir, "documents").withColumn("doc_index", F.col("doc_id"))
    text = retrieve.render(retrieve.pick(found, docs), lines, topics, _line())
    text = text.select(F.col("topic_id").alias("item_id"), F.coalesce("context", F.lit("")).alias("c"))
    return text.select("item_id", F.length("c").cast("long").alias("n_chars"), F.sha2("c", 256).alias("sha256"))


def retrieve_short(spark, sf_dir):
    docs, _, found = _candidates(spark, sf_dir, bonus=0.0, domestic=False)
    found = found.filter((F.col("n_common") >= 2) & (F.col("least_df") <= F.greatest(F.lit(2.0), 0.03 * F.col("n"))))
    picks = retrieve.pick(found, docs, retrieve.SHORT)
    return picks.select(F.col("topic_id").alias("item_id"), _joined(F.col("picked")).alias("picked"), "used")


def retrieve_weighted(spark, sf_dir):
    topics = _topics(spark, sf_dir)
    docs, weight = _by_field(_corpus(spark, sf_dir))
    picks = retrieve.pick(retrieve.scored(docs, topics, weight, domestic=False), docs, retrieve.WEIGHTED)
    return picks.select(F.col("topic_id").alias("item_id"), _joined(F.col("picked")).alias("picked"), "used")


def _by_field(docs: DataFrame):
    docs = docs.withColumns({"title_terms": X.terms(F.concat(F.lit("the "), F.col("source"), F.lit(" that"))), "meta_terms": X.terms(F.concat(F.col("lang"), F.lit("with from")))})
    return docs, F.when(F.array_contains("title_terms", F.col("term")), 3).when(F.array_contains("meta_terms", F.col("term")), 2).otherwise(1)


def retrieve_bounded(spark, sf_dir):
    """The picks of both budgets without scoring what cannot enter them: all terms alike, and weighted by field."""
    docs, topics = _corpus(spark, sf_dir), _topics(spark, sf_dir)
    fielded, weight = _by_field(docs)
    weighed = retrieve.weighted_terms(docs, topics)
    alike, weighted = pick_bounded(docs, topics, weighed=weighed), pick_bounded(fielded, topics, retrieve.WEIGHTED, weight, domestic=False, weighed=weighed)
    shown = lambda rows, name: rows.select(F.lit(name).alias("budget"), F.col("topic_id").alias("item_id"), _joined(F.col("picked")).alias("picked"), "used")
    return shown(alike, "alike").union(shown(weighted, "weighted"))


def retrieve_diverse(spark, sf_dir):
    docs, topics, found = _candidates(spark, sf_dir)
    picks = retrieve.pick_diverse(found, docs, topics)
    return picks.select(F.col("topic_id").alias("item_id"), _joined(F.array_sort("picked")).alias("picked"), F.size("picked").cast("long").alias("n_picked"))


def roman_numerals(spark, sf_dir):
    """The value of all Roman digits of a text, in whatever order they stand."""
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(F.col("text"), "[^IVXLCDMivxlcdm]", "").alias("numeral"))
    return rows.select("item_id", F.length("numeral").cast("long").alias("n_digits"), P.roman(F.col("numeral")).cast("long").alias("value"))


def _century(n) -> "F.Column":
    return F.element_at(F.array(*map(F.lit, CENTURIES)), (n % len(CENTURIES) + 1).cast("int"))


def periods_of_topic(spark, sf_dir):
    """The spans of topics that name centuries, ranges of them, years and decades, by the row's number."""
    n, form = F.col("doc_id"), F.col("doc_id") % 8
    year, later = (1000 + n % 900).cast("string"), (1100 + n % 800).cast("string")
    topic = (
        F.when(form == 0, F.concat(F.lit("Rozwój miast w "), _century(n), F.lit(" wieku")))
        .when(form == 1, F.concat(F.lit("w latach "), year, F.lit("-"), later, F.lit(" i w "), _century(n), F.lit(" w."), F.lit(" oraz 99 i 12345")))
        .when(form == 2, F.concat(_century(n), F.lit("–"), _century(n * 5), F.lit(" wiek")))
        .when(form == 3, F.concat(F.lit("w latach "), (n % 10).cast("string"), F.lit("0. "), _century(n), F.lit(" wieku, rok 1410")))
        .when(form == 4, F.concat(_century(n), F.lit(" wieku i "), _century(n * 3), F.lit(" wieku, "), year))
        .when(form == 5, F.concat(F.lit("rok "), (n % 10_000).cast("string")))
        .when(form == 6, F.concat(F.lit("a"), _century(n), F.lit(" wieku; "), _century(n), F.lit("wieku")))
        .otherwise(F.lit("bez daty"))
    )
    return _table(spark, sf_dir, "documents").select("doc_id", _spans(P.periods(topic)).alias("periods"))


def doc_year_span(spark, sf_dir):
    span = P.doc_span(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", span["lo"].cast("long").alias("lo"), span["hi"].cast("long").alias("hi"))


def period_overlap_join(spark, sf_dir):
    year = F.year("o_orderdate")
    docs = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_index"), F.struct(year.alias("lo"), (year + 1).alias("hi")).alias("span"))
    topics = spark.createDataFrame([(1, "1996"), (2, "1990-1995"), (3, "2001 2005"), (4, "1200")], "topic_id long, topic string")
    met = retrieve.dated_pairs(docs, topics.select("topic_id", P.periods(F.col("topic")).alias("spans")))
    return met.groupBy("topic_id").agg(F.count("*").alias("n_docs"), F.sum("doc_index").alias("key_sum"))


def domestic_union_branch(spark, sf_dir):
    """Topics with and without a domestic stem against timeline rows and notes, some of them dated."""
    n = F.col("doc_id")
    docs = _documents(spark, sf_dir).select(
        n.alias("doc_index"), F.when(n % 2 == 0, "timeline").otherwise("context").alias("kind"),
        X.terms(F.concat("text", F.when(n % 50 == 0, " Polska kultura").when(n % 7 == 0, " rycerstwo").otherwise(""))).alias("terms"),
        P.doc_span(F.concat((900 + n % 700).cast("string"), F.lit(" – "), (910 + n % 700).cast("string"), F.when(n % 11 == 0, " p.n.e.").otherwise(""))).alias("span"),
    )
    docs = materialize(docs.withColumn("span", F.when(F.col("doc_index") % 3 != 0, F.col("span"))), "domestic")
    topics = spark.createDataFrame([(1, "Polska w XI wieku"), (2, "Rycerstwo w roku 1410"), (3, "Rzeczpospolita w XV wieku"), (4, "Polska")], "topic_id long, topic string")
    topics = topics.select("topic_id", X.terms(F.col("topic")).alias("q"), P.periods(F.col("topic")).alias("spans"))
    return retrieve.scored(docs, topics).select("topic_id", "doc_index", F.coalesce("n_common", F.lit(0)).cast("long").alias("n_common"), "score")


def topic_split(spark, sf_dir):
    """Questions with numbered headings of several forms, or none, and text before the first."""
    rows = _table(spark, sf_dir, "pages").select("page_id", "url")
    n = F.col("page_id") % 4
    question = (
        F.when(n == 0, F.concat(F.lit("intro\n1. "), "url", F.lit("\n2) B "), "url")).when(n == 1, F.concat(F.lit("no heading "), "url"))
        .when(n == 2, F.concat(F.lit("Temat 1. "), "url", F.lit("\n  Temat 2) Drugi\nciąg dalszy "), "url")).otherwise(F.concat(F.lit("1. "), "url"))
    )
    rows = rows.select("page_id", F.posexplode(X.topic_parts(question)).alias("nth", "topic"))
    return rows.select("page_id", (F.col("nth") + 1).cast("long").alias("topic_no"), "topic")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' numbers with a question and its points each."""
    n = F.col("doc_id")
    said = F.element_at(F.array(*[F.lit(q) for q in QUESTIONS]), (n % len(QUESTIONS) + 1).cast("int"))
    points = F.when(n % 5 != 0, (n % 15).cast("double"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.replace(said, F.lit("{n}"), (n % 1200).cast("string")).alias("question"), points.alias("max_points"))


def essay_classification(spark, sf_dir):
    return _asked(spark, sf_dir).select("doc_id", X.essay_class(F.col("question"), F.col("max_points")).alias("kind"))


def word_bounds(spark, sf_dir):
    b = X.word_bounds(F.col("question"))
    return _asked(spark, sf_dir).select("doc_id", b["low"].cast("long").alias("low"), b["high"].cast("long").alias("high"))


def word_count(spark, sf_dir):
    one = _table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("t"), X.word_count(F.col("text")).alias("n"))
    two = _table(spark, sf_dir, "documents").select(F.lit("documents").alias("t"), X.word_count(F.col("text")).alias("n"))
    return one.union(two).groupBy("t").agg(F.sum("n").alias("words"), F.max("n").alias("longest"), F.count("*").alias("texts"))


def jaccard_pairs(spark, sf_dir):
    docs = _table(spark, sf_dir, "benchmark").select("item_id", X.terms(F.col("text")).alias("terms"))
    sized = docs.withColumn("n", F.size("terms"))
    one = sized.select(F.col("item_id").alias("a"), F.col("n").alias("n_a"), F.explode("terms").alias("term"))
    two = one.select(F.col("a").alias("b"), F.col("n_a").alias("n_b"), "term")
    shared = one.join(two, "term").filter("a < b").groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("common"))
    union = F.greatest(F.lit(1), F.col("n_a") + F.col("n_b") - F.col("common"))
    return shared.select("a", "b", F.round(F.col("common") / union, 6).alias("jaccard")).filter("jaccard >= 0.02")


def duplicate_ids(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    return ledger.duplicates(rows, "conv_id")


def duplicate_texts(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"))
    return ledger.duplicates(rows, "sha256")


def ledger_resume(spark, sf_dir):
    docs, done = (_table(spark, sf_dir, t).select(F.col("doc_id").alias("id")) for t in ("documents", "labels"))
    return ledger.pending(docs, done).select(F.col("id").alias("doc_id"))


def export_left_join(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"))
    known = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("answer"))
    return ledger.export(docs, known).select("pos", "answer")


def subset_and_setequal_checks(spark, sf_dir):
    docs, labels = (_table(spark, sf_dir, t).select(F.col("doc_id").alias("id")) for t in ("documents", "labels"))
    unknown = ledger.missing(labels, docs).agg(F.count("*").alias("unknown"))
    return ledger.same_sets(docs, labels).crossJoin(unknown)


BROKEN = [
    ("v1", "", "x", False, "stop", False, "q"), ("v2", "one", "two", False, "stop", False, "q"), ("v3", "cut", "cut", True, "length", False, "q"),
    ("v4", "odd", "odd", False, None, False, "q"), ("v5", "<think>hm</think> a", "<think>hm</think> a", False, "stop", False, "q"),
    ("v6", "too short", "too short", False, "stop", True, "minimum 300 słów"), ("v7", "one two three", "one two three", False, "stop", True, "at most 2 words"), ("v8", None, "x", False, "stop", True, "q"),
]
ROWS = "id string, answer string, recorded string, truncated boolean, finish_reason string, essay boolean, question string"


def _answers(spark, sf_dir):
    talk = _table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    key = F.concat_ws("-", "conv_id", "turn")
    rows = talk.select(key.alias("id"), F.col("text").alias("answer"), F.col("text").alias("recorded"), F.lit(False).alias("truncated"), F.lit("stop").alias("finish_reason"), (F.col("turn") == 1).alias("essay"), F.lit("at least 20 words").alias("question"))
    return rows.unionByName(spark.createDataFrame(BROKEN, ROWS))


def validate_answers(spark, sf_dir):
    return validate.row_violations(_answers(spark, sf_dir)).select("id", F.col("nth").cast("long").alias("nth"), "message")


def validation_report(spark, sf_dir):
    rows = _answers(spark, sf_dir)
    return validate.report(validate.row_violations(rows), rows)


def run_usage_totals(spark, sf_dir):
    rows = _table(spark, sf_dir, "events")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("seconds"), F.round(F.max("value"), 6).alias("longest"))


def nested_props(spark, sf_dir):
    k = F.from_json("props", "struct<k: bigint, absent: string>")
    rows = _table(spark, sf_dir, "events").select("event_type", F.coalesce(k["k"], F.lit(0)).alias("k"), F.coalesce(k["absent"], F.lit("")).alias("absent"))
    return rows.groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.max("k").alias("k_most"), F.max("absent").alias("absent"))


def sha256_and_key(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.substring(F.sha2("url", 256), 1, 12).alias("key"))


def data_url_length(spark, sf_dir):
    from ..operators.images import data_url

    rows = _table(spark, sf_dir, "pages")
    return rows.select("page_id", F.length(data_url(F.encode("html", "utf-8"), F.lit("picture.png"))).cast("long").alias("n_chars"))


def unpivot_parts(spark, sf_dir):
    talk = _table(spark, sf_dir, "conversations")
    found = prompt.parts(F.col("text"), F.col("role"), F.lit(""), F.col("turn") == 0, F.lit("help"))
    rows = talk.select("conv_id", "turn", F.posexplode(found).alias("nth", "part"))
    return rows.select("conv_id", "turn", F.col("nth").cast("long").alias("nth"), F.length("part.text").cast("long").alias("n_chars"))


def _echo(payloads):
    return [{"answer": " ".join(p["content"].split()[:5]), "finish_reason": "stop"} for p in payloads]


def responder_batch(spark, sf_dir):
    rows = _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.to_json(F.struct(F.col("text").alias("content"))).alias("payload"))
    return infer.respond(rows, _echo, 4).select("id", "answer", "status", "word_count", "truncated")


# --- DuckDB ---

_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def _sql_fold(text: str) -> str:
    return f"strip_accents(replace(lower({text}), 'ł', 'l'))"


def _sql_terms(text: str) -> str:
    words = f"regexp_extract_all({_sql_fold(text)}, '[a-z]{{4,}}')"
    return f"list_sort(list_distinct(list_transform(list_filter({words}, lambda w: NOT list_contains([{_STOP}], w)), lambda w: w[1:5])))"


def _sql_years(text: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all({text}, '[0-9]+'), lambda y: len(y) BETWEEN 3 AND 4), lambda y: CAST(y AS INTEGER))"


def _values(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(show, row)) + ")" for row in rows)


_LINE = "'[' || doc_id || '] ' || source || ' | ' || lang || ' | ' || text"
_TOPIC_SQL = f"SELECT item_id AS topic_id, {_sql_terms('text')} AS q, {_sql_years('text')} AS ys FROM benchmark"


def _sql_scored(bonus: str = "2", weight: str = "1", match: str = "TRUE", line: str = _LINE, topics: str = _TOPIC_SQL, years: str = _sql_years("text"), docs: str = "documents", terms: str = _sql_terms("text")) -> str:
    """Common table expressions up to ``scored`` (topic_id, doc_id, len, n_common, score); topics have no domestic stems here."""
    return f"""
corpus AS MATERIALIZED (SELECT doc_id, source, lang, text, {terms} AS terms, {years} AS ys, length({line}) AS len FROM {docs}),
topics AS MATERIALIZED ({topics}),
held AS (SELECT doc_id, source, lang, unnest(terms) AS term FROM corpus),
often AS (SELECT term, count(*) AS df FROM held GROUP BY term),
asked AS (SELECT topic_id, unnest(q) AS term FROM topics),
weighed AS (SELECT topic_id, term, df, ln(1 + (SELECT count(*) FROM corpus) / (1 + df)::DOUBLE) AS idf FROM asked JOIN often USING (term)),
base AS (
  SELECT a.topic_id, h.doc_id, sum(a.idf * {weight}) AS base, count(*) AS n_common, min(a.df) AS least_df, list_sort(list(h.term)) AS matched
  FROM weighed a JOIN held h USING (term) GROUP BY ALL),
met AS (
  SELECT b.*, c.len, c.source, c.lang, len(c.ys) > 0 AS dated, len(t.ys) > 0 AS asks,
         coalesce(list_min(c.ys) <= list_max(t.ys) AND list_max(c.ys) >= list_min(t.ys), FALSE) AS meets
  FROM base b JOIN corpus c USING (doc_id) JOIN topics t USING (topic_id)),
scored AS (
  SELECT topic_id, doc_id, len, n_common, matched, round(base + CASE WHEN meets THEN {bonus} ELSE 0 END, 6) AS score
  FROM met WHERE NOT (asks AND dated AND NOT meets) AND {match})"""


def _sql_picked(chars: int, in_test: int, in_sum: int, lines: int) -> str:
    """Common table expressions ``folded`` and ``picked`` (topic_id, ids, used) after ``scored``."""
    return f"""
ranked AS MATERIALIZED (
  SELECT topic_id, doc_id, len, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id) AS rn
  FROM scored WHERE len + {in_test} <= {chars}),
folded AS (
  SELECT topic_id, 0::BIGINT AS rn, 0::BIGINT AS used, []::BIGINT[] AS ids FROM (SELECT DISTINCT topic_id FROM ranked)
  UNION ALL
  SELECT f.topic_id, r.rn, CASE WHEN f.used + r.len + {in_test} <= {chars} AND len(f.ids) < {lines} THEN f.used + r.len + {in_sum} ELSE f.used END,
         CASE WHEN f.used + r.len + {in_test} <= {chars} AND len(f.ids) < {lines} THEN list_append(f.ids, r.doc_id) ELSE f.ids END
  FROM folded f JOIN ranked r ON r.topic_id = f.topic_id AND r.rn = f.rn + 1),
picked AS (SELECT topic_id, max_by(ids, rn) AS ids, max_by(used, rn) AS used FROM folded GROUP BY topic_id)"""


_FOLDED = _sql_fold("coalesce(question, '')")
_Q = "(SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 15)::DOUBLE END AS max_points, replace([{}][doc_id % {} + 1], '{{n}}', CAST(doc_id % 1200 AS VARCHAR)) AS question FROM documents)".format(", ".join(f"'{q}'" for q in QUESTIONS), len(QUESTIONS))
_HUNDRED = "(({}) % 21) * 100 + 1 || '-' || ((({}) % 21) + 1) * 100"
_UNIT = r"\s*(?:slow|wyraz|words)"
_ANSWERS = f"""
SELECT conv_id || '-' || turn AS id, text AS answer, text AS recorded, FALSE AS truncated, 'stop' AS finish_reason, turn = 1 AS essay, 20 AS low, NULL::INTEGER AS high
FROM conversations WHERE role = 'assistant'
UNION ALL SELECT id, answer, recorded, truncated, finish_reason, essay, CASE WHEN id = 'v6' THEN 300 END, CASE WHEN id = 'v7' THEN 2 END
FROM ({_values(BROKEN)}) t(id, answer, recorded, truncated, finish_reason, essay, question)"""
_VIOLATIONS = rf"""
WITH rows AS (SELECT *, len(regexp_extract_all(coalesce(answer, ''), '[^\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+')) AS n FROM ({_ANSWERS})),
told AS (
  SELECT id, CASE WHEN n = 0 THEN ['empty answer'] ELSE list_filter([
    CASE WHEN answer IS DISTINCT FROM recorded THEN 'answer differs from records' END,
    CASE WHEN coalesce(truncated, FALSE) OR coalesce(finish_reason, '') = 'length' THEN 'truncated answer' END,
    CASE WHEN coalesce(finish_reason, '') <> 'stop' THEN 'unexpected finish_reason' END,
    CASE WHEN contains(answer, '<think>') OR contains(answer, '</think>') OR contains(answer, '<|channel>') OR contains(answer, '<channel|>') THEN 'reasoning markers in answer' END,
    CASE WHEN essay AND n < low THEN n || ' words, minimum ' || low END,
    CASE WHEN essay AND n > high THEN n || ' words, maximum ' || high END], lambda m: m IS NOT NULL) END AS m FROM rows),
violations AS (SELECT id, unnest(range(len(m))) AS nth, unnest(m) AS message FROM told)"""

_FIELDS = f"CASE WHEN list_contains({_sql_terms("'the ' || h.source || ' that'")}, h.term) THEN 3 WHEN list_contains({_sql_terms("h.lang || 'with from'")}, h.term) THEN 2 ELSE 1 END"

ORACLE_SQL = {
    "terms_per_doc": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, array_to_string(t, ' ') AS terms FROM (SELECT doc_id, {_sql_terms('text')} AS t FROM documents)",
    "term_document_frequency": f"SELECT term, count(*) AS df FROM (SELECT unnest({_sql_terms('text')}) AS term FROM documents) GROUP BY term",
    "idf_scores": f"WITH {_sql_scored()} SELECT topic_id AS item_id, doc_id, score, n_common FROM scored",
    "retrieve_ranked": f"WITH {_sql_scored()} SELECT item_id, doc_id, score, rank FROM (SELECT topic_id AS item_id, doc_id, score, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10",
    "retrieve_budgeted": f"WITH RECURSIVE {_sql_scored()}, {_sql_picked(4000, 0, 1, 18)} SELECT topic_id AS item_id, array_to_string(ids, ' ') AS picked, CAST(len(ids) AS BIGINT) AS n_picked, used FROM picked",
    "retrieve_context_text": f"""WITH RECURSIVE {_sql_scored()}, {_sql_picked(4000, 0, 1, 18)},
lines AS (SELECT p.topic_id, string_agg('[' || c.doc_id || '] ' || c.source || ' | ' || c.lang || ' | ' || c.text, chr(10) ORDER BY c.doc_id) AS c
  FROM (SELECT topic_id, unnest(ids) AS doc_id FROM picked) p JOIN documents c USING (doc_id) GROUP BY p.topic_id)
SELECT b.item_id, CAST(length(coalesce(l.c, '')) AS BIGINT) AS n_chars, sha256(coalesce(l.c, '')) AS sha256 FROM benchmark b LEFT JOIN lines l ON l.topic_id = b.item_id""",
    "retrieve_short": f"WITH RECURSIVE {_sql_scored(bonus='0', match='n_common >= 2 AND least_df <= greatest(2, 0.03 * (SELECT count(*) FROM corpus))')}, {_sql_picked(1600, 1, 1, 4)} SELECT topic_id AS item_id, array_to_string(ids, ' ') AS picked, used FROM picked",
    "retrieve_weighted": f"WITH RECURSIVE {_sql_scored(weight=_FIELDS)}, {_sql_picked(8500, 2, 2, 5)} SELECT topic_id AS item_id, array_to_string(ids, ' ') AS picked, used FROM picked",
    "retrieve_bounded": f"""SELECT 'alike' AS budget, * FROM (WITH RECURSIVE {_sql_scored()}, {_sql_picked(4000, 0, 1, 18)} SELECT topic_id AS item_id, array_to_string(ids, ' ') AS picked, used FROM picked)
UNION ALL SELECT 'weighted', * FROM (WITH RECURSIVE {_sql_scored(weight=_FIELDS)}, {_sql_picked(8500, 2, 2, 5)} SELECT topic_id AS item_id, array_to_string(ids, ' ') AS picked, used FROM picked)""",
    "retrieve_diverse": f"""WITH RECURSIVE {_sql_scored()},
rivals AS MATERIALIZED (
  SELECT s.topic_id, s.doc_id, s.len, s.score, s.matched, c.terms FROM scored s JOIN corpus c USING (doc_id) WHERE s.len + 1 <= 4000),
worth AS MATERIALIZED (SELECT topic_id, map_from_entries(list((term, idf))) AS idf FROM weighed GROUP BY topic_id),
steps AS (
  SELECT topic_id, 0 AS n, 0::BIGINT AS used, []::BIGINT[] AS ids, []::VARCHAR[] AS covered, []::VARCHAR[][] AS chosen FROM (SELECT DISTINCT topic_id FROM rivals)
  UNION ALL
  SELECT topic_id, n + 1, used + best.len + 1, list_append(ids, best.doc_id), list_concat(covered, best.matched), list_append(chosen, best.terms)
  FROM (
    SELECT s.topic_id, any_value(s.n) AS n, any_value(s.used) AS used, any_value(s.ids) AS ids, any_value(s.covered) AS covered, any_value(s.chosen) AS chosen,
      max(struct_pack(
        u := round(r.score + coalesce(list_sum(list_transform(list_filter(r.matched, lambda t: NOT list_contains(s.covered, t)), lambda t: w.idf[t])), 0)
          - 3 * coalesce(list_max(list_transform(s.chosen, lambda c: len(list_intersect(c, r.terms)) / greatest(1, len(c) + len(r.terms) - len(list_intersect(c, r.terms)))::DOUBLE)), 0), 6),
        d := -r.doc_id, doc_id := r.doc_id, len := r.len, matched := r.matched, terms := r.terms)) AS best
    FROM steps s JOIN rivals r USING (topic_id) JOIN worth w USING (topic_id)
    WHERE s.n < 18 AND NOT list_contains(s.ids, r.doc_id) AND s.used + r.len + 1 <= 4000 GROUP BY s.topic_id))
SELECT topic_id AS item_id, array_to_string(list_sort(arg_max(ids, n)), ' ') AS picked, CAST(max(n) AS BIGINT) AS n_picked FROM steps GROUP BY topic_id""",
    "roman_numerals": """WITH d AS (SELECT item_id, list_transform(string_split(upper(regexp_replace(text, '[^IVXLCDMivxlcdm]', '', 'g')), ''), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 ELSE 0 END) AS v,
  length(regexp_replace(text, '[^IVXLCDMivxlcdm]', '', 'g')) AS n FROM benchmark)
SELECT item_id, n AS n_digits, CAST(list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN v[i] < coalesce(list_max(v[i + 1:]), 0) THEN -v[i] ELSE v[i] END)) AS BIGINT) AS value FROM d""",
    "periods_of_topic": f"""WITH d AS (SELECT doc_id, doc_id AS n, 1000 + doc_id % 900 AS y, 1100 + doc_id % 800 AS z FROM documents)
SELECT doc_id, CASE n % 8 WHEN 0 THEN {_HUNDRED.format('n', 'n')} WHEN 1 THEN {_HUNDRED.format('n', 'n')} || ' ' || least(y, z) || '-' || greatest(y, z)
  WHEN 2 THEN CASE WHEN n % 21 <= n * 5 % 21 THEN (n % 21) * 100 + 1 || '-' || (n * 5 % 21 + 1) * 100 ELSE '' END
  WHEN 3 THEN (n % 21) * 100 + (n % 10) * 10 || '-' || (n % 21) * 100 + (n % 10) * 10 + 9
  WHEN 4 THEN {_HUNDRED.format('n', 'n')} || ' ' || {_HUNDRED.format('n * 3', 'n * 3')} || ' ' || y || '-' || y
  WHEN 5 THEN CASE WHEN n % 10000 BETWEEN 100 AND 9999 THEN n % 10000 || '-' || n % 10000 ELSE '' END
  WHEN 6 THEN {_HUNDRED.format('n', 'n')} ELSE '' END AS periods FROM d""",
    "doc_year_span": f"""SELECT doc_id, CAST(CASE WHEN NOT contains(text, '{P.BCE}') THEN list_min(y) END AS BIGINT) AS lo, CAST(CASE WHEN NOT contains(text, '{P.BCE}') THEN list_max(y) END AS BIGINT) AS hi
FROM (SELECT doc_id, text, {_sql_years('text')} AS y FROM documents)""",
    "period_overlap_join": """SELECT t.id AS topic_id, count(*) AS n_docs, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM orders o JOIN (VALUES (1, 1996, 1996), (2, 1990, 1995), (3, 2001, 2005), (4, 1200, 1200)) t(id, lo, hi) ON year(o_orderdate) <= t.hi AND year(o_orderdate) + 1 >= t.lo GROUP BY t.id""",
    "domestic_union_branch": f"""WITH docs AS (SELECT doc_id, doc_id % 2 = 0 AS timeline, {_sql_terms("text || CASE WHEN doc_id % 50 = 0 THEN ' Polska kultura' WHEN doc_id % 7 = 0 THEN ' rycerstwo' ELSE '' END")} AS terms,
    CASE WHEN doc_id % 3 <> 0 AND doc_id % 11 <> 0 THEN least(900 + doc_id % 700, 910 + doc_id % 700) END AS lo, CASE WHEN doc_id % 3 <> 0 AND doc_id % 11 <> 0 THEN 910 + doc_id % 700 END AS hi FROM documents),
topics(topic_id, q, a, b, home) AS (VALUES (1, ['polsk'], 1001, 1100, TRUE), (2, ['rycer', 'roku'], 1410, 1410, FALSE), (3, ['rzecz'], 1401, 1500, TRUE), (4, ['polsk'], NULL, NULL, TRUE)),
often AS (SELECT t.term, count(*) AS df FROM (SELECT unnest(terms) AS term FROM docs) t GROUP BY t.term),
base AS (SELECT topic_id, doc_id, sum(ln(1 + (SELECT count(*) FROM docs) / (1 + df)::DOUBLE)) AS base, count(*) AS n FROM (SELECT topic_id, unnest(q) AS term FROM topics) x JOIN (SELECT doc_id, unnest(terms) AS term FROM docs) y USING (term) JOIN often USING (term) GROUP BY ALL),
pairs AS (SELECT t.topic_id, d.doc_id, t.a, t.home, d.timeline, d.lo, coalesce(d.lo <= t.b AND d.hi >= t.a, FALSE) AS meets, b.base, b.n FROM topics t CROSS JOIN docs d LEFT JOIN base b ON b.topic_id = t.topic_id AND b.doc_id = d.doc_id)
SELECT topic_id, doc_id AS doc_index, coalesce(n, 0) AS n_common, round(coalesce(base, 0.0) + CASE WHEN meets THEN 2 ELSE 0 END, 6) AS score FROM pairs
WHERE (n IS NOT NULL OR home AND meets AND timeline) AND NOT (a IS NOT NULL AND lo IS NOT NULL AND NOT meets)""",
    "topic_split": """SELECT page_id, 1 AS topic_no, CASE page_id % 4 WHEN 1 THEN 'no heading ' || url WHEN 3 THEN url ELSE url || chr(10) END AS topic FROM pages
UNION ALL SELECT page_id, 2, CASE page_id % 4 WHEN 0 THEN 'B ' || url ELSE 'Drugi' || chr(10) || 'ciąg dalszy ' || url END FROM pages WHERE page_id % 4 IN (0, 2)""",
    "essay_classification": rf"""SELECT doc_id, CASE WHEN regexp_matches(f, 'wypracowan|\besej|\bessay') OR (regexp_matches(f, '\b\d{{3,4}}{_UNIT}') AND regexp_matches(f, 'wybierz\s+jeden|choose\s+one')) THEN 'essay'
  WHEN regexp_matches(f, '\b\d{{3,4}}{_UNIT}') OR coalesce(max_points >= 10, FALSE) THEN 'uncertain' ELSE 'short' END AS kind FROM (SELECT doc_id, max_points, {_FOLDED} AS f FROM {_Q})""",
    "word_bounds": rf"""SELECT doc_id, coalesce(TRY_CAST(nullif(regexp_extract(f, '(?:minimum|co najmniej|at least|min\.)\s*(\d+){_UNIT}', 1), '') AS BIGINT), TRY_CAST(nullif(regexp_extract(f, '\b(\d+)\s*[-–]\s*(\d+){_UNIT}', 1), '') AS BIGINT)) AS low,
  coalesce(TRY_CAST(nullif(regexp_extract(f, '(?:maksymalnie|maksimum|nie wiecej niz|at most|maximum)\s*(\d+){_UNIT}', 1), '') AS BIGINT), TRY_CAST(nullif(regexp_extract(f, '\b(\d+)\s*[-–]\s*(\d+){_UNIT}', 2), '') AS BIGINT)) AS high
FROM (SELECT doc_id, {_FOLDED} AS f FROM {_Q})""",
    "word_count": r"""WITH n AS (SELECT 'conversations' AS t, len(regexp_extract_all(text, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) AS n FROM conversations
  UNION ALL SELECT 'documents', len(regexp_extract_all(text, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) FROM documents)
SELECT t, CAST(sum(n) AS BIGINT) AS words, CAST(max(n) AS BIGINT) AS longest, count(*) AS texts FROM n GROUP BY t""",
    "jaccard_pairs": f"""WITH s AS (SELECT item_id, {_sql_terms('text')} AS t FROM benchmark),
p AS (SELECT x.item_id AS a, y.item_id AS b, round(len(list_intersect(x.t, y.t)) / greatest(1, len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)))::DOUBLE, 6) AS jaccard FROM s x JOIN s y ON x.item_id < y.item_id)
SELECT a, b, jaccard FROM p WHERE jaccard >= 0.02""",
    "duplicate_ids": "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1",
    "duplicate_texts": "SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
    "ledger_resume": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "export_left_join": "SELECT d.doc_id AS pos, coalesce(CAST(l.quality AS VARCHAR), '') AS answer FROM documents d LEFT JOIN labels l USING (doc_id)",
    "subset_and_setequal_checks": """WITH l AS (SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), r AS (SELECT count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
SELECT l.n AS only_left, r.n AS only_right, l.n = 0 AND r.n = 0 AS equal, r.n AS unknown FROM l, r""",
    "validate_answers": f"{_VIOLATIONS} SELECT id, nth, message FROM violations",
    "validation_report": f"{_VIOLATIONS} SELECT CASE WHEN (SELECT count(*) FROM violations) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, (SELECT count(*) FROM violations) AS n_errors, count(*) AS answer_count FROM rows",
    "run_usage_totals": "SELECT event_type, count(*) AS n, round(sum(coalesce(value, 0)), 4) AS seconds, round(max(value), 6) AS longest FROM events GROUP BY event_type",
    "nested_props": "SELECT event_type, CAST(sum(coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS k_sum, max(coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0)) AS k_most, max(coalesce(json_extract_string(props, '$.absent'), '')) AS absent FROM events GROUP BY event_type",
    "sha256_and_key": "SELECT page_id, sha256(html) AS sha256, substr(sha256(url), 1, 12) AS key FROM pages",
    "data_url_length": "SELECT page_id, CAST(length('data:image/png;base64,') + length(base64(encode(html))) AS BIGINT) AS n_chars FROM pages",
    "responder_batch": """WITH w AS (SELECT item_id, string_split_regex(trim(text, chr(32) || chr(10) || chr(9)), '\\s+') AS w FROM benchmark)
SELECT CAST(item_id AS VARCHAR) AS id, array_to_string(w[1:5], ' ') AS answer, 'ok' AS status, CAST(least(len(w), 5) AS BIGINT) AS word_count, FALSE AS truncated FROM w""",
    "unpivot_parts": f"""WITH w AS (SELECT conv_id, turn, length(concat('{prompt.Wording.sources}', chr(10), role, chr(10), chr(10), '{prompt.Wording.task}', chr(10), text, chr(10), chr(10), '{prompt.Wording.form}', chr(10), '', chr(10), chr(10),
  CASE WHEN turn = 0 THEN '{prompt.Wording.essay}' ELSE '{prompt.Wording.short}' END)) AS n FROM conversations)
SELECT conv_id, turn, CAST(0 AS BIGINT) AS nth, n AS n_chars FROM w UNION ALL SELECT conv_id, turn, 1, length(concat('{prompt.Wording.help}', chr(10), 'help')) FROM w WHERE turn = 0""",
}
QUERIES = {
    f.__name__: f
    for f in (
        terms_per_doc, term_document_frequency, idf_scores, retrieve_ranked, retrieve_budgeted, retrieve_context_text, retrieve_short, retrieve_weighted, retrieve_bounded, retrieve_diverse,
        roman_numerals, periods_of_topic, doc_year_span, period_overlap_join, domestic_union_branch, topic_split, essay_classification, word_bounds, word_count, jaccard_pairs,
        duplicate_ids, duplicate_texts, ledger_resume, export_left_join, subset_and_setequal_checks, validate_answers, validation_report, run_usage_totals, nested_props,
        sha256_and_key, data_url_length, unpivot_parts, responder_batch,
    )
}
