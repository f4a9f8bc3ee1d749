"""Operator 9: personal data by bootstrapped contextual extraction, by DataFrame operations only.

Well-formed e-mail addresses, IP addresses, payment cards and phone numbers are
the seeds, and, for secrets, long hexadecimal strings.  The words before a seed
are a lexical pattern.  Patterns and the identifier-like strings that they
stand before form a bipartite graph, which is scored in rounds: a pattern's
confidence is the mean score of its distinct instances, an instance's score the
chance that one of its trusted patterns is right.  Strings that a trusted
pattern introduces are added: keys that a cue names, and identifiers of no
known form.  A hexadecimal string that no trusted pattern introduces is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, materialize

KINDS = ("email", "ip", "card", "phone")
#: The kind that only the method finds, and its seeds: long hexadecimal strings with letters and digits.
SECRET = "secret"
SECRET_SEED = r"^(?=.*[0-9])(?=.*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"
#: The given forms, written so that a search is linear: a run is entered at its start only, and never re-read.
_LOCAL = r"[A-Za-z0-9._%+-]"
FORMS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_S = r"\x20\x09-\x0D"
#: A word that holds a digit or an at sign: what a pattern may introduce.
TOKEN = rf"(?<![^{_S}])[^{_S}0-9@]*+[0-9@][^{_S}]*+"
ROUNDS = 3
#: A pattern is trusted at this confidence if so many distinct seeds support it; fewer with a cue (``:``, ``=``, ``#``).
CONFIDENCE, SUPPORT, CUED_SUPPORT = 0.8, 8, 3
#: Digits that an added string has at least, unless it has an at sign.
LEAST_DIGITS = 5


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    n = F.length(_digits(match))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", F.forall(parts, lambda p: F.when(F.length(p) > 3, False).otherwise(p.try_cast("int") <= 255)))
        .when(kind == "card", luhn(_digits(match)))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(False)
    )


def _matches(docs: DataFrame) -> DataFrame:
    """Every match of every form: doc_id, copy, kind, start, end, match, and before, the two words that precede it."""
    docs = docs.filter(F.col("text").rlike("[0-9@]"))
    forms = [
        F.struct(F.lit(kind).alias("kind"), F.split("text", form, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(form), F.lit(0)).alias("found"))
        for kind, form in (*FORMS.items(), ("token", TOKEN))
    ]
    rows = docs.select("doc_id", F.xxhash64("text").alias("copy"), F.explode(F.array(*forms)).alias("f")).filter(F.size("f.found") > 0)
    # the arrays are a column of their own, which is not copied into every row that comes of them
    rows = rows.select("doc_id", "copy", F.col("f.kind").alias("kind"), F.arrays_zip(F.col("f.gaps").alias("gap"), F.col("f.found").alias("match")).alias("zipped"))
    rows = rows.select("doc_id", "copy", "kind", F.posexplode("zipped").alias("nth", "x")).filter("x.match is not null")
    # read from its end, a gap gives its last two words without a look at the rest
    tail = F.regexp_extract(F.reverse("x.gap"), rf"^[{_S}]*+([^{_S}]++(?:[{_S}]++[^{_S}]++)?)", 1)
    words = F.filter(F.split(F.regexp_replace(F.lower(F.reverse(tail)), "[0-9]+", "0"), rf"[{_S}]+"), lambda w: w != "")
    rows = rows.select("doc_id", "copy", "kind", "nth", F.length("x.gap").alias("gap"), "x.match", words.alias("before"))
    rows = materialize(rows.dropDuplicates(["doc_id", "copy", "kind", "nth"]), "matches")
    turn = Window.partitionBy("doc_id", "copy", "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.length("match")).over(turn)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match")).drop("gap", "nth")


def _patterns(before: Column) -> Column:
    """The patterns that words give: the last word if it is a cue, and the last two."""
    last = F.try_element_at(before, F.lit(-1))
    cue = F.when(last.rlike("[^:=#].*[:=#]$"), F.concat(F.lit("1 "), last))
    two = F.when(F.size(before) == 2, F.concat(F.lit("2 "), F.array_join(before, " ")))
    return F.array_compact(F.array(cue, two))


def _spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Trusted patterns (pattern, kind, confidence) after the rounds of scoring.

    ``edges`` has the distinct pairs of pattern and value, ``seeds`` the kind
    of known values.  A value's or a pattern's edges meet only in combining
    aggregates, so frequent ones gather nowhere.
    """
    fillers = edges.groupBy("pattern").agg(F.count("*").alias("fillers"))
    scores = seeds.select("value", "kind", F.lit(1.0).alias("score"))
    trusted = None
    for _ in range(ROUNDS):
        scored = edges.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count("*").alias("support"))
        scored = scored.join(fillers, "pattern").withColumn("confidence", F.col("mass") / F.col("fillers"))
        least = F.when(F.col("pattern").rlike("[:=#]$"), CUED_SUPPORT).otherwise(SUPPORT)
        now = materialize(scored.filter((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= least)).select("pattern", "kind", "confidence"), "trusted")
        if trusted is not None:
            drop(trusted)
        trusted = now
        doubt = F.sum(F.log(F.greatest(F.lit(1.0) - F.col("confidence"), F.lit(1e-9))))
        found = edges.join(trusted, "pattern").groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("score"))
        scores = seeds.select("value", "kind", F.lit(1.0).alias("score")).unionByName(found).groupBy("value", "kind").agg(F.max("score").alias("score"))
    return trusted


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, copy (a hash of the text), kind, start, end, base: all personal data of ``docs``.

    Offsets are code points, the end exclusive.  ``base`` tells the well-formed
    ones; the others stand after a trusted pattern, are not part of anything
    that has a form, valid or not, and have digits enough or an at sign.
    Repeated rows of a document give one set of spans; null and empty texts
    none.  A row without doc_id is found under its text's hash.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(_matches(docs), "spans")
    formed = rows.filter("kind <> 'token'")
    base = formed.filter(_valid(F.col("kind"), F.col("match")))
    tokens = rows.filter("kind = 'token'").withColumn("value", F.regexp_extract("match", r"[A-Za-z0-9+](?:.*[A-Za-z0-9])?", 0))
    tokens = tokens.filter("value like '%@%' or length({}) >= {}".format("regexp_replace(value, '[^0-9]', '')", LEAST_DIGITS))
    tokens = tokens.withColumn("start", F.col("start") + F.instr("match", F.col("value")) - 1).withColumn("end", F.col("start") + F.length("value"))
    other = formed.select(F.col("doc_id").alias("d"), F.col("copy").alias("c"), F.col("start").alias("s"), F.col("end").alias("e"))
    free = tokens.join(other, tokens["doc_id"].eqNullSafe(other["d"]) & (F.col("copy") == F.col("c")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left_anti")
    free = materialize(free.select("doc_id", "copy", "start", "end", "value", F.explode(_patterns(F.col("before"))).alias("pattern")), "free")
    secrets = free.filter(F.col("value").rlike(SECRET_SEED)).select("value", F.lit(SECRET).alias("kind"))
    seeds = base.select(F.col("match").alias("value"), "kind").union(secrets).distinct()
    known = base.select(F.explode(_patterns(F.col("before"))).alias("pattern"), F.col("match").alias("value"))
    edges = materialize(known.unionByName(free.select("pattern", "value")).distinct(), "graph")
    trusted = _spread(edges, seeds)
    best = trusted.groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("b")).select("pattern", "b.kind")
    added = free.join(best, "pattern").select("doc_id", "copy", "kind", "start", "end", F.lit(False).alias("base")).distinct()
    return base.select("doc_id", "copy", "kind", "start", "end", F.lit(True).alias("base")).unionByName(added)


def pii_summary(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of base spans, their digest, all spans and their number.

    The order of spans is by kind as in ``KINDS``, secrets last, then start.
    """
    spans = find_spans(docs)
    rank = F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), F.col("kind"))
    spans = spans.withColumn("x", F.struct(rank.alias("rank"), "start", "end", "kind"))
    shown = lambda xs: F.array_join(F.transform(F.array_sort(xs), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    found = spans.groupBy(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")).agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS],
        F.collect_list(F.when(F.col("base"), F.col("x"))).alias("base_spans"),
        F.collect_list("x").alias("all_spans"),
    )
    found = found.select("_id", "_copy", *[f"n_{k}" for k in KINDS], shown(F.col("base_spans")).alias("base_shown"), shown(F.col("all_spans")).alias("shown"), F.size("all_spans").cast("long").alias("n_spans"))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")), "left")
    return rows.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base_shown", F.lit("")), 256).alias("base_sha256"), F.coalesce("shown", F.lit("")).alias("spans"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
    )


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of all ``documents``."""
    return pii_summary(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql_spread(n: int) -> str:
    """One round of scoring, from ``scores{n}`` to ``trusted{n}`` and ``scores{n + 1}``."""
    return f"""
trusted{n} AS (
  SELECT pattern, kind, confidence FROM (
    SELECT pattern, kind, sum(score) / any_value(fillers) AS confidence, count(*) AS support FROM edges JOIN scores{n} USING (value) JOIN fillers USING (pattern) GROUP BY pattern, kind)
  WHERE confidence >= {CONFIDENCE} AND support >= CASE WHEN regexp_matches(pattern, '[:=#]$') THEN {CUED_SUPPORT} ELSE {SUPPORT} END),
scores{n + 1} AS (
  SELECT value, kind, max(score) AS score FROM (
    SELECT value, kind, 1.0::DOUBLE AS score FROM seeds
    UNION ALL SELECT value, kind, 1 - exp(sum(ln(greatest(1 - confidence, 1e-9)))) FROM edges JOIN trusted{n} USING (pattern) GROUP BY value, kind) GROUP BY value, kind)"""


_SQL_FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "token": rf"[^{_S}]*[0-9@][^{_S}]*",
}
_SQL_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, unnest(m) AS s, unnest(g[1:len(m)]) AS gap, unnest(range(len(m))) AS nth FROM (SELECT doc_id, regexp_extract_all(t, '{form}') AS m, string_split_regex(t, '{form}') AS g FROM d)"
    for rank, (kind, form) in enumerate(_SQL_FORMS.items(), 1)
)
_SQL_DIGITS = "regexp_replace(s, '[^0-9]', '', 'g')"
_SQL_LUHN = f"""list_sum(list_transform(range(1, length({_SQL_DIGITS}) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN CAST({_SQL_DIGITS}[-i] AS INTEGER) WHEN CAST({_SQL_DIGITS}[-i] AS INTEGER) > 4 THEN 2 * CAST({_SQL_DIGITS}[-i] AS INTEGER) - 9 ELSE 2 * CAST({_SQL_DIGITS}[-i] AS INTEGER) END)) % 10 = 0"""
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({_SQL_MATCHES}),
placed AS (SELECT *, sum(length(gap) + length(s)) OVER (PARTITION BY doc_id, kind ORDER BY nth) AS e FROM matches),
-- digits that are no card by their number are none of its form
formed AS (SELECT doc_id, kind, rank, s, e - length(s) AS b, e FROM placed WHERE kind <> 'card' OR length({_SQL_DIGITS}) BETWEEN 16 AND 19),
between AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id, kind ORDER BY b), 0) AS last FROM formed),
told AS (SELECT doc_id, kind, rank, s, b, e, list_transform(regexp_extract_all(lower(substr(t, CAST(last + 1 AS BIGINT), CAST(b - last AS BIGINT))), '[^{_S}]+')[-2:], lambda w: regexp_replace(w, '[0-9]+', '0', 'g')) AS w FROM between JOIN d USING (doc_id)),
patterned AS (SELECT *, list_filter([CASE WHEN regexp_matches(w[-1], '[^:=#].*[:=#]$') THEN '1 ' || w[-1] END, CASE WHEN len(w) = 2 THEN '2 ' || array_to_string(w, ' ') END], lambda p: p IS NOT NULL) AS patterns FROM told),
base AS (
  SELECT * FROM patterned WHERE CASE kind WHEN 'email' THEN TRUE
    WHEN 'ip' THEN len(list_filter(string_split(s, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(nullif(ltrim(p, '0'), '') AS INTEGER), 0) > 255)) = 0
    WHEN 'card' THEN {_SQL_LUHN} WHEN 'phone' THEN length({_SQL_DIGITS}) BETWEEN 8 AND 15 ELSE FALSE END),
tokens AS (SELECT doc_id, s, b, patterns, regexp_extract(s, '[A-Za-z0-9+](?:.*[A-Za-z0-9])?') AS value FROM patterned WHERE kind = 'token'),
valued AS (SELECT doc_id, value, patterns, b + strpos(s, value) - 1 AS b, b + strpos(s, value) - 1 + length(value) AS e FROM tokens
  WHERE value <> '' AND (contains(value, '@') OR length(regexp_replace(value, '[^0-9]', '', 'g')) >= {LEAST_DIGITS})),
free AS (SELECT doc_id, value, b, e, unnest(patterns) AS pattern FROM valued v WHERE NOT EXISTS (SELECT 1 FROM formed f WHERE f.kind <> 'token' AND f.doc_id = v.doc_id AND v.b < f.e AND f.b < v.e)),
edges AS (SELECT DISTINCT unnest(patterns) AS pattern, s AS value FROM base UNION SELECT DISTINCT pattern, value FROM free),
seeds AS (SELECT DISTINCT s AS value, kind FROM base
  UNION SELECT value, '{SECRET}' FROM free WHERE regexp_full_match(value, '[0-9a-f]{{32,}}|[0-9A-F]{{32,}}') AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Fa-f]')),
fillers AS (SELECT pattern, count(*) AS fillers FROM edges GROUP BY pattern),
scores0 AS (SELECT value, kind, 1.0::DOUBLE AS score FROM seeds),{','.join(_sql_spread(n) for n in range(ROUNDS))},
best AS (SELECT pattern, max(struct_pack(c := confidence, k := kind)).k AS kind FROM trusted{ROUNDS - 1} GROUP BY pattern),
spans AS (
  SELECT doc_id, kind, rank, b, e, TRUE AS base FROM base
  UNION ALL SELECT DISTINCT doc_id, kind, list_position(['email', 'ip', 'card', 'phone', '{SECRET}'], kind), b, e, FALSE FROM free JOIN best USING (pattern)),
shown AS (
  SELECT doc_id, {', '.join(f"count(*) FILTER (base AND kind = '{k}') AS n_{k}" for k in KINDS)},
    coalesce(string_agg(concat(kind, ':', b, ':', e), ',' ORDER BY rank, b) FILTER (base), '') AS base_shown, string_agg(concat(kind, ':', b, ':', e), ',' ORDER BY rank, b, e) AS spans, count(*) AS n FROM spans GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in KINDS)}, sha256(coalesce(base_shown, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n, 0) AS n_spans FROM d LEFT JOIN shown USING (doc_id)
"""
