"""Operator 6: quality classifier from weak labels.

Overlapping heuristics vote on every text: good, bad, or nothing.  How often
each pattern of votes occurs in the whole corpus is all that expectation-
maximisation needs to estimate the heuristics' accuracies and the share of good
texts, and with them each pattern's chance of being good.  Those posterior
labels train a linear scorer on hashed word shapes, which then judges texts by
what the heuristics do not look at.

Toxicity is learned from a bounded sample of labelled texts: hashed words and
word beginnings that toxic texts hold far more often than others, in whatever
language, get their log odds as weights; a text is toxic if their mean over
its words passes a limit that labelled texts kept apart have set.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .store import drop, materialize, small_batches

GOOD, BAD, NOTHING = 1, 0, 2
#: Distinct texts on which the scorer is trained, those with the least hashes: the sample's documented bound, a hard one.
SAMPLE = 20_000
#: Hashed features of the scorer.
CELLS = 1 << 14
EPOCHS, RATE, DECAY = 300, 1.0, 1e-4

#: Labelled texts from which toxicity is learned (a hard bound), and the part of them, one in so many, that sets the limit.
LABELLED, APART = 20_000, 4
#: Bytes of the word beginnings that count as features beside the whole word.
BEGINNINGS = (5, 6, 7, 8)
#: Toxic texts that must hold a feature, how much more often than others, and the most features that are kept.
LEAST, ODDS, FEATURES = 3, 20.0, 100_000
#: Labelled texts of either kind on either side below which nothing is learned, and so nothing is toxic.
ENOUGH = 5

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_SYMBOLS, _BANGS, _BARS, _ENDS = _flags("#$%&*|~^=<>{}[]\\_@+/"), _flags("!"), _flags("|"), _flags(".!?")
_UPPER, _LETTER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_WORDY = _LETTER.copy()
_WORDY[48:58] = _WORDY[128:] = True
#: The heuristics, in the order of the votes.
LABELLERS = ("symbols", "capitals", "exclamations", "bars", "stutter", "bigrams", "sentences", "word_length", "tails", "letters")


def _per_text(b: tv.Bytes, table: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(table[b.data])])
    return np.diff(total[b.offsets]).astype(float)


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, NOTHING))


def votes(b: tv.Bytes, w: tv.Spans, h: np.ndarray) -> np.ndarray:
    """The heuristics' votes, one row per text."""
    n = tv.counts(w).astype(float)
    one = np.maximum(n, 1)
    symbols, bangs, bars, ends = (_per_text(b, t) / one for t in (_SYMBOLS, _BANGS, _BARS, _ENDS))
    letters = np.maximum(_per_text(b, _LETTER), 1)
    upper = _per_text(b, _UPPER) / letters
    own = tv.owners(w)
    same = np.zeros(len(h) + 1, np.int64)
    for back in (1, 2):
        same[back : len(h)] |= (h[back:] == h[:-back]) & (own[back:] == own[:-back])
    stutter = np.diff(np.concatenate([[0], np.cumsum(same[: len(h)])])[w.first]) / one
    pairs = tv.grams(h, 2)
    inside = tv.inside(w, 2)
    of, pairs = own[: len(pairs)][inside], pairs[inside]
    order = np.lexsort((pairs, of))
    of, pairs = of[order], pairs[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (pairs[1:] != pairs[:-1])
    distinct = np.bincount(of[new], minlength=len(n)).astype(float)
    variety = distinct / np.maximum(n - 1, 1)
    size = np.diff(b.offsets) / one
    some = n > 0
    tails = np.diff(np.concatenate([[0], np.cumsum(_SYMBOLS[b.data[w.end - 1]])])[w.first]) / one
    wordy = _per_text(b, _WORDY) / np.maximum(_per_text(b, ~tv._SPACE), 1)
    return np.stack(
        [
            _vote(symbols < 0.05, symbols > 0.25),
            _vote(upper < 0.2, upper > 0.4),
            _vote(bangs < 0.02, bangs > 0.25),
            _vote(np.zeros(len(n), bool), bars > 0.15),
            _vote(stutter < 0.05, stutter > 0.2),
            _vote((variety > 0.8) & (n >= 10), (variety < 0.5) & (n >= 10)),
            _vote((ends > 0.005) & (ends < 0.5), (ends == 0) & (n >= 60)),
            _vote((size > 3) & (size < 14) & some, ((size >= 30) | ~some)),
            _vote((tails < 0.05) & some, tails > 0.3),
            _vote(wordy > 0.9, (wordy < 0.8) & (n >= 5)),
        ],
        axis=1,
    )


def codes(v: np.ndarray) -> np.ndarray:
    """A number for each pattern of votes."""
    return v @ 3 ** np.arange(v.shape[1])


def fit_labellers(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """The chance of being good for each pattern of votes, by expectation-maximisation.

    ``counts`` holds how many texts have each pattern (at most 3 ** labellers).
    A labeller's chances of either vote, where it votes, are estimated for good
    and for bad texts.
    """
    k = len(LABELLERS)
    patterns = np.array(sorted(counts), dtype=np.int64)
    often = np.array([counts[p] for p in patterns.tolist()], dtype=float)
    v = patterns[:, None] // 3 ** np.arange(k) % 3
    seen = v[:, :, None] == np.array([BAD, GOOD])  # silence says nothing
    good = np.where((v == BAD).any(1), 0.1, 0.9)  # heuristics speak up against a text with reason, to begin with
    for _ in range(rounds):
        prior = np.clip((often * good).sum() / max(often.sum(), 1), 1e-3, 1 - 1e-3)
        log = np.zeros((2, len(patterns)))
        for side, weight in ((0, often * (1 - good)), (1, often * good)):
            said = (weight[:, None, None] * seen).sum(0) + 0.5
            log[side] = (seen * np.log(said / said.sum(1, keepdims=True))[None]).sum((1, 2)) + np.log((1 - prior, prior)[side])
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return dict(zip(patterns.tolist(), good.tolist()))


def shapes(b: tv.Bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of each text: shapes of words (runs of one class are one) and of pairs, with weights."""
    kind = _CLASS[b.data]
    keep = np.ones(len(kind), dtype=bool)
    keep[1:] = kind[1:] != kind[:-1]
    starts = b.offsets[:-1][b.offsets[:-1] < len(kind)]
    keep[starts] = True
    short = tv.Bytes(kind[keep], np.concatenate([[0], np.cumsum(keep)])[b.offsets])
    w = tv.words(short)
    h = tv.hashes(short, w)
    out = []
    for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        both = np.concatenate([h[i:j], tv.grams(h[i:j], 2)])
        cells, often = np.unique((both % np.uint64(CELLS)).astype(np.int32), return_counts=True)
        weight = np.log1p(often)
        out.append((cells, weight / max(np.sqrt((weight * weight).sum()), 1e-9)))
    return out


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Logistic regression on posterior labels; the bias is the last weight."""
    out = np.zeros(CELLS + 1)
    if not len(rows):
        return out
    cells = np.concatenate([c for c, _ in rows])
    weight = np.concatenate([x for _, x in rows])
    own = np.repeat(np.arange(len(rows)), [len(c) for c, _ in rows])
    matter = 1 / len(rows)
    for _ in range(EPOCHS):
        score = np.bincount(own, weight * out[cells], len(rows)) + out[-1]
        miss = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - labels) * matter
        step = np.bincount(cells, weight * miss[own], CELLS)
        out[:-1] -= 20 * RATE * (step + DECAY * out[:-1])
        out[-1] -= RATE * miss.sum()
    return out


def toxic_features(b: tv.Bytes, w: tv.Spans):
    """Hashes of each word, then of its beginnings of each length, case and outer punctuation aside; 0 where it is too short."""
    word = np.zeros(256, dtype=bool)
    word[65:91] = word[97:123] = word[128:] = True
    inner = word[b.data]
    start, end = w.start.copy(), w.end.copy()
    if not len(start):
        return
    for _ in range(4):
        start += ~inner[start] & (start < end - 1)
        end -= ~inner[end - 1] & (start < end - 1)
    yield tv.hashes(b, tv.Spans(start, end, w.first), lower=True)
    for k in BEGINNINGS:
        # only a longer word's: a whole word says something else than a beginning
        out = np.zeros(len(start), np.uint64)
        long = np.flatnonzero(end - start > k)
        out[long] = tv.hashes(b, tv.Spans(start[long], start[long] + k, w.first), lower=True, seed=k)
        yield out


def toxicity(b: tv.Bytes, w: tv.Spans, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each text's mean over its words of the greatest weight of a word's features; ``known`` is sorted."""
    most = np.zeros(len(w.start))
    for h in toxic_features(b, w) if len(known) else ():
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        np.maximum(most, np.where(known[at] == h, weights[at], 0.0), out=most)
    total = np.concatenate([[0.0], np.cumsum(most)])[w.first]
    return np.diff(total) / np.maximum(tv.counts(w), 1)


def best_limit(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The limit with the least sum of both classes' shares on its wrong side, halfway to the next score."""
    order = np.argsort(scores, kind="stable")
    s, t = scores[order], toxic[order]
    cost = np.cumsum(t) / max(t.sum(), 1) + (len(t) - t.sum() - np.cumsum(~t)) / max((~t).sum(), 1)
    cost[:-1][s[1:] == s[:-1]] = 9.0
    i = int(np.argmin(cost))
    return float((s[i] + s[min(i + 1, len(s) - 1)]) / 2)


def learn_toxicity(docs: DataFrame, labels: DataFrame | None, text: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """Features (sorted hashes), their weights, and the limit beyond which a text is toxic.

    ``labels`` has doc_id and toxic (0 or 1).  At most LABELLED labelled
    documents, by hash of doc_id, are used, equal texts once.
    """
    alone = np.zeros(0, np.uint64), np.zeros(0), float("inf")
    if labels is None:
        return alone
    given = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    given = given.orderBy(F.xxhash64("_id"), "_id").limit(LABELLED)
    rows = docs.filter(F.col(text).isNotNull()).join(F.broadcast(given), F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy(F.xxhash64(text).alias("key")).agg(F.min(text).alias("text"), F.max("_toxic").alias("toxic"))
    rows = materialize(rows.withColumn("apart", F.pmod("key", F.lit(APART)) == 0), "labelled")
    sizes = {(r["apart"], r["toxic"]): r["n"] for r in rows.groupBy("apart", "toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = sizes.get((False, 1), 0), sizes.get((False, 0), 0)
    if min(n_toxic, n_other, sizes.get((True, 1), 0), sizes.get((True, 0), 0)) < ENOUGH:
        drop(rows)
        return alone

    def features(batches):
        for batch in batches:
            w = tv.words(b := tv.Bytes.of(batch.column(0)))
            own, toxic = tv.owners(w), np.asarray(batch.column(1)) == 1
            for h in toxic_features(b, w):
                order = np.lexsort((own, h))
                h, of = h[order], own[order]
                new = h != 0
                new[1:] &= (h[1:] != h[:-1]) | (of[1:] != of[:-1])
                found, which = np.unique(h[new], return_inverse=True)
                t = np.bincount(which, toxic[of[new]], len(found)).astype(np.int64)
                n = np.bincount(which, minlength=len(found))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(t), pa.array(n - t)], names=["h", "t", "o"])

    often = rows.filter("not apart").select("text", "toxic").mapInArrow(features, "h long, t long, o long").groupBy("h").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    odds = (F.col("t") / n_toxic) / ((F.col("o") + 0.5) / n_other)
    chosen = often.filter(F.col("t") >= LEAST).withColumn("odds", odds).filter(F.col("odds") >= ODDS).orderBy(F.desc("odds"), "h").limit(FEATURES)
    found = chosen.select("h", "odds").toArrow().combine_chunks()
    hashes, weights = _column(found, "h").to_numpy().view(np.uint64), np.log(_column(found, "odds").to_numpy())
    hashes, weights = hashes[order := np.argsort(hashes)], weights[order]

    def score(batches):
        for batch in batches:
            w = tv.words(b := tv.Bytes.of(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(toxicity(b, w, hashes, weights)), pa.array(np.asarray(batch.column(1)) == 1)], names=["score", "toxic"])

    apart = rows.filter("apart").select("text", "toxic").mapInArrow(score, "score double, toxic boolean").collect()
    drop(rows)
    return hashes, weights, best_limit(np.array([r["score"] for r in apart]), np.array([r["toxic"] for r in apart]))


def train(docs: DataFrame, text: str = "text") -> tuple[dict[int, float], np.ndarray]:
    """The chance of each pattern of votes, from all texts, and the scorer's weights, from the sample."""
    small_batches(docs.sparkSession)

    def vote(batches):
        for batch in batches:
            w = tv.words(b := tv.Bytes.of(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(codes(votes(b, w, tv.hashes(b, w))))], names=["code"])

    counted = docs.select(text).mapInArrow(vote, "code long").groupBy("code").agg(F.count("*").alias("n")).collect()
    counts = {r["code"]: r["n"] for r in counted}
    chance = fit_labellers(counts)
    def sampled(batches):
        for batch in batches:
            w = tv.words(b := tv.Bytes.of(batch.column(0)))
            found = shapes(b)
            code = codes(votes(b, w, tv.hashes(b, w)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(code), pa.array([c for c, _ in found], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))],
                names=["key", "code", "cells", "weights"],
            )

    texts = docs.select(F.col(text).alias("text")).filter("text is not null").withColumn("key", F.xxhash64("text"))
    least = texts.select(F.col("key").alias("_key")).distinct().orderBy("_key").limit(SAMPLE)
    # a text's copies count once
    picked = texts.join(F.broadcast(least), F.col("key") == F.col("_key"), "left_semi").groupBy("key").agg(F.min("text").alias("text")).select("text", "key")
    # as Arrow: the driver's Python holds arrays, not millions of numbers
    rows = picked.mapInArrow(sampled, "key long, code long, cells array<int>, weights array<float>").toArrow().sort_by("key").combine_chunks()
    labels = np.array([chance[c] for c in rows["code"].to_pylist()])
    cells, weights = (_column(rows, c) for c in ("cells", "weights"))
    ends = cells.offsets.to_numpy()
    cells, weights = cells.values.to_numpy().astype(np.int64), weights.values.to_numpy().astype(float)
    return chance, fit_scorer([(cells[i:j], weights[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())], labels)


def _column(table: pa.Table, name: str) -> pa.Array:
    found = table[name]
    return found.combine_chunks() if found.num_chunks != 1 else found.chunk(0)


def classify(docs: DataFrame, threshold: float = 0.5, labels: DataFrame | None = None) -> DataFrame:
    """All columns of ``docs`` (with text), and weak_label, score, toxic and keep.

    weak_label is the posterior of the votes, score the linear scorer's; a text
    is kept if the score reaches the threshold and it is not toxic.  Toxicity is
    learned from ``labels`` (doc_id, toxic), which ``docs`` then needs doc_id
    for; without enough of them no text is toxic.  Null and
    blank texts score 0 and are not kept.  Equal texts are judged alike; columns
    that have a new one's name are replaced; an empty table gives an empty one.
    """
    chance, weights = train(docs)
    given = docs.sparkSession.sparkContext.broadcast((chance, weights.astype(np.float32), *learn_toxicity(docs, labels)))
    new = ["weak_label", "score", "toxic", "keep"]
    names = [c for c in docs.columns if c not in new]
    schema = docs.select(*names).schema
    for name, kind in zip(new, ("double", "double", "boolean", "boolean")):
        schema = schema.add(name, kind)

    def run(batches):
        chance, weights, known, odds, limit = given.value
        for batch in batches:
            w = tv.words(b := tv.Bytes.of(batch.column("text")))
            weak = [chance.get(c, 0.5) for c in codes(votes(b, w, tv.hashes(b, w))).tolist()]
            raw = np.array([float(x @ weights[c]) for c, x in shapes(b)]) + weights[-1]
            score = np.where(tv.counts(w) > 0, 1 / (1 + np.exp(-np.clip(raw, -50, 50))), 0.0)
            toxic = toxicity(b, w, known, odds) > limit
            keep = (score >= threshold) & ~toxic
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(weak, pa.float64()), pa.array(score), pa.array(toxic), pa.array(keep)], names=[*names, *new])

    return docs.select(*names).mapInArrow(run, schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Weak label, score and decision for all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels=labels).select("doc_id", F.round("weak_label", 6).alias("weak_label"), F.round("score", 4).alias("score"), "toxic", "keep")
