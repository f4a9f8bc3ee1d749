"""Context mixing against plain Python that goes decision by decision."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import context_mixing as cm
from lectern.llm import textvec as tv

U = 0xFFFFFFFF


def tokens(text):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]


def mixed(x, salt):
    x = (x + salt) * 0x9E3779B1 & U
    x ^= x >> 15
    x = x * 0x85EBCA6B & U
    return x ^ x >> 13


def cell(node, context):
    x = ((node * 0xC2B2AE35 & U) ^ context) * 0x9E3779B1 & U
    x ^= x >> 16
    return (x * 0x85EBCA6B & U) >> (32 - cm.BITS)


def whole_mix(x):
    m = (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & m
    return x ^ x >> 31


class Plain:
    """The same model, one decision at a time, its counts in dictionaries."""

    def __init__(self, texts, words):
        self.c = Counter(w for t in texts for w in tokens(t))
        self.ends = len(texts)
        steps = Counter()
        for w, n in self.c.items():
            steps[math.floor(math.log2(n) * 64)] += 1
        room, least = words, math.inf
        for step in sorted(steps, reverse=True):
            room -= steps[step]
            if room < 0:
                break
            least = step
        known = sorted((w for w, n in self.c.items() if math.log2(n) * 64 >= least), key=lambda w: (-self.c[w], w))
        other = sum(n for w, n in self.c.items() if w not in set(known)) + sum(n == 1 for n in self.c.values()) + 1
        self.code = cm.Code(known, np.array([self.c[w] for w in known], np.int64), self.ends, other)
        self.symbol = {w: i + 2 for i, w in enumerate(known)}
        mass = [max(self.ends, 1), other] + [self.c[w] for w in known]
        self.bits = [format(c, f"0{n}b") for c, n in zip(self.code.code.tolist(), self.code.length.tolist())]
        self.below = defaultdict(float)
        for b, m in zip(self.bits, mass):
            for i in range(len(b) + 1):
                self.below[b[:i]] += m
        self.met = defaultdict(lambda: [0, 0])
        for t in texts:
            for u in self.units(t):
                if u[0] == 0:
                    for _, _, bit, cells in self.decisions(u):
                        for at in cells[1:]:
                            self.met[at][bit] += 1
        for w in self.c:
            for u in self.letters(w):
                for _, _, bit, cells in self.decisions(u):
                    for at in cells:
                        self.met[at][bit] += 1

    def letters(self, w):
        w += b" "
        for i, c in enumerate(w):
            back = [w[i - k] + 1 if i >= k else 0 for k in (1, 2, 3)]
            so_far = sum(whole_mix(x + (k << 8)) for k, x in enumerate(w[:i])) & (1 << 64) - 1
            pair = back[0] * 257 + back[1]
            yield 1, c, [mixed(pair & U, 4), mixed((pair * 257 + back[2]) & U, 5), mixed((so_far >> 32) ^ i, 6)], max(back[0], 1) - 1

    def units(self, text):
        one = two = told = cm.END
        for w in tokens(text) + [None]:
            s = cm.END if w is None else self.symbol.get(w, cm.OTHER)
            yield 0, s, [mixed(one, 1), mixed((one * 0x9E3779B1 & U) ^ two, 2), mixed(told, 3)], None
            if s == cm.OTHER:
                yield from self.letters(w)
            one, two = s, one
            if s < cm.FREQUENT and s != cm.OTHER:
                told = s

    def decisions(self, unit):
        kind, value, contexts, last = unit
        bits = format(value, "08b") if kind else self.bits[value]
        for d, bit in enumerate(bits):
            node = int("1" + bits[:d], 2)
            first = ("dense", last << 8 | node) if kind else ("code", bits[:d])
            yield d, kind, int(bit), [first, *((k, cell(node | kind << 31, c)) for k, c in enumerate(contexts))]

    def odds(self, at):
        if at[0] == "code":
            zero, one = self.below[at[1] + "0"], self.below[at[1] + "1"]
            small = 1e-4 * (zero + one)
            return math.log((one + small) / (zero + small))
        n = self.met[at] if at in self.met else (0, 0)
        return math.log((n[1] + cm.ADDED) / (n[0] + cm.ADDED))

    def score(self, text):
        weights = {(k, d, s): list(cm.FIRST[k]) for k in (0, 1) for d in range(cm.DEPTHS) for s in range(cm.STRENGTHS)}
        right, total, units, nth = defaultdict(lambda: [0, 0]), 0.0, list(self.units(text)), 0
        while units:
            n = cm.BLOCKS[nth] if nth < len(cm.BLOCKS) else cm.BLOCK
            block, units, nth = units[:n], units[n:], nth + 1
            learned, said = defaultdict(list), []
            for u in block:
                for d, kind, bit, cells in self.decisions(u):
                    x = [self.odds(at) for at in cells]
                    gate = kind, min(d, cm.DEPTHS - 1), (x[2] != 0) + (abs(x[3]) > 1)
                    z = max(-11.9, min(11.9, sum(a * b for a, b in zip(x, weights[gate]))))
                    p = 1 / (1 + math.exp(-z))
                    spot = gate[:2] + (int((z + 12) * cm.STEPS / 24),)
                    met, ones = right[spot]
                    final = max(cm.LEAST, min(1 - cm.LEAST, (ones + cm.TRUST * p) / (met + cm.TRUST)))
                    total -= math.log2(final if bit else 1 - final)
                    learned[gate].append([(bit - p) * a for a in x])
                    said.append((spot, bit))
            for gate, rows in learned.items():
                weights[gate] = [w + cm.RATE * sum(g) / math.sqrt(len(rows)) for w, g in zip(weights[gate], zip(*rows))]
            for spot, bit in said:
                right[spot] = [right[spot][0] + 1, right[spot][1] + bit]
        return total

    def base(self, text):
        n, v = sum(self.c.values()) + self.ends, len(self.c) + (self.ends > 0)
        counts = [self.c[w] for w in tokens(text)] + [self.ends]
        return len(counts), sum(c > 0 for c in counts), n, sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in counts)


def corpus(seed=3, n=24):
    rng = random.Random(seed)
    words = ["the", "of", "and", "la", "der"] * 6 + [f"w{i}" for i in range(60)] + ["\xe9t\xe9", "中文", "A" * 70, "|"]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice(words) + rng.choice(["", "", "", "x%d" % rng.randrange(99)]) for _ in range(rng.choice([0, 3, 20, 90])))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (None, "the of"), (3, "the Of"), (3, "the Of"), (n + 3, "z" * 700), (n + 4, "of " * 400)]


@pytest.mark.parametrize("words", [cm.WORDS, 20, 1])
def test_scores_equal_plain_python(spark, words):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"nth": F.lit("mine"), "w": F.lit("mine"), "bits": F.lit("mine"), "held_out": F.lit("mine")})
    got = cm.lm_scores(df.repartition(3), cm.held_out(F.col("doc_id")), words).collect()
    held = lambda key: zlib.crc32(b"" if key is None else str(key).encode()) % 10 == 0
    plain = Plain([t for k, t in rows if not held(k)], words)
    want = defaultdict(list)
    for k, t in rows:
        want[k].append((held(k), *plain.base(t), plain.score(t), len((t or "").encode())))
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _ in rows)
    for k, mine in want.items():
        for r, w in zip(sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["score"], reverse=True), sorted(mine, key=lambda w: w[5])):
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
            assert math.isclose(r["base_score"], w[4], rel_tol=1e-9)
            assert math.isclose(r["score"], -w[5] * math.log10(2), rel_tol=2e-4)
            assert r["bits_per_byte"] is None if not w[6] else math.isclose(r["bits_per_byte"], w[5] / w[6], rel_tol=2e-4)


def test_scores_without_anything_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = cm.lm_scores(df, F.lit(True)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in sorted(got)] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert cm.lm_scores(df.limit(0), F.lit(False)).count() == 0


def test_code_is_free_of_prefixes_and_probabilities_of_words_add_up_to_one():
    rng = random.Random(1)
    words = [f"w{i}".encode() for i in range(300)]
    counts = sorted((rng.choice([1, 1, 2, 9, 500, 10**6]) for _ in words), reverse=True)
    code = cm.Code(words, np.array(counts, np.int64), 7, 30.0)
    bits = sorted(format(c, f"0{n}b") for c, n in zip(code.code.tolist(), code.length.tolist()))
    assert all(not b.startswith(a) for a, b in zip(bits, bits[1:]))
    mass = np.array([7, 30, *counts], float)
    yes = 1 / (1 + np.exp(-code.odds.astype(float)))
    said = np.where(code.packed & 1, yes, 1 - yes)
    p = np.multiply.reduceat(said, code.offset)
    assert np.allclose(p, mass / mass.sum(), rtol=5e-3) and p.sum() <= 1 + 1e-9


def test_a_text_scores_alike_whatever_stands_beside_it():
    texts = [t for _, t in corpus(9)]
    plain = Plain(texts[:20], 50)
    counts = cm.Counts()
    model = cm.Model(plain.code, cm.Model.learned(counts.total))

    def bits(some):
        b = tv.Bytes.of(pa.array(some, pa.string()))
        return model.bits(cm.Units(plain.code, b, *cm._words(b)))

    alone = [bits([t])[0] for t in texts]
    assert alone == bits(texts).tolist() == bits(texts[::-1]).tolist()[::-1]


def test_the_model_beats_single_words_on_texts_that_it_has_not_seen(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    got = cm.lm_scores(docs, cm.held_out(F.col("doc_id"))).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_what_is_counted_as_words_spells_no_letters():
    from lectern.llm import context_mixing as m
    from lectern.llm import textvec as tv

    code = m.Code([b"one", b"two"], np.array([5, 4]), 3, 2.0)
    b = tv.Bytes.of(pa.array(["one new two", "", "other one"]))
    whole, words = m.Units(code, b, *m._words(b)), m.Units(code, b, *m._words(b), spelled=False)
    assert whole.letter.any() and not words.letter.any()
    a, c = m.Counts(), m.Counts()
    a.words(code, whole)
    c.words(code, words)
    assert a.total.any() and (a.total == c.total).all()


def test_counts_are_handed_on_before_a_number_is_full(monkeypatch):
    monkeypatch.setattr(cm, "MOST_COUNTED", 3 * 8 * 4)
    counts = cm.Counts()
    counts.letters(np.frombuffer(b"a", np.uint8), np.array([0, 1]))
    assert counts.total.dtype == np.int32 and not counts.full()
    counts.letters(np.frombuffer(b"a", np.uint8), np.array([0, 1]))
    # two letters and the space behind each, eight bits, all tables
    assert counts.full() and counts.met == 4 * 8 * 4 == counts.total.sum()
    row = next(counts.rows())
    assert row.schema.field("c0").type == pa.int64()


def test_the_code_keeps_one_number_for_each_node_and_finds_words_without_a_search():
    words = [f"w{i}".encode() for i in range(500)]
    code = cm.Code(words, np.array([1000 - i for i in range(500)], np.int64), 7, 30.0)
    nodes = {(d, int(c) >> (int(n) - d)) for c, n in zip(code.code, code.length) for d in range(int(n))}
    # a node that many codes share is kept once, not once for each of their bits
    assert len(nodes) <= len(code.tree) <= len(nodes) + int(code.length.max()) < int(code.length.sum()) // 4
    b = tv.Bytes.of(pa.array([" ".join([w.decode() for w in words] + ["new", "W3"])]))
    assert code.symbols(cm._words(b)[1]).tolist() == [*range(2, 502), cm.OTHER, 5]
    assert cm.Code([], np.zeros(0, np.int64), 1, 1.0).symbols(np.array([0, 1 << 63, (1 << 64) - 1], np.uint64)).tolist() == [cm.OTHER] * 3


def test_what_is_repeated_is_counted_at_once(monkeypatch):
    told = []
    add = cm.Counts.add
    monkeypatch.setattr(cm.Counts, "add", lambda self, base, bit, cells, *n: (told.append(len(cells)), add(self, base, bit, cells, *n)))
    code = cm.Code([b"of", b"the"], np.array([3000, 2000]), 3, 2.0)

    def count(texts):
        told.clear()
        b = tv.Bytes.of(pa.array(texts))
        counts = cm.Counts()
        counts.words(code, cm.Units(code, b, *cm._words(b), spelled=False))
        return sum(told), counts
    few, once = count(["of the of the of the of"])
    many, often = count(["of the of the of the of"] * 300)
    assert many == few and (often.total == 300 * once.total).all() and often.met == 300 * once.met


def test_decisions_of_a_depth_stand_together_in_the_order_of_units():
    code = cm.Code([b"a", b"b", b"c", b"d"], np.array([900, 90, 9, 3]), 5, 2.0)
    value = np.array([5, 2, 3, 0, 2, 4], np.int32)
    d = cm.word_decisions(code, value)
    assert d.many == sorted(d.many, reverse=True) and sum(d.many) == len(d.bit) == code.length[value].sum()
    unit, depth = d.each(np.arange(6)[d.order]), np.repeat(np.arange(len(d.many)), d.many)
    for i, v in enumerate(value):
        mine = unit == i
        assert depth[mine].tolist() == list(range(code.length[v]))
        assert "".join(map(str, d.bit[mine])) == format(code.code[v], f"0{code.length[v]}b")
        assert (code.tree[d.place[mine]] == code.odds[code.offset[v] : code.offset[v] + code.length[v]]).all()
