"""Operator 13: language-model scores by online logistic context mixing.

A text's lower-cased words, then an end, are coded in yes-or-no decisions: a
word of the vocabulary by the bits of its Shannon code, any other by the code
of OTHER and the bits of its bytes and of a space.  Every decision is predicted
in four contexts: by the code alone (or the last byte), and, hashed into tables
of counts, by the word before, the two words before and the last frequent word
(or two bytes, three bytes and the word so far).  The log odds are added with
weights that a gate chooses; a text's weights follow its own decisions, block
by block, and a last stage corrects the mix by how often it was right so far.
A decision's chance rests on what stands before it alone, so the chances of a
text's decisions multiply to that of the text, and their logarithms add up to
its bits.

All training texts are counted: words by a grouped table, which decides the
vocabulary and the base score, contexts by sums over the tables' cells.  The
vocabulary and the tables are of bounded size, words beyond them are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .store import drop, materialize, small_batches

#: Most words of the vocabulary: the frequent ones, as far as words of about one frequency all have room.
WORDS = 1 << 18
#: Cells of each table of hashed contexts, tables, and cells whose counts travel in one row.
BITS, TABLES, ROW = 19, 3, 8
CELLS, DENSE = 1 << BITS, 1 << 16
ALL = TABLES * CELLS + DENSE
#: Units (words, bytes of other words) after which a text's weights are refined: small blocks first.
BLOCKS = (16, 16, 32, 64)
BLOCK = 128
#: Decisions' contexts are counted for so many units at once.
COUNTED = 1 << 13
#: Decisions after which counts are handed on: a batch has far fewer than the rest of a number's room.
MOST_COUNTED = 1 << 30
#: What the weights begin with, how fast they follow, what a count is worth beside the mix, and added counts.
FIRST = ((0.2, 0.2, 0.1, 0.6), (0.2, 0.25, 0.35, 0.35))
RATE, TRUST, ADDED = 0.08, 40.0, 0.15
#: Depths and kinds of evidence that choose the weights; steps of log odds that the last stage tells apart.
DEPTHS, STRENGTHS, STEPS = 12, 3, 24
LEAST = 2.0**-14
END, OTHER = 0, 1
#: Symbols of the most frequent words, which tell a text's language.
FREQUENT = 256
#: Texts that are scored side by side, longer ones with longer ones.
BESIDE = 256
#: Decisions whose predictors are looked up at once.
AHEAD = 1 << 20

#: Bits of a natural logarithm's unit.
_BITS = 1 / np.log(2)
#: Bits of a hash behind the beginning by which it is looked up.
_BEGINNING = np.uint64(64 - 18)
_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def held_out(doc_id: Column, parts: int = 10) -> Column:
    """Whether the checksum of an id's digits falls into the part that is not learned from; a null id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == 0


def _words(b: tv.Bytes) -> tuple[tv.Spans, np.ndarray]:
    w = tv.words(b)
    return w, tv.hashes(b, w, lower=True)


def _cut(b: tv.Bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of parts, one after the other, and where each begins."""
    n = end - start
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - n), n)
    return tv._LOWER[b.data[at]], np.concatenate([[0], ends])


def _binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def count_words(texts: DataFrame) -> DataFrame:
    """w and c: all words of ``texts`` (text), lower-cased, and how often they occur."""

    def run(batches):
        for batch in batches:
            b = tv.Bytes.of(batch.column("text"))
            w, h = _words(b)
            _, first, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([_binaries(*_cut(b, w.start[first], w.end[first])), pa.array(n)], names=["w", "n"])

    return texts.select("text").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("c"))


def _odds(prefix: np.ndarray, depth: int, aligned: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Log odds of the bit behind beginnings of codes; of codes in order: left-aligned, and the mass below each and of all."""
    low, middle, high = (total[np.searchsorted(aligned, (2 * prefix + i) << (29 - depth))] for i in (0, 1, 2))
    small = 1e-4 * (high - low)
    return np.log((high - middle + small) / (middle - low + small)).astype(np.float32)


class Code:
    """The vocabulary: hashes, counts, codes, and the log odds of each node of the codes' tree."""

    def __init__(self, words: list[bytes], counts: np.ndarray, ends: int, other: float):
        self.counts = np.concatenate([[ends, 0], counts]).astype(np.int64)
        mass = np.concatenate([[max(ends, 1), max(other, 1)], counts]).astype(float)
        # no code is longer than 29 bits
        mass = np.maximum(mass, mass.sum() / (1 << 28))
        length = np.ceil(np.log2(mass.sum() / mass) - 1e-9).astype(np.int64)
        order = np.lexsort((np.arange(len(mass)), length))
        wide = np.int64(1) << (30 - length[order])
        aligned = np.cumsum(wide) - wide
        self.length = length.astype(np.int32)
        self.code = np.empty(len(mass), np.uint32)
        self.code[order] = (aligned >> (30 - length[order])).astype(np.uint32)
        self.aligned = self.code << (30 - self.length).astype(np.uint32)
        total = np.concatenate([[0.0], np.cumsum(mass[order])])
        # codes leave no gaps and longer ones follow: nodes of a depth at which codes go on are a run of beginnings
        trees, self.base, done = [], [], 0
        for depth in range(int(length.max())):
            low = int(aligned[np.searchsorted(length[order], depth, side="right")]) >> (30 - depth)
            trees.append(_odds(np.arange(low, (int(aligned[-1]) >> (30 - depth)) + 1), depth, aligned, total))
            self.base.append(done - low)
            done += len(trees[-1])
        self.tree, self.base = np.concatenate(trees), np.array(self.base)
        data = pa.array(words, pa.binary())
        b = tv.Bytes.of(pa.array([], pa.string()))
        if len(words):
            _, offsets, buffer = data.buffers()
            b = tv.Bytes(np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8), np.frombuffer(offsets, np.int32)[: len(words) + 1].astype(np.int64))
        h = tv.hashes(b, tv.Spans(b.offsets[:-1], b.offsets[1:], b.offsets[:1]), lower=True)
        # hashes in order, and how many are below each of their beginnings; what is above all is another word
        order = np.argsort(h, kind="stable")
        self.hashes, self.by_hash = np.append(h[order], ~np.uint64(0)), np.append(order + 2, OTHER).astype(np.int32)
        n = np.bincount((h >> _BEGINNING).astype(np.int64), minlength=1 << 18)
        self.below, self.most = (np.cumsum(n) - n).astype(np.int32), int(n.max())

    # of each bit of each code, one code after the other: where a code's begin, log odds, and level with the bit behind

    @property
    def offset(self) -> np.ndarray:
        return np.cumsum(self.length) - self.length

    @property
    def odds(self) -> np.ndarray:
        of, depth = self._each()
        return self.tree[(self.aligned[of] >> (30 - depth)) + self.base[depth]]

    @property
    def packed(self) -> np.ndarray:
        of, depth = self._each()
        return (np.minimum(depth, DEPTHS - 1) << 1 | self.aligned[of] >> (29 - depth) & 1).astype(np.uint8)

    def _each(self) -> tuple[np.ndarray, np.ndarray]:
        of = np.repeat(np.arange(len(self.length)), self.length)
        return of, np.arange(len(of)) - self.offset[of]

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """The symbol of each word by its hash."""
        at = self.below[(h >> _BEGINNING).astype(np.int64)].astype(np.int64)
        for _ in range(self.most):
            at += self.hashes[at] < h
        return np.where(self.hashes[at] == h, self.by_hash[at], np.int32(OTHER))


class Units:
    """A batch's words (symbols), each text's end, and, if they are ``spelled``, the bytes of other words: what is coded, in order."""

    def __init__(self, code: Code, b: tv.Bytes, w: tv.Spans, h: np.ndarray, spelled: bool = True):
        n_texts = len(b.offsets) - 1
        n = tv.counts(w)
        ends = np.cumsum(n + 1) - 1
        symbol = np.full(len(h) + n_texts, END, np.int32)
        place = np.arange(len(h)) + tv.owners(w)
        symbol[place] = code.symbols(h)
        self.symbols, self.ends = symbol, ends
        # the words before: a text begins as after an end
        starts = ends - n
        one, two = np.full(len(symbol), END, np.uint32), np.full(len(symbol), END, np.uint32)
        one[1:], two[2:] = symbol[:-1], symbol[:-2]
        two[starts] = END
        two[(starts + 1)[n > 0]] = END
        # the last frequent word before
        frequent = symbol < FREQUENT
        frequent[place] &= symbol[place] != OTHER
        last = np.maximum.accumulate(np.where(frequent, np.arange(len(symbol)), -1))[:-1]
        told = np.full(len(symbol), END, np.uint32)
        told[1:] = np.where(last < 0, END, symbol[last])
        other = np.flatnonzero(symbol[place] == OTHER) if spelled else np.zeros(0, np.int64)
        data, offsets = _cut(b, w.start[other], w.end[other])
        self.other, self.data, self.offsets = other, data, offsets
        size = np.ones(len(symbol), np.int64)
        size[place[other]] += np.diff(offsets) + 1
        at = np.cumsum(size) - size
        self.first = np.concatenate([at[starts], [int(size.sum())]])
        total = int(size.sum())
        self.letter = np.ones(total, bool)
        self.letter[at] = False
        self.value = np.empty(total, np.int32)
        self.value[at] = symbol
        self.contexts = np.empty((TABLES, total), np.uint32)
        self.contexts[0, at] = _mixed(one, 1)
        self.contexts[1, at] = _mixed(one * _M1 ^ two, 2)
        self.contexts[2, at] = _mixed(told, 3)
        self.last = np.zeros(total, np.uint8)
        if len(other):
            where = np.flatnonzero(self.letter)
            self.value[where], self.last[where], self.contexts[:, where] = letters(data, offsets)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint32(salt)) * _M1
    x ^= x >> np.uint32(15)
    x *= _M2
    return x ^ x >> np.uint32(13)


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of words, each with a space behind, and their contexts: the last byte, and hashes of two, of three and of the word so far."""
    n = len(offsets) - 1
    total = len(data) + n
    value = np.full(total, 32, np.int32)
    size = np.diff(offsets)
    starts = offsets[:-1] + np.arange(n)
    value[np.arange(len(data)) + np.repeat(np.arange(n), size)] = data
    place = np.arange(total) - np.repeat(starts, size + 1)
    back = np.zeros((4, total), np.uint32)
    for k in (1, 2, 3):
        back[k, k:] = np.where(place[k:] >= k, value[:-k] + 1, 0)
    # sums over places' factors tell a word's beginnings apart
    terms = tv.mix(value.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)))
    sums = np.cumsum(terms) - terms
    sums -= np.repeat(sums[starts], size + 1) if n else sums
    pair = back[1] * np.uint32(257) + back[2]
    contexts = np.stack([_mixed(pair, 4), _mixed(pair * np.uint32(257) + back[3], 5), _mixed((sums >> np.uint64(32)).astype(np.uint32) ^ place.astype(np.uint32), 6)])
    return value, np.where(back[1] > 0, back[1] - np.uint32(1), 0).astype(np.uint8), contexts


def _slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Cell of a node of the code tree in a context, which tables tell apart; both are hashes, the first one's room is used."""
    x = context
    x ^= node
    x *= _M1
    x ^= x >> np.uint32(16)
    x *= _M2
    x >>= np.uint32(32 - BITS)
    return x.astype(np.int64)


class Decisions:
    """Units' decisions, one depth of the code after the other: longer units stand first in the ``order``, so each depth has the first ``many`` of them.

    Of each depth: the level; of each decision: bit, place of its first predictor, and a hash of its node in the code's tree.
    """

    def __init__(self, order, many: np.ndarray, level: np.ndarray, bit: np.ndarray, place: np.ndarray, node: np.ndarray):
        self.order, self.many, self.level, self.bit, self.place, self.node = order, many.tolist(), level, bit, place, node

    def each(self, x: np.ndarray) -> np.ndarray:
        """What belongs to units, in order, for each of their decisions."""
        return np.concatenate([x[:n] for n in self.many])

    def slots(self, context: np.ndarray) -> np.ndarray:
        """Cells of a table."""
        return _slots(self.each(context[self.order]), self.node)


def word_decisions(code: Code, value: np.ndarray) -> Decisions:
    """Of words; the place is one among the nodes of the code's tree."""
    length = code.length[value]
    order = np.argsort((31 - length).astype(np.uint8), kind="stable")
    many = len(value) - np.cumsum(np.bincount(length))[:-1]
    depth, aligned = np.arange(len(many)), code.aligned[value[order]]
    key = np.concatenate([aligned[:n] for n in many.tolist()])
    key >>= np.repeat((29 - depth).astype(np.uint32), many)
    key |= np.repeat((2 << depth).astype(np.uint32), many)
    bit = key & np.uint32(1)
    key >>= np.uint32(1)
    return Decisions(order, many, np.minimum(depth, DEPTHS - 1), bit, key + np.repeat(code.base[: len(many)] - (1 << depth), many), key * _M3)


def letter_decisions(value: np.ndarray, last: np.ndarray) -> Decisions:
    """Of bytes; the place is a cell of the dense table by last byte and node."""
    depth = np.arange(8)
    key = ((value.astype(np.uint32) | np.uint32(256)) >> (7 - depth).astype(np.uint32)[:, None]).ravel()
    bit = key & np.uint32(1)
    key >>= np.uint32(1)
    place = ((last.astype(np.int64) << 8) + key.reshape(8, -1)).ravel()
    # nodes apart from those of words
    return Decisions(slice(None), np.full(8, len(value)), DEPTHS + depth, bit, place, (key | np.uint32(1 << 31)) * _M3)


def _repeated(value: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs of value and context, as one number each, and how often they occur."""
    keys = value.astype(np.uint64)
    keys <<= np.uint64(32)
    keys |= context
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys)).astype(np.int32)


class Counts:
    """How often each bit was met in each cell, of all tables, the dense one last; narrow numbers, of which more stay in a core's cache."""

    def __init__(self):
        self.total, self.met = np.zeros(2 * ALL, np.int32), 0

    def full(self) -> bool:
        """Whether the next batch might count a cell beyond what a number holds: then the rows are due, and counting begins anew."""
        return self.met > MOST_COUNTED

    def add(self, base: int, bit: np.ndarray, cells: np.ndarray, n: np.ndarray) -> None:
        at = cells << 1
        at |= bit
        np.add.at(self.total[2 * base :], at, n)

    def words(self, code: Code, units: Units) -> None:
        at = np.flatnonzero(~units.letter)
        value = units.value[at]
        self.met += TABLES * int(code.length[value].sum())
        for k in range(TABLES):
            # a word that occurs often in a context is told once
            keys, n = _repeated(value, units.contexts[k, at])
            for i in range(0, len(keys), COUNTED):
                part, many = keys[i : i + COUNTED], n[i : i + COUNTED]
                d = word_decisions(code, (part >> np.uint64(32)).astype(np.int32))
                self.add(k * CELLS, d.bit, d.slots(part.astype(np.uint32)), d.each(many[d.order]))

    def letters(self, data: np.ndarray, offsets: np.ndarray) -> None:
        value, last, contexts = letters(data, offsets)
        self.met += 8 * (TABLES + 1) * len(value)
        for k in range(TABLES + 1):
            # the dense table's context is the last byte itself, only there it makes a place
            keys, n = _repeated(value, contexts[k] if k < TABLES else last)
            for i in range(0, len(keys), COUNTED):
                part, many = keys[i : i + COUNTED], n[i : i + COUNTED]
                context = part.astype(np.uint32)
                d = letter_decisions((part >> np.uint64(32)).astype(np.int32), context)
                self.add(k * CELLS, d.bit, d.slots(context) if k < TABLES else d.place, d.each(many))

    def rows(self):
        """Rows of the cells that were met, ROW cells in each."""
        wide = self.total.reshape(-1, 2 * ROW)
        met = np.flatnonzero(wide.any(1))
        for i in range(0, len(met), 1 << 13):
            part = met[i : i + (1 << 13)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in wide[part].astype(np.int64).T)], names=["cell", *_COUNTS])


_COUNTS = [f"c{i}" for i in range(2 * ROW)]


class Model:
    """The code, and the log odds of all cells."""

    def __init__(self, code: Code, odds: np.ndarray):
        self.code, self.odds = code, np.array(odds)  # an array of numpy's own may have large pages

    @staticmethod
    def learned(counts: np.ndarray) -> np.ndarray:
        """Log odds of cells with these counts of either bit."""
        n = counts.reshape(-1, 2) + np.float32(ADDED)
        return np.log(n[:, 1] / n[:, 0]).astype(np.float32)

    def bits(self, units: Units) -> np.ndarray:
        """Bits of each text of a batch; what a text gets does not depend on the others."""
        size = np.diff(units.first)
        out = np.zeros(len(size))
        order = np.argsort(size, kind="stable")
        for i in range(0, len(order), BESIDE):
            part = order[i : i + BESIDE]
            out[part] = self._side_by_side(units, units.first[part], size[part])
        return out

    def _side_by_side(self, units: Units, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        # of each predictor, text, level and strength; and of each text, level and step of log odds, the decisions that were no, and yes
        weights = np.tile(np.array(FIRST, np.float32).T[:, None, :, None], (1, len(size), 1, DEPTHS * STRENGTHS)).reshape(TABLES + 1, len(size), -1)
        right = np.zeros((len(size), 2 * DEPTHS * STEPS), np.int64)
        out = np.zeros(len(size))
        for some in self._ahead(units, first, size):
            odds = [np.empty((TABLES + 1, len(d.bit)), np.float32) for _, d, *_ in some]
            # table by table, each for many blocks: a table that is looked up at random stays in a core's cache
            for x, (_, d, a, _) in zip(odds, some):
                table = self.odds[TABLES * CELLS :] if units.letter[a[0]] else self.code.tree
                table.take(d.place, out=x[0], mode="clip")  # all places are within their tables: no second look
            for k in range(TABLES):
                table = self.odds[k * CELLS : (k + 1) * CELLS]
                for x, (_, d, a, _) in zip(odds, some):
                    table.take(d.slots(units.contexts[k, a]), out=x[k + 1], mode="clip")
            for x, (i, d, _, text) in zip(odds, some):
                out[i:] += self._block(d, x, text, weights[:, i:], right[i:])
        return out

    def _ahead(self, units: Units, first: np.ndarray, size: np.ndarray):
        """Lists of blocks, of about AHEAD decisions: first text that is not over, decisions, units, and the text of each."""
        some, many, done, nth = [], 0, 0, 0
        while done < size[-1]:
            # sizes ascend: what is left stands at the end
            i = int(np.searchsorted(size, done, side="right"))
            upto = done + (BLOCKS[nth] if nth < len(BLOCKS) else BLOCK)
            n = np.minimum(size[i:], upto) - done
            at = np.arange(int(n.sum())) + np.repeat(first[i:] + done - (np.cumsum(n) - n), n)
            text, letter = np.repeat(np.arange(len(n)), n), units.letter[at]
            # words and letters share neither weights nor records
            for kind, mine in ((0, np.flatnonzero(~letter)), (1, np.flatnonzero(letter))):
                if len(mine):
                    a = at[mine]
                    d = letter_decisions(units.value[a], units.last[a]) if kind else word_decisions(self.code, units.value[a])
                    some.append((i, d, a, text[mine]))
                    many += len(d.bit)
            if many > AHEAD:
                yield some
                some, many = [], 0
            done, nth = upto, nth + 1
        yield some

    def _block(self, d: Decisions, odds: np.ndarray, text: np.ndarray, weights: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Bits of the texts' blocks; then weights and records follow: all decisions are predicted before any is learned from."""
        text = text[d.order]
        level = d.each(text * (2 * DEPTHS))
        level += np.repeat(d.level, d.many)
        gate = level * STRENGTHS
        gate += odds[2] != 0
        gate += np.abs(odds[3]) > 1
        flat = [w.reshape(-1) for w in weights]
        z = flat[0].take(gate, mode="clip")
        z *= odds[0]
        for x, w in zip(odds[1:], flat[1:]):
            more = w.take(gate, mode="clip")
            more *= x
            z += more
        np.minimum(np.maximum(z, np.float32(-11.9), out=z), np.float32(11.9), out=z)
        p = np.exp(-z)
        p += 1
        np.reciprocal(p, out=p)
        # how often the mix was right so far, by its log odds
        z += np.float32(12)
        z *= np.float32(STEPS / 24)
        cell = level
        cell *= STEPS
        cell += z.astype(np.int32)
        told = right.reshape(-1).take(cell, mode="clip").view(np.int32)
        yes, share = told[1::2].astype(np.float32), told[::2].astype(np.float32)
        share += yes
        share += np.float32(TRUST)
        final = p * np.float32(TRUST)
        final += yes
        final /= share
        np.minimum(np.maximum(final, np.float32(LEAST), out=final), np.float32(1 - LEAST), out=final)
        bit = d.bit.astype(np.float32)
        final -= 1 - bit
        np.abs(final, out=final)
        # a unit's chance has 29 factors at most, none below LEAST
        chance, done = np.ones(len(text)), 0
        for n in d.many:
            chance[:n] *= final[done : (done := done + n)]
        cell <<= 1
        cell |= d.bit
        np.add.at(right.view(np.int32).reshape(-1), cell, np.int32(1))
        bit -= p
        step = RATE / np.sqrt(np.maximum(np.bincount(gate, minlength=len(flat[0])), 1))
        for k, x in enumerate(odds):
            x *= bit
            weights[k] += (np.bincount(gate, x, len(step)) * step).reshape(len(right), -1)
        return np.bincount(text, np.log(chance), len(right)) * -_BITS


def train(spark, texts: DataFrame, words: int = WORDS):
    """Of all ``texts`` (text): the code and the log odds, for tasks; how many tokens and distinct ones; and the counts (w, c) of the words outside the vocabulary."""
    counted = materialize(count_words(texts), "words")
    ends = texts.count()
    # a word's frequency to a 64th of a doubling: at most 64 * 63 rows
    step = F.floor(F.log2("c") * 64)
    steps = counted.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    room, least = words, float("inf")
    for r in sorted(steps, key=lambda r: -r["step"]):
        room -= r["n"]
        if room < 0:
            break
        least = r["step"]
    distinct, tokens = sum(r["n"] for r in steps), sum(r["c"] for r in steps)
    once = sum(r["n"] for r in steps if r["step"] == 0)
    outside = sum(r["c"] for r in steps if r["step"] < least)
    known = counted.filter(step >= least).toArrow().sort_by([("c", "descending"), ("w", "ascending")]) if steps and least < float("inf") else pa.table({"w": pa.array([], pa.binary()), "c": pa.array([], pa.int64())})
    code = Code(known["w"].to_pylist(), known["c"].to_numpy(), ends, outside + once + 1)
    shared = spark.sparkContext.broadcast(code)

    def count(batches):
        counts = Counts()
        for batch in batches:
            b = tv.Bytes.of(batch.column("text"))
            counts.words(shared.value, Units(shared.value, b, *_words(b), spelled=False))
            if counts.full():
                yield from counts.rows()
                counts = Counts()
        yield from counts.rows()

    def spell(batches):
        counts = Counts()
        for batch in batches:
            w = batch.column("w").cast(pa.large_binary())
            _, offsets, data = w.buffers()
            offsets = np.frombuffer(offsets, np.int64)[w.offset : w.offset + len(w) + 1]
            raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
            counts.letters(raw, offsets - offsets[0])
            if counts.full():
                yield from counts.rows()
                counts = Counts()
        yield from counts.rows()

    schema = "cell int, " + ", ".join(f"{c} long" for c in _COUNTS)
    # each distinct word is spelled once: what is new resembles words, not what is frequent
    met = texts.select("text").mapInArrow(count, schema).union(counted.select("w").mapInArrow(spell, schema))
    cells = met.groupBy("cell").agg(*[F.sum(c).alias(c) for c in _COUNTS]).toArrow()  # at most ALL / ROW rows
    total = np.zeros((ALL // ROW, 2 * ROW), np.int64)
    if cells.num_rows:
        for i, c in enumerate(_COUNTS):
            total[cells["cell"].to_numpy(), i] = cells[c].to_numpy()
    return shared, spark.sparkContext.broadcast(Model.learned(total)), tokens + ends, distinct + (ends > 0), counted.filter(step < least) if least < float("inf") else counted


def lm_scores(docs: DataFrame, held: Column, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Rows for which ``held`` is not true are learned from, all are scored.
    ``score`` is the model's log10 probability of the text's tokens,
    ``base_score`` that of single words with 0.1 added to each count.  Null and
    empty texts are an end alone and have no bits per byte; repeated rows are
    counted, and scored alike, each time; other columns are ignored; without
    rows to learn from every word is new.  An empty table gives an empty one.
    Words meet in the vocabulary by hashes of 64 bits.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    rows = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out"))
    code, odds, tokens, distinct, rare = train(spark, rows.filter(~F.col("held_out")), words)

    def run(batches):
        model = Model(code.value, odds.value)
        worth = np.log10(model.code.counts + 0.1)
        for batch in batches:
            b = tv.Bytes.of(batch.column("text"))
            units = Units(model.code, b, *_words(b))
            bits = model.bits(units)
            own = np.repeat(np.arange(batch.num_rows), np.diff(np.concatenate([[-1], units.ends])))
            known = np.bincount(own, model.code.counts[units.symbols] > 0, batch.num_rows).astype(np.int64)
            base = np.bincount(own, worth[units.symbols], batch.num_rows)
            n = np.bincount(own, minlength=batch.num_rows)
            others = np.concatenate([[0], np.cumsum(np.bincount(own[units.symbols == OTHER], minlength=batch.num_rows))]).astype(np.int32)
            spelled = pa.ListArray.from_arrays(pa.array(others), _binaries(units.data, units.offsets))
            columns = [batch.column("nth"), batch.column("doc_id"), batch.column("held_out"), *map(pa.array, (n, known, base, bits, np.diff(b.offsets))), spelled]
            yield pa.RecordBatch.from_arrays(columns, names=["nth", "doc_id", "held_out", "n_tokens", "known", "worth", "bits", "bytes", "others"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    schema = f"nth long, doc_id {ids}, held_out boolean, n_tokens long, known long, worth double, bits double, bytes long, others array<binary>"
    scored = materialize(rows.withColumn("nth", F.monotonically_increasing_id()).select("nth", "doc_id", "held_out", "text").mapInArrow(run, schema), "scored")
    rare = materialize(rare, "rare")
    found = scored.select("nth", F.explode("others").alias("w")).join(rare, "w")
    found = found.groupBy("nth").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 0.1) - F.log10(F.lit(0.1))).alias("gain"))
    out = scored.drop("others").join(found.withColumnRenamed("nth", "_nth"), F.col("nth") == F.col("_nth"), "left")
    # what a token's count is divided by
    size = F.log10(F.lit(tokens + 0.1 * (distinct + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("worth") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * size).alias("base_score"), (-F.col("bits") * F.log10(F.lit(2.0))).alias("score"),
        F.when(F.col("bytes") > 0, F.col("bits") / F.col("bytes")).alias("bits_per_byte"),
    )


def op13_context_mixing(spark, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a model of those nine in ten that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lm_scores(docs, held_out(F.col("doc_id")))
