"""Operator 1: exact SentencePiece encoding (merge type) and decoding.

Encoding backtracks instead of replaying merges.  An Aho-Corasick automaton
gives the longest piece at a position, and a table the next shorter ones.  A piece may
follow another only if the two, re-merged from their characters, come out as
the same two pieces; a text has exactly one chain of pieces that are all
compatible, and it is the one that merging gives.  Positions from which no
chain reaches the end are marked in a bitfield and never tried again.

Texts are cut where no piece of the vocabulary can cross, and the pieces of
recent cuts are kept, so common words are encoded once per worker.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import small_batches

SPACE = "▁"
#: Entries of each memory of a worker; a full one is emptied by and by.
CHUNKS_KEPT, PAIRS_KEPT = 300_000, 200_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        shift += 7
        if x < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The numbered fields of a protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, i = _varint(b, i)
            value = b[i : i + size]
            i += size
        yield key >> 3, value


class _Row(dict):
    """What may follow one piece: by a longest piece, the longest that fits."""

    def __init__(self, coder: "PieceCoder", left: str):
        super().__init__()
        self.coder, self.left = coder, left

    def __missing__(self, right: str) -> str | None:
        coder, left, piece = self.coder, self.left, right
        while piece is not None and left and coder.merged(left + piece) != [left, piece]:
            piece = coder.shorter.get(piece)
        if coder.pairs >= PAIRS_KEPT:
            for row in coder.rows.values():
                row.clear()
            coder.pairs = 0
        coder.pairs += 1
        self[right] = piece
        return piece


class _Words(dict):
    """Ids of words with a space before them; two generations of bounded size."""

    def __init__(self, coder: "PieceCoder"):
        super().__init__()
        self.coder, self.older = coder, {}

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            out = self.coder._of_cuts(SPACE + word)
        if len(word) <= 24:
            if len(self) >= CHUNKS_KEPT:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


class PieceCoder:
    """Encodes and decodes with one model file of the merge type."""

    def __init__(self, model: str | bytes):
        import ahocorasick
        import sentencepiece

        proto = model if isinstance(model, bytes) else open(model, "rb").read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes: list[int] = [0] * 256
        trainer, normalizer, number, kinds = {}, {}, 0, set()
        for field, value in _fields(proto):
            if field == 1:
                piece = dict(_fields(value))
                kind, text = piece.get(3, 1), piece[1].decode("utf-8")
                kinds.add(kind)
                if kind == 1:
                    self.ids[text] = number
                    self.score[text] = self.library.get_score(number)
                elif kind == 6:
                    self.bytes[int(text[3:5], 16)] = number
                number += 1
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        self.unknown = self.library.unk_id()
        self.falls_back = bool(trainer.get(35, 0))
        self.prefix = bool(normalizer.get(3, 1))
        if trainer.get(3, 1) != 2 or kinds & {4, 5}:
            raise ValueError("only merge-type models without user-defined or unused pieces are supported")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models that keep the text as it is are supported")

        usable = {p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}
        self.longest = max(map(len, usable))
        self.automaton = ahocorasick.Automaton()
        for piece in usable:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        #: The next shorter piece that starts as a piece does.
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in usable), p[0]) for p in usable if len(p) > 1}
        many = "".join(p for p in self.ids if len(p) > 1)
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in many)
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        body = f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if not crossing else f"[^{alone}]+" if alone else "(?s:.+)"
        self.cut = re.compile(f"[{alone}]|{body}" if alone else body).findall
        #: The longest piece that starts as a stretch of the automaton does.
        self.within: dict[str, str] = {}
        self.rows: dict[str, _Row] = {}
        self.pairs = 0
        self.crossing = crossing
        self._word = _Words(self)
        self._young: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._tables()

    def merged(self, text: str) -> list[str]:
        """The text's pieces by replaying merges: best score first, then leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _longest(self, part: str) -> str:
        """The longest piece with which the part starts; else its first character."""
        stretch = part[: self.automaton.longest_prefix(part)]
        piece = self.within.get(stretch)
        if piece is None:
            if not stretch:
                return part[0]
            piece = next((stretch[:n] for n in range(len(stretch), 0, -1) if stretch[:n] in self.automaton), stretch[0])
            self.within[stretch] = piece  # at most as many as the automaton has states
        return piece

    def pieces(self, text: str) -> list[str]:
        """The only chain of pieces that cover the text and all fit their neighbours."""
        size, longest, rows, shorter = len(text), self.longest, self.rows, self.shorter.get
        dead = bytearray(size // 8 + 1)
        chain: list[str] = []
        at, left = 0, ""
        piece: str | None = None
        while at < size:
            piece = self._longest(text[at : at + longest])
            while True:
                row = rows.get(left)
                if row is None:
                    row = rows[left] = _Row(self, left)
                while piece is not None:
                    piece = row[piece]
                    if piece is None:
                        break
                    end = at + len(piece)
                    if not dead[end >> 3] >> (end & 7) & 1:
                        break
                    piece = shorter(piece)
                if piece is not None:
                    break
                if not chain:
                    raise ValueError("the model's merges give no chain of pieces")
                dead[at >> 3] |= 1 << (at & 7)
                last = chain.pop()
                at -= len(last)
                left = chain[-1] if chain else ""
                piece = shorter(last)
            chain.append(piece)
            at, left = end, piece
        return chain

    def _of_chunk(self, chunk: str) -> bytes:
        """The ids of a cut as 32-bit numbers; kept in two generations of bounded size."""
        out = self._young.get(chunk) or self._older.get(chunk)
        if out is None:
            ids: list[int] = []
            for piece in self.pieces(chunk):
                number = self.ids.get(piece)
                if number is not None:
                    ids.append(number)
                elif self.falls_back:
                    ids.extend(self.bytes[x] for x in piece.encode("utf-8"))
                else:
                    ids.append(self.unknown)
            out = array("i", ids).tobytes()
        if chunk[0] != SPACE and len(chunk) <= 64:
            if len(self._young) >= CHUNKS_KEPT:
                self._older, self._young = self._young, {}
            self._young[chunk] = out
        return out

    def _of_cuts(self, text: str) -> bytes:
        return b"".join([self._of_chunk(c) for c in self.cut(text)])

    def encode_raw(self, text: str) -> bytes:
        """Ids of the text as 32-bit numbers, without begin or end ids."""
        if not text:
            return b""
        text = text.replace(" ", SPACE)
        if self.prefix:
            text = SPACE + text
        parts = text.split(SPACE)
        if self.crossing or parts[0] or "" in parts[1:]:
            out = self._of_cuts(text)
        else:  # words with one space before each
            known = self._word
            out = b"".join([known[p] for p in parts[1:]])
        if not self.falls_back:
            ids = np.frombuffer(out, np.int32)
            same = np.concatenate([[False], (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)])
            out = ids[~same].tobytes()
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of the text, without begin or end ids."""
        return np.frombuffer(self.encode_raw(text), np.int32).tolist()

    def _tables(self) -> None:
        """What each id decodes to, as one buffer and borders; -1 for ids left to the library."""
        size = self.library.get_piece_size()
        parts, self._plain = [b""] * size, np.zeros(size, dtype=bool)
        for piece, number in self.ids.items():
            parts[number] = piece.replace(SPACE, " ").encode("utf-8")
            self._plain[number] = True
        for value, number in enumerate(self.bytes):
            if number:
                parts[number] = bytes([value])
                self._plain[number] = True
        self._size = np.array([len(p) for p in parts], dtype=np.int64)
        self._start = np.concatenate([[0], np.cumsum(self._size)[:-1]])
        self._spaced = np.array([p[:1] == b" " for p in parts]) & (np.arange(size) != self.bytes[32])
        self._blob = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids) -> str:
        """The text of ids, as the library's decoder gives it.

        Pieces are gathered by array arithmetic; ids of other kinds, and bytes
        that are no UTF-8, are left to the library.
        """
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return ""
        if ids.min() < 0 or ids.max() >= len(self._plain) or not self._plain[ids].all():
            return self.library.decode(ids.tolist())
        sizes = self._size[ids]
        ends = np.cumsum(sizes)
        raw = self._blob[np.repeat(self._start[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            return self.library.decode(ids.tolist())
        return text[1:] if self.prefix and self._spaced[ids[0]] else text


_CODERS: dict[str, PieceCoder] = {}


def _coder(key: str, model: bytes) -> PieceCoder:
    """One coder per worker and model."""
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = PieceCoder(model)
    return _CODERS[key]


def _model(df: DataFrame, path: str):
    """The model's bytes for the executors (about half a megabyte, fixed by the vocabulary)."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _mapped(df: DataFrame, path: str, out: str, kind: T.DataType, work, slice_rows: int = 200) -> DataFrame:
    small_batches(df.sparkSession)
    model, names = _model(df, path), [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(out, kind)])

    def run(batches):
        coder = _coder(path, model.value)
        for batch in batches:
            for i in range(0, batch.num_rows, slice_rows):
                part = batch.slice(i, slice_rows)
                yield pa.RecordBatch.from_arrays([*map(part.column, names), work(coder, part)], names=[*names, out])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of each whole text; other columns stay, one named ``ids`` is replaced.

    Null and empty texts give an empty list; very long texts are encoded whole.
    Repeated rows give equal lists, an empty table an empty one.
    """

    def work(coder, part):
        rows = [coder.encode_raw(x) for x in part.column(text).to_pylist()]
        ends = np.cumsum([0, *(len(x) // 4 for x in rows)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))

    return _mapped(df, model_path, ids, T.ArrayType(T.IntegerType()), work)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of each list of ids; null and empty lists give the empty text."""

    def work(coder, part):
        lists = part.column(ids)
        return pa.array([coder.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in lists], pa.string())

    return _mapped(df, model_path, text, T.StringType(), work)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text of ``documents``; digests of both."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, path).select("doc_id", "ids")
    coded = coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        "ids",
    )
    return decode(coded, path).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )
