"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

A suffix automaton over the vocabulary (tokens as paths, suffix links between them) reads a pre-token once and gives,
at each end, the tokens that are suffixes of the prefix read so far. Every prefix has exactly one last token in its
encoding: the suffix token that is compatible with the last token of the prefix before it. Two tokens are compatible
if merging their joined bytes gives back just these two. Back-pointers from the end give the ids. The work is linear
in the pre-token's length, so a word of a megabyte is as safe as a short one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .bytelevel import distinct_pieces, pretoken_starts, vocabulary
from .shared import give_back, slices, spread, texts_of

#: Encodings of pre-tokens, and answers of the pair test, that a Python worker remembers; beyond that it starts anew.
REMEMBERED, REMEMBERED_PAIRS = 200_000, 200_000


class PrefixEncoder:
    """Encodes single pre-tokens with the vocabulary file at ``path``."""

    def __init__(self, path: str) -> None:
        self.words = words = vocabulary(path)
        self.parts = {new: (rank, *pair) for pair, (rank, new) in sorted(words.merge.items(), key=lambda x: -x[1][0])}
        self.spines: dict[tuple[int, int], tuple] = {}
        self.answers: dict[int, bool] = {}
        self.seen: dict[bytes, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        self.length: dict[int, int] = {}
        self.whole: dict[bytes, int] = {}
        for i, text in words.token.items():
            if i == words.special_id or not self._rebuilt(i):
                continue
            self.whole[text] = i
            self.length[i] = len(text)
            self.automaton.add_word(text.decode("latin-1"), i)
        self.automaton.make_automaton()

    def _rebuilt(self, token: int) -> bool:
        """Whether the token's own bytes encode as the token: its two parts are compatible up to its own merge, and whole."""
        made = self.parts.get(token)
        if made is None:
            return len(self.words.token[token]) == 1
        rank, left, right = made
        return self._rebuilt(left) and self._rebuilt(right) and not self._crossed(left, right, rank)

    def _spine(self, token: int, side: int) -> tuple[tuple[int, float], ...]:
        """Tokens at the right (side 2) or left (side 1) end of a token while it is built, each with the rank that ends it."""
        if (known := self.spines.get((token, side))) is None:
            out, until = [], float("inf")
            while True:
                out.append((token, until))
                made = self.parts.get(token)
                if made is None:
                    break
                until, token = made[0], made[side]
            known = self.spines[out[0][0], side] = tuple(out)
        return known

    def _crossed(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether some merge of rank under ``before`` would join bytes across the border of the two tokens.

        It would if its pair stands at the border at its rank's turn: neither side has grown yet. Of equal pairs the
        one further left is merged first, so a left side that grows at the same rank is gone, a right side is not.
        """
        merge = self.words.merge
        for a, a_until in self._spine(left, 2):
            for b, b_until in self._spine(right, 1):
                found = merge.get((a, b))
                if found and found[0] < before and found[0] < a_until and found[0] <= b_until:
                    return True
        return False

    def compatible(self, left: int, right: int) -> bool:
        key = left * self.words.size + right
        answer = self.answers.get(key)
        if answer is None:
            if len(self.answers) >= REMEMBERED_PAIRS:
                self.answers.clear()
            answer = self.answers[key] = not self._crossed(left, right)
        return answer

    def encode(self, piece: bytes) -> list[int]:
        last = [-1] * (len(piece) + 1)
        length, compatible = self.length, self.compatible
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length[token]
            if not start or last[start] >= 0 and compatible(last[start], token):
                last[end] = token
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        return ids[::-1]

    def forget(self) -> None:
        """Drop what was remembered."""
        self.seen.clear()
        self.answers.clear()
        self.spines.clear()

    def packed(self, piece: bytes) -> bytes:
        """The ids as 32-bit integers."""
        out = self.seen.get(piece)
        if out is None:
            if piece == self.words.special:
                ids = [self.words.special_id]
            else:
                ids = self.encode(piece)
            out = np.array(ids, np.int32).tobytes()
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            if len(piece) <= 200:
                self.seen[piece] = out
        return out


@cache
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def _kept(df: DataFrame, columns: list[str], **more) -> tuple[DataFrame, list[str], StructType]:
    """``df`` with the columns under names of our own, which cannot clash with others, those names, and the result's schema."""
    kept = [f"c{k}" for k in range(len(columns))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(columns, kept)), *(F.col(c).alias(name) for name, (c, _) in more.items() if c))
    kinds = [StructField(k, rows.schema[k].dataType) for k in kept]
    return rows, kept, StructType([*kinds, *(StructField(name, kind) for name, (_, kind) in more.items() if kind)])


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def _encoded(batches: Iterator[pa.RecordBatch], path: str, keys: list[str], ids: str) -> Iterator[pa.RecordBatch]:
    """Batches of keys and ids for batches of keys and t, the text."""
    model = encoder(path)
    try:
        for batch in slices(batches, "t", 4 << 20):
            raw, bounds = texts_of(batch.column("t"))
            starts = pretoken_starts(raw, bounds, model.words.special)
            at, pieces = distinct_pieces(raw, starts)
            packed = [model.packed(p) for p in pieces]
            lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            flat = np.frombuffer(b"".join(packed), np.int32)
            out = flat[spread((np.cumsum(lengths) - lengths)[at], lengths[at])]
            ends = np.concatenate([[0], np.cumsum(lengths[at])])[np.searchsorted(starts, bounds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))], [*keys, ids])
    finally:
        model.forget()
        give_back()


def _decoded(batches: Iterator[pa.RecordBatch], path: str, keep: list[str], ids: str, text: str) -> Iterator[pa.RecordBatch]:
    """The batches with the column ``text`` besides ``keep``."""
    words = vocabulary(path)
    tokens = [words.token.get(i, b"") for i in range(words.size)] + [b""]
    lengths = np.array([len(t) for t in tokens])
    starts, flat = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(tokens), np.uint8)
    for whole in batches:
        for first in range(0, whole.num_rows, 1000):
            batch = whole.slice(first, 1000)
            column = batch.column(ids)
            values = column.flatten()
            if values.null_count:
                values = values.fill_null(-1)
            at = values.to_numpy(zero_copy_only=False)
            at = np.where((at >= 0) & (at < words.size), at, words.size)
            counts = np.fromiter((0 if n is None else n for n in column.value_lengths().to_pylist()), np.int64, len(column))
            ends = np.concatenate([[0], np.cumsum(lengths[at])])[np.concatenate([[0], np.cumsum(counts)])]
            raw = flat[spread(starts[at], lengths[at])].tobytes()
            out = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends.tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], [*keep, text])


def encode(df: DataFrame, path: str, key: str | list[str] = "doc_id", text: str = "text", ids: str = "ids") -> DataFrame:
    """The key columns of each row and its token ids, an array of integers in column ``ids``.

    Ids are those of the tokenizers library without added special tokens, truncation or padding; its special string
    inside a text is its one id. A null or empty text has an empty array. Rows keep their number, repeated ones too;
    other columns are dropped. A key column named like ``ids`` keeps its name, and the ids get an underscore more.
    Nothing is shuffled.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows, kept, schema = _kept(df, keys, t=(text, None), ids=(None, ArrayType(IntegerType())))
    return rows.mapInArrow(lambda batches: _encoded(batches, path, kept, "ids"), schema).toDF(*keys, _free(ids, keys))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its token ids in column ``text``, special tokens included.

    Ids outside the vocabulary, null ids and a null array give nothing; bytes that are not UTF-8 become U+FFFD. A
    column of ``df`` named like ``text`` is replaced.
    """
    keep = [c for c in df.columns if c != text]
    rows, kept, schema = _kept(df, keep, t=(None, StringType()))
    mine = kept[keep.index(ids)]
    return rows.mapInArrow(lambda batches: _decoded(batches, path, kept, mine, "t"), schema).toDF(*keep, text)


def encode_decode(df: DataFrame, path: str, key: str | list[str] = "doc_id", text: str = "text") -> DataFrame:
    """The key columns, the ``ids`` of encode() and the text ``decoded`` from them, in one pass through Python.

    Where a key column has one of the two names, the result's column gets an underscore more.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows, kept, schema = _kept(df, keys, t=(text, None), ids=(None, ArrayType(IntegerType())), d=(None, StringType()))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(_encoded(batches, path, kept, "ids"), path, [*kept, "ids"], "ids", "d")

    return rows.mapInArrow(both, schema).toDF(*keys, _free("ids", keys), _free("decoded", keys))
