"""Packing token sequences as vector bins: limits on tokens, segments and loss-bearing tokens hold at the same time.

A task fills one sequence at a time from the examples it holds. Of those that fit whole it takes the one with the largest
dot product of its demands and what is left of the limits, each as a share of its limit. When none fits whole, one is cut
to what is left, and its rest waits for the next sequence. A sequence that cannot be filled is cut back to a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import give_back, slices, texts_of
from .token_files import encoder

#: Limits of a sequence. Where every token bears loss, the third is the first.
TOKENS, SEGMENTS = 4096, 256
#: Examples that a task holds, and the tokens of which it starts filling sequences.
HELD, READY = 512, 64 * TOKENS
#: Rows of a result batch.
ROWS = 10_000

COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]


class Example:
    """Token ids with the number of loss-bearing ones before each place; the part before ``at`` is packed."""

    __slots__ = ("key", "ids", "loss", "at")

    def __init__(self, key, ids: np.ndarray, loss: np.ndarray | None = None) -> None:
        self.key, self.ids, self.at = key, ids, 0
        self.loss = None if loss is None else np.concatenate([[0], np.cumsum(loss, dtype=np.int64)])

    def bears(self, a: int, b: int) -> int:
        return b - a if self.loss is None else int(self.loss[b] - self.loss[a])

    def reach(self, tokens: int, loss: int) -> int:
        """How many tokens from ``at`` on fit into so many tokens, so many of them loss-bearing."""
        n = min(tokens, len(self.ids) - self.at)
        if self.loss is None:
            return min(n, loss)
        return min(n, int(np.searchsorted(self.loss, self.loss[self.at] + loss, "right")) - 1 - self.at)


class Packer:
    """Fills sequences from a bounded number of examples; ``put`` gets (sequence, offset, example, from, to)."""

    def __init__(self, put: Callable, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, first: int = 0) -> None:
        self.put, self.limits = put, (tokens, segments, tokens if loss is None else loss)
        self.held: list[Example | None] = [None] * HELD
        self.free = list(range(HELD))[::-1]
        self.left = np.zeros((2, HELD), np.int64)  # tokens and loss-bearing tokens not yet packed
        self.sequence = first

    def add(self, example: Example) -> None:
        tokens, _, loss = self.limits
        n = len(example.ids)
        while n - example.at >= tokens and example.reach(tokens, loss) == tokens:
            self._close([(example, example.at, example.at + tokens)])
            example.at += tokens
        if example.at < n:
            while not self.free:
                self.fill()
            slot = self.free.pop()
            self.held[slot] = example
            self._update(slot)
            while self.left[0].sum() >= READY:
                self.fill()

    def _update(self, slot: int) -> None:
        example = self.held[slot]
        n = len(example.ids)
        self.left[:, slot] = n - example.at, example.bears(example.at, n)

    def fill(self) -> None:
        """Build one sequence of what is held."""
        tokens, segments, loss = self.limits
        room, room_loss, pieces = tokens, loss, []
        while room and len(pieces) < segments:
            n, bears = self.left
            whole = (n > 0) & (n <= room) & (bears <= room_loss)
            last = len(pieces) == segments - 1
            if whole.any() and not (last and (n > room).any()):
                value = n * (room / tokens**2) + bears * (room_loss / max(loss, 1) ** 2) + (segments - len(pieces)) / segments**2
                slot = int(np.where(whole, value, -1).argmax())
                take = int(n[slot])
            else:
                slot, take = self._longest(room, room_loss)
                if not take:
                    break
            example = self.held[slot]
            pieces.append((slot, example.at, example.at + take))
            room_loss -= example.bears(example.at, example.at + take)
            room -= take
            example.at += take
            self._update(slot)
        total = tokens - room
        over = total - (1 << total.bit_length() - 1) if room else 0
        while over:  # cut the end back; what is cut off waits
            slot, a, b = pieces.pop()
            keep = max(a, b - over)
            over -= b - keep
            self.held[slot].at = keep
            self._update(slot)
            if keep > a:
                pieces.append((slot, a, keep))
        self._close([(self.held[slot], a, b) for slot, a, b in pieces])
        for slot, _, _ in pieces:
            if self.held[slot] is not None and not self.left[0, slot]:
                self.held[slot] = None
                self.free.append(slot)

    def _longest(self, room: int, room_loss: int) -> tuple[int, int]:
        """The example of which most fits, and how much; a rest that is short is not cut any shorter if another will do."""
        n, bears = self.left
        free = np.minimum(np.minimum(n, room), np.where(bears == n, room_loss, room))
        partly = np.flatnonzero((bears > room_loss) & (bears < n))
        for slot in partly:
            free[slot] = self.held[slot].reach(room, room_loss)
        best = free.max()
        slot = int(np.where(free == best, n, -1).argmax())
        return slot, int(best)

    def _close(self, pieces: list[tuple[Example, int, int]]) -> None:
        offset = 0
        for example, a, b in pieces:
            self.put(self.sequence, offset, example, a, b)
            offset += b - a
        self.sequence += 1

    def finish(self) -> None:
        while self.left[0].any():
            self.fill()


def _packed(examples: Iterator[Example], key_type: pa.DataType, tokens: int, segments: int, loss: int | None) -> Iterator[pa.RecordBatch]:
    """Pieces of the examples; sequences are numbered from the task's partition on."""
    if tokens < 1 or segments < 1 or loss is not None and loss < 1:
        raise ValueError("limits have to be positive")
    context = TaskContext.get()
    rows: list[tuple] = []

    def put(sequence: int, offset: int, example: Example, a: int, b: int) -> None:
        crc = zlib.crc32(example.ids[a:b].astype("<u4").tobytes())
        rows.append((example.key, a, b - a, crc, len(example.ids), sequence, offset, example.bears(a, b)))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:])], ["key", *COLUMNS])

    packer = Packer(put, tokens, segments, loss, (context.partitionId() if context else 0) << 36)
    for example in examples:
        packer.add(example)
        if len(rows) >= ROWS:
            yield batch()
    packer.finish()
    if rows:
        yield batch()
    give_back()


def _shape(df: DataFrame, key: str) -> str:
    return f"key {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COLUMNS)


def pack_texts(
    df: DataFrame, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text",
    tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None,
) -> DataFrame:
    """Rows (key, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens): the pieces of all documents.

    A document is the ids of its text by the tokenizers file at ``path`` and ``end_id``; a null text is an empty one, so
    that it is its end alone. Every id lies in one piece: ``start`` ids of its document come before it, ``doc_tokens`` is
    the document's number of ids, ``ids_crc32`` the check sum of the piece's as little-endian 32-bit integers. The piece
    lies at ``offset`` of sequence ``sequence_id``, without gaps from 0. No sequence has more than ``tokens`` ids,
    ``segments`` pieces or ``loss`` loss-bearing ids (all ids are; None is no further limit). A sequence that is not full
    has a power of two of ids, so it needs no padding to its shape.

    Rows are documents, whatever their keys: null and repeated keys keep their own pieces. Texts are encoded and packed in
    one pass where they are read; nothing is shuffled. A task holds HELD documents at most, so a long text is cut while
    it goes, and a sequence holds documents of one task. The same files in the same partitions give the same result. An
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)

        def examples() -> Iterator[Example]:
            for batch in slices(batches, "text"):
                ids, bounds = model.encode(*texts_of(batch.column("text")))
                for k, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                    yield Example(batch.column("key")[k].as_py(), np.append(ids[a:b], np.uint32(end_id)))

        return _packed(examples(), kind, tokens, segments, loss)

    kind = to_arrow_type(df.schema[key].dataType)
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, _shape(df, key)).withColumnRenamed("key", key)


def pack_examples(
    df: DataFrame, key: str = "example_id", ids: str = "ids", loss_mask: str = "loss_mask",
    tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None,
) -> DataFrame:
    """Like ``pack_texts`` for rows that have their ids (array<int>) and flags of those that bear loss (array<boolean>).

    An example without flags, or with another number of them, bears loss on every id; a null flag is none. Null ids count
    as 0. An example of null or no ids has no piece. ``tokens``, ``segments`` and ``loss`` hold at the same time; an
    example may be cut anywhere, so one with more than ``loss`` flagged ids is spread over sequences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def examples() -> Iterator[Example]:
            for batch in batches:
                for k in range(batch.num_rows):
                    own, flags = batch.column("ids")[k].values, batch.column("flags")[k].values
                    if own is None or not len(own):
                        continue
                    flags = flags.fill_null(False).to_numpy(zero_copy_only=False) if flags is not None and len(flags) == len(own) else None
                    yield Example(batch.column("key")[k].as_py(), own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint32), flags)

        return _packed(examples(), kind, tokens, segments, loss)

    kind = to_arrow_type(df.schema[key].dataType)
    given = df.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"), F.col(loss_mask).cast("array<boolean>").alias("flags"))
    return given.mapInArrow(run, _shape(df, key)).withColumnRenamed("key", key)
