"""Token counts by the whole-token shortcut: most pre-tokens are one token, which is known without merging."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .bytelevel import distinct_pieces, pretoken_starts, vocabulary
from .shared import slices, sums, texts_of

#: Counts of other pre-tokens that a Python worker remembers; when there are more, it starts anew.
REMEMBERED = 400_000
_known: dict[str, dict[bytes, int]] = {}


@cache
def whole_token_ids(path: str) -> tuple[int, ...]:
    """The proof, made once on the driver: ids of the vocabulary strings that encode alone as one token."""
    return tuple(vocabulary(path).whole())


def _counter(path: str, whole: tuple[int, ...]):
    words = vocabulary(path)
    single = {words.token[i] for i in whole}
    if words.special:
        single.add(words.special)
    seen = _known.setdefault(path, {})

    def count(piece: bytes) -> int:
        if piece in single:
            return 1
        n = seen.get(piece)
        if n is None:
            n = len(words.merged(piece))
            if len(seen) >= REMEMBERED:
                seen.clear()
            if len(piece) <= 200:
                seen[piece] = n
        return n

    return words, count


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """The columns of ``df`` but the text, with n_bytes, n_tokens and over_limit, for the byte-level vocabulary at ``path``.

    Counts are those of the tokenizers library without added special tokens; its special string inside a text is one
    token. A null or empty text has 0 bytes and 0 tokens. Rows keep their order and number; repeated rows are counted
    each. Columns of ``df`` with one of the three names are replaced, others may have any name. Texts are cut into
    pre-tokens a batch at a time, each distinct pre-token of a batch is counted once, and a text of any length is counted
    whole. Nothing is shuffled.
    """
    rest = [c for c in df.columns if c not in ("n_bytes", "n_tokens", "over_limit", text)]
    whole = df.sparkSession.sparkContext.broadcast(whole_token_ids(path))  # at most one number a vocabulary entry
    kept = [f"c{k}" for k in range(len(rest))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(rest, kept)), F.col(text).alias("t"))
    schema = StructType([*(StructField(k, rows.schema[k].dataType) for k in kept), StructField("b", LongType()), StructField("n", LongType()), StructField("o", BooleanType())])

    def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, count = _counter(path, whole.value)
        for batch in slices(batches, "t"):
            raw, bounds = texts_of(batch.column("t"))
            starts = pretoken_starts(raw, bounds, words.special)
            at, pieces = distinct_pieces(raw, starts)
            per_piece = np.fromiter(map(count, pieces), np.int64, len(pieces))
            tokens = sums(per_piece[at], np.searchsorted(starts, bounds))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.diff(bounds)), pa.array(tokens), pa.array(tokens > limit)], [*kept, "b", "n", "o"])

    return rows.mapInArrow(count_batches, schema).toDF(*rest, "n_bytes", "n_tokens", "over_limit")
