"""Texts cut into chunks, and chunks into vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words whose place and sign a Python worker remembers; when there are more, it starts anew.
REMEMBERED = 400_000
#: Files whose chunks are held at a time.
ROWS = 200


def fold(text: str | None, target: int = 1200, overlap: int = 150) -> list[str]:
    """Chunks of one text: a paragraph joins the open chunk if that stays within the target, else it begins the next."""
    done: list[str] = []
    parts: list[str] = []  # of the open chunk, with its length so far
    size = 0
    for block in filter(None, map(str.strip, re.split(r"\n\s*\n", (text or "").strip()))):
        if not parts:
            parts, size = [block], len(block)
        elif size + 2 + len(block) <= target:
            parts += [block]
            size += 2 + len(block)
        else:
            full = "\n\n".join(parts)
            done.append(full)
            begin = f"{full[-overlap:]}\n\n{block}".strip() if overlap > 0 else block
            parts, size = [begin], len(begin)
    last = "\n\n".join(parts).strip()
    return [*done, last] if last else done


def chunks_of(text: Column, target: int = 1200, overlap: int = 150) -> Column:
    """Array of a text's chunks.

    Paragraphs are gathered as long as a chunk has ``target`` signs at most. The next chunk begins with the last
    ``overlap`` signs of the one before. A paragraph is never cut, however long. An empty text has no chunk. The work is
    in proportion to the text, which a fold over arrays of columns, that copies them at each step, is not.
    """
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: fold(t, target, overlap))

    return cut(text)


def chunk(df: DataFrame, uid: str = "file_uid", text: str = "content_md", target: int = 1200, overlap: int = 150) -> DataFrame:
    """Rows (uid, ordinal, text), ordinals from 0 on without gaps. A task holds the chunks of ROWS files at a time."""
    rows = df.select(F.col(uid).alias("u"), F.col(text).alias("t"))
    schema = T.StructType([T.StructField("u", rows.schema["u"].dataType), T.StructField("ordinal", T.IntegerType()), T.StructField("text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                found = [(k, n, part) for k, value in enumerate(batch.column("t")) for n, part in enumerate(fold(value.as_py(), target, overlap))]
                at, ordinals, texts = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column("u").take(pa.array(at, pa.int32())), pa.array(ordinals, pa.int32()), pa.array(texts, pa.string())], ["u", "ordinal", "text"])

    return rows.mapInArrow(cut, schema).toDF(uid, "ordinal", "text")


def _spots(words: list[str], dimension: int, known: dict[str, int]) -> np.ndarray:
    """Place + 1 of each word, negative where the word counts as -1."""
    out = np.empty(len(words), np.int64)
    for k, word in enumerate(words):
        spot = known.get(word)
        if spot is None:
            digest = hashlib.md5(word.encode()).digest()
            spot = int.from_bytes(digest[:4], "big") % dimension + 1
            spot = known[word] = spot if digest[4] & 1 else -spot
        out[k] = spot
    return out


def hash_embed(df: DataFrame, keys: list[str], text: str, dimension: int = 1024, column: str = "embedding") -> DataFrame:
    """Rows (keys, vector) for the rows of ``df``: each word adds 1 or -1 at a place given by its MD5.

    Vectors have length 1, or 0 without words. One pass over Arrow batches where the rows are; nothing is shuffled.
    """
    kept = [f"c{k}" for k in range(len(keys))]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(keys, kept)), F.col(text).alias("t"))
    schema = T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in kept), T.StructField("v", T.ArrayType(T.FloatType()))])

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                sums = np.zeros((batch.num_rows, dimension))
                for k, value in enumerate(batch.column("t")):
                    words = (value.as_py() or "").lower().split()
                    for start in range(0, len(words), 100_000):
                        if len(known) > REMEMBERED:
                            known.clear()
                        spots = _spots(words[start : start + 100_000], dimension, known)
                        sums[k] += np.bincount(np.abs(spots) - 1, np.sign(spots), dimension)
                length = np.sqrt((sums * sums).sum(1, keepdims=True))
                flat = (sums / np.where(length > 0, length, 1)).astype(np.float32).ravel()
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, dimension, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), vectors], [*kept, "v"])

    return rows.mapInArrow(embed, schema).toDF(*keys, column)


def index_files(documents: DataFrame, dimension: int = 1024, uid: str = "file_uid", text: str = "content_md") -> DataFrame:
    """Chunks with vectors of all files that have text: (uid, ordinal, text, embedding)."""
    cut = chunk(documents, uid, text)
    return hash_embed(cut, [uid, "ordinal", "text"], "text", dimension)
