"""Quality of texts by ordinal cumulative-link regression on graded ratings.

One weight a hashed feature is shared by all grades; ordered thresholds cut the score into grades:
P(grade <= k) = logistic(threshold[k] - score). A text's expected grade and the probability that it reaches a grade
follow. Features are the distinct pieces of a text, that is its runs of letters, numbers or other signs, and a few
buckets that describe its shape (repetition, share of signs, length of lines).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .bytelevel import LETTER, OTHER, SPACE, byte_classes, distinct_pieces
from .shared import give_back, slices, sums, texts_of

BITS = 18
GRADES = 3


def _dims(pieces: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(p) & (1 << BITS) - 1 for p in pieces), np.int64, len(pieces))


def features(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text number, dimension) of the features that the texts have, by text; a text without bytes has shape only."""
    n = len(bounds) - 1
    kind = byte_classes(raw)
    start = np.zeros(len(raw) + 1, bool)
    start[1 : len(raw)] = kind[1:] != kind[:-1]
    start[bounds] = True
    starts = np.flatnonzero(start)
    words = np.zeros(n, np.int64)
    different = np.zeros(n, np.int64)
    doc = dim = np.zeros(0, np.int64)
    if len(raw):
        raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        at, pieces = distinct_pieces(raw, starts)
        first = np.searchsorted(starts, bounds)
        owner = np.repeat(np.arange(n), np.diff(first))
        real = kind[starts[:-1]] != SPACE
        word = kind[starts[:-1]] == LETTER
        pair = np.unique(owner[real] * len(pieces) + at[real])
        doc, piece = pair // len(pieces), pair % len(pieces)
        dim = _dims(pieces)[piece]
        words = sums(word.astype(np.int64), first)
        is_word = np.zeros(len(pieces), bool)
        is_word[at[word]] = True
        different = np.bincount(doc, is_word[piece], n).astype(np.int64)
    size = np.maximum(np.diff(bounds), 1)
    shape = {
        b"different": np.floor(10 * different / np.maximum(words, 1)),
        b"signs": np.minimum(np.floor(20 * sums((kind == OTHER).astype(np.int64), bounds) / size), 10),
        b"line": np.floor(np.log2(1 + words / (1 + sums((raw == 10).astype(np.int64), bounds)))),
        b"words": np.minimum(np.floor(np.log2(1 + words)), 6),
    }
    table = [_dims([b"\0%s %d" % (name, k) for k in range(64)])[v.astype(np.int64)] for name, v in shape.items()]
    doc = np.concatenate([doc, np.tile(np.arange(n), len(table))])
    dim = np.concatenate([dim, *table])
    order = np.argsort(doc, kind="stable")
    return doc[order], dim[order]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def tails(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each text the probabilities of grade 1 or more, 2 or more, and so on."""
        doc, dim = features(raw, bounds)
        score = np.bincount(doc, self.weights[dim], len(bounds) - 1)
        return _logistic(score[:, None] - self.thresholds)


def fit(docs: list[np.ndarray], grades: np.ndarray, rounds: int = 250, rate: float = 0.05, ridge: float = 3e-4, least: float = 30.0, evenly: float = 0.5) -> OrdinalModel:
    """Weights of greatest penalised likelihood, by full gradients with adaptive steps.

    A grade's texts weigh as its share to the power of 1 - ``evenly`` (1: each grade has the same say). Features that
    are spread over the grades as chance would spread them, by a chi-square under ``least``, have weight 0: words of
    single texts would else be learned by heart.
    """
    grades = grades.astype(np.int64)
    dim = np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    share = np.bincount(grades, minlength=GRADES)
    present = np.stack([np.bincount(dim[grades[doc] == k], minlength=1 << BITS) for k in range(GRADES)])
    expected = np.outer(share / max(len(docs), 1), present.sum(0))
    common = ((present - expected) ** 2 / np.maximum(expected, 1e-9)).sum(0) >= least
    doc, dim = doc[common[dim]], dim[common[dim]]
    used, column = np.unique(dim, return_inverse=True)
    weight = ((1 / np.maximum(share, 1)) ** evenly)[grades]
    weight = weight / weight.sum()
    # the parameters: weights, the first threshold, the logarithms of the steps to the others
    values = np.concatenate([np.zeros(len(used)), [-1.0], np.zeros(GRADES - 2)])
    m, v = np.zeros_like(values), np.zeros_like(values)
    for t in range(1, rounds + 1):
        w, first, steps = values[: len(used)], values[len(used)], np.exp(values[len(used) + 1 :])
        thresholds = np.concatenate([[first], first + np.cumsum(steps)])
        score = np.bincount(doc, w[column], len(docs))
        upper = _logistic(np.append(thresholds, np.inf)[grades] - score)
        lower = _logistic(np.insert(thresholds, 0, -np.inf)[grades] - score)
        upper[grades == GRADES - 1], lower[grades == 0] = 1.0, 0.0
        p = np.maximum(upper - lower, 1e-9)
        by_score = weight * (upper + lower - 1)
        up, low = weight * upper * (1 - upper) / p, weight * lower * (1 - lower) / p
        by_threshold = np.bincount(grades, up, GRADES)[:-1] - np.bincount(grades, low, GRADES)[1:]
        gradient = np.concatenate([
            np.bincount(column, by_score[doc], len(used)) - ridge * w,
            [by_threshold.sum()], by_threshold[::-1].cumsum()[::-1][1:] * steps,
        ])
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        values = values + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    weights = np.zeros(1 << BITS)
    weights[used] = values[: len(used)]
    first, steps = values[len(used)], np.exp(values[len(used) + 1 :])
    return OrdinalModel(weights, np.concatenate([[first], first + np.cumsum(steps)]))


def graded(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, grade) of the labels: 0 for toxic texts, 1 for other texts of low quality, 2 for the rest.

    Labels without an id or with neither mark are left out; of several for one id the lowest grade holds.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col(key), grade.alias("grade")).filter(F.col(key).isNotNull() & F.col("grade").isNotNull()).groupBy(key).agg(F.min("grade").alias("grade"))


def train(df: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", most: int = 6000) -> OrdinalModel | None:
    """Fit on a bounded sample: about ``most`` of the rated texts (all, if fewer), those of the least hash of their id.

    ``ratings`` has columns (key, grade) with unique keys. Features are made where the texts are; only the feature lists
    of the sample come to the driver, 1.1 * ``most`` at most, again those of the least hash, so that ids that repeat in
    ``df`` do not make them more. Equal rows count each. None without a rated text.
    """
    total = ratings.count()
    place = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30))
    limit = int((1 << 30) * min(1.0, most / max(total, 1)))
    chosen = ratings.select(F.col(key).alias("__key"), F.col("grade").cast("int").alias("__grade"), place.alias("__place")).filter(F.col("__place") < limit)
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__key")  # about ``most`` short rows

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            raw, bounds = texts_of(batch.column("__text"))
            doc, dim = features(raw, bounds)
            ends = np.searchsorted(doc, np.arange(len(bounds)))
            yield pa.RecordBatch.from_arrays([batch.column("__grade"), batch.column("__place"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(dim.astype(np.int32)))], ["grade", "place", "dims"])

    made = rows.select("__grade", "__place", "__text").mapInArrow(lists, "grade int, place long, dims array<int>")
    found = made.orderBy("place", F.xxhash64("dims")).limit(most + most // 10).toArrow()
    if not found.num_rows:
        return None
    dims = found.column("dims").combine_chunks()
    values, ends = dims.flatten().to_numpy(), np.concatenate([[0], np.cumsum(dims.value_lengths().to_numpy())])
    lists_of = [values[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
    grades = found.column("grade").to_numpy()
    order = sorted(range(len(lists_of)), key=lambda k: (int(grades[k]), lists_of[k].tobytes()))  # alike in every run
    return fit([lists_of[k] for k in order], grades[order])


def score(df: DataFrame, model: OrdinalModel | None, key: str = "doc_id", text: str = "text", grade: int = 2, least: float = 0.5, carry: bool = False) -> DataFrame:
    """Rows (key, expected_grade, tail_probability, selected), one for each row of ``df``.

    ``tail_probability`` is that of ``grade`` or more; a text is selected if it is at least ``least``. A null text counts
    as an empty one. Without a model the two numbers are null and every row is selected. With ``carry`` the result is
    (row, selected), row a struct of all columns of ``df``, so that a filter needs no join.
    """
    sent = None if model is None else df.sparkSession.sparkContext.broadcast(model)  # 2 to the power of BITS numbers
    first = F.struct(*df.columns) if carry else F.col(key)
    rows = df.select(first.alias("__key"), F.col(text).alias("__text"))
    name = "row" if carry else key
    if model is None:
        nothing = F.lit(None).cast("double")
        found = rows.select(F.col("__key").alias(name), nothing.alias("expected_grade"), nothing.alias("tail_probability"), F.lit(True).alias("selected"))
        return found.select("row", "selected") if carry else found

    def grade_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 4 << 20):
            tails = sent.value.tails(*texts_of(batch.column("__text")))
            tail = tails[:, grade - 1]
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(tails.sum(1)), pa.array(tail), pa.array(tail >= least)], ["__key", "__expected", "__tail", "__selected"])
        give_back()

    schema = StructType([StructField("__key", rows.schema["__key"].dataType), StructField("__expected", DoubleType()), StructField("__tail", DoubleType()), StructField("__selected", BooleanType())])
    found = rows.mapInArrow(grade_batches, schema)
    if carry:
        return found.select(F.col("__key").alias("row"), F.col("__selected").alias("selected"))
    return found.toDF(key, "expected_grade", "tail_probability", "selected")
