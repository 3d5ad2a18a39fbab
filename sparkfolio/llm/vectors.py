"""Near-duplicate vectors by Euclidean p-stable hashing.

A table's hash of a normalised vector is a tuple of random projections on normal directions, shifted and cut into steps
of one width. Vectors that share a table's hash and a label are compared exactly. The number of projections follows from
the number of vectors of the largest label, so that vectors at right angles hardly meet, and the number of tables from
that: two vectors at the threshold share some table with probability 1 - MISSED, closer ones with more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, local_roots, sorted_groups, stored

WIDTH, PROJECTIONS, TABLES, SEED = 1.5, 8, 16, 20_240
#: Share of the pairs just at the threshold that no table finds, and vectors at right angles that may share a bucket.
MISSED, STRANGERS = 0.04, 2.0
#: Distinct vectors of a bucket that are compared in one piece; larger buckets are split into pairs of blocks. Of a piece,
#: so many rows are compared with the others at a time.
BLOCK, STRIP = 2000, 256


def usable(column: str):
    """Whether a vector has a length, only finite components and not only zeros."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """The rows over their lengths; scaled first, so that very large or small components are safe."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def same_step(distance: float) -> float:
    """Probability that two vectors of that distance fall into one step of a projection."""
    x = WIDTH / distance
    return math.erf(x / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def shape(n: int, least: float) -> tuple[int, int]:
    """Projections a table, and tables, for ``n`` vectors of a label and pairs of cosine ``least``."""
    projections = max(4, math.ceil(math.log(max(n, 1) / STRANGERS) / -math.log(same_step(math.sqrt(2)))))
    together = same_step(math.sqrt(max(2 - 2 * least, 1e-6))) ** projections
    return projections, max(1, math.ceil(math.log(MISSED) / math.log(1 - together)))


@cache
def _random(length: int, projections: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    random = np.random.default_rng([SEED, length])
    n = projections * tables
    return random.normal(size=(length, n)), random.random(n) * WIDTH, random.integers(1 << 62, size=(tables, projections)) * 2 + 1


def hashes(rows: np.ndarray, projections: int = PROJECTIONS, tables: int = TABLES) -> np.ndarray:
    """One 64-bit key a table for each row."""
    directions, shift, factors = _random(rows.shape[1], projections, tables)
    steps = np.floor((unit(rows) @ directions + shift) / WIDTH).astype(np.int64).reshape(-1, tables, projections)
    with np.errstate(over="ignore"):
        return (steps * factors).sum(2)


def hash_lists(column: pa.Array, projections: int, tables: int) -> pa.ListArray:
    """The keys of vectors of any lengths, a list for each."""
    lengths = column.value_lengths().to_numpy()
    keys = np.zeros((len(column), tables), np.int64)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        for first in range(0, len(at), 2000):
            some = at[first : first + 2000]
            keys[some] = hashes(matrix(column.take(pa.array(some))), projections, tables)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))


def piece_links(v: np.ndarray, keys: np.ndarray, t: int, n: np.ndarray, own: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of one piece of table ``t``: for each of its unit vectors the rows linked, and the least vector connected.

    Pairs that share an earlier table are left to it. With ``own``, only pairs of different blocks count. ``n`` is the
    number of rows of each vector. A strip's near pairs are all that is held, and tables are looked at one by one for the
    pairs that no earlier one has, so memory does not grow with pairs times tables, however many pairs are near.
    """
    links, root = np.zeros(len(v), np.int64), np.arange(len(v))
    for start in range(0, len(v), STRIP):
        near = v[start : start + STRIP] @ v.T >= least
        near[np.arange(len(near)), start + np.arange(len(near))] = False
        if own is not None:
            near &= own[start : start + STRIP, None] != own
        a, b = np.nonzero(near)
        a += start
        for earlier in range(t):
            if not len(a):
                break
            apart = keys[a, earlier] != keys[b, earlier]
            a, b = a[apart], b[apart]
        if len(a):
            links += np.bincount(a, n[b], len(v)).astype(np.int64)
            one = a < b
            tied = np.flatnonzero(root != np.arange(len(v)))
            root = local_roots(len(v), np.concatenate([tied, a[one]]), np.concatenate([root[tied], b[one]]))
    return links, root


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93) -> DataFrame:
    """Rows (key, n_links, component_id, kept), one for each row of ``df``.

    Two rows are linked if their labels are equal and not null, their vectors have the same length, and the cosine in
    double precision is at least ``least``. ``n_links`` counts the other rows linked directly; rows of equal vector and
    label are linked with each other. ``component_id`` is the smallest key reachable by links, ``kept`` whether it is
    the row's own. Vectors that are null, zero or hold null or non-finite components, and vectors without a label, link
    with nothing. A null key takes part but names no component. Keys may repeat; each row counts.

    The tables miss about MISSED of the pairs just at ``least``, and hardly any that are closer, so n_links may be short
    of such a pair; no pair below ``least`` is linked.

    Equal vectors are one until the end, with their number as weight, so a large group of copies is one vector. Only keys
    are grouped into buckets; the vectors of those with company follow. Buckets of more than BLOCK distinct vectors are
    dealt out as pairs of blocks, so no task holds a whole bucket. A pair that shares several tables counts in the first.
    From each piece come sums and one link a vector, never its pairs.
    """
    rows = df.select(F.col(key).alias("__key"), F.col(vector).alias("__vector"), F.col(label).alias("__label"))
    rows = rows.withColumn("__ok", usable("__vector") & F.col("__label").isNotNull())
    distinct = stored(
        rows.filter("__ok").groupBy("__label", "__vector").agg(F.count("*").alias("n"), F.min("__key").alias("least"))
        .withColumn("rid", F.monotonically_increasing_id()), "vectors",
    )
    spaces = distinct.select("rid", F.col("__label").alias("label"), F.size("__vector").alias("length"), F.col("__vector").alias("v"), "n")
    projections, tables = shape(spaces.groupBy("label", "length").count().agg(F.max("count")).first()[0] or 1, least)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("rid"), hash_lists(batch.column("v"), projections, tables)], ["rid", "keys"])

    signed = spaces.select("rid", "v").mapInArrow(sign, "rid long, keys array<long>")
    shares = stored(signed.select("rid", F.posexplode("keys").alias("t", "h")).join(spaces.select("rid", "label", "length"), "rid"), "signed")
    bucket = ["label", "length", "t", "h"]
    crowd = stored(shares.groupBy(*bucket).agg(F.count("*").alias("crowd")).filter("crowd > 1"), "buckets")
    blocks = F.ceil(F.col("crowd") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rid"), blocks.cast("long")).cast("int")
    dealt = shares.join(crowd, bucket).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    piece = [*bucket, "low", "high"]
    dealt = dealt.select(*bucket, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rid")
    dealt = dealt.join(spaces.select("rid", "v", "n"), "rid").select(*piece, "own", "rid", "v", "n")

    def with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, hash_lists(batch.column("v"), projections, tables)], [*batch.schema.names, "keys"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, t, _, low, high), group in sorted_groups(with_keys(batches), piece):
            if group.num_rows < 2:
                continue
            rid, n, own_block = (group.column(c).to_numpy() for c in ("rid", "n", "own"))
            v = unit(matrix(group.column("v")))
            keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, tables)
            links, root = piece_links(v, keys, t, n, own_block if low != high else None, least)
            some = np.flatnonzero(links)
            if not len(some):
                continue
            yield pa.RecordBatch.from_arrays([pa.array(rid[some]), pa.array(links[some]), pa.array(rid[root[some]])], ["rid", "links", "root"])

    found = stored(dealt.repartition(*piece).sortWithinPartitions(*piece).mapInArrow(compare, "rid long, links long, root long"), "found")
    parts = connected_components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    joined = (
        distinct.join(counts, "rid", "left").join(parts, F.col("rid") == F.col("node"), "left")
        .select("__label", "__vector", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rid").alias("part"))
    )
    named = joined.groupBy("part").agg(F.min("least").alias("component_id"))
    answer = stored(joined.join(named, "part").select("__label", "__vector", "n_links", "component_id"), "answer")
    linked = rows.filter("__ok").select("__key", "__label", "__vector").join(answer, ["__label", "__vector"]).select("__key", "n_links", "component_id")
    alone = rows.filter("not __ok").select("__key", F.lit(0).cast("long").alias("n_links"), F.col("__key").cast("long").alias("component_id"))
    out = linked.select("__key", "n_links", F.col("component_id").cast("long").alias("component_id")).union(alone)
    return out.select(F.col("__key").alias(key), "n_links", "component_id", F.col("__key").eqNullSafe(F.col("component_id")).alias("kept"))
