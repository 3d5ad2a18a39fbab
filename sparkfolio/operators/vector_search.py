"""Exact nearest neighbours by cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; null if a vector has length 0."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, 1 - dot(a, b) / size)


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def nearest(rows: DataFrame, query: list[float], k: int, vector: str = "embedding", order: tuple[str, ...] = ("file_uid", "ordinal"), scope: DataFrame | None = None) -> DataFrame:
    """The ``k`` rows of least distance to one query, ties by ``order``; rows without a vector never appear.

    ``scope``, a frame with some of the columns, restricts the rows before the search. The query is part of the plan, so
    nothing is joined or broadcast; each task keeps its best ``k``.
    """
    if scope is not None:
        rows = rows.join(scope, scope.columns, "left_semi")
    far = rows.filter(F.col(vector).isNotNull()).withColumn("distance", cosine_distance(F.col(vector), literal(query)))
    return far.filter("distance is not null").orderBy("distance", *order).limit(k)


#: Rows, and queries, that one task compares with each other.
BLOCK, ASKED = 20_000, 2_000


def nearest_each(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding", group: str | None = None) -> DataFrame:
    """The ``k`` nearest rows for each of a set of queries that share the column ``group``: (query_key, key, distance, rank).

    Rows and queries of a group are dealt into blocks of bounded size, so a group with most of the rows is many tasks.
    A task compares its blocks with NumPy and passes on the best ``k`` of each query, never the pairs. Null vectors, those
    of length 0 and those of another length than the query's have no distance. Keys are integers; ties go to the smaller.
    """
    part = lambda df, name: df.select(F.col(name).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(group) if group else F.lit(0)).alias("g")).filter("v is not null and g is not null")
    there, asked = part(rows, key), part(queries, query_key)
    sizes = there.groupBy("g").count().select("g", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    asks = asked.groupBy("g").count().select("g", F.ceil(F.col("count") / ASKED).cast("int").alias("asks"))
    shape = sizes.join(asks, "g")
    slot = lambda of: F.pmod(F.xxhash64("id"), F.col(of).cast("long")).cast("int")
    copies = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    there = there.join(shape, "g").withColumn("b", slot("blocks")).withColumn("a", copies("asks"))
    asked = asked.join(shape, "g").withColumn("a", slot("asks")).withColumn("b", copies("blocks"))

    def best(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        ids, lists = mine.column("id").to_numpy(), mine.column("v").to_pylist()
        q_ids, q_lists = theirs.column("id").to_numpy(), theirs.column("v").to_pylist()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for n in {len(v) for v in q_lists if v}:
            at, to = ([j for j, v in enumerate(x) if len(v) == n and None not in v and any(v)] for x in (q_lists, lists))
            if not at or not to:
                continue
            x, y = (np.array([side[j] for j in some]) for side, some in ((q_lists, at), (lists, to)))
            x, y = (m / np.sqrt((m * m).sum(1, keepdims=True)) for m in (x, y))
            names = ids[to]
            for first in range(0, len(at), 256):
                far = 1 - x[first : first + 256] @ y.T
                for row, q in zip(far, q_ids[at[first : first + 256]]):
                    near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + 1e-12) if len(row) > k else np.arange(len(row))
                    near = near[np.lexsort((names[near], row[near]))][: k + 8]
                    out.append((np.full(len(near), q), names[near], row[near]))
        return pa.table([np.concatenate(x) for x in zip(*out)], ["q", "id", "distance"])

    blocks = ["g", "a", "b"]
    found = asked.select(*blocks, "id", "v").groupBy(*blocks).cogroup(there.select(*blocks, "id", "v").groupBy(*blocks)).applyInArrow(lambda a, b: best(b, a), "q long, id long, distance double")
    order = Window.partitionBy("q").orderBy("distance", "id")
    kinds = rows.schema[key].dataType, queries.schema[query_key].dataType
    found = found.filter("distance is not null and not isnan(distance)").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select(F.col("q").cast(kinds[1]).alias(query_key), F.col("id").cast(kinds[0]).alias(key), "distance", "rank")
