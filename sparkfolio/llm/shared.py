"""What the operators have in common: the shared folder, stored intermediate tables, Arrow text batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named in spark.checkpoint.dir, or the session's checkpoint folder. Where both are unset, a session on
    one machine gets a temporary folder, as in tests; on a cluster that is an error.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_by_cluster:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_by_cluster = tempfile.mkdtemp(prefix="sparkfolio-")
        spark.sparkContext.setCheckpointDir(set_by_cluster)
    return set_by_cluster.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is created by whoever writes there first."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_store(folder: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a folder as Spark names it, and the path there.

    Local folders may be plain paths or begin with file:/ or file:///; s3a:// and s3n:// are what Arrow calls s3://.
    """
    scheme, _, rest = folder.partition(":")
    if folder.startswith("/") or not _ or scheme == "file":
        path = rest if scheme == "file" else folder
        return pafs.LocalFileSystem(), "/" + path.lstrip("/") if scheme == "file" else path
    return pafs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else folder)


def integer_key(df: DataFrame, key: str) -> Column:
    """The key column as a long; an error for a column of another type than an integer one, whose values might not fit."""
    kind = df.schema[key].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"column {key} has to be of an integer type, not {kind.simpleString()}")
    return F.col(key).cast("long")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values, one after the other, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches whose texts have about ``limit`` bytes; a longer text is a batch by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)


def give_back() -> None:
    """Return freed memory to the system at the end of a task; Python workers live on between tasks and stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one run after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(starts.astype(np.int64) - (ends - lengths), lengths) + np.arange(ends[-1])


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Runs of rows of equal ``keys`` as they come, without gathering them: the keys, whether they are new, the rows.

    The batches come with equal keys together; a run that goes on in the next batch is handed over in pieces.
    """
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for key in keys:
            column = batch.column(key)
            change |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            now = tuple(batch.column(key)[start].as_py() for key in keys)
            yield now, now != last, batch.slice(start, end - start)
            last = now


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Keys and all rows of each run of equal ``keys``; the batches come with equal keys together."""
    held: list[pa.RecordBatch] = []
    name = None
    for now, fresh, run in sorted_runs(batches, keys):
        if fresh and held:
            yield name, pa.Table.from_batches(held)
            held = []
        name = now
        held.append(run)
    if held:
        yield name, pa.Table.from_batches(held)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 and links a[i] - b[i], the least node that each is connected to."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    return label


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: (node, component), component the smallest node of it.

    ``edges`` has columns a and b of one orderable type, neither null. Nodes without an edge do not appear. Rounds of
    large-star and small-star steps run until nothing changes; each writes its edges to the shared folder, so a lost
    executor costs one round at most. A hub's neighbours are only ever reduced by min(), which combines before the
    shuffle, or joined with one row a node, which adaptive execution can split.
    """
    def linked_to_least(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return pairs.join(least, "a")

    def mark(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = mark(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = linked_to_least(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        joined = linked_to_least(down)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        now = stored(small.filter("a <> b").distinct(), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
