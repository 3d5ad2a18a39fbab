"""A stored index of vectors for retrieval: inverted lists of coarse centroids with product-quantised residuals.

``build`` fits centroids and code books on a bounded sample and writes two tables, a folder a list: short codes, and the
vectors themselves. ``search`` goes through the codes of the lists nearest to a query, and compares exactly only the few
vectors whose codes come nearest. Rights are checked before anything is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .access import readable

#: Vectors that centroids and books are fitted on, entries of a book, places that share one, and rounds of fitting.
SAMPLE, ENTRIES, PLACES, ROUNDS, SEED = 20_000, 256, 4, 10, 5
#: Files that a list may be written to, so that a large list is no single task.
FILES = 8


def _means(rows: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """``k`` centres of the rows, by rounds of assigning rows to the nearest and taking means."""
    centres = rows[random.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(rows, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, rows)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * rows @ centres.T).argmin(1)


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


class Model:
    """Centroids, and for each group of PLACES places a book of residuals."""

    def __init__(self, centroids: np.ndarray, books: np.ndarray) -> None:
        self.centroids, self.books = centroids, books  # list, place; group, entry, place

    @classmethod
    def fit(cls, rows: np.ndarray, lists: int) -> Model:
        random = np.random.default_rng(SEED)
        centroids = _means(rows, lists, random)
        rest = cls._grouped(rows - centroids[_nearest(rows, centroids)])
        entries = min(ENTRIES, len(rows))
        return cls(centroids, np.stack([_means(np.ascontiguousarray(rest[:, g]), entries, random) for g in range(rest.shape[1])]))

    @staticmethod
    def _grouped(rows: np.ndarray) -> np.ndarray:
        wide = np.pad(rows, ((0, 0), (0, -rows.shape[1] % PLACES)))
        return wide.reshape(len(rows), -1, PLACES)

    def code(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List of each row, and its entry in each book."""
        at = _nearest(rows, self.centroids)
        rest = self._grouped(rows - self.centroids[at])
        return at, np.stack([_nearest(rest[:, g], book) for g, book in enumerate(self.books)], 1).astype(np.uint8)

    def products(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of each query with the centroids, and with all entries of each book."""
        return asked @ self.centroids.T, np.einsum("qgp,gep->qge", self._grouped(asked), self.books)

    def off(self, rows: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far each row is from what its list and code say."""
        near = np.stack([book[codes[:, g]] for g, book in enumerate(self.books)], 1).reshape(len(rows), -1)[:, : rows.shape[1]]
        return np.linalg.norm(rows - self.centroids[at] - near, axis=1)

    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.centroids.tobytes(), self.books.tobytes(), *self.centroids.shape, *self.books.shape)
        spark.createDataFrame([row], "centroids binary, books binary, lists int, width int, groups int, entries int, places int").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        r = spark.read.parquet(path).first()
        return cls(np.frombuffer(r["centroids"]).reshape(r["lists"], r["width"]), np.frombuffer(r["books"]).reshape(r["groups"], r["entries"], r["places"]))


def _matrix(column: pa.Array) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def build(chunks: DataFrame, path: str, vector: str = "embedding", lists: int | None = None) -> None:
    """Write an index of ``chunks`` (file_uid, ordinal, vector) to ``path``: about sqrt(N) lists, SAMPLE / 8 at most.

    Vectors that are null, zero or of another length than most, and those with a null or non-finite place, are left out.
    """
    spark = chunks.sparkSession
    v = F.col(vector)
    good = F.size(v) > 0
    clean = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = chunks.filter(good & clean).select("file_uid", "ordinal", F.transform(v, lambda x: x.cast("float")).alias("v"))
    sizes = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if sizes is None:
        raise ValueError("there is no vector to index")
    rows = rows.filter(F.size("v") == sizes["width"])
    sample = _matrix(rows.orderBy(F.xxhash64("file_uid", "ordinal")).limit(SAMPLE).select("v").toArrow().column("v").combine_chunks())
    model = Model.fit(sample, lists or max(1, min(round(sizes["count"] ** 0.5), len(sample) // 8)))
    model.save(spark, f"{path}/model")
    sent = spark.sparkContext.broadcast(model)  # SAMPLE / 8 centroids and the books at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                units = _matrix(part.column("v"))
                at, codes = sent.value.code(units)
                off = pa.array(sent.value.off(units, at, codes))
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, packed, off, pa.array(at.astype(np.int32))], [*part.schema.names, "code", "off", "list"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    placed = rows.mapInArrow(place, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", code binary, off double, list int")
    dealt = placed.repartition("list", F.pmod(F.xxhash64("file_uid", "ordinal"), F.lit(FILES))).sortWithinPartitions("list", "file_uid", "ordinal")
    dealt.write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")


def search(
    spark: SparkSession, path: str, queries: list[list[float]], k: int = 10, probe: float = 0.6, rerank: int | None = 100,
    grants: DataFrame | None = None, scope: DataFrame | None = None,
) -> DataFrame:
    """Rows (query, rank, file_uid, ordinal, distance): for each of a bounded set of queries the ``k`` nearest found by cosine distance.

    Codes are read of the nearest lists that together are the share ``probe`` of all, at least one; of those rows that
    ``grants`` and ``scope`` (column file_uid) allow, the ``rerank`` nearest by code are compared exactly. Ties go to the
    smaller file_uid and ordinal. Queries of another length than the index's vectors are an error.

    Without ``rerank``, every row of those lists is compared exactly whose code, and how far the vector is from it, leave
    open whether it is among the ``k`` nearest; with a ``probe`` of 1 the result is exact.
    """
    model = Model.load(spark, f"{path}/model")
    asked = _unit(np.array(queries, float).reshape(len(queries), -1))
    if asked.shape[1] != model.centroids.shape[1]:
        raise ValueError(f"the index has vectors of {model.centroids.shape[1]} places")
    far, near = model.products(asked)
    most = max(1, round(probe * len(model.centroids)))
    open_ = np.zeros((len(asked), len(model.centroids)), bool)
    np.put_along_axis(open_, np.argsort(-far, axis=1)[:, :most], True, axis=1)
    stored = spark.read.parquet(f"{path}/rows").filter(F.col("list").isin(np.flatnonzero(open_.any(0)).tolist()))

    def allowed(rows: DataFrame) -> DataFrame:
        for rights in (grants, scope):
            rows = readable(rows, rights) if rights is not None else rows
        return rows

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("list").to_numpy()
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(at), -1)
            for q in range(len(asked)):
                value = np.where(open_[q, at], far[q, at] + near[q][np.arange(codes.shape[1]), codes].sum(1), -np.inf)
                best = np.argpartition(-value, rerank)[:rerank] if len(value) > rerank else np.arange(len(value))
                best = best[np.isfinite(value[best])]
                some = pa.array(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), q, np.int32)), *(batch.column(c).take(some) for c in ("file_uid", "ordinal", "list")), pa.array(value[best])], ["query", "file_uid", "ordinal", "list", "near"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ``k`` nearest of each batch, by exact products; rows that can't be nearer than a task's k-th so far are left out."""
        least = np.full(len(asked), -np.inf)
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                at = batch.column("list").to_numpy()
                off = batch.column("off").to_numpy() + 1e-9
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(at), -1)
                for q in range(len(asked)):
                    value = np.where(open_[q, at], far[q, at] + near[q][np.arange(codes.shape[1]), codes].sum(1), -np.inf)
                    some = np.flatnonzero(value + off >= least[q])
                    if not len(some):
                        continue
                    rows = batch.take(pa.array(some))
                    exact = (_matrix(rows.column("v")) * asked[q]).sum(1)
                    order = pc.sort_indices(pa.table({"n": -exact, "f": rows.column("file_uid"), "o": rows.column("ordinal")}), [("n", "ascending"), ("f", "ascending"), ("o", "ascending")])[:k]
                    best = rows.take(order)
                    if len(order) == k:
                        least[q] = max(least[q], exact[order.to_numpy()[-1]])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), q, np.int32)), *(best.column(c) for c in ("file_uid", "ordinal", "v"))], ["query", "file_uid", "ordinal", "v"])

    kinds = {f.name: f.dataType.simpleString() for f in stored.schema}
    turn = lambda *order: F.row_number().over(Window.partitionBy("query").orderBy(*order))
    asked_rows = spark.createDataFrame([(q, v.tolist()) for q, v in enumerate(asked)], "query int, asked array<double>")
    dot = F.aggregate(F.zip_with("v", "asked", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))

    def first(rows: DataFrame) -> DataFrame:
        found = rows.join(F.broadcast(asked_rows), "query").withColumn("distance", 1 - dot / size)
        return found.withColumn("rank", turn("distance", "file_uid", "ordinal")).filter(F.col("rank") <= k).select("query", "rank", "file_uid", "ordinal", "distance")

    if rerank is None:
        rows = allowed(stored.select("file_uid", "ordinal", "list", "code", "off", "v"))
        return first(rows.mapInArrow(compare, f"query int, file_uid {kinds['file_uid']}, ordinal {kinds['ordinal']}, v {kinds['v']}"))
    codes = allowed(stored.select("file_uid", "ordinal", "list", "code"))
    ranked = codes.mapInArrow(rank, f"query int, file_uid {kinds['file_uid']}, ordinal {kinds['ordinal']}, list int, near double")
    few = ranked.withColumn("turn", turn(F.desc("near"), "file_uid", "ordinal")).filter(F.col("turn") <= rerank).select("query", "file_uid", "ordinal", "list")
    exact = stored.select("file_uid", "ordinal", "list", "v").join(F.broadcast(few), ["list", "file_uid", "ordinal"])  # rerank rows a query
    return first(exact)
