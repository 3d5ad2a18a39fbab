"""Hard negatives by a multiway hyperplane tree with distance ranges between siblings.

A node has several split points; a vector belongs to the nearest one. For every split point and every sibling the node
keeps the least and greatest distance from the point to the sibling's vectors. A search for inner products in a window is
one for distances in an annulus: with one more component, sqrt(M^2 - |x|^2), all vectors have the length M of the longest,
and with 0 there for the anchor, distance^2 = |anchor|^2 + M^2 - 2 * product. A sibling is left out if, for some split
point, its range does not meet what the triangle inequality leaves of the annulus. The annulus narrows as results come in.
Leaves compare exactly, in integers.

The upper tree is fitted on a bounded sample and is the same for all tasks; its ranges are taken over all rows. The lower
ones are built where the vectors are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import integer_key, sorted_runs, stored
from .vectors import matrix

#: Split points of a node, vectors of a leaf, vectors that the upper tree is fitted on, and of those that give first bounds.
FAN, LEAF, SAMPLE, BOUNDS, SEED = 12, 128, 20_000, 2048, 41
#: Vectors that a task holds of one leaf of the upper tree; a larger leaf is dealt out in blocks.
BLOCK = 50_000
#: Queries that go down a lower tree together, and results that a task holds before it reduces them.
TOGETHER, HELD = 512, 1 << 18
#: Greatest squared length of a vector in steps: a hundred times a product has to fit into a long.
LONGEST = 1 << 56
#: Distances are rounded; ranges are widened by this share of the longest vector.
SLACK = 4e-6

ANY = np.iinfo(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def lifted(rows: np.ndarray, longest: float) -> np.ndarray:
    """The rows with the component that makes all of them as long as the longest."""
    return np.concatenate([rows, np.sqrt(np.maximum(longest - (rows * rows).sum(1), 0))[:, None]], 1)


class Tree:
    """Nodes with split points, children (a leaf k is ~k), and the ranges of distances between them."""

    def __init__(self, rows: np.ndarray, leaf: int, seed: int = SEED) -> None:
        self.points: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []
        random = np.random.default_rng(seed)
        waiting = [(np.arange(len(rows)), -1, 0)]
        while waiting:
            at, parent, place = waiting.pop()
            points = self._split_points(rows[at], random) if len(at) > leaf else rows[:0]
            if len(points) < 2:
                number = ~len(self.leaves)
                self.leaves.append(at)
            else:
                number = len(self.points)
                far = distances(rows[at], points)
                near = far.argmin(1)
                self.points.append(points)
                self.children.append([0] * len(points))
                low, high = self.blank(len(points))
                self._widen(low, high, far, near)
                self.low.append(low)
                self.high.append(high)
                waiting += [(at[near == j], number, j) for j in range(len(points))]
            if parent >= 0:
                self.children[parent][place] = number
            else:
                self.root = number

    @staticmethod
    def blank(k: int) -> tuple[np.ndarray, np.ndarray]:
        return np.full((k, k), np.inf), np.full((k, k), -np.inf)

    @staticmethod
    def _widen(low: np.ndarray, high: np.ndarray, far: np.ndarray, near: np.ndarray) -> None:
        """Take the rows' distances ``far`` (row, split point) into the ranges of the children ``near`` they belong to."""
        order = np.argsort(near, kind="stable")
        which, starts = np.unique(near[order], return_index=True)
        low[:, which] = np.minimum(low[:, which], np.minimum.reduceat(far[order], starts).T)
        high[:, which] = np.maximum(high[:, which], np.maximum.reduceat(far[order], starts).T)

    @staticmethod
    def _split_points(rows: np.ndarray, random: np.random.Generator) -> np.ndarray:
        """Of some random rows, those that lie farthest from the ones already chosen; equal rows count once."""
        some = rows[random.choice(len(rows), min(len(rows), 3 * FAN), replace=False)]
        chosen, away = [0], distances(some, some[:1])[:, 0]
        least = 1e-6 * max(float(np.abs(some).max()), 1e-300)
        while len(chosen) < FAN and away.max() > least:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, distances(some, some[chosen[-1:]])[:, 0])
        return some[chosen]

    def forget(self) -> None:
        """Drop the ranges, to take them over other rows."""
        for k, points in enumerate(self.points):
            self.low[k], self.high[k] = self.blank(len(points))

    def place(self, rows: np.ndarray, widen: bool = False) -> np.ndarray:
        """The leaf of each row; with ``widen`` the ranges take it in."""
        out = np.zeros(len(rows), np.int64)
        waiting = [(self.root, np.arange(len(rows)))]
        while waiting:
            node, at = waiting.pop()
            if node < 0:
                out[at] = ~node
                continue
            far = distances(rows[at], self.points[node])
            near = far.argmin(1)
            if widen:
                self._widen(self.low[node], self.high[node], far, near)
            waiting += [(self.children[node][j], at[near == j]) for j in np.unique(near)]
        return out

    def visits(self, asked: np.ndarray, inner: np.ndarray, outer: np.ndarray, slack: float) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves that may hold vectors at distances from inner to outer, with the queries for which they may, nearest first.

        ``outer`` may shrink from one leaf to the next.
        """
        waiting = [(self.root, np.arange(len(asked)))]
        while waiting:
            node, who = waiting.pop()
            if node < 0:
                yield ~node, who
                continue
            far = distances(asked[who], self.points[node])
            near, wide = inner[who, None], outer[who, None]
            alive = np.ones(far.shape, bool)
            for i in range(far.shape[1]):
                d = far[:, i, None]
                alive &= (self.high[node][i] >= np.maximum(near - d, d - wide) - slack) & (self.low[node][i] <= d + wide + slack)
            for j in np.argsort(-far.mean(0)):
                if alive[:, j].any():
                    waiting.append((self.children[node][j], who[alive[:, j]]))


def annulus(squares: np.ndarray, longest: float, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of lifted vectors whose products with a query of squared length ``squares`` lie from least to most."""
    whole = squares + longest
    return np.sqrt(np.maximum(whole - 2.0 * most, 0)), np.sqrt(np.maximum(whole - 2.0 * least, 0))


def best_of(query: np.ndarray, score: np.ndarray, number: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k`` of each query: higher scores first, then smaller numbers; in order of query and rank."""
    order = np.lexsort((number, -score, query))
    sorted_query = query[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_query, sorted_query) < k]


class Block:
    """The vectors of one block with the lower tree over them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, longest: float) -> None:
        order = np.argsort(ids, kind="stable")  # so that of equal vectors the smaller ids come first
        self.ids, self.labels, self.rows, self.longest = ids[order], labels[order], rows[order], longest
        self.tree = Tree(lifted(self.rows, longest), LEAF)
        self.exact = self.rows if longest < 1 << 53 else self.rows.astype(np.int64)
        self.compared = 0

    def search(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
        """Query number, product and id of the best ``k`` in each query's window, among the same label or the others."""
        squares = (rows * rows).sum(1)
        least, last = least.copy(), np.full(len(rows), ANY.max)
        inner, outer = annulus(squares, self.longest, least, most)
        asked = np.concatenate([rows, np.zeros((len(rows), 1))], 1)
        exact = rows.astype(self.exact.dtype)
        kept: list[tuple[np.ndarray, ...]] = []
        size = 0

        def reduce() -> None:
            nonlocal kept, size
            query, score, number = (np.concatenate(x) for x in zip(*kept))
            at = best_of(query, score, number, k)
            query, score, number = query[at], score[at], number[at]
            kth = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) == k - 1)
            least[query[kth]], last[query[kth]] = score[kth], number[kth]
            outer[query[kth]] = annulus(squares[query[kth]], self.longest, score[kth], score[kth])[1]
            kept, size = [(query, score, number)], len(query)

        for leaf, who in self.tree.visits(asked, inner, outer, SLACK * math.sqrt(self.longest)):
            there = self.tree.leaves[leaf]
            for start in range(0, len(there), 256):
                some = there[start : start + 256]
                score = (exact[who] @ self.exact[some].T).astype(np.int64)
                self.compared += score.size
                fits = (score >= least[who, None]) & (score <= most[who, None]) & (self.ids[some] != ids[who, None])
                fits &= (self.labels[some] == labels[who, None]) == same
                fits &= (score > least[who, None]) | (self.ids[some] <= last[who, None])
                query, row = np.nonzero(fits)
                if len(query):
                    kept.append((who[query], score[query, row], self.ids[some[row]]))
                    size += len(query)
                    if size > 2 * k * len(rows):
                        reduce()
        if not kept:
            none = np.zeros(0, np.int64)
            return none, none, none
        reduce()
        return kept[0]


class Index:
    """The upper tree of a table of ``n`` vectors with its blocks, and some vectors that give first bounds."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, n: int, longest: int) -> None:
        self.longest = float(max(longest, 1))
        leaves = max(1, round(math.sqrt(n) / 8))
        self.tree = Tree(lifted(rows, self.longest), max(8, math.ceil(len(rows) / leaves)))
        self.tree.forget()
        few = slice(0, max(1, min(BOUNDS, len(rows) // 8)))
        self.ids, self.labels, self.rows = ids[few], labels[few], rows[few]
        self.blocks = np.ones(len(self.tree.leaves), np.int64)

    def bounds(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, same: bool) -> np.ndarray:
        """Products that at least ``k`` vectors in each query's window reach, as far as the few known ones tell."""
        exact = np.float64 if self.longest < 1 << 53 else np.int64
        score = (rows.astype(exact) @ self.rows.T.astype(exact)).astype(np.int64)
        fits = (score >= least[:, None]) & (score <= most[:, None]) & (self.ids != ids[:, None]) & ((self.labels == labels[:, None]) == same)
        score = np.where(fits, score, ANY.min)
        if score.shape[1] < k:
            return least
        return np.maximum(least, -np.partition(-np.maximum(score, -ANY.max), k - 1, axis=1)[:, k - 1])


NAMES = ["leaf", "block", "query", "number", "id", "label", "least", "most", "v"]
SHAPE = "leaf long, block long, query boolean, number long, id long, label long, least long, most long, v array<double>"


def _parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _index(rows: DataFrame, n: int, longest: int):
    """An Index of all rows, as a broadcast: at most SAMPLE / 8 leaves with the ranges between them."""
    context = rows.sparkSession.sparkContext
    sample = rows.orderBy(F.xxhash64("v"), "number").limit(SAMPLE).select("id", "label", "v").toArrow()
    index = Index(sample.column("id").to_numpy(), sample.column("label").to_numpy(), matrix(sample.column("v")), n, longest)
    fitted = context.broadcast(index)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, counts = fitted.value.tree, np.zeros(len(fitted.value.blocks), np.int64)
        tree.forget()  # the worker may have used it for another task
        for part in _parts(batches, 2000):
            counts += np.bincount(tree.place(lifted(matrix(part.column("v")), fitted.value.longest), True), minlength=len(counts))
        out = [(-1, leaf, 0, 0.0, 0.0, int(c)) for leaf, c in enumerate(counts) if c]
        for node, (low, high) in enumerate(zip(tree.low, tree.high)):
            out += [(node, int(i), int(j), float(low[i, j]), float(high[i, j]), 0) for i, j in zip(*np.nonzero(high >= low))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)] if out else [pa.array([], t) for t in ("i8", "i8", "i8", "f8", "f8", "i8")], ["node", "i", "j", "low", "high", "n"])

    ranges = rows.select("v").mapInArrow(measure, "node long, i long, j long, low double, high double, n long")
    for r in ranges.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():
        if r["node"] < 0:
            index.blocks[r["i"]] = -(-r["n"] // BLOCK)
        else:
            index.tree.low[r["node"]][r["i"], r["j"]], index.tree.high[r["node"]][r["i"], r["j"]] = r["low"], r["high"]
    return context.broadcast(index)


def _search(rows: DataFrame, asked: DataFrame, sent, k: int, same: bool) -> DataFrame:
    """Rows (number, rank, id, score): for each of ``asked`` the best ``k`` of ``rows`` with products from least to most."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for part in _parts(batches, 2000):
            leaf = index.tree.place(lifted(matrix(part.column("v")), index.longest))
            number = part.column("number").to_numpy()
            block = ((number * 0x9E3779B1 >> 16) & 0xFFFFFF) % index.blocks[leaf]
            zero, no = pa.array(np.zeros(len(leaf), np.int64)), pa.array(np.zeros(len(leaf), bool))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(block), no, part.column("number"), part.column("id"), part.column("label"), zero, zero, part.column("v")], NAMES)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for part in _parts(batches, 256):
            ids, labels, low, high = (part.column(c).to_numpy() for c in ("id", "label", "least", "most"))
            v = matrix(part.column("v"))
            low = index.bounds(ids, labels, v, low, high, k, same)
            inner, outer = annulus((v * v).sum(1), index.longest, low, high)
            for leaf, who in index.tree.visits(np.concatenate([v, np.zeros((len(v), 1))], 1), inner, outer, SLACK * math.sqrt(index.longest)):
                for block in range(index.blocks[leaf]):
                    at, n = pa.array(who), len(who)
                    same_for_all = [pa.array(np.full(n, leaf)), pa.array(np.full(n, block)), pa.array(np.ones(n, bool))]
                    yield pa.RecordBatch.from_arrays([*same_for_all, *(part.column(c).take(at) for c in ("number", "id", "label")), pa.array(low[who]), pa.array(high[who]), part.column("v").take(at)], NAMES)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, made, size = [], None, [], 0

        def reduced() -> list[tuple[np.ndarray, ...]]:
            number, score, ids = (np.concatenate(x) for x in zip(*made))
            at = best_of(number, score, ids, k)
            return [(number[at], score[at], ids[at])]

        for _, fresh, run in sorted_runs(batches, ["leaf", "block"]):
            if fresh:
                held, block = [], None
            cut = run.num_rows - int(run.column("query").to_numpy(zero_copy_only=False).sum())  # the vectors come before the queries
            if cut:
                held.append((run.column("id")[:cut].to_numpy(), run.column("label")[:cut].to_numpy(), matrix(run.column("v")[:cut])))
            if cut == run.num_rows or not held:
                continue
            if block is None:
                block = Block(*(np.concatenate(x) for x in zip(*held)), sent.value.longest)
            for part in _parts([run.slice(cut)], TOGETHER):
                number, ids, labels, low, high = (part.column(c).to_numpy() for c in ("number", "id", "label", "least", "most"))
                query, score, found = block.search(ids, labels, matrix(part.column("v")), low, high, k, same)
                made.append((number[query], score, found))
                size += len(query)
                if size >= HELD:
                    made = reduced()
                    size = len(made[0][0])
                    if size >= HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made[0]], ["number", "score", "id"])
                        made, size = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in reduced()[0]], ["number", "score", "id"])

    both = rows.select("number", "id", "label", "v").mapInArrow(place, SHAPE).union(asked.select("number", "id", "label", "least", "most", "v").mapInArrow(route, SHAPE))
    met = both.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "query")
    found = met.mapInArrow(rank, "number long, score long, id long")
    turn = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", turn).filter(F.col("rank") <= k).select("number", "rank", "id", "score")


def hard_negatives(
    df: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each positive.

    Components count as floor(scale * x), scores are inner products of those, exact integers. A row for which ``anchors``
    holds has as positives the first ``positives`` rows of its label and another id: higher scores first, then smaller
    ids. For each of them come the first ``negatives`` rows of other labels, in the same order, whose score in hundredths
    of the positive's lies within ``window``, both ends included; a positive of negative score has none.

    Rows with a null key or label, or a vector that is null, empty, or holds a null or non-finite component take no part,
    nor do vectors longer than 2^28 steps, whose scores might not fit. A zero vector takes part: its scores are 0. Vectors
    of different lengths have no score. Each row counts, repeated ones too: a repeated anchor has its results as often,
    and rows of one id are no positives of each other. Key and label have to be of integer types. An empty table gives
    no rows.

    The upper tree is fitted on SAMPLE vectors at most, those of the least hash; all rows are placed and searched, and
    the result is exact. Anchors are dealt to the leaves that their annulus meets; where vectors are independent of each
    other in many dimensions, that is nearly all of them.
    """
    spark, v = df.sparkSession, F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(
        integer_key(df, key).alias("id"), integer_key(df, label).alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.when(~bad & (F.size(v) > 0), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double"))).alias("v"),
    )
    rows = rows.withColumn("squares", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.col("squares") < LONGEST))
    rows = stored(rows.withColumn("number", F.monotonically_increasing_id()), "steps")
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sizes = rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n"), F.max("squares").alias("longest"), F.max("anchor").alias("some"))
    for length, n, longest, some in sorted(tuple(r) for r in sizes.collect()):
        if not some:
            continue
        mine = rows.filter(F.size("v") == length)
        sent = _index(mine, n, int(longest))
        asked = mine.filter("anchor").withColumns({"least": F.lit(int(ANY.min) // 4), "most": F.lit(int(ANY.max) // 4)})
        near = _search(mine, asked, sent, positives, True).withColumnsRenamed({"number": "of", "id": "positive_id", "score": "positive_score"})
        found = near.filter("positive_score >= 0").join(asked.select(F.col("number").alias("of"), F.col("id").alias("anchor_id"), "label", "v"), "of")
        found = stored(found.withColumn("number", F.col("of") * positives + F.col("rank") - 1).drop("rank", "of"), "positives")
        score = F.col("positive_score")
        ends = {"id": F.col("anchor_id"), "least": F.expr(f"(positive_score * {window[0]} + 99) div 100"), "most": F.expr(f"positive_score * {window[1]} div 100")}
        hard = _search(mine, found.withColumns(ends), sent, negatives, False).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        named = hard.join(found.select("number", "anchor_id", "positive_id", score), "number")
        out = out.union(named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    return out
