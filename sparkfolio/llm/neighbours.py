"""Approximate nearest neighbours by a forest of random-projection trees.

A tree projects vectors on one random direction a level, at right angles to the tree's other ones, and splits each node
at the median. The upper levels are fitted on a bounded sample and are the same for all; they say which task holds a
vector. The lower ones are fitted where the node's vectors are, down to leaves of LEAF vectors, however large the table.

A query looks at the leaves of all trees through one priority queue. A neighbour lies at about the distance that sampled
vectors have to theirs, in any direction, so that its offset along a projection is normal; a branch's priority is the
probability that the neighbour is on that side of every split on the way. The vectors of the most probable leaves are
ranked by exact distance.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import sorted_runs, stored
from .vectors import matrix, usable

TREES, LEAF, SAMPLE, SEED = 24, 16, 20_000, 77
#: Distances that a query takes, counted once for each tree that leads to them: so many times the number of vectors to the
#: power of POWER.
EFFORT, POWER = 22.5, 0.6
#: Vectors of a node at which the upper part of a tree ends.
NODE = 1024
#: Vectors of a node that one task holds; a larger node is dealt out in blocks, each with lower levels of its own.
BLOCK = 50_000
#: Results that a task holds while it merges those of its nodes.
HELD = 1 << 18

_X = np.linspace(-37, 37, 7401)
_COST = np.array([-math.log(0.5 * math.erfc(-x / math.sqrt(2))) for x in _X])


def cost(x: np.ndarray) -> np.ndarray:
    """-log of the probability that a standard normal value is under x."""
    return np.interp(x, _X, _COST)


class Forest:
    """Directions of all levels, and splits of the upper ones, fitted on ``sample`` (rows) of a table of ``n`` vectors."""

    def __init__(self, sample: np.ndarray, n: int, k: int = 10, effort: float = EFFORT, seed: int = SEED) -> None:
        size, width = sample.shape
        may = effort * n**POWER
        self.trees = trees = TREES
        self.leaf = max(LEAF, k + 1)
        self.upper = int(np.clip(round(math.log2(max(n, 1) / NODE)), 0, max(0, int(math.log2(max(size / 8, 1))))))
        in_node = max(n / (1 << self.upper), 1)
        self.blocks = math.ceil(in_node / BLOCK)
        self.lower = max(0, round(math.log2(in_node / self.blocks / self.leaf)))
        self.leaves = max(1, round(may / self.leaf / self.blocks))
        levels = self.upper + max(self.lower, math.ceil(math.log2(max(BLOCK / self.leaf, 1)))) + 1
        random = np.random.default_rng([seed, width])
        turns = [[np.linalg.qr(random.normal(size=(width, width)))[0].T for _ in range(-(-levels // width))] for _ in range(trees)]
        self.directions = np.stack([np.concatenate(t)[:levels] for t in turns])  # tree, level, place
        along = self.along(sample, 0, self.upper + self.lower)
        self.middle = np.median(along, axis=0)
        self.split = np.zeros((trees, 1 << self.upper))  # node k has the children 2 k and 2 k + 1, the root is 1
        for t in range(trees):
            node = np.ones(size, np.int64)
            for level in range(self.upper):
                order = np.lexsort((along[:, t, level], node))
                ends = np.searchsorted(node[order], np.arange(1 << level, (2 << level) + 1))
                for j, (a, b) in enumerate(zip(ends, ends[1:])):
                    if b > a:
                        self.split[t, (1 << level) + j] = np.median(along[order[a:b], t, level])
                node = 2 * node + (along[:, t, level] > self.split[t, node])
        # how far a neighbour is along one direction: the sample's own neighbours, in a table so much larger
        asked = sample[:: max(1, size // 200)]
        squares = (asked**2).sum(1)[:, None] + (sample**2).sum(1) - 2 * asked @ sample.T
        nth = min(size - 1, max(1, round(k * size / max(n, 1))))
        self.reach = max(math.sqrt(max(float(np.median(np.partition(squares, nth, axis=1)[:, nth])), 0)) / math.sqrt(width), 1e-12)

    def along(self, rows: np.ndarray, first: int, last: int) -> np.ndarray:
        """Projections of the rows: row, tree, level."""
        return np.tensordot(rows, self.directions[:, first:last], (1, 2))

    def nodes(self, rows: np.ndarray) -> np.ndarray:
        """For each row its lowest upper node in each tree, numbered over all trees."""
        along = self.along(rows, 0, self.upper)
        out = np.zeros((len(rows), self.trees), np.int64)
        for t in range(self.trees):
            node = np.ones(len(rows), np.int64)
            for level in range(self.upper):
                node = 2 * node + (along[:, t, level] > self.split[t, node])
            out[:, t] = (t << self.upper) + node - (1 << self.upper)
        return out

    def search(self, row: np.ndarray) -> tuple[list[int], list[float]]:
        """The nodes that a query goes to, and how improbable a leaf below each may be, for about ``leaves`` leaves in all."""
        leaves = self.leaves
        along = self.along(row[None], 0, self.upper + self.lower)[0]
        level = np.array([0] + [k.bit_length() - 1 for k in range(1, 1 << self.upper)])
        off = (along[:, level] - self.split) / self.reach if self.upper else np.zeros((self.trees, 1))
        sides = np.stack([cost(-off), cost(off)], -1).tolist()
        queue = [(0.0, t, 1) for t in range(self.trees)]
        found = []
        while queue and len(found) < leaves:
            so_far, t, node = heapq.heappop(queue)
            if node >> self.upper:
                found.append((so_far, t, node))
                continue
            for side in (0, 1):
                heapq.heappush(queue, (so_far + sides[t][node][side], t, 2 * node + side))
        below = np.zeros((self.trees, 1))  # the lower levels as they would be with the sample's medians
        for x in ((along - self.middle) / self.reach)[:, self.upper :].T:
            below = np.concatenate([below + cost(-x)[:, None], below + cost(x)[:, None]], 1)
        so_far, tree = np.array([f[0] for f in found]), np.array([f[1] for f in found])
        every = (so_far[:, None] + below[tree]).ravel()
        limit = np.partition(every, leaves - 1)[leaves - 1] if leaves < len(every) else every.max()
        kept = [(f, limit - f[0]) for f in found if f[0] + below[f[1]].min() <= limit]
        return [(t << self.upper) + node - (1 << self.upper) for (_, t, node), _ in kept], [room for _, room in kept]


class Node:
    """The lower part of a tree over the vectors of one node."""

    def __init__(self, forest: Forest, number: int, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows, self.reach = ids, rows, forest.reach
        depth = max(0, round(math.log2(max(len(rows), 1) / forest.leaf)))
        self.directions = forest.directions[number >> forest.upper, forest.upper : forest.upper + depth]
        along = rows @ self.directions.T
        order, ends, self.splits = np.arange(len(rows)), np.array([0, len(rows)]), []
        for level in range(depth):
            order = order[np.lexsort((along[order, level], np.repeat(np.arange(len(ends) - 1), np.diff(ends))))]
            middle = (ends[:-1] + ends[1:]) // 2  # halves by place, so that equal projections do not fill one side
            self.splits.append((along[order[np.maximum(middle - 1, 0)], level] + along[order[middle], level]) / 2)
            ends = np.sort(np.concatenate([ends, middle]))
        self.order, self.ends = order, ends

    def nearest(self, asked: np.ndarray, room: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """For each query the best ``k`` of the leaves that its room allows: query number, id, distance; and how many it was compared with."""
        along = asked @ self.directions.T
        costs = np.zeros((len(asked), 1))
        for level, split in enumerate(self.splits):
            off = (along[:, level, None] - split) / self.reach
            costs = np.stack([costs + cost(-off), costs + cost(off)], 2).reshape(len(asked), -1)
        visits = costs <= room[:, None]
        query, row, away = [], [], []
        for leaf in np.flatnonzero(visits.any(0)):
            there, who = self.order[self.ends[leaf] : self.ends[leaf + 1]], np.flatnonzero(visits[:, leaf])
            query.append(np.repeat(who, len(there)))
            row.append(np.tile(there, len(who)))
            away.append(np.sqrt(((self.rows[there][None] - asked[who][:, None]) ** 2).sum(2)).ravel())
        query, row, away = (np.concatenate([*x, np.zeros(0, kind)]) for x, kind in ((query, np.int64), (row, np.int64), (away, float)))
        seen = np.bincount(query, minlength=len(asked))
        order = np.lexsort((self.ids[row], away, query))
        query, row, away = query[order], row[order], away[order]
        best = np.arange(len(query)) - np.searchsorted(query, query) < k
        query, row = query[best], row[best]
        squares = (self.rows[row] - asked[query]) ** 2
        return query, self.ids[row], np.sqrt(squares.cumsum(1)[:, -1]) if len(query) else away[best], seen  # added up from the first place on


def best_of(query: np.ndarray, rid: np.ndarray, away: np.ndarray, seen: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The best ``k`` vectors of each query, each once; a query's ``seen`` is added up in its first row."""
    order = np.lexsort((rid, away, query))
    query, rid, away, seen = (x[order] for x in (query, rid, away, seen))
    starts = np.flatnonzero(np.diff(query, prepend=query[:1] - 1))
    total = np.add.reduceat(seen, starts) if len(starts) else seen
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (rid[1:] != rid[:-1])
    query, rid, away = query[new], rid[new], away[new]
    starts = np.flatnonzero(np.diff(query, prepend=query[:1] - 1))
    seen = np.zeros(len(query), np.int64)
    seen[starts] = total
    kept = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query)))) < k
    return query[kept], rid[kept], away[kept], seen[kept]


def nearest(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, effort: float = EFFORT) -> DataFrame:
    """Rows (query_id, rank, vec_id, score, scored): the ``k`` nearest found for each row of ``queries``, nearest first.

    ``score`` is the Euclidean distance in double precision, ties go to the smaller id; ``scored`` is the number of
    distances that the query took. Rows with the query's own id are no candidates. Vectors that are null, zero or hold
    null or non-finite components, and rows with a null id, take no part; vectors of different lengths have no distance,
    so each length is searched by itself. If there are no more than ``k`` candidates, all that are found are returned.

    The upper levels are fitted on at most SAMPLE vectors, those of the least hash; every row is in the index, in one
    leaf a tree. A query takes about ``effort`` times the table's size to the power of POWER in distances. Equal vectors are one in
    the index and stand for their ``k`` + 1 smallest ids, which is all that can count; so many copies of one vector
    neither fill a leaf nor a task. A task holds one node's vectors, BLOCK at most, and streams the queries past them.
    """
    spark = df.sparkSession
    clean = lambda x: x.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter(usable("v") & F.col("id").isNotNull())
    asked = clean(queries).dropDuplicates(["id", "v"])
    turn = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = clean(df).distinct().withColumn("turn", turn).filter(F.col("turn") <= k + 1)
    first = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rid", F.monotonically_increasing_id())
    first = stored(first, "vectors")
    out = None
    for length, n in sorted((r["length"], r["count"]) for r in first.groupBy(F.size("v").alias("length")).count().collect()):
        mine = F.size("v") == length
        found = _found(first.filter(mine), asked.filter(mine), n, k, effort, df.schema[vector].dataType.simpleString())
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, scored long")
    out = out.groupBy("query_id", "rid").agg(F.min("score").alias("score"), F.sum("seen").alias("seen"))
    out = out.withColumn("scored", F.sum("seen").over(Window.partitionBy("query_id")))
    near = out.withColumn("turn", F.rank().over(Window.partitionBy("query_id").orderBy("score"))).filter(F.col("turn") <= k + 1)
    near = near.join(first.select("rid", F.explode("ids").alias("vec_id")), "rid").filter("vec_id <> query_id")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.first("scored").alias("scored"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "scored")


def _found(first: DataFrame, asked: DataFrame, n: int, k: int, effort: float, kind: str) -> DataFrame:
    """Rows (query_id, rid, score, seen) over vectors of one length: the best that each task has found in its nodes."""
    spark = first.sparkSession
    sample = first.orderBy(F.xxhash64("v"), "rid").limit(SAMPLE).select("v").toArrow()
    forest = Forest(matrix(sample.column("v")), n, k, effort)
    sent = spark.sparkContext.broadcast(forest)  # directions, and splits over at most SAMPLE / 8 nodes a tree

    def parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield batch.slice(start, rows)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sent.value.trees << sent.value.upper, np.int64)
        for part in parts(batches, 2000):
            total += np.bincount(sent.value.nodes(matrix(part.column("v"))).ravel(), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["node", "n"])

    counted = first.select("v").mapInArrow(sizes, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()
    blocks = np.ones(forest.trees << forest.upper, np.int64)
    for r in counted:
        blocks[r["node"]] = -(-r["n"] // BLOCK)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 2000):
            node = sent.value.nodes(matrix(part.column("v")))
            ids = part.column("rid").to_numpy()
            block = (ids * 0x9E3779B1 >> 16 & 0xFFFF)[:, None] % blocks[node]
            at = pa.array(np.repeat(np.arange(part.num_rows), sent.value.trees))
            yield pa.RecordBatch.from_arrays([pa.array(node.ravel()), pa.array(block.ravel()), pa.array(np.full(node.size, np.nan)), part.column("rid").take(at), part.column("v").take(at)], names)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 100):
            at, node, room = [], [], []
            for k, row in enumerate(matrix(part.column("v"))):
                nodes, rooms = sent.value.search(row)
                at += [k] * len(nodes)
                node += nodes
                room += rooms
            copies = blocks[node]
            at, node, room = (np.repeat(x, copies) for x in (at, node, room))
            block = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(block), pa.array(room), part.column("id").take(rows), part.column("v").take(rows)], names)

    names = ["node", "block", "room", "id", "v"]
    shape = f"node long, block long, room double, id long, v {kind}"
    both = first.select("rid", "v").mapInArrow(place, shape).union(asked.mapInArrow(probe, shape))
    met = both.repartition("node", "block").sortWithinPartitions("node", "block", ~F.isnan("room"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, node, made, size = [], None, [], 0

        def merged() -> pa.RecordBatch:
            """What this task's nodes have found so far: the best of each query."""
            return pa.RecordBatch.from_arrays([pa.array(x) for x in best_of(*(np.concatenate(x) for x in zip(*made)), k + 1)], ["query_id", "rid", "score", "seen"])

        for (number, _), fresh, run in sorted_runs(batches, ["node", "block"]):
            if fresh:
                held, node = [], None
            is_row = np.isnan(run.column("room").to_numpy())
            cut = int(is_row.sum())  # the node's vectors come before the queries
            if cut:
                held.append((run.column("id")[:cut].to_numpy(), matrix(run.column("v")[:cut])))
            if cut == run.num_rows or not held:
                continue
            if node is None:
                node = Node(sent.value, number, *(np.concatenate(x) for x in zip(*held)))
            for part in parts([run.slice(cut)], 512):
                ids = part.column("id").to_numpy()
                query, rid, away, seen = node.nearest(matrix(part.column("v")), part.column("room").to_numpy(), k + 1)
                counts = np.zeros(len(query), np.int64)
                starts = np.flatnonzero(np.diff(query, prepend=-1))
                counts[starts] = seen[query[starts]]
                made.append((ids[query], rid, away, counts))
                size += len(query)
                if size >= HELD:
                    batch = merged()
                    made, size = [tuple(c.to_numpy() for c in batch.columns)], batch.num_rows
                    if size >= HELD // 2:
                        yield batch
                        made, size = [], 0
        if made:
            yield merged()

    return met.mapInArrow(rank, "query_id long, rid long, score double, seen long")
