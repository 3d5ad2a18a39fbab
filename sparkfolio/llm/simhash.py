"""Near-duplicates by SimHash, linked through a hierarchical index in Gray order.

All distinct fingerprints are sorted by Gray rank, so that neighbours in the order share bits, and cut into shards of
SHARD. Each upper node of the index holds the bits that all below it share and its parent does not yet hold; a search adds
up differences on its way down and leaves out a whole group as soon as they are too many. The nodes over the shards, one
row a shard, go to every task and say which shards a fingerprint has to be looked up in; the nodes below are made in the
task that has the shard. Of random fingerprints, a search for 2 differences reads about b * b / 2 of 2 to the power of b
shards. What leaves a shard is one link a fingerprint and piece of queries, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, give_back, local_roots, slices, sorted_runs, stored

DISTANCE = 2
#: Children of a node.
FANOUT = 8
#: Fingerprints of a shard, and queries that go down the index together.
SHARD, TOGETHER = 8192, 512


def fingerprint(text: bytes, size: int = 3) -> bytes:
    """The 8 bytes of the SimHash over shingles of ``size`` words."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    if len(words) < size:
        return xxhash.xxh64_digest(b" ".join(words), 42)
    n = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    for first in range(0, n, 1 << 15):
        part = words[first : first + (1 << 15) + size - 1]
        codes = b"".join([xxhash.xxh64_digest(b" ".join(s), 42) for s in zip(*(part[k:] for k in range(size)))])
        ones += np.unpackbits(np.frombuffer(codes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, __fp), the fingerprint as a signed long, for every row; a null text is like an empty one: 0."""
    kind = df.schema[key].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            codes = b"".join([fingerprint((t or "").encode()) for t in batch.column("__text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(np.frombuffer(codes, ">i8").astype(np.int64))], [key, "__fp"])
        give_back()

    return df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(compute, f"`{key}` {kind}, __fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_order(code: Column) -> Column:
    """Signed long that sorts codes, signed longs too, by Gray rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Hierarchical index over groups of 64-bit codes in Gray order, given as the AND and the OR of each group's codes.

    ``visits`` counts the nodes that searches have looked at.
    """

    def __init__(self, every: np.ndarray, some: np.ndarray) -> None:
        all_, any_ = [every], [some]
        while len(all_[-1]) > 1:
            cuts = np.arange(0, len(all_[-1]), FANOUT)
            all_.append(np.bitwise_and.reduceat(all_[-1], cuts))
            any_.append(np.bitwise_or.reduceat(any_[-1], cuts))
        shared = [~(a ^ o) for a, o in zip(all_, any_)]
        self.levels = []  # from the top: pattern, and the bits that the node adds to its parent's
        for level in reversed(range(len(all_))):
            above = shared[level + 1].repeat(FANOUT)[: len(all_[level])] if level + 1 < len(all_) else np.uint64(0)
            self.levels.append((all_[level], shared[level] & ~above))
        self.visits = 0

    @classmethod
    def of_codes(cls, codes: np.ndarray) -> GrayIndex:
        return cls(codes, codes)

    def within(self, queries: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query number, group number) of which the group's shared bits differ from the query's in ``distance`` at most.

        They come for some queries after the others; each query's groups come together.
        """
        for first in range(0, len(queries), TOGETHER):
            part = queries[first : first + TOGETHER]
            query, node = np.arange(len(part)), np.zeros(len(part), np.int64)
            differ = np.zeros(len(part), np.int64)
            for depth, (pattern, added) in enumerate(self.levels):
                if depth:
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    query, differ = query.repeat(FANOUT), differ.repeat(FANOUT)
                    real = node < len(pattern)
                    query, node, differ = query[real], node[real], differ[real]
                self.visits += len(node)
                differ = differ + np.bitwise_count((part[query] ^ pattern[node]) & added[node])
                near = differ <= distance
                query, node, differ = query[near], node[near], differ[near]
            yield query + first, node


def _joined(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1 << 20) -> np.ndarray:
    """For nodes 0 to n - 1 the least node that the pairs lead to; about ``most`` pairs are held at a time."""
    label, held, size = np.arange(n), [], 0
    for pair in pairs:
        held.append(pair)
        size += len(pair[0])
        if size >= most:
            label = local_roots(n, *(np.concatenate(x) for x in zip(*held, (np.arange(n), label))))
            held, size = [], 0
    return local_roots(n, *(np.concatenate(x) for x in zip(*held, (np.arange(n), label)))) if held else label


def _links(index: GrayIndex, codes: np.ndarray, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the searches connect: codes, and one that each is linked to, of ``codes`` then ``queries``."""
    both = np.concatenate([codes, queries])
    label = _joined(len(both), ((query + len(codes), node) for query, node in index.within(queries, distance)))
    linked = both != both[label]
    return both[linked], both[label[linked]]


def group_roots(codes: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """The codes in ascending order, and for each the least code that links among them lead to."""
    codes = np.sort(codes)
    place = np.argsort(gray_rank(codes))
    pairs = GrayIndex.of_codes(codes[place]).within(codes, distance)
    return codes, codes[_joined(len(codes), ((query, place[node]) for query, node in pairs))]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted fingerprints cut into shards, numbered in order."""
    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def cut(codes: np.ndarray) -> pa.RecordBatch:
        nonlocal number
        number += 1
        ends = [np.bitwise_and.reduce(codes), np.bitwise_or.reduce(codes)]
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), *(pa.array([e], pa.int64()) for e in ends), pa.array([codes.tobytes()])], ["shard", "every", "some", "codes"])

    for batch in batches:
        held.append(batch.column(0).to_numpy())
        size += batch.num_rows
        if size >= SHARD:
            codes = np.concatenate(held)
            for first in range(0, size - SHARD + 1, SHARD):
                yield cut(codes[first : first + SHARD])
            held, size = [codes[size - size % SHARD :]], size % SHARD
    if size:
        yield cut(np.concatenate(held))


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) of column __fp, distinct values, such that linked values are the components at ``distance``."""
    ranged = prints.select("__fp", gray_order(F.col("__fp")).alias("rank")).repartitionByRange("rank").sortWithinPartitions("rank")
    shards = stored(ranged.select("__fp").mapInArrow(_shards, "shard long, every long, some long, codes binary"), "shards")
    upper = shards.select("shard", "every", "some").orderBy("shard").toArrow()  # one row for SHARD fingerprints
    if not upper.num_rows:
        return prints.sparkSession.createDataFrame([], "a long, b long")
    sent = prints.sparkSession.sparkContext.broadcast([upper.column(c).to_numpy() for c in ("shard", "every", "some")])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shard's fingerprints, under the later shards in which they have to be looked up."""
        numbers, every, some = sent.value
        index = GrayIndex(every.view(np.uint64), some.view(np.uint64))
        for batch in batches:
            for own, codes in zip(batch.column("shard").to_pylist(), batch.column("codes")):
                codes = np.frombuffer(codes.as_buffer(), np.uint64)
                pairs = list(index.within(codes, distance))
                query, shard = (np.concatenate(x) for x in zip(*pairs))
                later = numbers[shard] > own
                query, shard = query[later], shard[later]
                order = np.argsort(shard, kind="stable")
                to, starts = np.unique(shard[order], return_index=True)
                parts = np.split(codes[query[order]], starts[1:]) if len(to) else []
                yield pa.RecordBatch.from_arrays([pa.array(numbers[to]), pa.array(np.ones(len(to), np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], ["shard", "kind", "codes"])

    schema = "shard long, kind int, codes binary"
    asked = shards.select("shard", "codes").mapInArrow(look_up, schema)
    met = shards.select("shard", F.lit(0).alias("kind"), "codes").union(asked).repartition("shard").sortWithinPartitions("shard", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, fresh, run in sorted_runs(batches, ["shard"]):
            for blob in run.column("codes"):
                queries = np.frombuffer(blob.as_buffer(), np.uint64)
                if fresh:  # the shard itself comes first
                    codes, index, fresh = queries, GrayIndex.of_codes(queries), False
                    a, b = _links(index, codes[:0], codes, distance)
                else:
                    a, b = _links(index, codes, queries, distance)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return met.mapInArrow(search, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, fingerprint, component_id), one for each row of ``df``.

    ``fingerprint`` has 16 hex digits; ``component_id`` is the smallest id in the documents reachable by links of
    fingerprints that differ in 2 bits at most. Texts without a word, null ones too, have fingerprint 0 and are linked
    like any other. Rows may repeat ids or texts. A row with a null id takes part, but gives no component its name; if
    a component has null ids only, its name is null.
    """
    prints = stored(fingerprints(df, key, text), "fingerprints")
    distinct = prints.groupBy("__fp").agg(F.min(key).alias("__least"))
    parts = connected_components(links(distinct.select("__fp")))
    placed = distinct.join(parts, F.col("__fp") == F.col("node"), "left").select("__fp", "__least", F.coalesce("component", "__fp").alias("__part"))
    named = placed.join(placed.groupBy("__part").agg(F.min("__least").alias("component_id")), "__part").select("__fp", "component_id")
    named = stored(named, "components")
    return prints.join(named, "__fp").select(key, F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")
