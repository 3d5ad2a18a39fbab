"""The best matches of a full-text query without reading all postings: blocks of files with bounds on their rank."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored
from .access import readable
from .search import Query, lexeme_part, matching, spread

#: Files of a block, blocks that are read first, and how many times more each time after.
BLOCK, FIRST, TIMES = 256, 16, 4


def store_blocks(index: DataFrame, path: str, block: int = BLOCK, lengths: DataFrame | None = None) -> None:
    """Write an inverted index by blocks of about ``block`` files, with the number of places of each posting beside it.

    Files are put in order of their length, those of one length by a hash of their ids, so that those in which words stand
    often are together and the bounds of the blocks differ. Postings lie by stem and block, so that a few blocks of a stem
    are a few row groups; a part of the stems is spread over tasks by blocks. The index is shuffled once if it has a column
    ``length`` (inverted_index(lengths=True)); ``lengths`` (uid, length) of all its files spare a pass over it.
    """
    uid = index.columns[0]
    if "length" not in index.columns:
        index = index.join(index.groupBy(uid).agg(F.max(F.array_max("positions")).alias("length")), uid)
        lengths = None
    sizes = (index.select(uid, "length").distinct() if lengths is None else lengths).groupBy("length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1))  # one row a length
    sizes = stored(sizes.withColumn("before", F.coalesce(before, F.lit(0))), "lengths")
    salts = spread(sizes.agg(F.sum("n")).first()[0] or 0)
    number = F.floor((F.col("before") + F.pmod(F.xxhash64(uid), F.col("n"))) / block).cast("long")
    rows = index.join(F.broadcast(sizes), "length").select(uid, "lexeme", "positions", F.size("positions").alias("places"), number.alias("block"), lexeme_part(F.col("lexeme")).alias("part"))
    dealt = rows.withColumn("salt", F.pmod("block", F.lit(salts))).repartition("part", "salt").drop("salt")
    dealt.sortWithinPartitions("part", "lexeme", "block").write.mode("overwrite").partitionBy("part").parquet(path)


def _bound(query: Query, most: Column) -> Column:
    """No file of a block ranks higher: its rank if every stem stood in it as often as anywhere in the block, and all of them side by side."""
    n = lambda w: F.coalesce(F.try_element_at(most, F.lit(w)), F.lit(0))
    wanted = query.wanted
    if not wanted:
        return F.lit(0.0)
    if len(query.groups) > 1 or len(wanted) == 1:
        series = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda s, j: s + F.when(j <= k, 0.1 / (j * j)).otherwise(0.0))
        return reduce(lambda a, b: a + b, (series(n(w)) for w in wanted)) / 1.64493406685 / len(wanted)
    beside = 1 - math.sqrt(0.01 / (1.005 + 0.05 * math.exp(1 / 1.5 - 2)))
    pairs = reduce(lambda a, b: a + b, (n(a) * n(b) for i, a in enumerate(wanted) for b in wanted[i + 1 :]))
    every = reduce(lambda a, b: a & b, (n(w) > 0 for w in wanted))
    return F.when(every, F.greatest(1 - F.pow(F.lit(beside), pairs), F.lit(1e-20)))


class Found:
    """The best files (uid, rank), and how many of the blocks in which the query's stems stand were read."""

    def __init__(self, rows: list[tuple], read: int, blocks: int) -> None:
        self.rows, self.read, self.blocks = rows, read, blocks


def best(spark: SparkSession, path: str, text: str, k: int = 20, grants: DataFrame | None = None, uid: str = "file_uid") -> Found:
    """The ``k`` files that rank highest, ties to the smaller uid: exactly those that reading everything would give.

    Blocks are read in order of their bounds, a few and then more, until the ``k``-th best file is above all the bounds
    that are left. With ``grants`` (column file_uid) only files that may be read count. An alternative of negations alone
    ranks everything 0 and needs the whole index; it is refused.
    """
    query = Query(text)
    if query.negative:
        raise ValueError("a query with an alternative of negations only has no bounds")
    if not query.lexemes:
        return Found([], 0, 0)
    parts = [r["p"] for r in spark.createDataFrame([(w,) for w in query.lexemes], "w string").select(lexeme_part(F.col("w")).alias("p")).distinct().collect()]
    mine = spark.read.parquet(path).filter(F.col("part").isin(parts) & F.col("lexeme").isin(query.lexemes))
    most = mine.filter(F.col("lexeme").isin(query.wanted)).groupBy("lexeme", "block").agg(F.max("places").alias("most"))  # neither ids nor places are read
    maps = most.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("lexeme", "most"))).alias("most"))
    bounds = maps.select("block", (_bound(query, F.col("most")) + 1e-12).alias("bound")).filter("bound is not null").persist()
    try:
        total, read, last, rows = bounds.count(), 0, None, []
        wave = FIRST
        while True:
            left = bounds if last is None else bounds.filter((F.col("bound") < last[0]) | (F.col("bound") == last[0]) & (F.col("block") > last[1]))
            if len(rows) == k:
                left = left.filter(F.col("bound") >= rows[-1][1])
            some = left.orderBy(F.desc("bound"), "block").limit(wave).collect()
            if not some:
                return Found(rows, read, total)
            low, high = some[-1], some[0]
            within = left.filter((F.col("bound") <= high["bound"]) & ((F.col("bound") > low["bound"]) | (F.col("bound") == low["bound"]) & (F.col("block") <= low["block"])))
            numbers = [r["block"] for r in some]
            postings = mine.filter(F.col("block").between(min(numbers), max(numbers)))  # row groups, then the blocks themselves
            found = matching(postings.join(within.select("block"), "block", "left_semi"), query, uid)
            if grants is not None:
                found = readable(found, grants.select(F.col("file_uid").alias(uid)), on=[uid])
            fresh = [tuple(r) for r in found.orderBy(F.desc("rank"), uid).limit(k).collect()]
            rows = sorted([*rows, *fresh], key=lambda r: (-r[1], r[0]))[:k]
            read, last, wave = read + len(some), (low["bound"], low["block"]), min(wave * TIMES, 4096)
    finally:
        bounds.unpersist()
