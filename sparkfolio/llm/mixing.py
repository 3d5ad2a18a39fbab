"""Mixing sources to target weights by entropy balancing.

Each source has a target of words. Among all document rates between 0 and 2 copies that meet the targets, those are
taken that are closest to one copy each in relative entropy of copies taken and left. They are exponentially tilted by
document size: rate / (2 - rate) = exp(tilt * size / mean size), with one tilt a source, which is the solution of the
convex dual. Newton steps find it; each sums over the sizes of all documents where they are, and only one row a source
comes back. Rates are then rounded into whole copies so that each source's words stay near its target.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored

#: Documents of one source and size that are ranked together; larger groups are split by hash.
RANKED = 256
#: Equal rows that one task writes in a row; more of them are dealt out in pieces.
TOGETHER = 10_000


def word_count(text: str = "text"):
    """Number of runs other than ASCII white space; 0 for null."""
    words = F.size(F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "")).cast("long")
    return F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(words)


def targets(sizes: dict, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict:
    """Target of each source: ``share`` of all sizes split by weight, none above ``most`` times its own size.

    Sources in code point order, null last, have the weights in turn. What a source cannot take is shared by the others
    by weight, until none is above.
    """
    order = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    rest, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > most * sizes[s]]
        if not full:
            return out | {s: weight[s] * unit for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            rest -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def solve_tilts(cells: DataFrame, wanted: dict, sizes: dict, docs: dict, most: float = 2.0, rounds: int = 60) -> dict:
    """Tilt of each source (its place in ``wanted``) by Newton steps on the dual, kept in a bracket that shrinks.

    ``cells`` has columns place, size, n: so many documents of a source have that size. A source whose target is all it
    can give has tilt infinity, one without words tilt 0.
    """
    spark = cells.sparkSession
    tilt, low, high, done = {}, {}, {}, {}
    for k, s in enumerate(wanted):
        if sizes[s] <= 0 or wanted[s] <= 0:
            done[k] = 0.0 if sizes[s] <= 0 else -math.inf
        elif wanted[s] >= most * sizes[s] * (1 - 1e-9):
            done[k] = math.inf
        else:
            tilt[k], low[k], high[k] = 0.0, -math.inf, math.inf
    mean = {k: sizes[s] / max(docs[s], 1) for k, s in enumerate(wanted)}
    goal = dict(enumerate(wanted.values()))
    for _ in range(rounds):
        if not tilt:
            break
        state = spark.createDataFrame([(k, tilt[k], mean[k]) for k in tilt], "place int, tilt double, mean double")
        x = F.col("size") / F.col("mean")
        rate = most / (1 + F.exp(-F.greatest(F.least(F.col("tilt") * x, F.lit(500.0)), F.lit(-500.0))))
        sums = cells.join(state, "place").groupBy("place").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("words"),
            F.sum(F.col("n") * F.col("size") * x * rate * (1 - rate / most)).alias("slope"),
        ).collect()
        for r in sums:
            k, off = r["place"], r["words"] - goal[r["place"]]
            if abs(off) <= 1e-7 * goal[k]:
                done[k] = tilt.pop(k)
                continue
            if off > 0:
                high[k] = tilt[k]
            else:
                low[k] = tilt[k]
            step = tilt[k] - off / r["slope"] if r["slope"] > 0 else math.nan
            if not low[k] < step < high[k]:
                if math.isinf(high[k]):
                    step = max(1.0, 4 * low[k])
                elif math.isinf(low[k]):
                    step = min(-1.0, 4 * high[k])
                else:
                    step = (low[k] + high[k]) / 2
            tilt[k] = step
    return done | tilt


def _copies(cells: pd.DataFrame, most: int = 2) -> pd.DataFrame:
    """Whole copies of each size (size, n, rate) of one source, so that the words taken follow the words wanted.

    From the largest size down, each gets the number of copies that brings the words taken nearest to the words wanted
    so far, the later and smaller ones making up for what is left over, and at the end single copies of any. A source has a row for each different size, so
    their number is at most that of the words of its longest text, however many documents there are.
    """
    cells = cells.sort_values("size", ascending=False, kind="stable").reset_index(drop=True)
    size, n = cells["size"].to_numpy(float), cells["n"].to_numpy(float)
    wanted = size * n * cells["rate"].to_numpy()
    owed, out = 0.0, np.zeros(len(cells), np.int64)
    for k in range(len(cells)):
        owed += wanted[k]
        if size[k] > 0:
            out[k] = min(max(round(owed / size[k]), 0), int(most * n[k]))
            owed -= out[k] * size[k]
        else:
            out[k] = n[k]
    for _ in range(64):  # what the smallest sizes could not make up for: the size that comes nearest to it
        can = (size > 0) & ((out < most * n) if owed > 0 else (out > 0))
        off = np.where(can, np.abs(abs(owed) - size), np.inf)
        if not len(off) or off.min() >= abs(owed):
            break
        k, step = int(off.argmin()), 1 if owed > 0 else -1
        out[k] += step
        owed -= step * size[k]
    return cells.assign(copies=out)[["place", "size", "n", "copies"]]


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", most: float = 2.0) -> DataFrame:
    """Rows (key, size, source_size, target, copies, taken), one for each row of ``df``.

    ``size`` is the text's number of words (null: 0), ``copies`` how often the mix has the document (0, 1 or 2) and
    ``taken`` = copies * size. Null sources are one source. Texts without words are kept once. Rows with equal ids, or
    null ids, are mixed like any others; rows equal in id and text are counted, not ranked, and the rows as a whole are
    the same in every run. An empty table gives no rows. The number of sources is taken to be small, as weights are set
    by source: one row for each comes to the driver.
    """
    kind = df.schema[key].dataType.simpleString()
    docs = stored(df.select(F.col(key).alias("__key"), F.col(source).alias("__source"), word_count(text).alias("size"), F.xxhash64(F.col(key), F.col(text)).alias("__hash")), "sizes")
    return _mixed(docs, most).select(F.col("__key").cast(kind).alias(key), "size", "source_size", "target", "copies", "taken")


def _mixed(docs: DataFrame, most: float) -> DataFrame:
    spark = docs.sparkSession
    found = {r["__source"]: r for r in docs.groupBy("__source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()}
    sizes, number = {s: r["words"] for s, r in found.items()}, {s: r["docs"] for s, r in found.items()}
    wanted = targets(sizes, most=most)
    places = spark.createDataFrame([(k, s, int(sizes[s]), float(wanted[s])) for k, s in enumerate(wanted)], f"place int, name {docs.schema['__source'].dataType.simpleString()}, source_size long, target double")
    rows = docs.join(places, F.col("__source").eqNullSafe(F.col("name"))).drop("__source", "name")
    cells = stored(rows.groupBy("place", "size").agg(F.count("*").alias("n")), "cells")
    tilts = solve_tilts(cells, wanted, sizes, number, most)
    tilt = spark.createDataFrame([(k, float(tilts[k]), sizes[s] / max(number[s], 1)) for k, s in enumerate(wanted)], "place int, tilt double, mean double")
    exponent = F.greatest(F.least(F.col("tilt") * F.col("size") / F.greatest(F.col("mean"), F.lit(1e-9)), F.lit(500.0)), F.lit(-500.0))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("tilt") == math.inf, float(most)).when(F.col("tilt") == -math.inf, 0.0).otherwise(most / (1 + F.exp(-exponent)))
    rated = cells.join(tilt, "place").select("place", "size", "n", rate.alias("rate"))
    copies = stored(rated.groupBy("place").applyInPandas(lambda cells: _copies(cells, int(most)), "place int, size long, n long, copies long"), "copies")
    # a size's copies are dealt to its parts by prefix sums of their documents, and within a part in the order of hashes;
    # equal rows are one row with a number until the end, so that no task has to rank them
    base = F.floor(F.col("copies") / F.col("n"))
    copies = copies.select("place", "size", "n", base.alias("base"), (F.col("copies") - base * F.col("n")).alias("more"))
    whole = ["place", "size", "source_size", "target", "__hash", "__key"]
    part = F.pmod(F.col("__hash"), F.ceil(F.col("n") / RANKED))
    alike = rows.groupBy(*whole).agg(F.count("*").alias("same")).join(copies, ["place", "size"]).withColumn("part", part)
    counts = alike.groupBy("place", "size", "part").agg(F.sum("same").alias("here"), F.first("more").alias("more"), F.first("n").alias("n"))
    counts = counts.withColumn("until", F.sum("here").over(Window.partitionBy("place", "size").orderBy("part")))
    up_to = lambda x: F.expr(f"cast(more as decimal(19,0)) * {x} div n")
    counts = counts.withColumn("before", F.col("until") - F.col("here")).select("place", "size", "part", (up_to("until") - up_to("before")).cast("long").alias("extra"))
    passed = F.sum("same").over(Window.partitionBy("place", "size", "part").orderBy("__hash", "__key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("same")
    dealt = alike.withColumn("passed", passed).join(counts, ["place", "size", "part"])
    more = F.greatest(F.least(F.col("extra") - F.col("passed"), F.col("same")), F.lit(0))
    return _expanded(stored(dealt.select(*whole, "base", "same", more.alias("more")), "dealt"))


def _expanded(dealt: DataFrame) -> DataFrame:
    """A row for each of the ``same`` equal ones: ``more`` of them have base + 1 copies, the rest base.

    Rows that stand for more than TOGETHER others are dealt out again in pieces of so many.
    """
    sorts = F.array(F.struct((F.col("base") + 1).alias("copies"), F.col("more").alias("number")), F.struct(F.col("base").alias("copies"), (F.col("same") - F.col("more")).alias("number")))
    few, many = (dealt.filter(f"same {sign} {TOGETHER}").withColumn("sort", F.explode(sorts)).filter("sort.number > 0") for sign in ("<=", ">"))
    few = few.withColumn("number", F.col("sort.number"))
    pieces = many.withColumn("piece", F.explode(F.expr(f"sequence(0L, (sort.number - 1) div {TOGETHER})"))).repartition("__hash", "sort", "piece")
    pieces = pieces.withColumn("number", F.least(F.col("sort.number") - F.col("piece") * TOGETHER, F.lit(TOGETHER))).drop("piece")
    each = few.unionByName(pieces).withColumn("turn", F.explode(F.expr("sequence(1L, number)")))
    copies = F.col("sort.copies").cast("long")
    return each.select("__key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
