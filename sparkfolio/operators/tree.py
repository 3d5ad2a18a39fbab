"""Folder trees as intervals: every folder has a first and a last place, and what is below it lies between them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import settled, stored


def _next_sibling(kids: DataFrame) -> DataFrame:
    """Rows (parent, id, after, head): each child's next one by id, null for the last; head says that it is the first.

    Children are sorted over all tasks, so a folder of very many is in no single one; what a task's first and last row
    have to know of their neighbours, one row a task, goes through the driver.
    """
    ranged = kids.repartitionByRange("parent", "id").sortWithinPartitions("parent", "id")
    ranged = stored(ranged.withColumn("task", F.spark_partition_id()), "siblings", by="task")
    ends = ranged.groupBy("task").agg(F.min(F.struct("parent", "id")).alias("low"), F.max(F.struct("parent", "id")).alias("high")).orderBy("task").collect()
    before = {b["task"]: tuple(a["high"])[0] for a, b in zip(ends, ends[1:])}
    behind = {a["task"]: tuple(b["low"]) for a, b in zip(ends, ends[1:])}
    seam = kids.sparkSession.createDataFrame([(t["task"], before.get(t["task"]), *behind.get(t["task"], (None, None))) for t in ends], "task int, before string, parent_behind string, id_behind string")
    rows = ranged.repartition("task").sortWithinPartitions("task", "parent", "id")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (task, parent, id, head), until what follows is known
        for batch in batches:
            out = []
            for task, parent, own in zip(*(batch.column(c).to_pylist() for c in ("task", "parent", "id"))):
                same = last is not None and last[:2] == (task, parent)
                if last is not None:
                    out.append((*last, own if same else None, last[0] != task))
                last = (task, parent, own, not same, last is None or last[0] != task)
            if out:
                yield record(out)
        if last is not None:
            yield record([(*last, None, True)])

    def record(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["task", "parent", "id", "head", "opens", "after", "closes"])

    linked = rows.mapInArrow(link, "task int, parent string, id string, head boolean, opens boolean, after string, closes boolean")
    joined = linked.join(F.broadcast(seam), "task")  # one row a task
    after = F.when(F.col("closes") & (F.col("parent_behind") == F.col("parent")), F.col("id_behind")).otherwise(F.col("after"))
    head = F.col("head") & ~F.coalesce(F.col("opens") & (F.col("before") == F.col("parent")), F.lit(False))
    return joined.select("parent", "id", after.alias("after"), head.alias("head"))


def folder_labels(edges: DataFrame, cycles: str = "drop") -> DataFrame:
    """Rows (uid, parent, first, last) of the folders in ``edges`` (parent, child, is_container).

    A folder lies under another if its ``first`` is between the other's ``first`` and ``last``. The walk around the tree
    is a chain of two steps a folder, down and up; every step learns its distance to the end by pointer jumping, in as
    many rounds as the logarithm of the number of folders, however deep the tree.

    A folder with several parents lies under the least of them. Folders in a cycle, and below one, are reached by no walk:
    they are left out, or refused with an error if ``cycles`` is "refuse". A folder that is its own parent is a root.
    Null ids are passed over.
    """
    if cycles not in ("drop", "refuse"):
        raise ValueError(f"cycles are dropped or refused, not {cycles!r}")
    given = edges.filter("is_container and child is not null").select(F.col("parent").cast(StringType()).alias("parent"), F.col("child").cast(StringType()).alias("id"))
    links = given.filter("parent is not null and parent <> id").groupBy("id").agg(F.min("parent").alias("parent"))
    every = given.select("id").union(edges.filter("parent is not null").select(F.col("parent").cast(StringType()).alias("id"))).distinct()
    mark = lambda c: F.concat(F.lit("/"), c)  # noqa: E731  the top has the empty name, which no folder has then
    tree = stored(every.join(links, "id", "left").select(mark("id").alias("id"), F.coalesce(mark("parent"), F.lit("")).alias("parent")), "folders")
    siblings = stored(_next_sibling(tree), "walk")
    firsts = siblings.filter("head").select(F.col("parent").alias("id"), F.col("id").alias("child"))
    down = tree.join(firsts, "id", "left").select("id", F.lit(False).alias("up"), F.coalesce("child", "id").alias("to"), F.col("child").isNull().alias("to_up"))
    top = F.col("after").isNull() & (F.col("parent") == "")
    up = siblings.select("id", F.lit(True).alias("up"), F.when(~top, F.coalesce("after", "parent")).alias("to"), F.col("after").isNull().alias("to_up"))
    steps = settled(down.union(up).withColumn("far", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long")))
    n = steps.count()
    for _ in range(max(1, math.ceil(math.log2(max(n, 2))) + 1)):
        if steps.filter("to is not null").isEmpty():
            break
        on = steps.select(F.col("id").alias("to"), F.col("up").alias("to_up"), F.col("to").alias("next"), F.col("to_up").alias("next_up"), F.col("far").alias("more"))
        steps = settled(steps.join(on, ["to", "to_up"], "left").select("id", "up", F.col("next").alias("to"), F.col("next_up").alias("to_up"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")))
    ended = steps.filter("to is null")
    reached = ended.count()
    if cycles == "refuse" and reached < n:
        raise ValueError("there are cycles of folders")
    place = (F.lit(reached - 1) - F.col("far")).alias("place")
    both = ended.select("id", "up", place).groupBy("id").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    name = lambda c: F.substring(c, F.lit(2), F.length(c))
    return both.join(tree, "id").select(name(F.col("id")).alias("uid"), F.nullif(name(F.col("parent")), F.lit("")).alias("parent"), "first", "last")


def store_labels(edges: DataFrame, path: str, cycles: str = "drop") -> None:
    """Write the folders' labels, and each file with its folder's first place, sorted by it: a scope reads a few row groups."""
    labels = stored(folder_labels(edges, cycles), "labels")
    labels.repartitionByRange("first").sortWithinPartitions("first").write.mode("overwrite").parquet(f"{path}/folders")
    files = edges.filter("not is_container").select(F.col("parent").alias("uid"), F.col("child").alias("file_uid"))
    placed = files.join(labels.select("uid", "first"), "uid").select("file_uid", "first")
    placed.repartitionByRange("first", "file_uid").sortWithinPartitions("first").write.mode("overwrite").parquet(f"{path}/files")


def _within(labels: DataFrame, roots: list[str]) -> Column:
    """Whether a place lies under one of a request's folders; those within others add nothing."""
    spans = sorted((r["first"], r["last"]) for r in labels.filter(F.col("uid").isin(roots)).select("first", "last").collect())
    out, end = F.lit(False), -1
    for first, last in spans:
        if last > end:
            out, end = out | F.col("first").between(first, last), last
    return out


def stored_scope(labels: DataFrame, files: DataFrame, roots: list[str], grants: DataFrame | None = None) -> DataFrame:
    """Distinct ids (file_uid) of the files under the folders ``roots``, from stored tables; unknown folders hold nothing.

    With ``grants`` (column file_uid), files that cannot be read are left out, and all that is below a folder that cannot.
    """
    found = files.filter(_within(labels, roots))
    if grants is not None:
        shut = labels.filter(_within(labels, roots)).join(grants.select(F.col("file_uid").alias("uid")).distinct(), "uid", "left_anti")
        # a folder above the roots does not count, as for a walk that begins at them
        ends = shut.select(F.col("first").alias("low"), F.col("last").alias("high"))
        inner = labels.filter(_within(labels, roots)).select(F.col("first").alias("at"))
        below = _covered(inner, ends)
        found = found.join(below, found["first"] == below["at"], "left_anti").join(grants.select("file_uid").distinct(), "file_uid", "left_semi")
    return found.select("file_uid").distinct()


def _covered(places: DataFrame, spans: DataFrame) -> DataFrame:
    """The places that lie within some span (low, high); spans of one tree are nested or apart.

    Counts how many spans are open at each place, by running sums over ranges of places, so no pairs are made.
    """
    marks = spans.select(F.col("low").alias("at"), F.lit(1).alias("open")).union(spans.select((F.col("high") + 1).alias("at"), F.lit(-1).alias("open")))
    both = marks.withColumn("asked", F.lit(False)).union(places.select("at", F.lit(0).alias("open"), F.lit(True).alias("asked")))
    summed = both.groupBy("at").agg(F.sum("open").alias("open"), F.max("asked").alias("asked"))
    ranged = stored(summed.repartitionByRange("at").withColumn("task", F.spark_partition_id()), "spans", by="task")
    from pyspark.sql.window import Window

    base, offsets = 0, []
    for r in ranged.groupBy("task").agg(F.sum("open").alias("open")).orderBy("task").collect():  # one row a task
        offsets.append((r["task"], base))
        base += r["open"]
    start = places.sparkSession.createDataFrame(offsets, "task int, base long")
    run = F.sum("open").over(Window.partitionBy("task").orderBy("at"))
    return ranged.withColumn("run", run).join(F.broadcast(start), "task").filter((F.col("run") + F.col("base") > 0) & F.col("asked")).select("at")
