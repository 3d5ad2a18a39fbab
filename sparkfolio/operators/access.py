"""Read rights, folder scopes and what of a ranking a user may see."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cap_bytes
from ..session import settled


def readable(rows: DataFrame, grants: DataFrame, live: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """Rows with a grant, and of files that exist; whatever is missing or null is denied. Columns and number stay.

    ``grants`` has the columns ``on`` (file_uid, if not said), one row or more a grant.
    """
    on = on or ["file_uid"]
    out = rows.join(grants.select(*on), on, "left_semi")
    return out.join(live.select(*on), on, "left_semi") if live is not None else out


def grants_of(acl: DataFrame, tenant: str, user: str) -> DataFrame:
    """File ids that a user may read. An ``allowed`` column, if there, must be true."""
    mine = acl.filter((F.col("tenant") == tenant) & (F.col("user") == user))
    return (mine.filter("allowed") if "allowed" in acl.columns else mine).select("file_uid").distinct()


def allowed_top(ranked: DataFrame, grants: DataFrame, limit: int, order: list, mode: str = "exact", over: int = 5) -> DataFrame:
    """The first ``limit`` rows that a user may read.

    "exact": rights before the ranking, so the page is full if there are enough rows. "post": of the first over * limit
    rows, those that may be read; a page can come out short.
    """
    if mode == "exact":
        return readable(ranked, grants).orderBy(*order).limit(limit)
    if mode != "post":
        raise ValueError(f"unknown mode {mode!r}")
    return readable(ranked.orderBy(*order).limit(over * limit), grants).orderBy(*order).limit(limit)


def forget(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """Decisions (tenant, user, file_uid, ...) that no governance event makes void.

    A change of rights or a deleted file voids the file's decisions, a change of a member's role the member's, a deleted
    role the tenant's.
    """
    of = lambda *types: events.filter(F.col("type").isin(*types))
    files = of("acl.changed", "file.deleted").select("tenant", "file_uid").distinct()
    members = of("role.assigned", "role.member_removed").select("tenant", F.col("member").alias("user")).distinct()
    tenants = of("role.deleted").select("tenant").distinct()
    for void in (files, members, tenants):
        decisions = decisions.join(void, void.columns, "left_anti")
    return decisions


def folder_scope(edges: DataFrame, roots: DataFrame, grants: DataFrame | None = None, most_folders: int | None = None) -> DataFrame:
    """Distinct ids of the files under the folders ``roots`` (column uid), over ``edges`` (parent, child, is_container).

    Level by level, however deep; a folder seen before is not walked again, so a cycle ends. With ``grants`` (column
    file_uid), folders and files that cannot be read are left out. ``most_folders`` bounds the folders walked, by id
    within a level.
    """
    rights = grants.select(F.col("file_uid").alias("uid")).distinct() if grants is not None else None
    may = (lambda df: df.join(rights, "uid", "left_semi")) if rights is not None else (lambda df: df)
    level = may(roots.select("uid").distinct())
    seen = None
    walked = 0
    for depth in count(1):
        level = level if seen is None else level.join(seen, "uid", "left_anti")
        if most_folders is not None:
            level = level.orderBy("uid").limit(max(0, most_folders - walked))
        level = settled(level)
        n = level.count()
        if not n:
            break
        walked += n
        seen = level if seen is None else seen.union(level)
        if depth % 8 == 0:  # one table of the levels so far
            seen = settled(seen.repartition("uid"))
        below = edges.filter("is_container").join(level.withColumnRenamed("uid", "parent"), "parent")
        level = may(below.select(F.col("child").alias("uid")).distinct())
    folders = (level if seen is None else seen).withColumnRenamed("uid", "parent")
    files = edges.filter(~F.col("is_container")).join(folders, "parent").select(F.col("child").alias("uid"))
    return may(files).distinct().withColumnRenamed("uid", "file_uid")


def get_text(documents: DataFrame, uids: DataFrame, grants: DataFrame, most: int = 5 << 20) -> DataFrame:
    """Rows (file_uid, outcome, text, trimmed), one for each asked file_uid; the text up to ``most`` bytes of UTF-8.

    The outcome is "denied" without a grant, whether the file is there or not, then "missing" without a text, else "ok".
    """
    may = grants.select("file_uid").distinct().withColumn("__may", F.lit(True))
    asked = uids.select("file_uid").join(may, "file_uid", "left")
    texts = readable(documents.select("file_uid", "content_md"), grants).withColumn("__cut", cap_bytes(F.col("content_md"), most))
    rows = asked.join(texts.select("file_uid", "__cut"), "file_uid", "left")
    outcome = F.when(F.col("__may").isNull(), "denied").when(F.col("__cut.text").isNull(), "missing").otherwise("ok")
    return rows.select("file_uid", outcome.alias("outcome"), F.col("__cut.text").alias("text"), F.coalesce("__cut.trimmed", F.lit(False)).alias("trimmed"))


def sweep(edges: DataFrame, files: DataFrame, documents: DataFrame, root: str, unlistable: DataFrame | None = None, most_files: int | None = None) -> DataFrame:
    """Rows (file_uid, version, status) of the files under ``root``: current, or outdated and so to be converted.

    ``edges`` is (parent, child, is_container), ``files`` (file_uid, version). Folders in ``unlistable`` (uid) are passed
    by, with all that only they hold. ``most_files`` is the number of files after which a sweep ends, by id.
    """
    if unlistable is not None:
        edges = edges.join(unlistable.select(F.col("uid").alias("parent")), "parent", "left_anti")
    there = folder_scope(edges, edges.sparkSession.createDataFrame([(root,)], "uid string"))
    if most_files is not None:
        there = there.orderBy("file_uid").limit(most_files)
    done = documents.filter(F.col("status").isin("converted", "indexed")).select("file_uid", F.col("source_version").alias("version"), F.lit(True).alias("__done"))
    found = files.join(there, "file_uid", "left_semi").join(done.distinct(), ["file_uid", "version"], "left")
    return found.select("file_uid", "version", F.when(F.col("__done"), "current").otherwise("outdated").alias("status"))


def check_query(query: str, most: int = 1000) -> str:
    """The query without blanks at its ends; an error if it is empty or too long (0: any length)."""
    query = (query or "").strip()
    if not query:
        raise ValueError("the query is empty")
    if most and len(query) > most:
        raise ValueError(f"the query has more than {most} signs")
    return query


def cap(wanted: int, most: int) -> int:
    """At least 1, at most ``most`` (0: no limit)."""
    wanted = max(1, int(wanted))
    return min(wanted, most) if most > 0 else wanted
