"""Tables of documents, chunks, renditions and conversations: each change gives the new table as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import slug, strip
from ..session import settled


def upsert(documents: DataFrame, changes: DataFrame, now: Column, key: str = "file_uid", keep_if_null: tuple[str, ...] = ("content_md",)) -> DataFrame:
    """Rows of ``changes`` in place of those of equal key, or besides them.

    A null in a column of ``keep_if_null`` keeps the old value. created_at stays, updated_at is ``now``. Of several
    changes of one key the last by source_version counts; if it is older than the stored row, that stays as it is. The
    whole table is joined; operators.store.FileStore keeps a table of which only the changed part is written.
    """
    latest = newest(changes, key, "source_version")
    old, new = documents.alias("o"), latest.withColumn("__new", F.lit(True)).alias("n")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    version = lambda side: F.coalesce(F.col(f"{side}.source_version"), F.lit(""))
    fresh = F.col("__new").isNotNull() & (version("n") >= version("o"))

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(f"n.{c}", f"o.{c}")
        if c == "created_at":
            return F.coalesce(f"o.{c}", now)
        if c == "updated_at":
            return F.when(fresh, now).otherwise(F.col(f"o.{c}"))
        if c not in latest.columns:
            return F.col(f"o.{c}")
        if c in keep_if_null:
            return F.when(fresh, F.coalesce(f"n.{c}", f"o.{c}")).otherwise(F.col(f"o.{c}"))
        return F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return both.select(*(value(c).alias(c) for c in documents.columns))


def newest(events: DataFrame, key: str | list[str], version: str) -> DataFrame:
    """Of each key the row of the greatest version; a null version is the least.

    Of equal versions, the row that is greatest column by column counts, in the order of the columns, null being the
    least; columns of maps cannot be compared and are passed over.
    """
    rest = F.struct(*events.columns)
    keys = [key] if isinstance(key, str) else key
    ties = [F.col(f.name) for f in events.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    best = events.groupBy(*keys).agg(F.max_by(rest, F.struct(F.coalesce(F.col(version).cast("string"), F.lit("")), *ties)).alias("__r"))
    return best.select("__r.*")


def delete(table: DataFrame, gone: DataFrame, key: str = "file_uid") -> DataFrame:
    """Rows whose key is not among ``gone``; use it for documents and for their chunks."""
    return table.join(gone.select(key), key, "left_anti")


def replace(table: DataFrame, items: DataFrame, key: str = "file_uid") -> DataFrame:
    """All old rows of the keys in ``items`` go, the items come."""
    return delete(table, items, key).unionByName(items.select(*table.columns))


def outdated(files: DataFrame, documents: DataFrame, force: bool = False) -> DataFrame:
    """Files (file_uid, version, is_dir) to convert: no folders, and none converted or indexed in this version already."""
    files = files.filter(~F.coalesce("is_dir", F.lit(False)))
    if force:
        return files
    done = documents.filter(F.col("status").isin("converted", "indexed")).select("file_uid", F.col("source_version").alias("version"))
    return files.join(done, ["file_uid", "version"], "left_anti")


def sweep_counts(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (status, n): how many files a sweep finds skipped (folders), current or outdated."""
    done = documents.filter(F.col("status").isin("converted", "indexed")).select("file_uid", F.col("source_version").alias("version"), F.lit(True).alias("__done"))
    kind = F.when(F.coalesce("is_dir", F.lit(False)), "skipped").when(F.col("__done"), "current").otherwise("outdated")
    return files.join(done.distinct(), ["file_uid", "version"], "left").groupBy(kind.alias("status")).agg(F.count("*").alias("n"))


#: The kinds of renditions.
RENDITIONS = ("thumbnail", "preview", "pdf", "poster", "model", "chatlog")


def safe_version(version: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(strip(F.coalesce(version, F.lit("0"))), "[^A-Za-z0-9._-]", "_"), F.lit("")), F.lit("0"))


def rendition_name(version: Column, kind: Column, ending: Column) -> Column:
    return F.concat(safe_version(version), F.lit("-"), kind, F.lit("."), ending)


def rendition_parts(name: Column) -> Column:
    """Version, kind and ending of a rendition's name, null for other names. A version may hold dashes and dots."""
    of = lambda k: F.regexp_extract(name, r"(?s)^(.+)-([^-]*)\.([^.]+)$", k)
    return F.when((of(1) != "") & of(2).isin(*RENDITIONS), F.struct(of(1).alias("version"), of(2).alias("kind"), of(3).alias("ending")))


def new_renditions(made: DataFrame, there: DataFrame) -> DataFrame:
    """Rows of ``made`` (file_uid, name, ...) that do not exist yet."""
    return made.join(there, ["file_uid", "name"], "left_anti")


def rendition_list(there: DataFrame, version: str) -> DataFrame:
    """Rows (file_uid, names): the sorted names of one version's renditions."""
    mine = there.filter(F.col("name").startswith(F.concat(safe_version(F.lit(version)), F.lit("-"))))
    return mine.groupBy("file_uid").agg(F.array_sort(F.collect_list("name")).alias("names"))


def stale_renditions(there: DataFrame, keep: DataFrame) -> DataFrame:
    """Renditions (file_uid, name) of other versions than the one to keep (file_uid, version); other children never."""
    rows = there.withColumn("__p", rendition_parts(F.col("name"))).filter("__p is not null")
    return rows.join(keep.select("file_uid", safe_version(F.col("version")).alias("__keep")), "file_uid").filter("__p.version <> __keep").drop("__p", "__keep")


def terminal_events(outcomes: DataFrame) -> DataFrame:
    """Rows (file_uid, type, reason, renditions) for outcomes (file_uid, status, has_text, children) that end a conversion.

    Kinds of renditions are named once each, text first. Skipped and missing files give no event.
    """
    kinds = F.filter(F.transform("children", lambda c: rendition_parts(c)["kind"]), lambda k: k.isNotNull())
    made = F.array_distinct(F.concat(F.when(F.col("has_text"), F.array(F.lit("text"))).otherwise(F.array().cast("array<string>")), kinds))
    rows = outcomes.filter(F.col("status").isin("converted", "indexed", "unsupported")).withColumn("renditions", made)
    good = (F.col("status") != "unsupported") & (F.size("renditions") > 0)
    return rows.select(
        "file_uid", F.when(good, "conversion.complete").otherwise("conversion.failed").alias("type"),
        F.when(F.col("status") == "unsupported", "unsupported").when(~good, "error").alias("reason"),
        F.when(good, F.col("renditions")).otherwise(F.array().cast("array<string>")).alias("renditions"),
    )


def conversation_list(conversations: DataFrame, user: str, limit: int = 200) -> DataFrame:
    """A user's conversations, the latest first."""
    return conversations.filter(F.col("user_id") == user).orderBy(F.desc("updated_at"), "id").limit(limit)


def conversation_get(conversations: DataFrame, messages: DataFrame, user: str, conversation_id: str) -> DataFrame:
    """One conversation of its owner with its messages in order; no row for anyone else."""
    own = conversations.filter((F.col("id") == conversation_id) & (F.col("user_id") == user))
    mine = messages.filter(F.col("conversation_id") == conversation_id)
    said = F.struct("message_id", "role", "content", F.coalesce("citations", F.lit("[]")).alias("citations"))
    grouped = mine.groupBy("conversation_id").agg(F.array_sort(F.collect_list(said)).alias("messages"))
    return own.join(grouped, own["id"] == grouped["conversation_id"], "left").drop("conversation_id")


def append_message(conversations: DataFrame, messages: DataFrame, user: str, message: DataFrame) -> DataFrame:
    """``messages`` with those of ``message`` that belong to a conversation of the user."""
    own = conversations.filter(F.col("user_id") == user).select(F.col("id").alias("conversation_id"))
    return messages.unionByName(message.join(own, "conversation_id", "left_semi").select(*messages.columns))


def title_if_empty(conversations: DataFrame, user: str, conversation_id: str, title: Column) -> DataFrame:
    """The title set, up to 120 signs, where the user's conversation has none."""
    mine = (F.col("id") == conversation_id) & (F.col("user_id") == user) & (F.coalesce("title", F.lit("")) == "")
    return conversations.withColumn("title", F.when(mine, F.substring(title, 1, 120)).otherwise(F.col("title")))


def set_scope(conversations: DataFrame, user: str, conversation_id: str, scope: Column) -> DataFrame:
    """The folders that a user's conversation is about; null becomes an empty list, which means all. Others' stay as they are."""
    mine = (F.col("id") == conversation_id) & (F.col("user_id") == user)
    kind = conversations.schema["scope"].dataType
    return conversations.withColumn("scope", F.when(mine, F.coalesce(scope, F.array()).cast(kind)).otherwise(F.col("scope")))


def delete_conversation(conversations: DataFrame, messages: DataFrame, user: str, conversation_id: str) -> tuple[DataFrame, DataFrame]:
    """Conversations and messages without one conversation, if it is the user's; else both as they are."""
    own = conversations.filter((F.col("id") == conversation_id) & (F.col("user_id") == user)).select("id")
    return conversations.join(own, "id", "left_anti"), messages.join(own.withColumnRenamed("id", "conversation_id"), "conversation_id", "left_anti")


def status_of(documents: DataFrame, uids: DataFrame) -> DataFrame:
    """Rows (file_uid, status), one for each asked file_uid; null for a file that is not there. Texts are not read."""
    return uids.select("file_uid").join(documents.select("file_uid", "status"), "file_uid", "left")


def unique_slugs(names: DataFrame, key: str = "id", name: str = "name", most: int | None = 999) -> DataFrame:
    """Rows (key, slug): equal slugs are numbered from 2 to ``most`` in order of the key; the rest end in six signs made of the key.

    The signs are the same at every run; of very many equal names two may have the same. Without ``most`` all are numbered.
    """
    base = names.select(key, F.coalesce(F.nullif(slug(F.col(name)), F.lit("")), F.lit("integration")).alias("base"))
    turn = F.row_number().over(Window.partitionBy("base").orderBy(key))
    number = F.col("n").cast("string")
    if most is not None:
        number = F.when(F.col("n") <= most, number).otherwise(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 6))
    return base.withColumn("n", turn).select(key, F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", number)).alias("slug"))


def folder_listing(entries: DataFrame, most_folders: int = 200, most_files: int = 20) -> DataFrame:
    """Rows (parent, folders, files): the first names in order, and how many more there are.

    Names beyond the limits are counted where they are, and left behind before anything of a folder meets.
    """
    names = entries.select("parent", F.col("is_container").alias("__folder"), "name")
    turn = F.row_number().over(Window.partitionBy("parent", "__folder").orderBy("name"))
    first = names.filter("name is not null").withColumn("__turn", turn).filter(F.col("__turn") <= max(most_folders, most_files))
    first = first.filter(F.col("__turn") <= F.when(F.col("__folder"), most_folders).otherwise(most_files)).select("parent", "__folder", "name", F.lit(0).cast("long").alias("__n"))
    numbers = names.groupBy("parent", "__folder").agg(F.count("name").alias("__n")).select("parent", "__folder", F.lit(None).cast("string").alias("name"), "__n")

    def shown(is_folder: bool, most: int) -> Column:
        of = lambda c: F.when(F.col("__folder") == is_folder, F.col(c))
        more = F.coalesce(F.sum(of("__n")), F.lit(0)) - most
        return F.concat(F.array_join(F.array_sort(F.collect_list(of("name"))), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more, F.lit(" more)"))).otherwise(""))

    return first.unionByName(numbers).groupBy("parent").agg(shown(True, most_folders).alias("folders"), shown(False, most_files).alias("files"))


def resolve_paths(paths: DataFrame, entries: DataFrame, root: str = "") -> DataFrame:
    """Rows (path, uid, missing): the folder that a path leads to, or the first path that is not there.

    One equi-join a level over ``entries`` (parent, uid, name, is_container), down to the deepest path.
    """
    folders = entries.filter("is_container").groupBy(F.col("parent").alias("__at"), F.col("name").alias("__name")).agg(F.min("uid").alias("__uid"))
    parts = F.filter(F.split(F.replace(F.coalesce("path", F.lit("")), F.lit("\\"), F.lit("/")), "/"), lambda p: strip(p) != "")
    rows = paths.select("path", parts.alias("parts"), F.lit(root).alias("uid"), F.lit(None).cast("string").alias("missing"))
    depth = rows.agg(F.max(F.size("parts"))).first()[0] or 0
    for k in range(depth):
        step = rows.withColumn("__name", F.when(F.size("parts") > k, F.get("parts", F.lit(k))))
        found = step.join(folders, (step["uid"] == folders["__at"]) & (step["__name"] == folders["__name"]), "left")
        gone = step["__name"].isNotNull() & F.col("uid").isNotNull() & F.col("__uid").isNull()
        rows = found.select(
            "path", "parts", F.when(step["__name"].isNull(), F.col("uid")).otherwise(F.col("__uid")).alias("uid"),
            F.when(gone, F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, k + 1), "/"))).otherwise(F.col("missing")).alias("missing"),
        )
        if k % 8 == 7 and k + 1 < depth:
            rows = settled(rows)
    return rows.select("path", "uid", "missing")


def link_file_references(texts: DataFrame, names: DataFrame, tenant: str, base_url: str = "", key: str = "id", html: str = "html") -> DataFrame:
    """Rows (key, html): ``(file <uid>)`` becomes a link with the file's name, or a label where it has none.

    ``names`` has file_uid and name of the files that the reader may see.
    """
    from ..functions.text import escape_html

    base = base_url.replace("{tenant}", tenant)
    # fixed value: how texts refer to a file
    pattern = r"\(file\s+([0-9a-fA-F-]{8,})\)"
    whole = lambda k: F.regexp_extract_all(F.col(html), F.lit(rf"({pattern})"), F.lit(k))
    found = texts.select(key, F.explode(F.array_distinct(F.arrays_zip(whole(1).alias("all"), whole(2).alias("uid")))).alias("r")).select(key, "r.*")
    label = escape_html(F.concat(F.lit("📄 "), F.coalesce(F.nullif("name", F.lit("")), F.lit("file"))))
    url = escape_html(F.concat(F.lit(f"{base}/files?file="), F.col("uid"), F.lit(f"&tenant={tenant}")))
    new = F.when(F.coalesce("name", F.lit("")) != "", F.concat(F.lit('(<a href="'), url, F.lit('">'), label, F.lit("</a>)"))).otherwise(F.concat(F.lit("("), label, F.lit(")")))
    named = found.join(names.select(F.col("file_uid").alias("uid"), "name"), "uid", "left").select(key, "all", new.alias("new"))
    swaps = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("all", "new"))).alias("swaps"))
    done = F.aggregate(F.coalesce("swaps", F.array().cast("array<struct<all:string,new:string>>")), F.col(html), lambda t, s: F.replace(t, s["all"], s["new"]))
    return texts.join(swaps, key, "left").select(key, done.alias(html))
