"""Context for answers: what of a ranking fits, how it is laid out and cited."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import escape_html, html_document, redact_pii, to_html
from ..session import settled
from . import access, ann, vector_search
from .chunking import hash_embed

NOTHING_FOUND = "(no document matches the question)"


def trim(chunks: DataFrame, budget: int = 12_000, by: list[str] | None = None, rank: str = "rank", text: str = "text", length: str | None = None) -> DataFrame:
    """Rows in order up to the length budget, the first in any case, with column ``trimmed``: whether something is cut.

    ``by`` are the columns of a question; each has its own budget, and without them all rows are one question's.
    ``length`` names a column of lengths: where a question may have many rows, rank and trim keys and lengths, and join
    the texts of what is left.
    """
    group = Window.partitionBy(*(by or [F.lit(0)]))
    so_far = group.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    rows = chunks.withColumn("__sum", F.sum(F.col(length) if length else F.length(text)).over(so_far)).withColumn("__n", F.row_number().over(group.orderBy(rank)))
    rows = rows.withColumn("trimmed", F.max(F.col("__sum")).over(group) > budget)
    return rows.filter((F.col("__n") == 1) | (F.col("__sum") <= budget)).drop("__sum", "__n")


def assemble(chunks: DataFrame, by: list[str], rank: str = "rank", uid: str = "file_uid", text: str = "text") -> DataFrame:
    """Rows (by, context): numbered texts with their files, parted by blank lines."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(rank))
    part = F.concat(F.lit("["), F.col("__n"), F.lit("] (file "), F.col(uid), F.lit(")\n"), F.col(text))
    parts = chunks.withColumn("__n", turn).select(*by, "__n", part.alias("__part"))
    return parts.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__part"))), lambda x: x["__part"]), "\n\n").alias("context"))


def contexts(questions: DataFrame, chunks: DataFrame, by: list[str], **columns) -> DataFrame:
    """As assemble(), for all questions: those without a text have a fixed remark."""
    return questions.join(assemble(chunks, by, **columns), by, "left").withColumn("context", F.coalesce("context", F.lit(NOTHING_FOUND)))


def citations(chunks: DataFrame, by: list[str] | None = None, rank: str = "rank", uid: str = "file_uid") -> DataFrame:
    """Rows (by, marker, file_uid): each file once, under the number of its first text."""
    return chunks.groupBy(*(by or []), uid).agg(F.min(rank).alias("marker"))


def tool_citations(results: DataFrame, n_chunks: int, order: list[str]) -> DataFrame:
    """Results of tools, numbered on after the texts; web and other results share one numbering."""
    return ranked(results, *(F.col(c) for c in order)).withColumn("marker", (F.col("rank") + n_chunks).cast("int")).drop("rank")


def retrieve(chunks: DataFrame, query: list[float], grants: DataFrame, k: int = 8, scope: DataFrame | None = None, max_k: int = 12, mode: str = "exact") -> DataFrame:
    """The nearest chunks that a user may read, within a scope of files if given: (..., distance), nearest first.

    "post" looks at 4 k rows (8 k with a scope) before rights are checked, and can come out short.
    """
    k = access.cap(k, max_k)
    if scope is not None:
        chunks = chunks.join(scope.select("file_uid"), "file_uid", "left_semi")
    if mode == "exact":
        return vector_search.nearest(access.readable(chunks, grants), query, k)
    over = vector_search.nearest(chunks, query, (8 if scope is not None else 4) * k)
    return access.readable(over, grants).orderBy("distance", "file_uid", "ordinal").limit(k)


def ask(chunks: DataFrame, question: str, grants: DataFrame, dimension: int, k: int = 8, scope: DataFrame | None = None, embed: Callable = hash_embed, **more) -> DataFrame:
    """retrieve() for a question in words; a blank question and an empty scope give no rows.

    ``embed`` is the provider that the chunks were embedded with.
    """
    if not (question or "").strip():
        return retrieve(chunks.limit(0), [0.0] * dimension, grants, k, scope, **more)
    asked = chunks.sparkSession.createDataFrame([(0, question)], "id int, text string")
    vector = embed(asked, ["id"], "text", dimension).first()["embedding"]
    return retrieve(chunks, vector, grants, k, scope, **more)


def ask_stored(spark: SparkSession, path: str, questions: DataFrame, grants: DataFrame, dimension: int, k: int = 8, scope: DataFrame | None = None, embed: Callable = hash_embed, max_k: int = 12, chunks: DataFrame | None = None, **search) -> DataFrame:
    """ask() for a bounded set of questions (id, text) from a stored vector index: (id, rank, file_uid, ordinal, distance).

    ``path`` is what ann.build() wrote of chunks that ``embed`` embedded; nothing is chunked or embedded anew but the
    questions, which come to the driver. Rights and scope are checked before anything is cut. Blank questions, null ones,
    and those whose vector is zero give no rows; questions with equal ids have their rows each. With ``chunks`` (file_uid,
    ordinal, text) the texts of what is found are joined. ``search`` goes to ann.search(): probe and rerank.
    """
    kind = questions.schema["id"].dataType.simpleString()
    asked = questions.filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select("id", "text").collect()
    numbered = spark.createDataFrame([(n, r["text"]) for n, r in enumerate(asked)], "id int, text string")
    vectors = sorted((r["id"], list(r["embedding"])) for r in embed(numbered, ["id"], "text", dimension).collect() if any(r["embedding"])) if asked else []
    names = spark.createDataFrame([(place, asked[n]["id"]) for place, (n, _) in enumerate(vectors)], f"query int, id {kind}")
    if not vectors:
        none = spark.read.parquet(f"{path}/rows").limit(0)
        return none.select(F.lit(None).cast(kind).alias("id"), F.lit(0).alias("rank"), "file_uid", "ordinal", F.lit(0.0).alias("distance"))
    found = ann.search(spark, path, [v for _, v in vectors], access.cap(k, max_k), grants=grants, scope=scope, **search)
    found = found.join(F.broadcast(names), "query").select("id", "rank", "file_uid", "ordinal", "distance")  # a row a question
    return found if chunks is None else found.join(chunks.select("file_uid", "ordinal", "text"), ["file_uid", "ordinal"])


def transcript(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conversation, turns, transcript): JSON of the messages in order, without personal data."""
    row = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), redact_pii(F.col(text)).alias("content"))
    turns = F.transform(F.array_sort(F.collect_list(row)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return messages.groupBy(conversation).agg(F.count("*").alias("turns"), F.to_json(turns).alias("transcript"))


def provenance(answers: DataFrame) -> DataFrame:
    """JSON record of each answer: who asked, what was cited, and the whole exchange without personal data.

    ``answers`` has uid, version, user, tenant, message, answer_text, history (array of role and content), citations.
    """
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), redact_pii(text).alias("content"))
    before = F.transform(F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>")), lambda m: F.struct(F.coalesce(m["role"], F.lit("")).alias("role"), redact_pii(m["content"]).alias("content")))
    whole = F.concat(before, F.array(turn("user", F.col("message")), turn("assistant", F.col("answer_text"))))
    record = F.struct(F.struct("uid", "version").alias("report"), F.col("user").alias("chatted_by"), "tenant", "citations", whole.alias("transcript"), F.lit(True).alias("pii_redacted"))
    return answers.select("uid", F.to_json(record).alias("record"))


def provenance_page(records: DataFrame, uid: str = "uid", record: str = "record", title: str | None = None) -> DataFrame:
    """Rows (uid, page): an HTML page of each provenance() record, with the record itself in a script element.

    Every turn is rendered as Markdown, or as it is where it is HTML. Citations are a list: web pages as links, documents
    as ``(file <uid>)``, which tables.link_file_references() turns into links with names. A closing tag inside the record
    cannot end the script, and only web addresses become links.
    """
    kind = "report struct<uid:string,version:string>, chatted_by string, tenant string, transcript array<struct<role:string,content:string>>, citations string"
    r = F.from_json(F.col(record), kind)
    turns = records.select(uid, F.posexplode(r["transcript"]).alias("place", "m"))  # the renderer is Python: a row a turn
    one = F.concat(F.lit('<section class="'), escape_html(F.col("m.role")), F.lit('"><h2>'), escape_html(F.col("m.role")), F.lit("</h2>"), to_html(F.col("m.content")), F.lit("</section>"))
    told = turns.select(uid, "place", one.alias("html")).groupBy(uid).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "html"))), lambda x: x["html"]), "").alias("__told"))
    who = F.concat(F.lit("<p>"), escape_html(F.concat_ws(" · ", r["chatted_by"], r["tenant"], r["report"]["version"])), F.lit("</p>"))
    data = F.concat(F.lit('<script type="application/json" id="record">'), F.replace(F.col(record), F.lit("</"), F.lit("<\\/")), F.lit("</script>"))
    cites = F.from_json(r["citations"], "array<struct<marker:string,kind:string,url:string,title:string,file_uid:string>>")

    def cite(c: Column) -> Column:
        named = escape_html(F.coalesce(F.nullif(c["title"], F.lit("")), c["url"], F.lit("")))
        web = F.when(F.lower(c["url"]).rlike("^https?://"), F.concat(F.lit('<a href="'), escape_html(c["url"]), F.lit('" rel="noopener">'), named, F.lit("</a>"))).otherwise(named)
        what = F.when(c["kind"] == "web", web).otherwise(F.concat(F.lit("(file "), escape_html(F.coalesce(c["file_uid"], F.lit(""))), F.lit(")")))
        return F.concat(F.lit("<li>["), escape_html(F.coalesce(c["marker"], F.lit(""))), F.lit("] "), what, F.lit("</li>"))

    listed = F.when(F.size(cites) > 0, F.concat(F.lit("<ul>"), F.array_join(F.transform(cites, cite), ""), F.lit("</ul>"))).otherwise("<p>No citations.</p>")
    sources = F.concat(F.lit("<h2>Sources</h2>"), listed)
    name = F.col(title) if title else F.concat(F.lit("Record of "), r["report"]["uid"])
    whole = html_document(name, F.concat(who, F.coalesce("__told", F.lit("")), sources, data))
    return records.join(told, uid, "left").select(uid, whole.alias("page"))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows with their place in the whole order, from 1 on, in column ``rank``.

    Rows are sorted by range, counted a partition, and numbered from the sum of the partitions before: no task holds all.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settled(ranged.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row")))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    base = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    starts = counts.select("__part", "__first", F.coalesce(base, F.lit(0)).alias("__base"))
    return placed.join(F.broadcast(starts), "__part").withColumn("rank", F.col("__row") - F.col("__first") + F.col("__base") + 1).drop("__part", "__row", "__first", "__base")


def fuse(first: DataFrame, second: DataFrame, key: str, limit: int, constant: int = 60) -> DataFrame:
    """Two rankings (key, rank) as one by reciprocal ranks: (key, score), best first."""
    both = first.select(key, F.col("rank").alias("r1")).join(second.select(key, F.col("rank").alias("r2")), key, "full_outer")
    share = lambda r: F.coalesce(1 / (constant + F.col(r)), F.lit(0.0))
    return both.select(key, (share("r1") + share("r2")).alias("score")).orderBy(F.desc("score"), key).limit(limit)
