"""Files to documents: type, text, status, chunks; the same for a sweep and for a stream's batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mime, models
from ..functions.text import decode_utf8, html_to_text
from ..session import stored
from . import chunking, tables

#: Types that are text as they are, besides text/*.
PLAIN = ("application/json", "application/xml", "application/javascript", "application/x-yaml", "application/toml", "application/x-sh", "application/sql")


def is_plain(kind: Column) -> Column:
    return kind.startswith("text/") | kind.isin(*PLAIN) | kind.rlike(r"^application/[^/]*\+(?:xml|json)$")


class Converter(NamedTuple):
    """Text of the types that ``claims``, a condition on the type, is true for: ``read`` of a column of bytes."""

    name: str
    claims: Callable[[Column], Column]
    read: Callable[[Column], Column]


#: In order: the first that claims a type has it.
CONVERTERS = [
    Converter("html", lambda k: k == "text/html", lambda c: html_to_text(decode_utf8(c), all_entities=True)),
    Converter("cityjson", lambda k: k == "application/city+json", models.cityjson_text),
    Converter("gltf", lambda k: k.isin("model/gltf+json", "model/gltf-binary"), models.gltf_text),
    Converter("obj", lambda k: k == "model/obj", models.obj_text),
    Converter("vrml", lambda k: k == "model/vrml", models.vrml_text),
    Converter("iges", lambda k: k == "model/iges", models.iges_text),
    Converter("las", lambda k: k.isin("application/vnd.las", "application/vnd.laz"), models.las_text),
    Converter("stl", lambda k: k == "model/stl", models.stl_text),
    Converter("ply", lambda k: k == "model/ply", models.ply_text),
    Converter("plain", is_plain, decode_utf8),
]
#: Statements of these are joined over rows, so they have a function of tables, not of columns.
PART_21 = ("application/x-ifc", "model/step")


def by_python(read: Callable[[bytes], str | None]) -> Callable[[Column], Column]:
    """A Python function of a file's bytes as the ``read`` of a converter: a file it fails on has no text, others go on."""
    def one(content: bytes | None) -> str | None:
        try:
            return None if content is None else read(bytes(content))
        except Exception:  # a file that cannot be read must not stop the others
            return None

    @F.pandas_udf("string")
    def texts(contents: pd.Series) -> pd.Series:
        return contents.map(one)

    return texts


def extract(files: DataFrame, more: Sequence[Converter] = ()) -> DataFrame:
    """``files`` (file_uid, name, content, ...) with mime, supported and text; null text where there is none.

    ``more`` are converters that come before the usual ones. Files are written once by the converter that has them, and
    each converter is a plan of its own over its own files, so that neither plans nor passes grow with the formats.
    """
    kind, every = F.col("mime"), [*more, *CONVERTERS]
    owner = F.when(F.lit(False), "")
    for c in more:
        owner = owner.when(c.claims(kind), c.name)
    owner = owner.when(kind.isin(*PART_21), "part21")
    for c in CONVERTERS:
        owner = owner.when(c.claims(kind), c.name)
    typed = files.withColumn("mime", mime.detect(F.col("content"), F.col("name")))
    typed = stored(typed.withColumn("__owner", owner.otherwise("none")), "files", by="__owner")
    mine = lambda name: typed.filter(F.col("__owner") == name).drop("__owner")
    parts = [mine(c.name).withColumn("supported", F.lit(True)).withColumn("text", c.read(F.col("content"))) for c in every]
    part21 = mine("part21")
    read = models.part21_text(part21, "file_uid", "content").withColumnRenamed("text", "__text")
    parts.append(part21.join(read, "file_uid", "left").withColumn("supported", F.lit(True)).withColumn("text", F.col("__text")).drop("__text"))
    parts.append(mine("none").withColumn("supported", F.lit(False)).withColumn("text", F.lit(None).cast("string")))
    columns = [*files.columns, *([] if "mime" in files.columns else ["mime"]), "supported", "text"]
    return reduce(DataFrame.unionByName, (p.select(*columns) for p in parts))


def convert(files: DataFrame, documents: DataFrame, chunks: DataFrame, now: Column, dimension: int = 1024, force: bool = False, keep_stale: bool = False, more: Sequence[Converter] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New documents, new chunks, and outcomes (file_uid, status, has_text, children) of the files that needed work.

    Files of a known type end as indexed if they have chunks, else as converted; others as unsupported. A new version
    without text clears the old text and chunks, or leaves them with ``keep_stale``. ``more`` are converters as for
    extract(). The extracted texts are written to the shared folder, as all three results need them.
    """
    done = stored(extract(tables.outdated(files, documents, force), more).drop("content"), "texts")
    cut = chunking.index_files(done.select("file_uid", F.col("text").alias("content_md")), dimension)
    has = cut.select("file_uid").distinct().withColumn("__has", F.lit(True))
    rows = done.join(has, "file_uid", "left")
    status = F.when(~F.col("supported"), "unsupported").when(F.col("__has"), "indexed").otherwise("converted")
    changes = rows.select("file_uid", F.col("version").alias("source_version"), "mime", "name", F.lit("").alias("path"), F.col("text").alias("content_md"), status.alias("status"), F.lit(None).cast("string").alias("error"))
    new_documents = tables.upsert(documents, changes, now, keep_if_null=("content_md",) if keep_stale else ())
    gone = changes.filter("content_md is not null") if keep_stale else changes
    new_chunks = tables.delete(chunks, gone).unionByName(cut.select(*chunks.columns))
    outcomes = changes.select("file_uid", "status", F.col("content_md").isNotNull().alias("has_text"), F.array().cast("array<string>").alias("children"))
    return new_documents, new_chunks, outcomes
