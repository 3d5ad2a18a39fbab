"""A corpus pipeline of five of the operators: each stage reads what the one before it wrote.

Language ID, quality, near-duplicates, mixing, BPE. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkfolio.llm import bpe, lang_id, mixing, quality, shared, simhash

#: A text is rejected if no language has at least this share.
LEAST_SHARE = 0.5
#: Nor if its contexts do not save that many bits a byte against the text's bytes alone, as in no learned language.
LEAST_GAIN = 0.25
#: Bits that a text may lack for that: what one or two odd spots cost, which in a short text say little.
SPARED_BITS = 32


def _whole(docs: DataFrame) -> DataFrame:
    """Rows (doc, row): each row as one struct, whatever its columns are called, with what tells it from others."""
    return docs.select(F.struct(*docs.columns).alias("doc"), _row().alias("row"))


def _row() -> Column:
    """A row's id and the digest of its text, by which decisions are kept: ids may be null or repeated."""
    digest = F.unhex(F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), digest.alias("digest"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that one of the learned languages has claimed: not ``und``, sure enough, and like it in itself.

    The share says which language is nearest, not that it is near: letters in no order, codes and other languages have a
    share of 1 too. They go because what a learned language's contexts foretell does not help to code them.

    Row by row: of rows that repeat, all stay or all go. A null or blank text is ``und`` and goes; a tie of two languages
    at half each is sure enough. Without any label nothing can be learned, and nothing stays.
    """
    found = lang_id.predict(docs, lang_id.train(docs), carry=True)
    size = F.octet_length("row.text")
    sure = (F.col("score") >= LEAST_SHARE) & (F.col("gain") * size >= LEAST_GAIN * size - SPARED_BITS)
    return found.filter((F.col("lang_pred") != "und") & sure).select("row.*")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents of which the best grade is more likely than not; the classifier learns from the labels.

    Row by row: of rows that repeat, all stay or all go. A null text counts as an empty one; a null id learns nothing but is
    scored like any other.
    """
    ratings = quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, quality.train(docs, ratings), carry=True).filter("selected").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component: that of the least id, null last, then of the least digest of the text.

    Of rows that are equal in both, each task passes on only one.
    """
    found = simhash.near_duplicates(docs.select(_row().alias("row"), "text"), key="row")
    kept = found.filter(F.col("row") == F.col("component_id")).select("row.*").distinct()
    key = kept.columns  # plain columns: as structs that differ in what may be null, they would be dealt out once more for the join
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("doc")))
    one = _whole(docs).select("doc", "row.*").withColumn("copy", first).filter("copy = 1")
    return one.join(kept.hint("shuffle_hash"), key, "left_semi").select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes of it, as rows. Of rows equal in id and text, all get as many as one."""
    mixed = mixing.mix(docs.select(_row().alias("row"), "text", "source"), key="row")
    copies = mixed.filter("copies > 0").groupBy("row").agg(F.max("copies").alias("copies"))
    many = _whole(docs).join(copies.hint("shuffle_hash"), "row")
    return many.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row, and the digest of what they decode to; a null text has none and decodes to nothing.

    One row for each row given, copies included.
    """
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode_decode(docs, path, ["doc_id", "source"])
    return coded.select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("bpe", encode),
]
#: The stages cannot be said in SQL; tests/llm/test_pipeline.py holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared.stored(docs, name)
    return docs
