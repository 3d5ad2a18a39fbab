"""Every numbered operator on odd tables: nulls, empty and very long texts, ties, repeats, no rows, clashing names."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import audit, bpe, lang_id, mixing, negatives, neighbours, packing, quality, shared, simhash, token_counts, token_files, vectors, warc

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
#: Names that the operators use inside or return.
CLASHES = """__key __text __lang __score __fp __part __least __source __hash __place __grade t c0 ids decoded n_bytes n_tokens over_limit score
lang_pred held_out fingerprint component_id size place target copies taken row selected captured digest original run pos id v rid node rank n_links kept
part bits words start length sequence_id offset anchor number leaf block least most squares anchor_id negative_id""".split()
LONG = "the thing is that a text of any length is read whole " * 6000


def documents(spark):
    rows = [(k, f"the {k} and thing number {k % 7} of with {'é' * (k % 3)}", "en" if k % 2 else "fr", "ab"[k % 2]) for k in range(40)]
    rows += [(None, "no id here", "en", "a"), (None, None, None, None), (50, None, "fr", None), (51, "", "en", "a"), (52, " \t\n", None, "b"), (53, "12 % 34", "fr", "b")]
    rows += [(54, LONG, "en", "a"), (55, LONG, "en", "a"), (56, "漢字" * 9000, None, "b"), (57, "same", "en", "a"), (57, "same", "en", "a"), (57, "other", "en", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


def pages(spark):
    rows = [(k, f"http://a/{k % 3}", "x" * (999 + k % 3)) for k in range(20)] + [(None, None, None), (None, "http://b", "x" * 1000), (300_000_000_000, "u", ""), (5, "http://a/2", LONG), (5, "http://a/2", LONG)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def embeddings(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=6).tolist(), k % 2) for k in range(30)]
    rows += [(None, rows[0][1], 0), (40, None, 0), (41, [], 0), (42, [0.0] * 6, 1), (43, [float("nan")] * 6, 1), (44, [None] + [1.0] * 5, 0), (45, rows[1][1], 1), (45, rows[1][1], 1), (46, [1.0, 2.0], None), (47, [float("inf")] * 6, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


def files(spark, df):
    folder = token_files.write_token_files(df, WORD, shared.new_folder(spark, "tokens"))
    return token_files.read_token_digests(spark, folder)


def archived(spark, df):
    folder = shared.new_folder(spark, "warc")
    return warc.read_archives(warc.archive(df, folder), folder)


def graded(df):
    return quality.train(df, df.filter("doc_id < 40").select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade")))


OPERATORS = {
    "lang_id": (documents, lambda spark, df: lang_id.predict(df, lang_id.train(df))),
    "simhash": (documents, lambda spark, df: simhash.near_duplicates(df)),
    "warc": (pages, archived),
    "token_files": (documents, files),
    "vectors": (embeddings, lambda spark, df: vectors.near_vectors(df)),
    "neighbours": (embeddings, lambda spark, df: neighbours.nearest(df, df.filter("vec_id < 3"))),
    "bpe": (documents, lambda spark, df: bpe.encode_decode(df, BYTE)),
    "quality": (documents, lambda spark, df: quality.score(df, graded(df))),
    "mixing": (documents, lambda spark, df: mixing.mix(df)),
    "token_counts": (documents, lambda spark, df: token_counts.token_counts(df, BYTE)),
    "negatives": (embeddings, lambda spark, df: negatives.hard_negatives(df, F.col("vec_id") < 3)),
    "audit": (documents, lambda spark, df: audit.audit(df, df.select("doc_id", F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic"), "*"))),
    "packing": (documents, lambda spark, df: packing.pack_texts(df.repartition(1, "doc_id"), WORD)),
}
#: Operators of which the result has another number of rows than the table.
OTHER_ROWS = {"neighbours": 30, "audit": 3 * 600, "negatives": None, "packing": None}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, name):
    make, run = OPERATORS[name]
    df = make(spark)
    plain = [c for c in df.columns]
    bare = run(spark, df).collect()
    clash = df.select("*", *(F.lit("x").alias(c) for c in CLASHES if c not in plain))
    found = run(spark, clash).select(*(bare[0].asDict())).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, bare))
    assert len(bare) == (OTHER_ROWS.get(name, df.count()) or len(bare)) > 0
    assert run(spark, df.limit(0)).count() == 0
    names = set(bare[0].asDict())
    assert set(run(spark, df.limit(0)).columns) >= names


def test_results_do_not_depend_on_ansi_mode(spark):
    df = documents(spark)
    wanted = sorted(map(repr, mixing.mix(df).collect()))
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        found = mixing.mix(df).collect()
        assert sorted(map(repr, found)) == wanted and min(r["size"] for r in found) == 0
        spark.conf.set("spark.sql.legacy.sizeOfNull", "true")
        assert sorted(map(repr, mixing.mix(df).collect())) == wanted
    finally:
        spark.conf.unset("spark.sql.legacy.sizeOfNull")
        spark.conf.unset("spark.sql.ansi.enabled")


def test_a_key_may_have_the_name_of_a_result(spark):
    df = spark.createDataFrame([(1, "the thing")], "ids long, text string")
    row = bpe.encode_decode(df, BYTE, "ids").first()
    assert row["ids"] == 1 and len(row["ids_"]) == 2 and row["decoded"] == "the thing"


def test_keys_have_to_be_integers_where_files_hold_them(spark):
    df = spark.createDataFrame([("a", "the thing", "u")], "doc_id string, text string, url string")
    with pytest.raises(TypeError, match="integer type"):
        token_files.write_token_files(df, WORD, shared.new_folder(spark, "tokens"))
    with pytest.raises(TypeError, match="integer type"):
        warc.archive(df, shared.new_folder(spark, "warc"), key="doc_id", html="text")


def test_times_of_captures(spark):
    rows = [(1, "u", "x", None), (2, "u", "y", 10**15), (3, "u", "z", -(10**15)), (4, "u", "w", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, at long")
    folder = shared.new_folder(spark, "warc")
    index = warc.archive(df, folder, captured="at")
    assert [r["page_id"] for r in warc.captures(spark, index, "u").collect()] == [3, 4, 1, 2]
    assert warc.read_archives(index, folder).count() == 4


@pytest.mark.parametrize("folder,kind,path", [("/a/b", "local", "/a/b"), ("file:/a/b", "local", "/a/b"), ("file:///a/b", "local", "/a/b")])
def test_folders_as_spark_names_them(folder, kind, path):
    store, found = shared.file_store(folder)
    assert (store.type_name, found) == (kind, path)


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError, match="word"):
        token_files.WordEncoder(BYTE)
