"""Stored postings against a pass over all texts; the similarity join against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import terms
from sparkfolio.operators import search, trigram


def files(spark):
    rng = random.Random(7)
    words = "steel bolt bolts licence license apache version table tables trash cat catalogue übung".split()
    rows = [(f"f{k:03}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 3))) or None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), rng.choice(["indexed", "indexed", "error"])) for k in range(150)]
    rows += [("none", None, None, "indexed"), ("empty", "", "", "indexed"), ("stop", "the", "of the", "converted")]
    return spark.createDataFrame(rows, "file_uid string, name string, content_md string, status string").persist()


@pytest.mark.parametrize("query", ["apache license", "bolts", '"steel bolt" or cat', "-trash", "-trash -table or licence", "xyzzy"])
def test_search_on_stored_structures_gives_the_same(spark, tmp_path, query):
    docs = files(spark)
    grants = docs.filter("file_uid <> 'f003'").select("file_uid")
    search.store_index(search.inverted_index(docs), str(tmp_path / "stems"), docs)
    trigram.store_trigrams(trigram.trigram_index(docs), str(tmp_path / "grams"))
    index = search.stored_index(spark, str(tmp_path / "stems"), search.Query(query))
    postings = trigram.stored_trigrams(spark, str(tmp_path / "grams"), query)
    wanted = search.search(docs, None, grants, query, 100).collect()
    assert search.search(docs, index, grants, query, 100, postings=postings).collect() == wanted
    assert bool(wanted) == (query != "xyzzy")


def test_negations_on_a_stored_index(spark, tmp_path):
    docs = files(spark)
    index = search.inverted_index(docs)
    search.store_index(index, str(tmp_path), docs)
    for query in ("-trash", "-trash or steel", "-nosuchword"):
        wanted = search.Query(query)
        full = {r[0] for r in search.matching(index, wanted, every=docs).select("file_uid").collect()}
        assert {r[0] for r in search.matching(search.stored_index(spark, str(tmp_path), wanted), wanted).select("file_uid").collect()} == full
        assert "none" in full or query == "-trash or steel" and "empty" in full


def test_hot_lexemes_are_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "INDEX_ROWS", 10)
    monkeypatch.setattr(trigram, "ROWS", 10)
    docs = spark.createDataFrame([(f"f{k}", "same", "same word") for k in range(200)], "file_uid string, name string, content_md string")
    search.store_index(search.inverted_index(docs), str(tmp_path / "i"))
    assert search.stored_index(spark, str(tmp_path / "i"), search.Query("word")).count() == 200
    trigram.store_trigrams(trigram.trigram_index(docs), str(tmp_path / "g"))
    assert trigram.similar_names(trigram.stored_trigrams(spark, str(tmp_path / "g"), "same"), "same").count() == 200


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_similar_pairs(spark, least):
    rng = random.Random(3)
    make = lambda n: [(k, rng.choice([None, "", " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 3)))])) for k in range(n)]
    a, b = make(120), make(90) + [(900 + k, "abc abc") for k in range(40)]
    grams = lambda rows: {k: frozenset(terms.trigram_list(t)) for k, t in rows if terms.trigram_list(t)}

    def classes(rows):
        out = {}
        for k, g in grams(rows).items():
            out.setdefault(g, []).append(k)
        return {g: (min(ks), len(ks)) for g, ks in out.items()}

    wanted = {(k, m, n, o) for g, (k, n) in classes(a).items() for h, (m, o) in classes(b).items() if len(g & h) / len(g | h) >= least}
    frame = lambda rows: spark.createDataFrame(rows, "id int, text string").withColumn("gram", F.lit("x"))
    found = trigram.similar_pairs(frame(a), frame(b), least).collect()
    assert {(r["left_id"], r["right_id"], r["left_n"], r["right_n"]) for r in found} == wanted and len(found) == len(wanted)
    assert trigram.similar_pairs(frame(a), frame(b).limit(0), least).count() == 0


def test_texts_are_gone_through_once_for_a_stored_index(spark, tmp_path):
    docs = files(spark)
    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    texts = docs.withColumn("content_md", F.udf(count, "string")("content_md"))
    search.store_index(search.inverted_index(texts), str(tmp_path), docs)
    assert seen.value == docs.count()
    found = search.stored_index(spark, str(tmp_path), search.Query("-trash"))
    assert found.filter("lexeme = ''").count() == docs.count()


def test_different_texts_of_the_same_trigrams_keep_their_pairs(spark):
    rows = [(k, f"no {d * n}") for k, (d, n) in enumerate((d, n) for d in "1234" for n in (3, 4, 5, 6))] + [(90, "no 1111"), (91, "1111 no"), (92, None)]
    names = spark.createDataFrame(rows, "id int, text string")
    grams = {k: set(terms.trigram_list(t)) for k, t in rows if t and k != 90}
    wanted = {(k, m) for k, g in grams.items() for m, h in grams.items() if len(g & h) / len(g | h) >= 0.75}
    found = trigram.similar_pairs(names, names, 0.75, each=True).collect()
    assert {(r["left_id"], r["right_id"]) for r in found} == wanted and len(found) == len(wanted)
    assert {(r["left_id"], r["left_n"]) for r in found} == {(k, 2 if k == 1 else 1) for k in grams}


def test_names_alike_but_for_a_number_meet_only_where_they_are_similar(spark, monkeypatch):
    names = spark.range(2000).select("id", F.concat(F.lit("Supplier#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("text"))
    frame, compared = type(names), []
    keep = frame.distinct
    monkeypatch.setattr(frame, "distinct", lambda df: compared.append(df) or keep(df) if "left_id" in df.columns else keep(df))
    found = trigram.similar_pairs(names, names, 0.75).count()
    assert keep(compared[0]).count() < 3 * found  # by one rare trigram at a time, most pairs of names met


def test_texts_that_cannot_count_are_left_out_before_joins(spark):
    words = "trash nobility relational dying skies happily licensing ügel no. bolt".split()
    for w in words:
        assert w.startswith(terms.stem_head(terms.stem(w)))
    assert terms.stem_head(terms.stem("licensing")) == "licens" and terms.stem_head("") == ""
    docs = files(spark).withColumn("status", F.lit("indexed"))
    may = docs.filter(search.may_have(["apach", "licens"])).select("file_uid")
    has = search.inverted_index(docs).filter("lexeme in ('apach', 'licens')").select("file_uid")
    assert has.subtract(may).count() == 0 < may.count() < docs.count()
    short = docs.filter(terms.may_share("apache license", F.col("content_md")) < terms.shared_trigrams("apache license", F.col("content_md")))
    assert short.count() == 0


def test_python_sees_a_text_once_and_after_the_rights(spark):
    docs = files(spark)
    plan = search.search(docs, None, docs.select("file_uid"), "apache license")._jdf.queryExecution().optimizedPlan().toString()
    at = [k for k, line in enumerate(plan.splitlines()) if "ArrowEvalPython [word_similarity" in line]
    rights = [k for k, line in enumerate(plan.splitlines()) if "Join LeftSemi" in line]
    assert len(at) == 1 and rights[0] > at[0]  # below in the plan is before
