"""The pipeline's stages against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from test_documents import brute_bits, brute_fingerprint, brute_plain, brute_tails, brute_targets, components
from tokenizers import Tokenizer

import corpus_pipeline
from sparkfolio.llm import lang_id, quality

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage on what the one before it kept, against code that shares nothing with the operators but the fitted models."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        if name == "language_id":
            model = lang_id.train(docs)
        if name == "quality":
            model = quality.train(docs, quality.graded(spark.read.parquet(f"{SF}/labels.parquet")))
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        kept = {r["doc_id"] for r in after}
        assert after and (name == "bpe" or docs.columns == columns)
        if name == "language_id":
            for r in before:
                if len(r["text"] or "") > 600:
                    continue
                bits = brute_bits(model, r["text"] or "")
                sure = 1 / sum(2 ** max(min(bits) - b, -1000) for b in bits) >= 0.5
                best = bits.index(min(bits))
                sure = sure and brute_plain(model, r["text"] or "")[best] - bits[best] >= 0.25 * len((r["text"] or "").encode()) - 32
                assert (r["doc_id"] in kept) == (sure and any(c.isalpha() for c in r["text"] or "")), r["doc_id"]
        elif name == "quality":
            assert kept == {r["doc_id"] for r in before if brute_tails(model, r["text"] or "")[1] >= 0.5}
        elif name == "near_duplicates":
            prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in before}
            near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
            assert kept == set(components(prints, near).values()) and len(after) == len(kept)
        elif name == "mixing":
            sizes, taken, copies = Counter(), Counter(), Counter(r["doc_id"] for r in after)
            words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in before}
            for r in before:
                sizes[r["source"]] += words[r["doc_id"]]
                taken[r["source"]] += words[r["doc_id"]] * copies[r["doc_id"]]
            for source, wanted in brute_targets(sizes).items():
                least = min(words[r["doc_id"]] for r in before if r["source"] == source and words[r["doc_id"]])
                assert abs(taken[source] - wanted) <= max(least, 0.02 * wanted)  # a source has few texts here
            assert max(copies.values()) <= 2
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            texts = {r["doc_id"]: r["text"] or "" for r in before}
            assert Counter(kept) == Counter({r["doc_id"] for r in before}) and len(after) == len(before)
            for r in after:
                ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
                assert r["ids"] == ids and r["n_tokens"] == len(ids)
                assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "12 34", "en", "s", 5), (None, "the thing and the other", "en", None, 20), (9004, "of the and was with " * 4000, "en", "s", 80_000)], docs.schema)
    docs.union(odd).union(docs.limit(3)).withColumn("component_id", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    rows = found.collect()
    assert rows and not {9001, 9002, 9003} & {r["doc_id"] for r in rows}
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows)


def test_run_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_gibberish_and_unknown_languages_go_and_clean_texts_stay(spark):
    """Letters in no order and text in none of the languages have a share of 1, but gain nothing; no clean text is lost."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(3)
    clean = [r["text"] for r in docs.filter("length(text) > 40").limit(30).collect()]
    strange = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)) for n in (20, 60, 200, 3000, 50_000)]
    strange += ["".join(rng.sample(text, len(text))) for text in clean]
    strange += ["Suomen kieli on uralilaisten kielten itämerensuomalaiseen ryhmään kuuluva kieli", "Русский язык является одним из восточнославянских языков " * 3, "日本語は日本国内や日本人同士の間で使われている言語", "QmFzZTY0IGVuY29kZWQgdGV4dCBpcyBub3QgYSBsYW5ndWFnZQ=="]
    strange = [text if len(text) > 40 or text.isascii() else text * 4 for text in strange]
    odd = spark.createDataFrame([(1_000_000 + k, text, None, "s", len(text)) for k, text in enumerate(strange)], docs.schema)
    kept = [r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.union(odd), SF).select("doc_id").collect()]
    assert not [k for k in kept if k >= 1_000_000]
    found = lang_id.predict(docs, lang_id.train(docs)).filter("lang_pred <> 'und' and score >= 0.5").count()
    assert len(kept) == found


def test_toxic_and_doubled_texts_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    ratings = quality.graded(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 0
    found = quality.score(docs, quality.train(docs, ratings.filter(learn))).join(ratings.filter(~learn), "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 0 for r in found)
    kept = [r["selected"] for r in found if r["grade"] == 2]
    gone = [not r["selected"] for r in found if r["grade"] == 0]
    assert sum(kept) / len(kept) > 0.95 and sum(gone) / len(gone) > 0.9


def test_each_component_keeps_one_row_whatever_its_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {k: " ".join(f"{k}{(n * n + 7 * n) % 101}x{n}" for n in range(60)) for k in "ABCDE"}
    rows = [
        (None, texts["A"]), (None, texts["A"]), (None, texts["B"]), (None, texts["C"]), (3, texts["C"]),
        (3, texts["C"]), (7, texts["C"]), (7, texts["D"]), (8, texts["D"]), (5, texts["E"]), (5, ""), (None, None),
    ]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    found = corpus_pipeline.near_duplicates(spark, odd.repartition(3), SF)
    assert found.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in found.collect()]
    expected = [(None, texts["A"]), (None, texts["B"]), (3, texts["C"]), (7, texts["D"]), (5, texts["E"]), (5, "")]
    assert sorted(kept, key=repr) == sorted(expected, key=repr)
