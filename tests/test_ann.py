"""The stored vector index against exact search."""

import os

import numpy as np
import pytest

from sparkfolio.operators import ann, chunking, context

TABLE = "/root/testdata/sf0.1/embeddings.parquet"


def exact(rows, query, k, may=None):
    v, q = rows / np.linalg.norm(rows, axis=1, keepdims=True), query / np.linalg.norm(query)
    far = 1 - v @ q
    if may is not None:
        far[~may] = np.inf
    return np.argsort(far, kind="stable")[:k]


@pytest.mark.skipif(not os.path.exists(TABLE), reason="needs the test tables")
def test_recall_on_the_test_vectors(spark, tmp_path):
    """Independent directions: recall of 0.9 from part of the lists, with a twentieth of the vectors compared."""
    df = spark.read.parquet(TABLE).selectExpr("cast(vec_id as string) as file_uid", "0 as ordinal", "embedding").orderBy("file_uid")
    ann.build(df, str(tmp_path))
    table = df.toPandas()
    rows = np.array(table["embedding"].tolist(), float)
    asked = list(range(0, 2000, 50))
    found = ann.search(spark, str(tmp_path), rows[asked].tolist()).collect()
    assert 100 <= 0.2 * len(rows)  # vectors compared exactly
    hits = [len({r["file_uid"] for r in found if r["query"] == n} & set(table["file_uid"][exact(rows, rows[q], 10)])) for n, q in enumerate(asked)]
    assert np.mean(hits) / 10 >= 0.9


def test_lists_of_clustered_vectors(spark, tmp_path):
    """Where vectors have neighbours, a twelfth of the lists is enough; rights are checked before the cut."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 32))
    rows = centres[rng.integers(60, size=6000)] + 0.4 * rng.normal(size=(6000, 32))
    df = spark.createDataFrame([(f"f{k:05}", k % 3, v) for k, v in enumerate(rows.tolist())] + [("null", 0, None), ("zero", 0, [0.0] * 32), ("nan", 0, [float("nan")] * 32), ("short", 0, [1.0])], "file_uid string, ordinal int, embedding array<double>")
    ann.build(df, str(tmp_path))
    asked = list(range(0, 6000, 200))
    found = ann.search(spark, str(tmp_path), rows[asked].tolist(), probe=1 / 12).collect()
    hits = [len({int(r["file_uid"][1:]) for r in found if r["query"] == n} & set(exact(rows, rows[q], 10).tolist())) for n, q in enumerate(asked)]
    assert np.mean(hits) / 10 >= 0.9
    may = np.arange(6000) % 50 == 7  # few may be read, the page is full all the same
    grants = spark.createDataFrame([(f"f{k:05}",) for k in np.flatnonzero(may)], "file_uid string")
    found = sorted(ann.search(spark, str(tmp_path), [rows[0].tolist()], k=20, probe=1.0, rerank=120, grants=grants).collect(), key=lambda r: r["rank"])
    assert [int(r["file_uid"][1:]) for r in found] == exact(rows, rows[0], 20, may).tolist()
    with pytest.raises(ValueError, match="32 places"):
        ann.search(spark, str(tmp_path), [[1.0, 2.0]])


def test_nothing_to_index(spark, tmp_path):
    with pytest.raises(ValueError, match="no vector"):
        ann.build(spark.createDataFrame([("a", 0, None)], "file_uid string, ordinal int, embedding array<float>"), str(tmp_path))


@pytest.mark.skipif(not os.path.exists(TABLE), reason="needs the test tables")
def test_questions_from_a_stored_index(spark, tmp_path):
    """Chunks of whole documents, all benchmark texts as questions: nine tenths of the nearest readable chunks are found."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("cast(doc_id as string) as file_uid", "doc_id", "text as content_md")
    chunks = chunking.index_files(docs, 64)
    ann.build(chunks, str(tmp_path))
    grants = docs.filter("doc_id % 5 <> 0").select("file_uid")
    questions = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id as id", "text")
    odd = spark.createDataFrame([(-1, ""), (-2, None), (-3, " \n "), (None, "the and of")], "id long, text string")
    found = context.ask_stored(spark, str(tmp_path), questions.union(odd), grants, 64, chunks=chunks).collect()
    may = {r["file_uid"] for r in grants.collect()}
    assert not {-1, -2, -3} & {r["id"] for r in found} and {r["file_uid"] for r in found} <= may
    assert sorted(r["rank"] for r in found if r["id"] is None) == list(range(1, 9))
    table = [r for r in chunks.collect() if r["file_uid"] in may and any(r["embedding"])]
    text = {(r["file_uid"], r["ordinal"]): r["text"] for r in table}
    assert all(r["text"] == text[r["file_uid"], r["ordinal"]] for r in found)
    vector = {(r["file_uid"], r["ordinal"]): np.array(r["embedding"], float) for r in table}
    every = np.stack(list(vector.values()))
    hits, asked = 0, chunking.hash_embed(questions, ["id"], "text", 64).collect()
    for q in asked:
        at = np.array(q["embedding"], float)
        far = np.sort(1 - every @ at)[:8]
        mine = sorted((r for r in found if r["id"] == q["id"]), key=lambda r: r["rank"])
        assert [r["distance"] for r in mine] == pytest.approx([1 - vector[r["file_uid"], r["ordinal"]] @ at for r in mine], abs=1e-5)
        assert [r["rank"] for r in mine] == list(range(1, 9))
        hits += sum(r["distance"] <= far[-1] + 1e-6 for r in mine)
    assert hits >= 0.9 * 8 * len(asked)
    blank = context.ask_stored(spark, str(tmp_path), odd.filter("id < 0"), grants, 64)
    assert blank.columns == ["id", "rank", "file_uid", "ordinal", "distance"] and blank.count() == 0


def test_codes_that_cannot_tell_leave_no_neighbour_out(spark, tmp_path):
    """Vectors closer together than their codes can say, some of them equal: all of the nearest are found, in order."""
    rng = np.random.default_rng(4)
    rows = np.repeat(rng.normal(size=(4, 16)), 500, axis=0) + 0.01 * rng.normal(size=(2000, 16))
    rows[7:40] = rows[6]
    rows = rows.astype(np.float32).astype(float)
    df = spark.createDataFrame([(f"f{k:04}", 0, v) for k, v in enumerate(rows.tolist())], "file_uid string, ordinal int, embedding array<double>")
    ann.build(df, str(tmp_path), lists=4)
    asked = [6, 100, 777, 1900]
    found = ann.search(spark, str(tmp_path), rows[asked].tolist(), probe=1.0, rerank=None).collect()
    for n, q in enumerate(asked):
        far = np.round(1 - (rows / np.linalg.norm(rows, axis=1, keepdims=True)) @ (rows[q] / np.linalg.norm(rows[q])), 12)
        mine = [int(r["file_uid"][1:]) for r in sorted((r for r in found if r["query"] == n), key=lambda r: r["rank"])]
        assert mine == np.argsort(far, kind="stable")[:10].tolist()
