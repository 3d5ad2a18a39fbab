"""Early stopping against reading everything."""

import random

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import terms
from sparkfolio.operators import search, topk


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [w for n, w in ((30, "steel"), (20, "bolt"), (3, "copper"), (1, "zinc")) for _ in range(n)] + [f"w{k}" for k in range(60)]
    rows = [(f"f{k:04}", " ".join(rng.choice(words) for _ in range(int(rng.paretovariate(1.1) * 4)))[:20_000]) for k in range(1200)] + [("empty", "")]
    docs = spark.createDataFrame(rows, "file_uid string, content_md string").withColumn("name", F.lit("")).persist()
    index = search.inverted_index(docs).persist()
    path = str(tmp_path_factory.mktemp("blocks"))
    topk.store_blocks(index, path, 16)
    return docs, index, path


@pytest.mark.parametrize("text,share", [("steel", 0.5), ("steel bolt", 0.5), ("steel or bolt", 0.5), ("steel -zinc", 0.6), ('"steel bolt"', 1.0), ("zinc or copper", 1.0), ("copper zinc", 1.0), ("nowhere", 1.0), ("the", 1.0)])
def test_the_best_are_exact(spark, stored, monkeypatch, text, share):
    monkeypatch.setattr(topk, "FIRST", 4)
    docs, index, path = stored
    wanted = [tuple(r) for r in search.matching(index, search.Query(text)).orderBy(F.desc("rank"), "file_uid").limit(20).collect()]
    found = topk.best(spark, path, text)
    assert [u for u, _ in found.rows] == [u for u, _ in wanted]
    assert [r for _, r in found.rows] == pytest.approx([r for _, r in wanted], abs=1e-12)
    assert found.read <= share * found.blocks or found.blocks < 20


def test_rights_count_before_the_cut(spark, stored):
    docs, index, path = stored
    grants = docs.filter(F.xxhash64("file_uid") % 17 == 0).select("file_uid")
    wanted = search.matching(index, search.Query("steel")).join(grants, "file_uid", "left_semi").orderBy(F.desc("rank"), "file_uid").limit(20).collect()
    assert [u for u, _ in topk.best(spark, path, "steel", grants=grants).rows] == [r["file_uid"] for r in wanted]
    with pytest.raises(ValueError, match="negations"):
        topk.best(spark, path, "-steel")


def test_an_index_is_gathered_where_the_texts_are(spark):
    """No posting is shuffled before an index is dealt out, and each is that of a plain pass over the words."""
    rng = random.Random(5)
    words = "the running runs run bolt bolts of Übung übung license licensed a42".split()
    rows = [(k, rng.choice([None, "", "Bolts"]), rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 300)))])) for k in range(120)]
    docs = spark.createDataFrame(rows, "id long, name string, content_md string")
    index = search.inverted_index(docs, "id", lengths=True)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    wanted = {}
    for k, name, content in rows:
        for at, word in enumerate(said := f"{name or ''} {content or ''}".lower().split()):
            if word not in terms.STOP_WORDS:
                wanted.setdefault((k, terms.stem(word), len(said)), []).append(at + 1)
    found = {(r["id"], r["lexeme"], r["length"]): r["positions"] for r in index.collect()}
    assert found == wanted
    some = {(r["id"], r["lexeme"]): r["positions"] for r in search.inverted_index(docs, "id", only=["run", "bolt"]).collect()}
    assert some == {(k, w): at for (k, w, _), at in wanted.items() if w in ("run", "bolt")}


def test_blocks_by_lengths_that_are_given(spark, stored, tmp_path):
    docs, index, path = stored
    topk.store_blocks(search.inverted_index(docs, lengths=True), str(tmp_path), 16, search.lengths(docs))
    assert [u for u, _ in topk.best(spark, str(tmp_path), "steel or bolt").rows] == [u for u, _ in topk.best(spark, path, "steel or bolt").rows]
