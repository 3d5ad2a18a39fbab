"""The bucketed store of documents and chunks, and newest-wins across batches."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import tables
from sparkfolio.operators.store import CHANGES, FileStore


def words(docs):
    """A chunk a word."""
    return docs.select("tenant", "file_uid", F.posexplode(F.split("content_md", " ")).alias("ordinal", "text"))


def change(uid, version, text=None, deleted=False, ts="", event="", status="indexed", tenant="t"):
    return (tenant, uid, version, ts, event, "text/plain", f"name {version}", "/p", status, None, text, deleted)


def brute(changes):
    """One change after the other, in order."""
    docs = {}
    for c in sorted(changes, key=lambda c: (c[2] or "", c[3] or "", c[4] or "")):
        key = c[:2]
        if c[11]:
            docs.pop(key, None)
        else:
            old = docs.get(key)
            docs[key] = (c[2], c[6], c[10] if c[10] is not None else old and old[2])
    return docs


def held(store):
    return {(r["tenant"], r["file_uid"]): (r["source_version"], r["name"], r["content_md"]) for r in store.documents().collect()}


def test_batches_in_any_order_end_the_same(spark, tmp_path):
    rng = random.Random(1)
    changes = [change(f"f{rng.randrange(8)}", f"v{rng.randrange(4)}", rng.choice([None, "", "one two", f"text {k}"]), rng.random() < 0.25, ts=f"{k:03}", event=f"e{k}", tenant=rng.choice("tu")) for k in range(60)]
    changes += changes[:5]
    batches = [changes[k::3] for k in range(3)]
    wanted = brute(changes)
    for n, order in enumerate([(0, 1, 2), (2, 0, 1)]):
        store = FileStore(spark, str(tmp_path / f"s{n}"), 4, words)
        for k in order:
            assert store.apply(f"b{k}", spark.createDataFrame(batches[k], CHANGES))
        assert held(store) == wanted
        before = store.ledger().count()
        assert not store.apply("b1", spark.createDataFrame(batches[1], CHANGES)) and store.ledger().count() == before
        store.apply("again", spark.createDataFrame(batches[1], CHANGES))  # the same rows under another name
        assert held(store) == wanted
        chunks = {}
        for r in store.chunks().orderBy("ordinal").collect():
            chunks.setdefault((r["tenant"], r["file_uid"]), []).append(r["text"])
        assert chunks == {k: v[2].split(" ") for k, v in wanted.items() if v[2] is not None}


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = FileStore(spark, str(tmp_path), 64, words)
    store.apply("all", spark.createDataFrame([change(f"f{k}", "v1", f"text {k}") for k in range(500)], CHANGES))
    files = lambda: {str(p) for p in (tmp_path / "files").glob("*/*/*.parquet")}
    before = files()
    store.apply("ten", spark.createDataFrame([change(f"f{k}", "v2", "new") for k in range(10)], CHANGES))
    ledger = store.ledger().orderBy("turn").collect()
    assert len(ledger[1]["buckets"]) <= 10 and before <= files()
    assert {p.split("bucket=")[1].split("/")[0] for p in files() - before} == {str(b) for b in ledger[1]["buckets"]}
    assert store.documents().filter("content_md = 'new'").count() == 10 and store.documents().count() == 500
    assert store.chunks().count() == 490 * 2 + 10
    assert store.outdated().count() == 2 * len(ledger[1]["buckets"])


def test_a_lost_writer_leaves_nothing_to_read(spark, tmp_path):
    store = FileStore(spark, str(tmp_path), 4, words)
    store.apply("one", spark.createDataFrame([change("a", "v1", "old text")], CHANGES))
    bad = FileStore(spark, str(tmp_path), 4, lambda docs: docs.select("tenant", "file_uid", F.raise_error(F.lit("lost")).alias("ordinal"), F.lit("x").alias("text")))
    with pytest.raises(Exception, match="lost"):
        bad.apply("two", spark.createDataFrame([change("a", "v2", "new")], CHANGES))
    assert held(store) == {("t", "a"): ("v1", "name v1", "old text")}
    assert store.apply("two", spark.createDataFrame([change("a", "v2", "new")], CHANGES))
    assert held(store)["t", "a"][2] == "new" and [r["text"] for r in store.chunks().collect()] == ["new"]
    assert store.apply("none", spark.createDataFrame([], CHANGES)) and len(held(store)) == 1


def test_an_older_change_does_not_overwrite(spark):
    docs = spark.createDataFrame([("a", "v9", "new"), ("b", None, "old")], "file_uid string, source_version string, content_md string")
    changes = spark.createDataFrame([("a", "v1", "stale"), ("b", "v1", None), ("c", None, "x")], docs.schema)
    assert sorted(tuple(r) for r in tables.upsert(docs, changes, F.current_timestamp()).collect()) == [("a", "v9", "new"), ("b", "v1", "old"), ("c", None, "x")]


def test_equal_versions_have_one_winner(spark):
    rows = [("a", "v1", k, [k]) for k in range(4)] + [("a", None, 9, None)]
    for order in itertools.islice(itertools.permutations(rows), 0, 120, 17):
        df = spark.createDataFrame(list(order), "k string, v string, i int, l array<int>").repartition(3)
        assert [tuple(r) for r in tables.newest(df, "k", "v").collect()] == [("a", "v1", 3, [3])]
