"""Archives and vectors against brute force."""

import gzip
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import neighbours, shared, vectors, warc


def test_archives_read_back(spark):
    big, other = "<p>é" * 400, "x" * 1000
    rows = [(1, "http://a.org/x", big), (2, "http://b.org/y", big), (3, "https://A.org:8080/x?q=1#f", big), (4, None, None), (5, "http://a.org/", ""), (6, "bad url", "x" * 999), (7, "http://c.d", "x" * 999)]
    rows += [(8, "http://e.f", other), (None, "http://e.f/2", other), (8, "http://e.f", other), (9, "http://g.h/\r\nX: y", "tail")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("original", F.lit(1)).repartition(3)
    folder = shared.new_folder(spark, "warc")
    index = warc.archive(pages, folder)
    found = warc.read_archives(index, folder).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r["page_id"], []).append(r)
    payload = {k: (h or "").encode() for k, _, h in rows}
    for r in found:
        raw = payload[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert r["html"] is None if r["record_type"] == "revisit" else r["html"].encode() == raw
    kinds = {k: {(r["record_type"], r["refers_to"]) for r in v} for k, v in by_id.items()}
    assert kinds == {1: {("revisit", 3)}, 2: {("revisit", 3)}, 3: {("response", None)}, 4: {("response", None)}, 5: {("response", None)}, 6: {("response", None)}, 7: {("response", None)}, 8: {("response", None)}, None: {("revisit", 8)}, 9: {("response", None)}}
    keys = [(r["url_key"], r["captured"], r["page_id"] is not None, r["page_id"] or 0) for r in index.collect()]
    assert keys == sorted(keys)
    assert [r["page_id"] for r in warc.captures(spark, index, "org,a)/x").collect()] == [1, 3]


def test_archive_is_a_gzip_file_of_records(spark):
    import glob

    folder = shared.new_folder(spark, "warc")
    warc.archive(spark.createDataFrame([(k, f"http://h/{k}", f"page {k}") for k in range(10)], "page_id long, url string, html string").coalesce(1), folder)
    raw = b"".join(gzip.open(f).read() for f in glob.glob(f"{folder.removeprefix('file:')}/*.warc.gz"))
    assert raw.count(b"WARC/1.1\r\n") == 10 and raw.endswith(b"\r\n\r\n")


def test_entries_that_repeat_are_dealt_out(spark, monkeypatch):
    """Pages without URL and id have one key: their ranges are bounded all the same, and every one is read back."""
    monkeypatch.setattr(warc, "RANGE", 500)
    folder = shared.new_folder(spark, "warc")
    pages = spark.range(4000).select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.format_string("page %d", F.col("id") % 7).alias("html")).repartition(4)
    merged = warc.merge_runs(warc.write_archives(pages, folder))
    sizes = [r["n"] for r in merged.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 1500
    assert warc.read_archives(merged, folder).groupBy("html").count().count() == 7
    assert not [f for f in os.listdir(folder.removeprefix("file:")) if f.endswith(".part")]


def test_repeated_payloads_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "SENT", 0)
    folder = shared.new_folder(spark, "warc")
    rows = [(k, f"http://h/{k}", "x" * (1000 + k % 2)) for k in range(10)] + [(k, None, "") for k in range(10, 40)]
    found = warc.read_archives(warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), folder), folder).collect()
    assert sorted((r["page_id"], r["refers_to"]) for r in found) == [(k, 8 + k % 2 if k < 8 else None) for k in range(40)]


def test_archives_of_an_empty_table(spark):
    folder = shared.new_folder(spark, "warc")
    index = warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archives(index, folder).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 30))) for _ in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def brute_links(rows):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links = {k: set() for k in range(len(rows))}
    for a, (_, v, p) in enumerate(rows):
        for b in range(a):
            _, w, q = rows[b]
            if ok(v) and ok(w) and p is not None and p == q and len(v) == len(w):
                v1, w1 = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if v1 @ w1 / np.sqrt((v1 @ v1) * (w1 @ w1)) >= 0.93:
                    links[a].add(b)
                    links[b].add(a)
    return links


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)  # so that buckets are split
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = rng.normal(size=32)
        for _ in range(rng.integers(1, 40)):
            rows.append((len(rows), [float(x) for x in centre + rng.normal(size=32) * 0.12], int(c % 3)))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(50)]
    rows += [(1000, None, 0), (1001, [0.0] * 32, 0), (1002, [float("nan")] + [1.0] * 31, 0), (1003, rows[0][1], None), (1004, [None] + [1.0] * 31, 0), (1005, [1.0, 2.0], 0), (1006, [2.0, 4.0], 0), (1007, [], 0), (1008, [float("inf")] * 32, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("x")).withColumn("kept", F.lit("y"))
    found = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    assert len(found) == len(rows)
    links = brute_links(rows)
    wanted = sum(map(len, links.values()))
    got = sum(r["n_links"] for r in found.values())
    assert 0.9 * wanted <= got <= wanted
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a, near in links.items():
            low = min([label[a], *(label[b] for b in near)])
            changed |= low != label[a]
            label[a] = low
    same = np.mean([found[rows[k][0]]["component_id"] == rows[label[k]][0] for k in range(len(rows))])
    assert same > 0.97
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())
    assert all(found[k]["n_links"] == 0 and found[k]["kept"] for k in (1000, 1001, 1002, 1003, 1004, 1007, 1008))
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_a_cone_of_vectors_is_compared_in_bounded_memory():
    """4,000 different vectors around one direction, all near each other, in the last of 71 tables."""
    import tracemalloc

    rng = np.random.default_rng(2)
    v = vectors.unit(rng.normal(size=64) + 0.01 * rng.normal(size=(4000, 64)))
    keys = vectors.hashes(v, 15, 71)
    weight = rng.integers(1, 4, 4000)
    tracemalloc.start()
    links, root = vectors.piece_links(v, keys, 70, weight, None, 0.93)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    apart = np.ones((4000, 4000), bool)
    for t in range(70):
        apart &= keys[:, t, None] != keys[:, t]
    apart &= v @ v.T >= 0.93
    np.fill_diagonal(apart, False)
    assert (links == apart @ weight).all()
    own = np.arange(4000) % 2
    half, _ = vectors.piece_links(v, keys, 0, weight, own, 0.93)
    assert (half == np.where(own == 0, weight[own == 1].sum(), weight[own == 0].sum())).all()
    assert (vectors.piece_links(v, keys, 0, weight, None, 0.93)[1] == 0).all()


def test_tables_reach_the_recall_at_the_threshold():
    """Pairs of cosine 0.93, the farthest that count, share a table 9 times in 10 or more."""
    rng = np.random.default_rng(8)
    a = vectors.unit(rng.normal(size=(4000, 64)))
    other = rng.normal(size=(4000, 64))
    other = vectors.unit(other - (other * a).sum(1, keepdims=True) * a)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * other
    assert (vectors.hashes(a) == vectors.hashes(b)).any(1).mean() > 0.92


def test_nearest_of_few_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(60)]
    rows += [(200 + k, rows[0][1]) for k in range(30)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    asked = df.filter("vec_id % 50 = 0")
    found = neighbours.nearest(df, asked).collect()
    usable = [(k, np.array(v, np.float32).astype(float)) for k, v in rows if k is not None and k not in (300, 301, 302)]
    for q in (0, 50, 200):
        v = dict(usable)[q]
        wanted = sorted((np.sqrt(((w - v) ** 2).sum()), k) for k, w in usable if k != q)[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [(rank, k) for rank, k, _ in mine] == [(n + 1, k) for n, (_, k) in enumerate(wanted)]
        assert [s for _, _, s in mine] == pytest.approx([d for d, _ in wanted], abs=1e-12)
    few = neighbours.nearest(df.filter("vec_id < 4"), df.filter("vec_id = 1")).collect()
    assert sorted(r["vec_id"] for r in few) == [0, 2, 3]
    assert neighbours.nearest(df.limit(0), df).count() == 0


def recall(found, rows, queries):
    hits = 0
    for q in queries:
        far = np.sqrt(((rows.astype(float) - rows[q]) ** 2).sum(1))
        far[q] = np.inf
        hits += len({r["vec_id"] for r in found if r["query_id"] == q} & set(np.argsort(far)[:10].tolist()))
    return hits / len(queries) / 10


@pytest.mark.parametrize("n,step,share", [(500, 5, 2.0), (100_000, 1000, 0.21)])
def test_forest_recall_at_any_size(n, step, share):
    """Independent directions, the hardest case: 0.9 and more at either size, with no more distances, repeats included, than a share of the table."""
    rows = np.random.default_rng(3).normal(size=(n, 64))
    forest = neighbours.Forest(rows[np.random.default_rng(0).permutation(n)[: neighbours.SAMPLE]], n)
    place = np.concatenate([forest.nodes(rows[k : k + 2000]) for k in range(0, n, 2000)])
    asked = np.arange(0, n, step)
    going, found, seen = {}, {int(q): {} for q in asked}, 0
    for q in asked:
        for node, room in zip(*forest.search(rows[q])):
            going.setdefault(node, []).append((q, room))
    for number, queries in going.items():
        at = np.flatnonzero(place[:, number >> forest.upper] == number)
        who, room = (np.array(x) for x in zip(*queries))
        query, ids, away, counts = neighbours.Node(forest, number, at, rows[at]).nearest(rows[who], room, 11)
        seen += counts.sum()
        for k, i, d in zip(who[query].tolist(), ids.tolist(), away.tolist()):
            found[k][i] = d
    hits = 0
    for q, near in found.items():
        far = ((rows - rows[q]) ** 2).sum(1)
        best = [i for i in sorted(near, key=near.get) if i != q][:10]
        hits += len(set(best) & set(np.argsort(far)[1:11].tolist()))
    assert hits / len(asked) / 10 >= 0.9
    assert seen / len(asked) <= share * n


def test_forest_recall(spark):
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(12_000, 48)).astype(np.float32)
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(rows)], "vec_id long, embedding array<float>")
    found = neighbours.nearest(df, df.filter("vec_id % 300 = 0")).collect()
    assert recall(found, rows, range(0, 12_000, 300)) >= 0.9
    assert np.mean([r["scored"] for r in found]) < 0.7 * len(rows)


def test_forest_leaves_do_not_grow(spark, monkeypatch):
    """Clustered vectors: most of a large table is left alone; nodes over BLOCK vectors are dealt out and lose nothing."""
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(400, 24))
    rows = (centres[rng.integers(400, size=30_000)] + 0.5 * rng.normal(size=(30_000, 24))).astype(np.float32)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows.tolist())], "vec_id long, embedding array<float>")
    asked = list(range(0, 30_000, 600))
    for block in (neighbours.BLOCK, 300):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        found = neighbours.nearest(df, df.filter("vec_id % 600 = 0")).collect()
        assert recall(found, rows, asked) >= 0.9
        assert np.mean([r["scored"] for r in found]) < 0.4 * len(rows)
    forest = neighbours.Forest(rows[:2000].astype(float), 5_000_000)
    assert forest.upper > 5 and forest.leaf == neighbours.LEAF and forest.leaves * forest.leaf * forest.blocks < 0.06 * 5_000_000


def test_neighbours_of_vectors_of_several_lengths(spark):
    rows = [(k, [float(k), 1.0]) for k in range(30)] + [(100 + k, [float(k), 1.0, 2.0]) for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("node", F.lit(1)).withColumn("v", F.lit(2))
    found = neighbours.nearest(df, df.filter("vec_id in (0, 100)")).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in found] == [*range(1, 11), 101, 102, 103, 104]
