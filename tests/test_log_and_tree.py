"""The event log as a source, and folder trees as intervals."""

import random

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import access, tree
from sparkfolio.sources import log_stream


def read(spark, path, state, out, begin="earliest", piece=1 << 20):
    rows = log_stream(spark, str(path), begin, piece)
    rows.writeStream.format("json").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("segment string, offset long, value string").json(str(out)).collect()
    return sorted((r["segment"], r["offset"], r["value"]) for r in found)


def lines(path, *skip):
    """Offset and text of each whole line."""
    out, at = [], 0
    for line in path.read_bytes().split(b"\n")[:-1]:
        out.append((path.name, at, line.decode()))
        at += len(line) + 1
    return out


def test_nothing_is_lost_or_repeated(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    a, b = folder / "seg-1", folder / "seg-2"
    a.write_text("one\ntwo\nübung\n\nhalf a li")
    (folder / "_ignored").write_text("x\n")
    args = (spark, folder, tmp_path / "state", tmp_path / "out")
    assert read(*args) == lines(a)
    assert read(*args) == lines(a)  # a start without news
    with a.open("a") as f:
        f.write("ne\nafter\n")
    b.write_text("".join(f"line {k} {'x' * (k % 50)}\n" for k in range(2000)))
    assert read(*args, piece=1000) == sorted(lines(a) + lines(b))
    with b.open("a") as f:
        f.write("last\n")
    assert read(*args) == sorted(lines(a) + lines(b))


def test_the_tail_skips_old_lines_of_a_segment_that_grows(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    a = folder / "seg-1"
    a.write_text("old\nolder\n")
    args = (spark, folder, tmp_path / "state", tmp_path / "out", "tail")
    assert read(*args) == []
    with a.open("a") as f:
        f.write("new\n")
    (folder / "seg-2").write_text("other\n")
    assert [v for _, _, v in read(*args)] == ["new", "other"]
    with pytest.raises(Exception, match="earliest or tail"):
        read(spark, folder, tmp_path / "s2", tmp_path / "o2", "middle")


def frame(spark, rows):
    return spark.createDataFrame(rows, "parent string, child string, is_container boolean")


def random_tree(rng, n, files):
    rows = [(f"d{rng.randrange(k)}" if k % 20 else "r", f"d{k}", True) for k in range(1, n)] + [("r", "d0", True)]
    return rows + [(f"d{rng.randrange(n)}", f"f{k}", False) for k in range(files)]


def test_scopes_are_ranges(spark, tmp_path):
    rows = random_tree(random.Random(4), 80, 300) + [("d3", "d70", True), ("x", "y", True), ("y", "fy", False), (None, "d1", True), ("r", None, True)]
    edges = frame(spark, rows)
    tree.store_labels(edges, str(tmp_path))
    labels, files = (spark.read.parquet(f"{tmp_path}/{kind}") for kind in ("folders", "files"))
    up = {}
    for p, c, is_folder in rows:
        if is_folder and p is not None and c is not None:
            up[c] = min(up.get(c, p), p)
    above = lambda d: {d} | (above(up[d]) if d in up else set())
    for roots in (["r"], ["d1", "d2"], ["d5"], ["x", "d9"], ["none"]):
        wanted = {c for p, c, is_folder in rows if not is_folder and above(p) & set(roots)}
        assert {r[0] for r in tree.stored_scope(labels, files, roots).collect()} == wanted
    spans = sorted((r["first"], r["last"]) for r in labels.collect())
    assert sorted(x for s in spans for x in s) == list(range(2 * len(spans)))
    shut = {"d7", "d12", "f5"}
    grants = spark.createDataFrame([(c,) for c in {c for _, c, _ in rows if c} | {"r", "x"} if c not in shut], "file_uid string")
    plain = frame(spark, [(p, c, d) for p, c, d in rows if p is not None and c is not None and (not d or up[c] == p)])
    walked = access.folder_scope(plain, spark.createDataFrame([("d1",)], "uid string"), grants)
    assert {r[0] for r in tree.stored_scope(labels, files, ["d1"], grants).collect()} == {r[0] for r in walked.collect()}


def test_cycles(spark):
    rows = [("r", "a", True), ("a", "b", True), ("c1", "c2", True), ("c2", "c3", True), ("c3", "c1", True), ("c2", "under", True), ("s", "s", True)]
    found = {r["uid"] for r in tree.folder_labels(frame(spark, rows)).collect()}
    assert found == {"r", "a", "b", "s"}
    with pytest.raises(ValueError, match="cycles"):
        tree.folder_labels(frame(spark, rows), "refuse")
    assert tree.folder_labels(frame(spark, rows).limit(0)).count() == 0


def test_a_chain_of_ten_thousand_folders(spark, monkeypatch):
    rounds = []
    keep = tree.settled
    monkeypatch.setattr(tree, "settled", lambda df: rounds.append(1) or keep(df))
    edges = spark.range(10_000).select(F.format_string("d%d", "id").alias("parent"), F.format_string("d%d", F.col("id") + 1).alias("child"), F.lit(True).alias("is_container"))
    found = {r["uid"]: (r["first"], r["last"]) for r in tree.folder_labels(edges).collect()}
    assert len(rounds) < 20 and found == {f"d{k}": (k, 20_001 - k) for k in range(10_001)}
