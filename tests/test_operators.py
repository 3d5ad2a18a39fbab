import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkfolio import providers, schemas
from sparkfolio.operators import access, chunking, context, conversion, search, tables, vector_search
from sparkfolio.sources import append_events, event_stream, events, read_files, read_metadata, write_table
from sparkfolio.streaming import decisions, ingest


def folded(text, target, overlap):
    """The chunks, restated one paragraph at a time."""
    out, open_ = [], None
    import re

    for block in (b.strip() for b in re.split(r"\n\s*\n", (text or "").strip())):
        if not block:
            continue
        if open_ is None:
            open_ = block
        elif len(open_) + 2 + len(block) > target:
            out.append(open_)
            open_ = f"{open_[-overlap:]}\n\n{block}".strip() if overlap else block
        else:
            open_ = f"{open_}\n\n{block}"
    return out + ([open_.strip()] if open_ else [])


@pytest.mark.parametrize("target,overlap", [(1200, 150), (400, 50), (50, 0), (10, 30)])
def test_chunks(spark, target, overlap):
    rng = random.Random(target)
    texts = ["\n\n".join("wörd " * rng.randint(0, 30) for _ in range(rng.randint(0, 25))) for _ in range(60)] + ["", None, "x" * 5000, "# H\n\npara", " \n \n "]
    df = spark.createDataFrame(list(enumerate(texts)), "file_uid int, content_md string")
    found = {}
    for r in chunking.chunk(df, target=target, overlap=overlap).orderBy("file_uid", "ordinal").collect():
        found.setdefault(r["file_uid"], []).append((r["ordinal"], r["text"]))
    for k, t in enumerate(texts):
        assert found.get(k, []) == list(enumerate(folded(t, target, overlap)))


def test_hash_embedding(spark):
    def brute(text, n):
        v = [0.0] * n
        for w in (text or "").lower().split():
            d = hashlib.md5(w.encode()).digest()
            v[int.from_bytes(d[:4], "big") % n] += 1 if d[4] & 1 else -1
        size = math.sqrt(sum(x * x for x in v))
        return [x / size if size else 0.0 for x in v]

    texts = ["the quick  brown\tfox the", "", None, "ÄÖ x", "a " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for r in chunking.hash_embed(df, ["k"], "t", 32).collect():
        assert list(r["embedding"]) == pytest.approx(brute(texts[r["k"]], 32), abs=1e-6)


def test_index_files_leaves_out_empty_ones(spark):
    df = spark.createDataFrame([("a", "x\n\ny"), ("b", "")], "file_uid string, content_md string")
    assert [(r["file_uid"], r["ordinal"], len(r["embedding"])) for r in chunking.index_files(df, 16).collect()] == [("a", 0, 16)]


def test_nearest(spark):
    rows = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 0, [0.0, 1.0]), ("c", 0, None), ("d", 0, [0.0, 0.0]), ("e", 0, [1.0, 0.0])], "file_uid string, ordinal int, embedding array<float>")
    assert [r["file_uid"] for r in vector_search.nearest(rows, [1.0, 0.1], 5).collect()] == ["a", "e", "b"]
    scope = spark.createDataFrame([("b",), ("c",)], "file_uid string")
    assert [r["file_uid"] for r in vector_search.nearest(rows, [1.0, 0.1], 5, scope=scope).collect()] == ["b"]


def test_rights_fail_closed(spark):
    rows = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0), (None, 0.5)], "file_uid string, score double")
    acl = spark.createDataFrame([("t", "alice", "a", True), ("t", "alice", "c", True), ("t", "alice", "b", None), ("u", "alice", "b", True), ("t", "alice", None, True)], schemas.GRANTS)
    mine = access.grants_of(acl, "t", "alice")
    assert [r["file_uid"] for r in access.readable(rows, mine).orderBy("file_uid").collect()] == ["a", "c"]
    live = spark.createDataFrame([("c",)], "file_uid string")
    assert [r["file_uid"] for r in access.readable(rows, mine, live).collect()] == ["c"]
    top = lambda mode: [r["file_uid"] for r in access.allowed_top(rows, mine, 2, [F.desc("score")], mode, over=1).collect()]
    assert top("exact") == ["a", "c"] and top("post") == ["a"]
    assert access.readable(rows, access.grants_of(acl, "t", "bob")).count() == 0


def test_forget(spark):
    known = spark.createDataFrame([("t", "u1", "f1"), ("t", "u1", "f2"), ("t", "u2", "f2"), ("s", "u1", "f1")], "tenant string, user string, file_uid string")
    event = lambda kind, **x: spark.createDataFrame([json.dumps({"type": kind, "tenant": "t", **x})], "string")
    left = lambda e: sorted(tuple(r) for r in access.forget(known, events(e)).collect())
    assert left(event("acl.changed", file_uid="f2")) == [("s", "u1", "f1"), ("t", "u1", "f1")]
    assert left(event("role.assigned", member="u1")) == [("s", "u1", "f1"), ("t", "u2", "f2")]
    assert left(event("role.deleted")) == [("s", "u1", "f1")]
    assert len(left(event("file.created", file_uid="f1"))) == 4


def test_folder_scope(spark):
    edges = spark.createDataFrame([("F1", "a", False), ("F1", "S", True), ("S", "b", False), ("S", "F1", True), ("F2", "c", False)], schemas.EDGES)
    roots = lambda *r: spark.createDataFrame([(x,) for x in r], "uid string")
    ids = lambda df: sorted(r["file_uid"] for r in df.collect())
    assert ids(access.folder_scope(edges, roots("F1"))) == ["a", "b"]
    assert ids(access.folder_scope(edges, roots("EMPTY"))) == []
    rights = spark.createDataFrame([(x,) for x in ("F1", "a", "b")], "file_uid string")
    assert ids(access.folder_scope(edges, roots("F1", "F2"), rights)) == ["a"]
    assert ids(access.folder_scope(edges, roots("F1"), most_folders=1)) == ["a"]


def test_folders_of_any_depth(spark):
    chain = [(f"F{k}", f"F{k + 1}", True) for k in range(70)] + [(f"F{k}", f"f{k}", False) for k in (0, 35, 70)]
    edges = spark.createDataFrame(chain, schemas.EDGES).coalesce(1)
    roots = spark.createDataFrame([("F0",)], "uid string").coalesce(1)
    assert sorted(r["file_uid"] for r in access.folder_scope(edges, roots).collect()) == ["f0", "f35", "f70"]
    entries = spark.createDataFrame([(f"u{k}" if k else "", f"u{k + 1}", f"n{k}", True) for k in range(40)], "parent string, uid string, name string, is_container boolean")
    whole = "/" + "/".join(f"n{k}" for k in range(40))
    paths = spark.createDataFrame([(whole,), (whole + "/x",), (whole[: whole.index("/n33")],)], "path string").coalesce(1)
    found = {r["path"]: (r["uid"], r["missing"]) for r in tables.resolve_paths(paths, entries.coalesce(1)).collect()}
    assert found == {whole: ("u40", None), whole + "/x": (None, whole + "/x"), whole[: whole.index("/n33")]: ("u33", None)}


def test_guards():
    assert access.check_query("  x ") == "x" and access.check_query("x" * 2000, 0)
    for bad in ("", "  ", None, "x" * 1001):
        with pytest.raises(ValueError):
            access.check_query(bad)
    assert [access.cap(*x) for x in ((0, 10), (5, 10), (50, 10), (50, 0), (-3, 0))] == [1, 5, 10, 50, 1]


def test_context(spark):
    chunks = spark.createDataFrame([(1, k, f"f{k % 2}", "x" * 100) for k in (1, 2, 3)] + [(2, 1, "g", "y" * 500)], "q int, rank int, file_uid string, text string")
    kept = sorted((r["q"], r["rank"], r["trimmed"]) for r in context.trim(chunks, 150, ["q"]).collect())
    assert kept == [(1, 1, True), (2, 1, True)]
    assert [r["rank"] for r in context.trim(chunks.filter("q = 1"), 300).collect()] == [1, 2, 3]
    cited = {(r["q"], r["file_uid"]): r["marker"] for r in context.citations(chunks, ["q"]).collect()}
    assert cited == {(1, "f1"): 1, (1, "f0"): 2, (2, "g"): 1}
    asked = spark.createDataFrame([(2,), (3,)], "q int")
    said = {r["q"]: r["context"] for r in context.contexts(asked, chunks, ["q"]).collect()}
    assert said == {2: "[1] (file g)\n" + "y" * 500, 3: context.NOTHING_FOUND}
    more = context.tool_citations(spark.createDataFrame([("b",), ("a",)], "url string"), 3, ["url"])
    assert sorted(tuple(r) for r in more.collect()) == [("a", 4), ("b", 5)]


def test_provenance(spark):
    row = [("r", "v", "ann", "t", "mail a@b.co", "ok 555-123-4567", [("user", "hi"), ("assistant", "yo")], [(1, "doc")])]
    df = spark.createDataFrame(row, "uid string, version string, user string, tenant string, message string, answer_text string, history array<struct<role:string,content:string>>, citations array<struct<marker:int,kind:string>>")
    record = json.loads(context.provenance(df).first()["record"])
    assert [m["content"] for m in record["transcript"]] == ["hi", "yo", "mail [redacted-email]", "ok [redacted-phone]"]
    assert record["pii_redacted"] and record["citations"] == [{"marker": 1, "kind": "doc"}]


@pytest.mark.parametrize("asked,wanted", [
    ("running dogs", {"a"}), ('"quick brown"', {"a", "c"}), ('"brown quick"', set()), ("cat or dog", {"a", "b"}),
    ("brown -dog", {"c"}), ("-brown", {"b"}), ("the", set()), ("quick fox", {"c"}), ('-"quick brown" cat', {"b"}),
])
def test_query_matches(spark, asked, wanted):
    docs = spark.createDataFrame([("a", "n", "The dog runs; quick brown"), ("b", "n", "a cat"), ("c", "n", "quick brown fox"), ("d", "", None)], "file_uid string, name string, content_md string")
    docs = docs.filter("file_uid <> 'd'")
    found = {r["file_uid"]: r["rank"] for r in search.matching(search.inverted_index(docs), search.Query(asked)).collect()}
    assert set(found) == wanted and all(r >= 0 for r in found.values())


def test_rank_values(spark):
    docs = spark.createDataFrame([("a", "", "cat"), ("b", "", "cat cat"), ("c", "", "cat dog"), ("d", "", "cat x x x x dog")], "file_uid string, name string, content_md string")
    index = search.inverted_index(docs)
    one = {r["file_uid"]: r["rank"] for r in search.matching(index, search.Query("cat")).collect()}
    assert one["a"] == pytest.approx(0.1 / 1.64493406685) and one["b"] == pytest.approx(0.125 / 1.64493406685)
    two = {r["file_uid"]: r["rank"] for r in search.matching(index, search.Query("cat dog")).collect()}
    decay = lambda d: 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))
    assert two["c"] == pytest.approx(0.1 * math.sqrt(decay(1))) and two["d"] == pytest.approx(0.1 * math.sqrt(decay(5)))


def test_search(spark):
    docs = spark.createDataFrame([
        ("a", "wall.txt", "the red wall was painted", "indexed"), ("b", "door.txt", "a blue door", "converted"), ("c", "walls", "nothing else", "indexed"),
        ("x", "wall.txt", "red wall", "pending"), ("y", "wall.txt", "red wall", "indexed"), ("z", None, None, "indexed"),
    ], "file_uid string, name string, content_md string, status string")
    grants = docs.filter("file_uid <> 'y'").select("file_uid")
    index = search.inverted_index(docs)
    rows = search.search(docs, index, grants, "walls").collect()
    assert {r["file_uid"] for r in rows} == {"a", "c"} and "**wall**" in next(r["snippet"] for r in rows if r["file_uid"] == "a")
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert {r["file_uid"] for r in search.search(docs, index, grants, "painted", fuzzy=False).collect()} == {"a"}
    assert search.search(docs, index, grants.limit(0), "wall").count() == 0


NOW = "2026-02-02 00:00:00"


def test_upsert(spark):
    old = spark.createDataFrame([("a", "v1", "text a"), ("b", "v1", "text b")], "file_uid string, source_version string, content_md string")
    old = old.withColumn("created_at", F.lit("2026-01-01").cast("timestamp")).withColumn("updated_at", F.lit("2026-01-01").cast("timestamp"))
    new = spark.createDataFrame([("a", "v2", None), ("a", "v1", "older"), ("c", "v1", "text c")], "file_uid string, source_version string, content_md string")
    now = F.lit(NOW).cast("timestamp")
    rows = {r["file_uid"]: r for r in tables.upsert(old, new, now).collect()}
    assert rows["a"]["source_version"] == "v2" and rows["a"]["content_md"] == "text a" and str(rows["a"]["created_at"]) == "2026-01-01 00:00:00" and str(rows["a"]["updated_at"]) == NOW
    assert str(rows["b"]["updated_at"]) == "2026-01-01 00:00:00" and str(rows["c"]["created_at"]) == NOW
    assert {r["file_uid"]: r["content_md"] for r in tables.upsert(old, new, now, keep_if_null=()).collect()}["a"] is None


def test_renditions(spark):
    names = {"v9-preview.png": ("v9", "preview", "png"), "20260623-1-model.xkt": ("20260623-1", "model", "xkt"), "report.pdf": None, "v9-notes.txt": None, "-pdf.pdf": None, "v-pdf.": None, "v.1-pdf.tar.gz": None, "a.b-pdf.pdf": ("a.b", "pdf", "pdf")}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", tables.rendition_parts(F.col("n")).alias("p"))
    assert {r["n"]: r["p"] and tuple(r["p"]) for r in df.collect()} == names
    made = spark.createDataFrame([(" a/b c ",), ("",), (None,)], "v string").select(tables.rendition_name(F.col("v"), F.lit("pdf"), F.lit("pdf")).alias("n"))
    assert [r["n"] for r in made.collect()] == ["a_b_c-pdf.pdf", "0-pdf.pdf", "0-pdf.pdf"]


def test_terminal_events(spark):
    rows = [("a", "indexed", True, ["v-pdf.pdf", "v-pdf.x", "notes"]), ("b", "converted", False, []), ("c", "unsupported", False, []), ("d", "skipped", True, []), ("e", "converted", False, ["v-preview.png"])]
    found = {r["file_uid"]: (r["type"], r["reason"], r["renditions"]) for r in tables.terminal_events(spark.createDataFrame(rows, "file_uid string, status string, has_text boolean, children array<string>")).collect()}
    assert found == {"a": ("conversion.complete", None, ["text", "pdf"]), "b": ("conversion.failed", "error", []), "c": ("conversion.failed", "unsupported", []), "e": ("conversion.complete", None, ["preview"])}


def test_conversations(spark):
    heads = spark.createDataFrame([("1", "ann", ""), ("2", "bob", "T")], "id string, user_id string, title string")
    said = spark.createDataFrame([("1", 2, "assistant", "b", None), ("1", 1, "user", "a", "[1]")], schemas.MESSAGES)
    row = tables.conversation_get(heads, said, "ann", "1").first()
    assert [(m["role"], m["citations"]) for m in row["messages"]] == [("user", "[1]"), ("assistant", "[]")]
    assert tables.conversation_get(heads, said, "bob", "1").count() == 0
    more = spark.createDataFrame([("1", 3, "user", "c", None), ("2", 4, "user", "d", None)], schemas.MESSAGES)
    assert tables.append_message(heads, said, "ann", more).count() == 3
    titles = {r["id"]: r["title"] for r in tables.title_if_empty(heads, "ann", "1", F.lit("x" * 200)).collect()}
    assert titles == {"1": "x" * 120, "2": "T"}


def test_paths_links_and_listings(spark):
    entries = spark.createDataFrame([("", "u1", "A", True), ("u1", "u2", "B", True), ("u1", "u3", "f", False)], "parent string, uid string, name string, is_container boolean")
    paths = spark.createDataFrame([("/A/B",), ("A\\B/",), ("/",), ("/A/f",), ("/X/B",), (None,)], "path string")
    assert {r["path"]: (r["uid"], r["missing"]) for r in tables.resolve_paths(paths, entries).collect()} == {"/A/B": ("u2", None), "A\\B/": ("u2", None), "/": ("", None), "/A/f": (None, "/A/f"), "/X/B": (None, "/X"), None: ("", None)}
    many = spark.createDataFrame([("p", f"n{k:02}", False) for k in range(25)] + [("p", "d", True)], "parent string, name string, is_container boolean")
    row = tables.folder_listing(many).first()
    assert row["folders"] == "d" and row["files"].endswith("n19 (+5 more)")
    html = "see (file abcdef01-23) and (file ABCDEF99) and (file 12) (file abcdef01-23)"
    names = spark.createDataFrame([("abcdef01-23", "<b>.txt")], "file_uid string, name string")
    out = tables.link_file_references(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), names, "t", "https://{tenant}.x.org")
    link = '(<a href="https://t.x.org/files?file=abcdef01-23&amp;tenant=t">📄 &lt;b&gt;.txt</a>)'
    assert {r["id"]: r["html"] for r in out.collect()} == {1: f"see {link} and (📄 file) and (file 12) {link}", 2: None}


def test_conversion(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.html").write_text("<html><head><title>T</title></head><p>hello</p>")
    (folder / "b.obj").write_bytes(b"# wall\no Wall\n")
    (folder / "c.bin").write_bytes(b"\x00\x01")
    (folder / "d.txt").write_text(" ")
    (folder / "e.step").write_text("ISO-10303-21;\n#1=PART('bolt');")
    files = read_files(spark, str(folder))
    assert {r["name"]: r["length"] for r in read_metadata(spark, str(folder)).collect()}["d.txt"] == 1
    files = files.withColumn("file_uid", F.col("name"))
    empty = spark.createDataFrame([], schemas.DOCUMENTS), spark.createDataFrame([], schemas.CHUNKS)
    now = F.lit(NOW).cast("timestamp")
    docs, chunks, outcomes = conversion.convert(files, *empty, now, dimension=16)
    status = {r["file_uid"]: (r["status"], r["content_md"]) for r in docs.collect()}
    assert status == {"a.html": ("indexed", "# T\n\nhello"), "b.obj": ("indexed", "# OBJ mesh\n\n## Comments\n- wall\n\n## Names\n- Wall"), "c.bin": ("unsupported", None), "d.txt": ("converted", " "), "e.step": ("indexed", "# STEP CAD model\n\n## Part\n- bolt")} or status["e.step"][1] is None
    assert {r["file_uid"] for r in chunks.collect()} >= {"a.html", "b.obj"}
    assert tables.outdated(files.drop("content"), docs.select("file_uid", "source_version", "status")).count() == 1  # the unsupported one
    spark.catalog.clearCache()


def lines(*rows):
    return [(json.dumps(r) if isinstance(r, dict) else r,) for r in rows]


EVENTS = lines(
    {"event_id": "1", "type": "file.created", "file_uid": "a", "ts": "20260101_000000.001"}, {"event_id": "2", "type": "file.deleted", "file_uid": "a", "ts": "20260101_000000.003"},
    {"event_id": "3", "type": "file.updated", "file_uid": "a", "ts": "20260101_000000.002"}, {"event_id": "4", "type": "file.updated", "file_uid": "b", "is_rendition": True, "ts": "20260101_000000.009"},
    {"event_id": "5", "type": "file.updated", "file_uid": "", "ts": "x"}, {"event_id": "6", "type": "dir.created", "file_uid": "c"}, "{broken", {"event_id": "7", "type": "file.restored", "file_uid": "d", "tenant": "t", "new": 1, "ts": "20260101_000001.000"},
)


def test_events_and_routing(spark):
    rows = events(spark.createDataFrame(EVENTS, "value string"))
    assert rows.count() == len(EVENTS) and {r["tenant"] for r in rows.collect()} == {"default", "t"}
    assert {(r["file_uid"], r["action"]) for r in ingest.latest_actions(rows).collect()} == {("a", "delete"), ("d", "convert")}
    assert {(r["event_id"], r["action"]) for r in ingest.routed(rows).collect()} == {("1", "convert"), ("2", "delete"), ("3", "convert"), ("7", "convert")}
    stamp = rows.filter("event_id = '2'").select(ingest.event_time(F.col("ts")).alias("t"), ingest.stamp(ingest.event_time(F.col("ts"))).alias("s")).first()
    assert stamp["s"] == "20260101_000000.003" and stamp["t"].microsecond == 3000


def test_stream_equals_batch(spark, tmp_path):
    log, seen = tmp_path / "log", []
    append_events(events(spark.createDataFrame(EVENTS, "value string")).drop("tenant"), str(log))
    ingest.ingest(event_stream(spark, str(log)), lambda c, d, n: seen.extend((r["file_uid"], r["action"]) for r in c.union(d).collect()), str(tmp_path / "check"), once=True).awaitTermination()
    assert set(seen) == {("a", "delete"), ("d", "convert")}
    before = len(seen)
    ingest.ingest(event_stream(spark, str(log)), lambda c, d, n: seen.extend(c.collect()), str(tmp_path / "check"), once=True).awaitTermination()
    assert len(seen) == before  # nothing is handed over twice


def test_failed_batch_comes_again(spark, tmp_path):
    log, seen = tmp_path / "log", []
    append_events(events(spark.createDataFrame(EVENTS[:1], "value string")), str(log))

    def broken(c, d, n):
        raise RuntimeError("the store is read-only")

    with pytest.raises(Exception, match="read-only"):
        ingest.ingest(event_stream(spark, str(log)), broken, str(tmp_path / "check"), once=True).awaitTermination()
    ingest.ingest(event_stream(spark, str(log)), lambda c, d, n: seen.extend(c.collect()), str(tmp_path / "check"), once=True).awaitTermination()
    assert len(seen) == 1


def test_stream_deduplicates(spark, tmp_path):
    log = tmp_path / "log"
    rows = events(spark.createDataFrame(EVENTS, "value string")).filter("ts is not null and ts <> 'x'")
    append_events(rows, str(log))
    append_events(rows, str(log))
    query = ingest.deduplicated(event_stream(spark, str(log))).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == rows.count()


def test_decision_cache(spark, tmp_path):
    schema = "tenant string, user string, kind string, file_uid string, allowed boolean, at double"
    rows = [("t", "u", "decision", "f", True, 1.0), ("t", "u", "ask", "f", None, 2.0), ("t", "u", "ask", "g", None, 2.0), ("t", "u", "ask", "f", None, 400.0), ("t", "u", "decision", "h", False, 401.0), ("t", "u", "ask", "h", None, 402.0), ("t", "u", "forget", "h", None, 403.0), ("t", "u", "ask", "h", None, 404.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    query = decisions.cached_decisions(stream).writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["file_uid"], r["allowed"]) for r in spark.table("answers").collect()] == [("f", True), ("g", None), ("f", None), ("h", False), ("h", None)]


def test_tables_are_replaced_by_partition(spark, tmp_path):
    write_table(spark.createDataFrame([("a", 1), ("b", 1)], "tenant string, x int"), str(tmp_path / "t"), ["tenant"])
    write_table(spark.createDataFrame([("a", 2)], "tenant string, x int"), str(tmp_path / "t"), ["tenant"])
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("tenant", "x").collect()) == [("a", 2), ("b", 1)]


def test_providers(spark):
    asked = spark.createDataFrame([(1, "why", "ctx")], "question_id int, message string, context string")
    assert "why" in providers.chosen(providers.CHAT, "", "echo")(asked).first()["answer"]
    assert providers.chosen(providers.WEB_SEARCH, "fake", "none")(asked, k=3).count() == 3
    assert providers.chosen(providers.WEB_SEARCH, "", "none")(asked).count() == 0
    with pytest.raises(ValueError):
        providers.chosen(providers.EMBEDDING, "other", "hash")


def test_asking_nothing_or_nowhere_finds_nothing(spark):
    docs = spark.createDataFrame([("a", "red wall"), ("b", "blue door")], "file_uid string, content_md string")
    chunks, grants = chunking.index_files(docs, 512), docs.select("file_uid")
    assert [r["file_uid"] for r in context.ask(chunks, "the blue door", grants, 512, k=1).collect()] == ["b"]
    assert context.ask(chunks, "  ", grants, 512).count() == 0 == context.ask(chunks, "door", grants, 512, scope=grants.limit(0)).count()


def test_ranks_over_the_whole_order(spark):
    df = spark.range(1000).withColumn("v", F.pmod(F.col("id") * 7919, F.lit(1000))).repartition(7)
    assert all(r["rank"] == r["v"] + 1 for r in context.ranked(df, F.col("v")).collect())
    assert all(r["rank"] == 1000 - r["v"] for r in context.ranked(df, F.desc("v")).collect())


def test_a_log_keeps_its_last_events(spark):
    from sparkfolio.sources import latest_events

    df = spark.createDataFrame([(f"e{n}", f"20260101_0000{n:02}.000") for n in range(20)], "event_id string, ts string")
    assert sorted(r["event_id"] for r in latest_events(df, 3).collect()) == ["e17", "e18", "e19"]


def test_files_without_a_byte_have_a_row(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    for name, text in (("one.txt", "x"), ("a b/none é.txt", ""), ("none.md", ""), ("two.md", "yy")):
        (tmp_path / name).write_text(text)
    found = {r["name"]: bytes(r["content"]) for r in read_files(spark, str(tmp_path)).collect()}
    assert found == {"one.txt": b"x", "none é.txt": b"", "none.md": b"", "two.md": b"yy"}
    rows = read_metadata(spark, str(tmp_path), "*.md").collect()
    assert {r["name"]: r["length"] for r in rows} == {"none.md": 0, "two.md": 2} and all(len(r["version"]) == 19 for r in rows)
    assert len({r["file_uid"].split(":")[0] for r in rows}) == 1


def test_a_thousand_equal_names(spark):
    names = spark.createDataFrame([(k, "My Tool!") for k in range(1003)], "id int, name string")
    found = {r["id"]: r["slug"] for r in tables.unique_slugs(names).collect()}
    assert found[0] == "my-tool" and found[998] == "my-tool-999" and len(set(found.values())) == 1003
    assert all(len(found[k]) == len("my-tool-") + 6 for k in range(999, 1003))
    assert {r["id"]: r["slug"] for r in tables.unique_slugs(names).collect()} == found


def test_all_equal_names_are_numbered(spark):
    names = spark.createDataFrame([(k, "My Tool!") for k in range(1003)], "id int, name string")
    found = {r["id"]: r["slug"] for r in tables.unique_slugs(names, most=None).collect()}
    assert found == {0: "my-tool"} | {k: f"my-tool-{k + 1}" for k in range(1, 1003)}


def test_fragments_do_not_end_in_short_words(spark):
    from sparkfolio.functions import terms

    df = spark.createDataFrame([("an of it is steel bolts on to we do " + "filler words " * 20,), ("no steel",)], "t string")
    found = [r[0] for r in df.select(terms.headline(["steel"], most=10)("t")).collect()]
    assert found == ["is **steel** bolts on to we", "no **steel**"] or found[0].split()[-1] not in ("do",) and found[1] == "no **steel**"
