"""Streams: dead letters, waits, tails, kept decisions; and the work of a similarity in a long text."""

import json
import time

import pytest
from pyspark.sql import functions as F

from sparkfolio import providers
from sparkfolio.functions import terms
from sparkfolio.sources import event_stream
from sparkfolio.streaming import decisions, ingest


def log(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def file_event(n, kind="file.created"):
    return {"event_id": f"e{n}", "type": kind, "tenant": "t", "file_uid": f"f{n}", "ts": f"20260101_0000{n:02}.000"}


def test_poison_events_go_to_the_dead_letters(spark, tmp_path):
    log(tmp_path / "log", "a.json", [file_event(n) for n in range(12)])
    seen = []

    def handle(convert, delete, number):
        uids = {r["file_uid"] for r in convert.collect()}
        if "f7" in uids:
            raise ValueError("f7 cannot be read")
        seen.extend(uids)

    args = (event_stream(spark, str(tmp_path / "log")), handle, str(tmp_path / "state"))
    ingest.ingest(*args, once=True, dead=str(tmp_path / "dead")).awaitTermination()
    assert sorted(seen) == sorted(f"f{n}" for n in range(12) if n != 7)
    dead = spark.read.parquet(str(tmp_path / "dead")).collect()
    assert [(r["file_uid"], r["error"]) for r in dead] == [("f7", "ValueError: f7 cannot be read")]
    log(tmp_path / "log", "b.json", [file_event(20)])
    ingest.ingest(*args, once=True, dead=str(tmp_path / "dead")).awaitTermination()
    assert seen[-1] == "f20" and len(seen) == 12


def test_read_only_waits_and_loses_nothing(spark, tmp_path):
    log(tmp_path / "log", "a.json", [file_event(n) for n in range(3)])
    tries, seen = [], []

    def handle(convert, delete, number):
        tries.append(time.time())
        if len(tries) < 3:
            raise ingest.ReadOnly("primary is gone")
        seen.extend(r["file_uid"] for r in convert.collect())

    stream = event_stream(spark, str(tmp_path / "log"))
    ingest.ingest(stream, handle, str(tmp_path / "state"), once=True, dead=str(tmp_path / "dead"), pause=0.2).awaitTermination()
    assert sorted(seen) == ["f0", "f1", "f2"] and len(tries) == 3 and tries[2] - tries[0] >= 0.4
    assert not (tmp_path / "dead").exists()


def test_without_dead_letters_an_error_stops_and_the_batch_comes_again(spark, tmp_path):
    log(tmp_path / "log", "a.json", [file_event(1)])
    seen = []

    def handle(convert, delete, number):
        seen.append(number)
        if len(seen) == 1:
            raise ValueError("once")

    args = (event_stream(spark, str(tmp_path / "log")), handle, str(tmp_path / "state"))
    with pytest.raises(Exception, match="once"):
        ingest.ingest(*args, once=True).awaitTermination()
    ingest.ingest(*args, once=True).awaitTermination()
    assert seen == [0, 0]


def test_a_group_starts_at_the_tail(spark, tmp_path):
    log(tmp_path / "log", "old.json", [file_event(1)])
    time.sleep(1.1)
    seen = []

    def run():
        stream = ingest.event_tail(spark, str(tmp_path / "log"), str(tmp_path / "group"))
        ingest.ingest(stream, lambda convert, delete, n: seen.extend(r["file_uid"] for r in convert.collect()), str(tmp_path / "state"), once=True).awaitTermination()

    run()
    time.sleep(1.1)
    log(tmp_path / "log", "new.json", [file_event(2)])
    run()
    assert seen == ["f2"]


def test_decisions_are_kept_and_forgotten(spark, tmp_path):
    rows = [
        ("alice", "decision", "a", True, 1), ("alice", "decision", "b", False, 1), ("bob", "decision", "a", True, 1), ("carl", "decision", "c", True, 1),
        ("alice", "ask", "a", None, 2), ("alice", "ask", "b", None, 2), ("alice", "ask", "x", None, 2), ("alice", "ask", "a", None, 400),
        ("bob", "forget", None, None, 3), ("bob", "ask", "a", None, 4), (None, "forget", "c", None, 5), ("carl", "ask", "c", None, 6),
        ("dora", "decision", "d", True, 7), ("dora", "ask", "d", None, 8), (None, "forget", None, None, 9), ("dora", "ask", "d", None, 10),
    ]
    schema = "tenant string, user string, kind string, file_uid string, allowed boolean, at double"
    spark.createDataFrame([("t", *r[:4], float(r[4])) for r in rows], schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    answers = decisions.cached_decisions(stream)
    answers.writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    found = [(r["user"], r["file_uid"], r["allowed"]) for r in spark.table("answers").collect()]
    wanted = [("alice", "a", True), ("alice", "b", False), ("alice", "x", None), ("alice", "a", None), ("bob", "a", None), ("carl", "c", None), ("dora", "d", True), ("dora", "d", None)]
    assert sorted(map(str, found)) == sorted(map(str, wanted))


def test_governance_events_become_forget_rows(spark):
    events = spark.createDataFrame([("acl.changed", "t", "f", None, 1.0), ("role.assigned", "t", None, "ann", 2.0), ("role.deleted", "t", None, None, 3.0), ("file.moved", "t", "g", None, 4.0)], "type string, tenant string, file_uid string, member string, at double")
    rows = {tuple(r) for r in decisions.forget_rows(events).select("tenant", "user", "file_uid", "at").collect()}
    assert rows == {("t", None, "f", 1.0), ("t", "ann", None, 2.0), ("t", None, None, 3.0)}


@pytest.mark.parametrize("text", ["aa " * 20_000, "aab " + "aa " * 20_000 + "ab", "a b " * 10_000])
def test_a_similarity_in_a_repetitive_text_is_quick(text):
    start = time.perf_counter()
    terms.best_extent(set(terms.trigram_list("aab ab")), terms.trigram_list(text))
    assert time.perf_counter() - start < 2


def test_shared_trigrams_bound_the_similarity(spark):
    texts = ["", None, "Steel bolts, small", "a steep hill", "STEEL", "x" * 50, "un-steel"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", terms.shared_trigrams("steel", F.col("t")).alias("n"), terms.word_similarity(F.lit("steel"), F.col("t")).alias("s")).collect()
    grams = set(terms.trigram_list("steel"))
    for r in rows:
        assert r["n"] == len(grams & set(terms.trigram_list(r["t"])))
        assert r["s"] <= r["n"] / len(grams) + 1e-12


def test_unknown_tools_are_said_to_be_unknown(spark):
    calls = spark.createDataFrame([(1, "web_search", {"query": "q"}), (2, "other", {}), (3, None, None), (4, "web_search", {})], "call_id int, name string, args map<string,string>")
    found = {r["call_id"]: (r["text"], len(r["sources"])) for r in providers.run_tools(calls, [providers.web_search_tool()]).collect()}
    assert found == {1: ("", 0), 2: ("there is no tool other", 0), 3: ("there is no tool ", 0), 4: ("", 0)}


def test_idle_decisions_go_by_themselves(spark, tmp_path):
    schema = "tenant string, user string, kind string, file_uid string, allowed boolean, at double"
    for name, rows in (("1", [("t", "ann", "decision", "a", True, 1.0), ("t", "ann", "forget", "b", None, 2.0)]), ("2", [("t", "bob", "decision", "a", True, 5000.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        answers = decisions.cached_decisions(spark.readStream.schema(schema).json(str(tmp_path / "in")))
        answers.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    left = lambda name: [r["key"]["user"] for r in spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "state")).select("user_map_key.user").withColumnRenamed("user", "u").selectExpr("struct(u as user) as key").collect()]
    assert left("kept") == ["bob"] and left("void") == []


def test_a_batch_reads_and_writes_each_decision_once():
    """Calls of the state go to the JVM: their number follows the entries of a batch, not its rows."""
    import pandas as pd

    class State(dict):
        calls = 0

        def _called(self, result=None):
            self.calls += 1
            return result

        containsKey = lambda self, k: self._called(k in self)
        getValue = lambda self, k: self._called(self[k])
        updateValue = lambda self, k, v: self._called(self.__setitem__(k, v))
        exists = lambda self: bool(self)
        get = lambda self: self[0]
        update = lambda self, v: self.__setitem__(0, v)

    class Handle:
        getMapState = getValueState = lambda self, *_: State()
        registerTimer = lambda self, end: None

    kept = decisions._Decisions(300)
    kept.init(Handle())
    rows = [("u", "decision" if k % 2 else "ask", "f", True, float(k)) for k in range(1, 1000)]
    for _ in range(2):
        (out,) = kept.handleInputRows(("t", 0), iter([pd.DataFrame(rows, columns=["user", "kind", "file_uid", "allowed", "at"])]), None)
        assert len(out) == 499
    assert kept.kept.calls <= 4 and kept.void.calls <= 8
