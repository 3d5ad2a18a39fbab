"""Read decisions kept for a time, and forgotten when governance events say so."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ANSWERS = "tenant string, user string, file_uid string, allowed boolean"
#: Parts of a tenant's users. A tenant-wide change goes to all of them.
PARTS = 64
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Touched:
    """The entries of a map state that one batch touches: each is read once and written once, as every call goes to the JVM."""

    def __init__(self, state, filled: bool) -> None:
        self.state, self.filled = state, filled  # a part without a turn has no entry yet
        self.known: dict[tuple, tuple | None] = {}
        self.changed: set[tuple] = set()

    def get(self, entry: tuple) -> tuple | None:
        if entry not in self.known:
            there = self.filled and self.state.containsKey(entry)
            self.known[entry] = self.state.getValue(entry) if there else None
        return self.known[entry]

    def put(self, entry: tuple, value: tuple) -> None:
        self.known[entry] = value
        self.changed.add(entry)

    def write(self) -> None:
        for entry in self.changed:
            self.state.updateValue(entry, self.known[entry])


class _Decisions(StatefulProcessor):
    """What is kept of one part of a tenant's users, an entry a user and file; timers drop what is too old.

    A change that makes many decisions void is one entry as well: decisions noted before it do not count. Each row that
    changes something has a number of its own, so that order is known also within one moment.
    """

    def __init__(self, seconds: float) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "user string, file string", "allowed boolean, at double, turn long")
        self.void = handle.getMapState("void", "user string, file string", "at double, turn long")
        self.turn = handle.getValueState("turn", "turn long")
        self.swept: dict[tuple, int] = {}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # a part's rows of one batch: questions and notes, as many as came in since the last one
        batch = pd.concat(list(rows)).sort_values("at", kind="stable")
        before = self.turn.get() if self.turn.exists() else None
        turn = start = before[0] if before else 0
        out, ends = [], set()
        kept, void = (_Touched(state, before is not None) for state in (self.kept, self.void))
        for user, kind, file, allowed, at in zip(*(batch[c].tolist() for c in ("user", "kind", "file_uid", "allowed", "at"))):
            if kind == "decision" and self.seconds > 0:
                turn += 1
                kept.put((user, file), (bool(allowed), float(at), turn))
                ends.add(self._end(float(at)))
            elif kind == "forget" and self.seconds > 0:
                turn += 1
                void.put((user, file), (float(at), turn))
                ends.add(self._end(float(at)))
            elif kind == "ask":
                out.append((key[0], user, file, self._known(kept, void, user, file, float(at))))
        kept.write()
        void.write()
        if turn > start:
            self.turn.update((turn,))
        if ends:
            self.handle.registerTimer(min(ends))  # when it is up, the next one is set
        yield pd.DataFrame(out, columns=["tenant", "user", "file_uid", "allowed"]).astype({"allowed": "object"})

    def _end(self, at: float) -> int:
        """When what is noted at ``at`` is dropped, in milliseconds: in steps of the life of a decision, so timers are few."""
        return int(math.floor(at / self.seconds) + 2) * math.ceil(self.seconds * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        if self.swept.get(key) == mark:  # one pass for all timers that are up
            return iter(())
        self.swept[key] = mark
        left, ends = 0, set()
        for state, at in ((self.kept, 1), (self.void, 0)):
            for entry, value in list(state.iterator()):
                if mark / 1000 - value[at] >= self.seconds:  # no question that still counts can ask for it
                    state.removeKey(entry)
                else:
                    left += 1
                    ends.add(self._end(value[at]))
        if ends:
            self.handle.registerTimer(min(ends))
        if not left:
            self.turn.clear()
        return iter(())

    def _known(self, kept: _Touched, void: _Touched, user: str, file: str, now: float) -> bool | None:
        found = kept.get((user, file))
        if not found or now - found[1] >= self.seconds:
            return None
        for scope in ((user, file), (user, None), (None, file), (None, None)):
            if (gone := void.get(scope)) and gone[1] > found[2]:
                return None
        return found[0]

    def close(self) -> None:
        pass


def cached_decisions(rows: DataFrame, seconds: float = 300, late: str = "10 minutes") -> DataFrame:
    """Answers (tenant, user, file_uid, allowed) to the questions in a stream of rows (tenant, user, kind, file_uid, allowed, at).

    Rows of kind "decision" are noted, rows of kind "ask" answered from what is noted and less than ``seconds`` old (null:
    ask the source). Rows of kind "forget" clear a user's file, all of a user with a null file, a file of all users with a
    null user, and the whole tenant with both null. Rows count in order of ``at``, in seconds.

    The state is kept by tenant and part of its users, so that one tenant is not one task. It is a map with an entry a
    user and file: a question reads a few entries, a note writes one, nothing is written anew as a whole. A timer in event
    time drops what is too old, also where no more rows come, as the stream's time goes on. Rows that are ``late`` behind
    that time are passed over. The state store has to be the one on RocksDB; it is set for the session.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    part = F.pmod(F.xxhash64("user"), F.lit(PARTS))
    parts = F.when(F.col("user").isNull(), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(part.cast("int")))
    timed = rows.withColumn("__time", F.timestamp_millis((F.col("at") * 1000).cast("long"))).withWatermark("__time", late)
    dealt = timed.withColumn("__part", F.explode(parts))
    return dealt.groupBy("tenant", "__part").transformWithStateInPandas(_Decisions(seconds), ANSWERS, "append", "EventTime")


def forget_rows(events: DataFrame) -> DataFrame:
    """Governance events as rows of kind "forget" for cached_decisions()."""
    gone = invalidations(events.withColumn("__at", F.col("at"))).withColumnRenamed("__at", "at") if "at" in events.columns else invalidations(events)
    of = lambda scope: F.when(F.col("scope") == scope, F.col("id"))
    return gone.select("tenant", of("member").alias("user"), F.lit("forget").alias("kind"), of("resource").alias("file_uid"), F.lit(None).cast("boolean").alias("allowed"), *(["at"] if "at" in gone.columns else []))


def invalidations(events: DataFrame) -> DataFrame:
    """What governance events make void: rows (tenant, scope, id) with scope resource, member or tenant."""
    scope = F.when(F.col("type").isin("acl.changed", "file.deleted"), "resource").when(F.col("type").isin("role.assigned", "role.member_removed"), "member").when(F.col("type") == "role.deleted", "tenant")
    subject = F.when(scope == "resource", F.col("file_uid")).when(scope == "member", F.col("member")).otherwise(F.col("tenant"))
    return events.select("tenant", scope.alias("scope"), subject.alias("id"), *(["__at"] if "__at" in events.columns else [])).filter("scope is not null and coalesce(id, '') <> ''")
