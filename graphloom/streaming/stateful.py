"""State per key with ``transformWithState``: running contradictions and the audit ring.

Both need the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass`` (see
``ROCKS``).  Rows are handled a frame at a time with column operations; what a key keeps is a few
facts, or as many entries as its ring holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.operators import facts

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAMES = 16  #: frames of a key that are held before they go to the state store


def use_rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


FACT = ["id", "object", "source_confidence", "timestamp"]
FACT_TYPE = "id long, object string, source_confidence double, timestamp long"
FIRSTS_TYPE = ", ".join(f"{which}_{c}" for which in ("first", "second") for c in FACT_TYPE.split(", "))
PAIR = "subject long, predicate string, " + ", ".join(f"{age}_{c}" for age in ("old", "new") for c in ("id long", "object string", "source_confidence double", "timestamp long"))


def _known(x) -> bool:
    return x is not None and x == x


def _placed(first: tuple | None, second: tuple | None, fact: tuple) -> tuple[tuple | None, tuple | None]:
    """The earliest fact and the earliest one of another object, once ``fact`` is known too."""
    before = lambda a, b: a[3] < b[3] or (a[3] == b[3] and _known(a[0]) and (not _known(b[0]) or a[0] < b[0]))
    if first is None or before(fact, first):
        return fact, second if first is None or first[1] == fact[1] else first
    if fact[1] != first[1] and (second is None or before(fact, second)):
        return first, fact
    return first, second


class _Firsts(StatefulProcessor):
    """Of each (subject, predicate): the earliest accepted fact, and the earliest one of another object.

    A key has few rows, so its cost is that of its calls: plain lists instead of frame operations,
    one state read, at most one written, and one frame out for the frames that are held.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.firsts = handle.getValueState("firsts", FIRSTS_TYPE, self.ttl_ms)
        self.waiting = handle.getListState("waiting", FACT_TYPE + ", state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held: list = [[] for _ in FACT]
        frames, spilled = 0, False
        kept = self.firsts.get()
        before = (tuple(kept[:4]), None if kept[7] is None else tuple(kept[4:])) if kept is not None else (None, None)
        first, second = before
        for frame in rows:
            columns = [frame[c].tolist() for c in FACT]
            for *fact, state in zip(*columns, frame["state"].tolist()):
                if state == "Accepted" and fact[1] is not None and _known(fact[3]):
                    first, second = _placed(first, second, tuple(fact))
            if frames < FRAMES:
                frames += 1
                for some, more in zip(held, columns):
                    some += more
            else:
                spilled = True
                self.waiting.appendList([tuple(x if _known(x) else None for x in r) for r in zip(*columns, frame["state"].tolist())])
        if (first, second) != before:
            self.firsts.update((*self._plain(first), *self._plain(second)))
        if first is not None:
            yield from self._pairs(key, first, second, zip(*held))
            if spilled:
                part: list = []
                for row in self.waiting.get():
                    part.append(row[:4])
                    if len(part) == 10_000:
                        yield from self._pairs(key, first, second, part)
                        part = []
                yield from self._pairs(key, first, second, part)
        if spilled:
            self.waiting.clear()

    @staticmethod
    def _plain(fact: tuple | None) -> tuple:
        if fact is None:
            return (None,) * 4
        return int(fact[0]) if _known(fact[0]) else None, fact[1], float(fact[2]) if _known(fact[2]) else None, int(fact[3])

    @staticmethod
    def _pairs(key, first: tuple, second: tuple | None, facts) -> Iterator[pd.DataFrame]:
        """Each new fact with the earliest known one of another object, if that is earlier; a frame, or none."""
        pairs = []
        for new in facts:
            if new[1] is None or not _known(new[3]):
                continue
            old = second if new[1] == first[1] else first
            if old is not None and (new[3] > old[3] or (new[3] == old[3] and _known(new[0]) and _known(old[0]) and new[0] > old[0])):
                pairs.append((*old, *new))
        if pairs:
            columns = dict(zip((f"{age}_{c}" for age in ("old", "new") for c in FACT), map(list, zip(*pairs))))
            yield pd.DataFrame({"subject": [key[0]] * len(pairs), "predicate": [key[1]] * len(pairs), **columns})

    def close(self) -> None:
        pass


def contradictions(stream: DataFrame, seconds: int = facts.TEMPORAL_SECONDS, gap: float = facts.CONFIDENCE_GAP, ttl_ms: int | None = None) -> DataFrame:
    """``(subject, predicate, old_id, new_id, strategy, winner, loser, winner_state, loser_state)`` as facts come in.

    The result is that of ``facts.resolve(first_only=True)`` for facts that come in the order of
    (timestamp, id) from batch to batch; inside a batch their order does not matter.  A fact that
    comes late is held against the earliest known fact if that is earlier, else against none; it
    becomes the earliest itself for what comes after, and pairs already given stay.  A key that
    had no new earliest fact for ``ttl_ms`` milliseconds is forgotten and starts anew; such a stream
    never runs out of empty batches, so ``availableNow`` ends only with
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off.  Keys with a
    null subject or predicate and facts without object or timestamp give no pairs.
    """
    columns = ["subject", "predicate", *FACT, "state"]
    rows = stream.select(*columns).where("subject is not null and predicate is not null")
    found = rows.groupBy("subject", "predicate").transformWithStateInPandas(_Firsts(ttl_ms), PAIR, "append", "none" if ttl_ms is None else "processingTime")
    return found.withColumn("r", facts.resolution(seconds, gap)).select("subject", "predicate", "old_id", "new_id", "r.*")


ENTRY = ["timestamp", "seq", "action", "user", "status"]
ENTRY_TYPE = "timestamp long, seq long, action string, user string, status int"


class _Ring(StatefulProcessor):
    """The newest ``capacity`` entries of a namespace that are not older than ``retention`` seconds."""

    def __init__(self, capacity: int, retention: int):
        self.capacity, self.retention = capacity, retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", ENTRY_TYPE)
        self.due = handle.getValueState("due", "at long")

    def _out(self, key, rows: pd.DataFrame, reason: str) -> pd.DataFrame:
        return rows.assign(namespace=key[0], reason=reason)[["namespace", *ENTRY, "reason"]]

    def _keep(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.entries.put([(int(t), int(s), a, u, None if pd.isna(c) else int(c)) for t, s, a, u, c in rows.astype(object).to_numpy().tolist()])
        else:
            self.entries.clear()
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        if len(rows) and self.retention:
            at = (int(rows["timestamp"].iloc[0]) + self.retention + 1) * 1000
            self.handle.registerTimer(at)
            self.due.update((at,))

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.entries.get()) if self.entries.exists() else [], columns=ENTRY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ring = self._held()
        for frame in rows:
            ring = pd.concat([ring, frame[ENTRY]]) if len(ring) else frame[ENTRY]
            ring = ring.sort_values(["timestamp", "seq"])
            yield self._out(key, ring.iloc[: max(0, len(ring) - self.capacity)], "capacity")
            ring = ring.iloc[max(0, len(ring) - self.capacity) :]
        self._keep(ring)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ring = self._held()
        now = timerValues.getCurrentWatermarkInMs() // 1000
        old = ring["timestamp"] < now - self.retention
        self.due.clear()
        self._keep(ring[~old])
        yield self._out(key, ring[old], "retention")

    def close(self) -> None:
        pass


def audit_ring(stream: DataFrame, capacity: int = 10_000, retention: int = 90 * 86_400, late: str = "0 seconds") -> DataFrame:
    """Entries ``(namespace, timestamp, seq, action, user, status)`` as they leave the ring, with a ``reason``.

    Each namespace keeps its newest ``capacity`` entries by (timestamp, seq); what is pushed out
    leaves with ``capacity``, what the watermark has left ``retention`` seconds behind with
    ``retention`` (0: never).  An entry older than a full ring leaves at once.  What has not left is
    retained: an anti-join of the entries with this stream's output is the log.
    """
    timed = stream.withColumn("_at", F.timestamp_seconds("timestamp")).withWatermark("_at", late)
    return timed.groupBy("namespace").transformWithStateInPandas(_Ring(capacity, retention), f"namespace string, {ENTRY_TYPE}, reason string", "append", "eventTime")
