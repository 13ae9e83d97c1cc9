"""Arbitrary state with named variables and event-time timers (``transformWithState``)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from basinflow.streaming.queries import ROCKS_DB, drain, late_deliveries, setting

IDLE = "user_id long, start long, stop long, n long, nth long"
DAY_MS = 86_400_000


class IdleUsers(StatefulProcessor):
    """A row for each spell of a key's events once the watermark says that ``gap_ms`` have passed without another one.

    ``spells`` lists the key's open spells as (start, stop, n), in microseconds; rows may come in any order, also in one that joins two
    spells. ``sent`` counts the spells sent. One timer stands for a key, at the first end of its open spells, and sends all that the watermark has
    ended: calls to the state go by keys and batches, not by spells. A key's state is its open spells only, however many rows they have.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spells = handle.getListState("spells", "start long, stop long, n long")
        self.sent = handle.getValueState("sent", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        spells = [tuple(s) for s in self.spells.get()]
        before = self._due(spells)
        merged: list[tuple[int, int, int]] = []
        for start, stop, n in sorted(spells + [(r.at, r.at, 1) for r in rows]):
            if merged and start - merged[-1][1] < self.gap_ms * 1000:
                first, last, m = merged[-1]
                merged[-1] = (first, max(last, stop), m + n)
            else:
                merged.append((start, stop, n))
        self.spells.put(merged)
        due = self._due(merged)
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        spells = sorted(tuple(s) for s in self.spells.get())
        over = [s for s in spells if self._end(s) <= now]
        left = [s for s in spells if self._end(s) > now]
        if left:
            self.spells.put(left)
            self.handle.registerTimer(self._due(left))
        else:
            self.spells.clear()
        sent = (self.sent.get() or (0,))[0]
        self.sent.update((sent + len(over),))
        for nth, (start, stop, n) in enumerate(over, sent + 1):
            yield Row(user_id=key[0], start=start, stop=stop, n=n, nth=nth)

    def _end(self, spell: tuple[int, int, int]) -> int:
        """When a spell is over, in milliseconds, rounded up."""
        return -(-spell[1] // 1000) + self.gap_ms

    def _due(self, spells: list[tuple[int, int, int]]) -> int | None:
        return min(map(self._end, spells), default=None)

    def close(self) -> None:
        pass


def idle_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spells of users' events that six idle hours have ended, numbered as they end, over several deliveries. The state is kept in RocksDB."""
    stream, steps = late_deliveries(spark, sf_dir)
    watched = stream.select("user_id", "ts", F.unix_micros("ts").alias("at")).withWatermark("ts", "1 hour").groupBy("user_id")
    with setting(spark, *ROCKS_DB):
        spells = watched.transformWithState(IdleUsers(6 * 3_600_000), IDLE, "Append", "EventTime")
        done = drain(spells, "append", steps)
    stamp = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return done.select("user_id", stamp("start"), stamp("stop"), "n", "nth")


class FirstOfKind(StatefulProcessor):
    """The first row of each kind that a key has, as long as it remembers: a kind is forgotten ``ttl_ms`` of processing time after it was let through.

    The map's keys are read once for a key and batch.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "kind string", "event_id long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        first: dict[str, int] = {}
        for r in rows:
            first[r.event_type] = min(r.event_id, first.get(r.event_type, r.event_id))
        for (kind,) in self.seen.keys():
            first.pop(kind, None)
        for kind, event in first.items():
            self.seen.updateValue((kind,), (event,))
            yield Row(user_id=key[0], event_type=kind, event_id=event)

    def close(self) -> None:
        pass


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each type and user over the on-time deliveries and the late one, from a map that forgets after a day."""
    stream, steps = late_deliveries(spark, sf_dir)
    with setting(spark, *ROCKS_DB):
        kinds = stream.select("user_id", "event_type", "event_id").groupBy("user_id")
        found = kinds.transformWithState(FirstOfKind(DAY_MS), "user_id long, event_type string, event_id long", "Append", "ProcessingTime")
        return drain(found, "append", steps, flush=False)  # with processing time there would always be one more batch


QUERIES = {"stream_idle_users": idle_users, "stream_first_seen": first_seen}

SQL = {
    # Late rows that the watermark of the first two deliveries has passed are dropped; of the spells of all others those are sent
    # whose six hours the watermark of the last delivery has passed.
    "stream_idle_users": """
WITH e AS (
  SELECT user_id, ts FROM events, (
    SELECT max(ts) FILTER (event_id % 97 <> 0 AND event_id * 3 // (m + 1) < 2) - INTERVAL 1 HOUR AS before FROM events, (SELECT max(event_id) AS m FROM events))
  WHERE NOT (event_id % 97 = 0 AND ts <= before)
), b AS (
  SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM b
), g AS (SELECT user_id, min(ts) AS start, max(ts) AS stop, count(*) AS n FROM s GROUP BY user_id, s)
SELECT user_id, start, stop, n, row_number() OVER (PARTITION BY user_id ORDER BY start) AS nth FROM g
WHERE stop + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "stream_first_seen": """
SELECT user_id, event_type, coalesce(min(event_id) FILTER (event_id % 97 <> 0), min(event_id)) AS event_id FROM events GROUP BY user_id, event_type""",
}
