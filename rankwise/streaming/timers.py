"""ST2: streaming timer pairing, the same for every cut into micro-batches.

State per key (``transformWithState`` on RocksDB): the pending start, and
the events that are not final yet in slots of ``slot_ms``.  A micro-batch writes
only the slots that its events fall in.  A key has one event-time timer, at the
end of its first open slot: once the watermark has passed it, all slots that end
before the watermark are replayed in ``(ts, id)`` order, in one call, so that an
event which arrives late but within the allowed delay still takes its place, and
the slots go.  Times are microseconds and results plain rows: a key with a few
events makes no data frames.  Events behind the watermark
are dropped by Spark.  A start overwrites the pending one, a stop consumes it
(pair) or is rejected.

With ``expiry_seconds`` a start counts for that long: a later stop doesn't
find it, and the start leaves a row with the reason ``expired``, as soon as the
next event of its key or a timer shows it.  Without it starts wait for ever,
like the batch form.  (State's own time to live goes by the clock, not by event
time, and would make results depend on when a stream runs.)
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PENDING, TIMER = "us long, id long", "at long"
SLOT, SLOT_EVENTS = "slot long", "us array<long>, ids array<long>, stops array<boolean>"
SLOT_MS = 1000
#: Time of an event without one: it comes before all others.
NO_TIME = -2**63
#: Slots of a key that are read and removed together; more of them one by one.
TOGETHER = 10_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Pairing(StatefulProcessor):
    def __init__(self, expiry_us: int | None, slot_ms: int) -> None:
        self.expiry_us, self.slot_ms = expiry_us, slot_ms
        self.row = Row("has_key", "key", "start_id", "stop_id", "start_us", "stop_us", "seconds", "reason")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", PENDING)
        self.timer = handle.getValueState("timer", TIMER)
        self.slots = handle.getMapState("slots", SLOT, SLOT_EVENTS)

    def _slot(self, us: int) -> int:
        return us // (1000 * self.slot_ms)

    def _end(self, slot: int) -> int:
        return (slot + 1) * self.slot_ms

    def _wake(self, at: int, timer: int | None) -> None:
        """The key's timer rings at ``at``."""
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found: dict[int, list] = {}
        for r in rows:
            found.setdefault(self._slot(r["us"]), []).append((r["us"], r["id"], r["is_stop"]))
        known = self.timer.get()  # a key without a timer has no open slot
        timer = None if known is None else known[0]
        for slot, events in found.items():
            if timer is not None and self.slots.containsKey((slot,)):
                events += zip(*self.slots.getValue((slot,)), strict=True)
            self.slots.updateValue((slot,), tuple(list(c) for c in zip(*events, strict=True)))
        first = self._end(min(found))
        if timer is None or first < timer:
            self._wake(first, timer)
        yield from ()

    def _due(self, now: int) -> tuple[Iterator[list], int | None]:
        """Events of the slots that end by ``now``, slot by slot in order, which are removed; and the first slot left."""
        slots = sorted(k[0] for k in self.slots.keys())
        due = [s for s in slots if self._end(s) <= now]
        left = slots[len(due)] if len(due) < len(slots) else None
        if left is None and len(due) <= TOGETHER:
            whole = {k[0]: list(zip(*v, strict=True)) for k, v in self.slots.iterator()}
            self.slots.clear()
            return (whole[s] for s in due), left

        def taken() -> Iterator[list]:
            for s in due:
                yield list(zip(*self.slots.getValue((s,)), strict=True))
                self.slots.removeKey((s,))
        return taken(), left

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        start = before = self.pending.get()
        due, left = self._due(now)
        for events in due:
            for at, eid, stop in sorted(events):
                if start is not None and self.expiry_us is not None and at - start[0] > self.expiry_us:
                    yield self.row(*key, start[1], None, start[0], None, None, "expired")
                    start = None
                if not stop:
                    start = (at, eid)
                elif start is not None:
                    yield self.row(*key, start[1], eid, start[0], at, -((start[0] - at) // 1_000_000), None)  # whole seconds, up
                    start = None
                else:
                    yield self.row(*key, None, eid, None, at, None, "stop_without_start")
        ends = [] if left is None else [self._end(left)]
        if start is not None and self.expiry_us is not None:
            over = self._end(self._slot(start[0] + self.expiry_us))
            if over <= now:  # all events up to there are replayed
                yield self.row(*key, start[1], None, start[0], None, None, "expired")
                start = None
            else:
                ends.append(over)
        if start is None and before is not None:
            self.pending.clear()
        elif start is not None and start != before:
            self.pending.update(tuple(start))
        if ends:
            self._wake(min(ends), None)
        else:
            self.timer.clear()

    def close(self) -> None:
        pass


# The state's code runs in Python workers; ship this module by value so the
# workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pair_timers_stream(events: DataFrame, start_value: str = "click", stop_value: str = "purchase", *,
                       key: str = "user_id", kind_col: str = "event_type", ts_col: str = "ts",
                       id_col: str = "event_id", delay: str = "1 hour",
                       expiry_seconds: int | None = None, slot_ms: int = SLOT_MS) -> DataFrame:
    """Streaming form of ``timing.pair_timers``: pairs (``reason`` null) and rejects in one frame.

    ``delay`` is how far behind the latest event others may arrive; rows
    come out once the watermark has passed the slot of their last event.  The
    session's state store becomes RocksDB, which this kind of state asks for."""
    ev = (events.filter(F.col(kind_col).isin(start_value, stop_value))
          .select(F.col(key).isNotNull().alias("has_key"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(ts_col).cast("timestamp").alias("ts"),
                  (F.col(kind_col) == stop_value).alias("is_stop"))
          .withColumn("us", F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME))).withWatermark("ts", delay))
    # the state's keys are never null: Python workers take rows of a null key for the next key's
    kind = dict(events.dtypes)[key]
    schema = "has_key boolean, key string, start_id long, stop_id long, start_us long, stop_us long, seconds long, reason string"
    expiry = None if expiry_seconds is None else expiry_seconds * 1_000_000
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = ev.groupBy("has_key", "key").transformWithState(_Pairing(expiry, slot_ms), schema, "append", "EventTime")
    at = lambda us: F.when(F.col(us) != NO_TIME, F.timestamp_micros(us))
    return out.select(F.when(F.col("has_key"), F.col("key").cast(kind)).alias(key), "start_id", "stop_id", at("start_us").alias("start_ts"), at("stop_us").alias("stop_ts"), "seconds", "reason")


def state_bytes(query) -> int:
    """State held by a running or finished query, as its last progress tells."""
    return sum(op["memoryUsedBytes"] for op in (query.lastProgress or {"stateOperators": []})["stateOperators"])
