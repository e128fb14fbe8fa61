"""Streaming episode state.

The only incremental computation of the original is the per-episode state
the agent loop carries (rooms, objects, recent actions, rewards, stop
rules).  Here it is a Structured Streaming operator over a log of steps
(``transformWithState``), keyed by ``(task_no, variation_id)``:

* rows may arrive out of order, so each episode appends them to a list
  state and sets an event-time timer for the earliest; when the watermark
  passes it, the rows up to the watermark are taken in ``(ts, event_id)``
  order (rows without time first);
* rooms are a list state of which only what a row adds is written, objects (as
  many as the limit) one that is written where they change, the rest, with the short list of the last actions and
  scores, is one value; a trigger touches the episodes that have new rows or an
  expired timer, and no other;
* an episode with no new rows for ``gap`` of event time is closed by its
  timer, which is when R2 emits an end record for episodes whose stop rules
  never fired; its state is removed.

An episode has few rows a trigger, so rows are taken as they are, without a frame for
each episode, and state is read and written at most once.  The per-row step is a small Python helper; the results equal the batch
window operators on the same rows (tests compare them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed
from ..functions.text import look_room, object_mentions, observation_room

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])

EPISODE = ("task_no", "variation_id")
#: List, map and timer states need this store.
STORE = ("spark.sql.streaming.stateStore.providerClass",
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Bytes of a Parquet log for each state partition.
STATE_BYTES = 8 << 20

HEAD = ("step int, told_room string, prev_score double, last_score double, last_at long, "
        "entered long, done boolean, wake long, recent array<string>, scores array<double>")
PENDING = "at long, event_id long, action string, score double, told_room string, seen_room string, things array<string>"
R1_SCHEMA = ("task_no long, variation_id long, step int, action string, reward double, "
             "places string, objects string")
R2_SCHEMA = "task_no long, variation_id long, end_step int, final_score double, reason string"


def read_event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


@contextmanager
def state_partitions(spark: SparkSession, log: str | None = None):
    """A new stateful stream started inside has one state partition a core, more where the
    ``log`` it reads is large.  Every trigger opens and commits all of them, rows or none, so
    the session's many partitions would be most of the time."""
    width = spark.sparkContext.defaultParallelism
    if log is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
        held = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        width = max(width, -(-held // STATE_BYTES))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def event_steps(events: DataFrame) -> DataFrame:
    """The steps of an event stream, without noise steps (F1)."""
    from ..operators.windows import not_noise
    from ..sources.tables import events_as_steps
    return events_as_steps(events, position=False, keep=("ts", "event_id")).where(not_noise())


def _step_rows(steps: DataFrame) -> DataFrame:
    """What the state needs of a step, as columns: the room an observation tells, the
    room and the objects a look shows."""
    return steps.select(
        *EPISODE, "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "action", "score",
        observation_room("observation").alias("told_room"), look_room("freelook").alias("seen_room"),
        object_mentions("freelook").alias("things"))


# --- the per-episode state ------------------------------------------------------------

#: ``HEAD`` of an episode without rows.
START = (0, None, 0.0, 0.0, None, 0, False, None, [], [])


class EpisodeSteps:
    """An episode's running values while its rows are taken; ``rooms`` and ``objects``
    map names to the order in which they came."""

    def __init__(self, head: tuple | None, rooms: dict, objects: dict):
        self.step, self.told_room, self.prev_score, self.last_score, self.last_at, self.entered, self.done = (head or START)[:7]
        self.rooms, self.objects = rooms, objects
        self.recent = [*zip(*(head or START)[8:])] or [(fixed.SENTINEL_ACTION, 0.0)]

    def advance(self, row: tuple, object_limit: int) -> dict:
        """Take one step; its R1 values."""
        at, _, action, score, told_room, seen_room, things = row
        if self.step >= 1:
            for room in (self.told_room, seen_room):
                if room is not None:
                    self.rooms.setdefault(room, len(self.rooms))
            for thing in things or []:
                if thing not in self.objects:
                    self.objects[thing] = self.entered
                    self.entered += 1
            for thing in sorted(self.objects, key=self.objects.get)[:max(0, len(self.objects) - object_limit)]:
                del self.objects[thing]
        shown = 0.0 if self.step == 0 else score
        out = {"step": self.step, "action": action, "reward": 0.0 if self.step == 0 else shown - self.prev_score,
               "places": ", ".join(sorted(self.rooms, key=self.rooms.get)) or None,
               "objects": ", ".join(sorted(self.objects, key=self.objects.get))}
        self.told_room, self.prev_score, self.last_score = told_room, shown, score
        self.last_at = at if at is not None and (self.last_at is None or at > self.last_at) else self.last_at
        return out

    def reason(self, row: tuple, loop_k: int, step_limit: int, stall_k: int | None) -> str | None:
        """The stop rule that the step just taken fires, in the order the loop checks them."""
        step, score = self.step, row[3]
        self.recent = (self.recent + [(row[2], score)])[-max(loop_k, stall_k or 1):]
        self.step += 1
        if score < 0:
            return "negative"
        if step + 2 >= loop_k and len({a for a, _ in self.recent[-loop_k:]}) == 2:
            return "loop"
        if stall_k and step + 2 > stall_k and len({x for _, x in self.recent[-stall_k:]}) == 1:
            return "stall"
        return "step_cap" if step == 2 * step_limit - 1 else None


class EpisodeProcessor(StatefulProcessor):
    """R1 (``mode='state'``) and R2 (``mode='stops'``) of one episode."""

    def __init__(self, mode: str, object_limit: int, loop_k: int, step_limit: int, stall_k: int | None, gap_us: int):
        self.mode, self.object_limit, self.gap_us = mode, object_limit, gap_us
        self.rules = (loop_k, step_limit, stall_k)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.pending = handle.getListState("pending", PENDING)
        self.rooms = handle.getListState("rooms", "name string")
        self.objects = handle.getListState("objects", "name string, place long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # a score without value compares with nothing
        new = [(r.at, r.event_id, r.action, math.nan if r.score is None else r.score, r.told_room, r.seen_room, r.things) for r in rows]
        if new:
            self.pending.appendList(new)
            head = self.head.get() or START
            times = [r[0] for r in new if r[0] is not None]
            first = min(times) if times else timerValues.getCurrentWatermarkInMs() * 1000
            woken = self.woken(head, -(-first // 1000))
            if woken is not head:
                self.head.update(woken)
        return iter(())

    def woken(self, head: tuple, at: int) -> tuple:
        """``head`` with a timer at ``at`` milliseconds or before."""
        if head[7] is not None and head[7] <= at:
            return head
        if head[7] is not None:
            self.handle.deleteTimer(head[7])
        self.handle.registerTimer(at)
        return (*head[:7], at, *map(list, head[8:]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.pending.get()]
        ready = sorted((r for r in held if r[0] is None or r[0] <= passed), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0))
        left = [r for r in held if r[0] is not None and r[0] > passed]
        rooms, objects = {}, {}
        if ready and self.mode == "state":
            rooms = {name: i for i, (name,) in enumerate(self.rooms.get())}
            objects = dict(self.objects.get())
        before = dict(rooms), dict(objects)
        steps, ends = [], []
        s = EpisodeSteps(self.head.get(), rooms, objects)
        for row in ready:
            if s.done:                           # R2 ignores what follows; the time still counts
                s.last_at = max(s.last_at or 0, row[0] or 0)
                continue
            out = s.advance(row, self.object_limit)
            steps.append((*key, *out.values()))
            reason = s.reason(row, *self.rules)
            if reason and self.mode == "stops":
                s.done = True
                ends.append((*key, out["step"], 0.0 if reason == "negative" else row[3], reason))
        closes = (s.last_at if s.last_at is not None else passed) + self.gap_us
        if not left and s.step and passed >= closes:
            if not s.done:
                ends.append((*key, s.step - 1, s.last_score, "end"))
            for state in (self.head, *([self.pending] if held else []), *([self.rooms, self.objects] if self.mode == "state" else [])):
                state.clear()
        else:
            if ready:
                self.pending.put(left) if left else self.pending.clear()
                if len(rooms) > len(before[0]):
                    self.rooms.appendList([(name,) for name in [*rooms][len(before[0]):]])
                if objects != before[1]:
                    self.objects.put([*objects.items()])
            head = (s.step, s.told_room, s.prev_score, s.last_score, s.last_at, s.entered, s.done, None, *map(list, zip(*s.recent)))
            wake = min((r[0] for r in left), default=closes)
            self.head.update(self.woken(head, max(-(-wake // 1000), passed // 1000 + 1)))
        schema, found = (R1_SCHEMA, steps) if self.mode == "state" else (R2_SCHEMA, ends)
        named = Row(*(c.split()[0] for c in schema.split(", ")))
        for values in found:
            yield named(*(None if x != x else x for x in values))

    def close(self) -> None:
        pass


def stream_state(steps: DataFrame, watermark: str = "10 minutes", object_limit: int = fixed.OBJECT_LIMIT_ONLINE,
                 loop_k: int = fixed.LOOP_WINDOW, step_limit: int = 10 ** 9, stall_k: int | None = None,
                 gap: str = "1 day", mode: str = "state") -> DataFrame:
    """``steps``: a stream of ``task_no, variation_id, ts, event_id, action, score,
    observation, freelook``.
    R1 (``mode='state'``): per-step running state rows.
    R2 (``mode='stops'``): one end record per episode when the first stop
    rule fires (negative score, loop, stall, step cap) or, failing that,
    when the episode closes; later steps are ignored.
    The session is set to the state store that these states need."""
    steps.sparkSession.conf.set(*STORE)
    gap_us = int(pd.Timedelta(gap).total_seconds() * 1_000_000)
    rows = _step_rows(steps).withWatermark("ts", watermark)
    schema = R1_SCHEMA if mode == "state" else R2_SCHEMA
    return rows.groupBy(*EPISODE).transformWithState(
        EpisodeProcessor(mode, object_limit, loop_k, step_limit, stall_k, gap_us), schema, "Append", "EventTime")


def stream_scores(stops: DataFrame) -> DataFrame:
    """Running per-task mean of the final scores of finished episodes
    (an ``update``-mode aggregate over the R2 records)."""
    return stops.groupBy("task_no").agg(F.avg("final_score").alias("mean_score"), F.count(F.lit(1)).alias("episodes"))


def write_epoch(path: str):
    """``foreachBatch`` writer of R3: each epoch owns one folder, which a replay of the
    epoch writes again instead of adding to it."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write
