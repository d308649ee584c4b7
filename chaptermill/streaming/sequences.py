"""Events numbered without gaps and tokens that expire, as a stream with state and timers and as a batch.

An event is (project_id, event_id, occurred_at, event_type, generation, token). A project's events are put
in order of occurred_at and event_id and numbered from 1. One of an earlier generation than an event
before it comes late: it is dropped and gets no number. A ``token-opened`` event that isn't followed within
``TTL_MS`` by one that consumes the token, or opens it again, makes a ``token-expired`` event of its own
at that time. Events without a project, an id or a time are left out, as are repeats of an id.

The stream holds events back until the watermark has passed them, so events that come out of order, but
not later than ``delay``, get the numbers that the batch gives them. Counter, generation, open tokens and what is
held back are state; after a restart from the checkpoint numbering goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from chaptermill.operators.ordered import along

# Fixed value: how long tokens, selections and previews hold.
TTL_MS = 300_000
EVENTS = "project_id long, event_id string, occurred_at timestamp, event_type string, generation long, token string"
NUMBERED = "project_id long, sequence long, event_id string, occurred_at timestamp, event_type string, generation long, token string"
OPENED, CONSUMED, EXPIRED = "token-opened", "token-consumed", "token-expired"
#: Milliseconds whose events one task orders together.
WIDTH = 1 << 20
_MS = "unix_millis(occurred_at)"


def _usable(events: DataFrame) -> DataFrame:
    return events.filter("project_id IS NOT NULL AND event_id IS NOT NULL AND occurred_at IS NOT NULL")


def _in_time(events: DataFrame) -> DataFrame:
    """Events that no event of a later generation stands before, in stretches of time."""
    cut = events.withColumn("_stretch", F.floor(F.expr(_MS) / WIDTH))
    whole = Window.partitionBy("project_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy("project_id", "_stretch").agg(F.max("generation").alias("_g")).select("project_id", "_stretch", F.max("_g").over(whole).alias("_carried"))
    own = Window.partitionBy("project_id", "_stretch").orderBy("occurred_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = cut.withColumn("_seen", F.max("generation").over(own)).join(carried, ["project_id", "_stretch"])
    late = F.col("generation") < F.greatest("_seen", "_carried")
    return seen.filter(~F.coalesce(late, F.lit(False))).drop("_stretch", "_seen", "_carried")


def expiries(events: DataFrame) -> DataFrame:
    """The ``token-expired`` events of the tokens opened in ``events``."""
    ms = F.expr(_MS)
    own = Window.partitionBy("project_id", "token").orderBy("occurred_at", "event_id")
    known = events.filter(F.col("token").isNotNull() & F.col("event_type").isin(OPENED, CONSUMED)).withColumns({"ms": ms, "next": F.lead(ms).over(own)})
    left = known.filter((F.col("event_type") == OPENED) & (F.col("next").isNull() | (F.col("next") >= F.col("ms") + TTL_MS)))
    return left.select(
        "project_id", F.concat(F.lit("expired-"), "token", F.lit("-"), F.col("ms").cast("string")).alias("event_id"), F.timestamp_millis(F.col("ms") + TTL_MS).alias("occurred_at"),
        F.lit(EXPIRED).alias("event_type"), F.lit(None).cast("long").alias("generation"), "token",
    )


def numbered(events: DataFrame) -> DataFrame:
    """The events of a batch with their ``sequence``; only a row a moment goes through sums by stretches."""
    kept = _in_time(_usable(events).dropDuplicates(["project_id", "event_id"]))
    every = kept.select("project_id", "event_id", "occurred_at", "event_type", "generation", "token").unionByName(expiries(kept)).withColumn("_ms", F.expr(_MS))
    moments = along(every.groupBy("project_id", "_ms").agg(F.count("*").alias("n")), ["project_id"], "_ms", WIDTH, totals={"_before": F.col("n")})
    place = F.row_number().over(Window.partitionBy("project_id", "_ms").orderBy("occurred_at", "event_id"))
    return every.withColumn("_place", place).join(moments.drop("n"), ["project_id", "_ms"]).select("project_id", (F.col("_before") + F.col("_place")).cast("long").alias("sequence"), "event_id", "occurred_at", "event_type", "generation", "token")


class Numbering(StatefulProcessor):
    """A project's counter, newest generation, open tokens and events held back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("counter", "sequence long, generation long")
        self.tokens = handle.getMapState("tokens", "token string, ms long", "open boolean")
        self.held = handle.getMapState("held", "us long, event_id string", "event_type string, generation long, token string")

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            for r in frame.itertuples():
                at = r.occurred_at.value // 1000
                place = (at, r.event_id)
                if not self.held.containsKey(place):
                    self.held.updateValue(place, (r.event_type, None if r.generation != r.generation or r.generation is None else int(r.generation), r.token))
        yield from self._told(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._told(key, timerValues)

    def close(self) -> None:
        pass

    def _told(self, key, timer_values):
        """Number what the watermark has passed, and wait for what comes next."""
        import pandas as pd

        now = timer_values.getCurrentWatermarkInMs()
        sequence, newest = self.counter.get() if self.counter.exists() else (0, None)
        out = []
        open_tokens = {(k[0], k[1]) for k, _ in self.tokens.iterator()}
        coming = sorted((k[0], k[1], *v) for k, v in self.held.iterator())
        waiting = []

        def tell(us, event_id, kind, generation, token):
            nonlocal sequence
            sequence += 1
            out.append((key[0], sequence, event_id, pd.Timestamp(us, unit="us"), kind, generation, token))

        def expire(before_us, before_id):
            """Expiries that stand before an event; they are ordered by time and id like any other."""
            due = sorted(((ms + TTL_MS) * 1000, f"expired-{token}-{ms}", token, ms) for token, ms in open_tokens)
            for at, event_id, token, ms in due:
                if (at, event_id) < (before_us, before_id):
                    tell(at, event_id, EXPIRED, None, token)
                    close(token, ms)

        def close(token, ms):
            open_tokens.discard((token, ms))
            self.tokens.removeKey((token, ms))

        for us, event_id, kind, generation, token in coming:
            if us // 1000 >= now:
                waiting.append(us // 1000)
                continue
            self.held.removeKey((us, event_id))
            expire(us, event_id)
            if generation is not None and newest is not None and generation < newest:
                continue
            newest = generation if newest is None or (generation is not None and generation > newest) else newest
            tell(us, event_id, kind, generation, token)
            if token is not None and kind in (OPENED, CONSUMED):
                for ms in [ms for t, ms in open_tokens if t == token and us // 1000 < ms + TTL_MS]:
                    close(token, ms)
                if kind == OPENED:
                    open_tokens.add((token, us // 1000))
                    self.tokens.updateValue((token, us // 1000), (True,))
        expire(now * 1000, "")
        self.counter.update((sequence, newest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        waiting += [ms + TTL_MS for _, ms in open_tokens]
        if waiting:
            self.handle.registerTimer(max(min(waiting) + 1, now + 1))
        if out:
            yield pd.DataFrame(out, columns=["project_id", "sequence", "event_id", "occurred_at", "event_type", "generation", "token"]).astype({"generation": "Int64"})


def numbered_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """As :func:`numbered`, of a stream; needs the state store that keeps timers
    (``spark.sql.streaming.stateStore.providerClass`` with RocksDB)."""
    timed = _usable(events).withWatermark("occurred_at", delay)
    return timed.groupBy("project_id").transformWithStateInPandas(
        statefulProcessor=Numbering(), outputStructType=T.StructType.fromDDL(NUMBERED), outputMode="append", timeMode="eventTime",
    )
