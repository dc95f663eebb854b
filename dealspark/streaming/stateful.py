"""Stateful streams on `transformWithState` (st04, st05, st06): list and value state, event-time timers, time to live.

`InOrder` keeps what arrives until the watermark has passed it and then hands it on in the order of time, so results
don't depend on how rows are split into batches: late rows that the watermark still allows are put where they belong, and
what comes after it is dropped by Spark. What is kept of a user are numbers in list state, appended in parts.

Rows without key or time take no part. Rows of equal time are taken by their second number (ties: as equals)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Rows that are put into list state at once.
APPENDED = 4096


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that `transformWithState` needs, for the streams started inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class InOrder(StatefulProcessor):
    """Walks the rows (at, in microseconds, and item) of a key in order, as far as the watermark allows. Subclasses say what
    the walk carries along (`carried`: schema of a value state), what a row does (`step`), and when and how the walk ends if
    nothing comes (`until`, `end`)."""

    carried: str

    def step(self, key: tuple, state: tuple | None, at: int, item: int) -> tuple[tuple, list[Row]]:
        raise NotImplementedError

    def until(self, state: tuple) -> int:
        """From when on the state says no more than none."""
        raise NotImplementedError

    def end(self, key: tuple, state: tuple) -> list[Row]:
        return []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, item long")
        self.state = handle.getValueState("carried", self.carried)
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int) -> None:
        """One timer a key, the earliest that is needed (milliseconds, rounded up)."""
        ms = -(-at // 1000)
        now = self.timer.get() if self.timer.exists() else None
        if now is not None and now[0] <= ms:
            return
        if now is not None:
            self.handle.deleteTimer(now[0])
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        part: list[tuple[int, int]] = []
        first = None
        for r in rows:
            if r["at"] is None:
                continue
            first = r["at"] if first is None else min(first, r["at"])
            part.append((r["at"], r["item"] or 0))
            if len(part) == APPENDED:
                self.waiting.appendList(part)
                part = []
        if part:
            self.waiting.appendList(part)
        if first is not None:
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.timer.exists() or self.timer.get()[0] != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for at, item in self.waiting.get() if self.waiting.exists() else ():
            (due if at <= passed else later).append((at, item))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        state = self.state.get() if self.state.exists() else None
        for at, item in sorted(due):
            if state is not None and self.until(state) <= at:
                yield from self.end(key, state)
                state = None
            state, rows = self.step(key, state, at, item)
            yield from rows
        if state is not None and self.until(state) <= passed:
            yield from self.end(key, state)
            state = None
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        needed = [*([min(later)[0]] if later else []), *([self.until(state)] if state is not None else [])]
        if needed:
            self._wake(min(needed))

    def close(self) -> None:
        pass


class CappedSessions(InOrder):
    """st04: a session ends at the first gap of the idle time, and takes in no event from the cap after its start on. One row
    for each session, when it has ended."""

    carried = "started long, last long, n long"

    def __init__(self, idle: int, cap: int):
        self.idle, self.cap = idle, cap

    def step(self, key, state, at, item):
        return (at, at, 1) if state is None else (state[0], at, state[2] + 1), []

    def until(self, state):
        return min(state[1] + self.idle, state[0] + self.cap)

    def end(self, key, state):
        return [Row(key=key[0], started=state[0], ended=self.until(state), n=state[2])]


class RateVerdicts(InOrder):
    """st05: whether a request is within the limit of those allowed in the time before it. What is carried are the times of at
    most `limit` allowed requests; it goes when the newest of them leaves the window."""

    carried = "times array<long>"

    def __init__(self, limit: int, span: int):
        self.limit, self.span = limit, span

    def step(self, key, state, at, item):
        times = [t for t in (state[0] if state else []) if t > at - self.span]
        allowed = len(times) < self.limit
        if allowed:
            times.append(at)
        return (times,), [Row(key=key[0], item=item, allowed=allowed, remaining=self.limit - len(times), reset_at=(times[0] + self.span) if times else at)]

    def until(self, state):
        return state[0][-1] + self.span if state[0] else 0


class LastTurns(StatefulProcessor):
    """st06: the last n numbers of a key; a key that nothing was written to for the time to live leaves the state."""

    def __init__(self, n: int, ttl_ms: int | None):
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "turn long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        import heapq

        if key[0] is None:
            return
        ring = [r[0] for r in self.ring.get()] if self.ring.exists() else []
        heapq.heapify(ring)
        for r in rows:
            if r["turn"] is not None:
                (heapq.heappush if len(ring) < self.n else heapq.heappushpop)(ring, r["turn"])
        if ring:
            self.ring.put([(t,) for t in sorted(ring)])
            yield Row(conv_id=key[0], kept=len(ring), first_turn=min(ring), last_turn=max(ring))

    def close(self) -> None:
        pass


def _ordered(events: DataFrame, key: str, item: str | None, delay: str, processor: InOrder, schema: str) -> DataFrame:
    number = F.col(item) if item else F.lit(0)
    rows = events.withWatermark("ts", delay).select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("at"), number.cast("long").alias("item"))
    return rows.groupBy("key").transformWithState(processor, schema, "append", "eventTime")


def capped_sessions(events: DataFrame, idle_minutes: int = 30, cap_hours: int = 8, delay: str = "1 hour") -> DataFrame:
    """st04: user_id, started, ended, n of every session that has ended. Equal to a walk through each user's events in order of time."""
    walk = CappedSessions(idle_minutes * 60_000_000, cap_hours * 3_600_000_000)
    found = _ordered(events, "user_id", None, delay, walk, "key long, started long, ended long, n long")
    return found.select(F.col("key").alias("user_id"), F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), "n")


def rate_verdicts(events: DataFrame, limit: int = 100, minutes: int = 60, delay: str = "1 hour") -> DataFrame:
    """st05: user_id, event_id, allowed, remaining, reset_at of every event, in order of time and then event_id."""
    walk = RateVerdicts(limit, minutes * 60_000_000)
    found = _ordered(events, "user_id", "event_id", delay, walk, "key long, item long, allowed boolean, remaining int, reset_at long")
    return found.select(F.col("key").alias("user_id"), F.col("item").alias("event_id"), "allowed", "remaining", F.timestamp_micros("reset_at").alias("reset_at"))


def last_turns(turns: DataFrame, n: int = 20, ttl_hours: float | None = 30 * 24) -> DataFrame:
    """st06: conv_id, kept, first_turn, last_turn after every batch that brought turns. Idle conversations leave the state
    after the time to live; Spark then looks at the clock in endless batches, so a run over bounded input takes None."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"))
    processor = LastTurns(n, None if ttl_hours is None else int(ttl_hours * 3_600_000))
    return rows.groupBy("conv_id").transformWithState(processor, "conv_id long, kept int, first_turn long, last_turn long", "update", "none" if ttl_hours is None else "processingTime")


def run_to_end(events: DataFrame, job: Callable[[DataFrame], DataFrame], base: str, at: str = "ts") -> DataFrame:
    """Runs job over all that the stream has, then marks its end: a row with nothing but a time far ahead moves the
    watermark past everything that still waits. For bounded input; endless streams need no mark. Returns what was written."""
    spark = events.sparkSession
    nothing = spark.createDataFrame([], events.schema)
    nothing.write.parquet(f"{base}/end")
    mark = spark.range(1).select(*[(F.lit("9999-01-01").cast(f.dataType) if f.name == at else F.lit(None).cast(f.dataType)).alias(f.name) for f in events.schema])
    stream = events.unionByName(spark.readStream.schema(events.schema).parquet(f"{base}/end"))
    out = job(stream)
    with state_store(spark):
        for last in (False, True):
            if last:
                mark.write.mode("append").parquet(f"{base}/end")
            out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def run_updates(df: DataFrame, keys: list[str], base: str) -> DataFrame:
    """Runs an updating stream over what is there; of every key the row of the last batch that had one. A batch that runs
    again overwrites its own part."""
    spark = df.sparkSession

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    with state_store(spark):
        df.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(StructType([*df.schema.fields, StructField("epoch", IntegerType())])).parquet(f"{base}/out")
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(F.struct(*df.columns), "epoch").alias("r")).select("r.*")
