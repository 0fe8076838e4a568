"""Streaming forms of operators whose result does not need the whole log.

Stateless ones (routing, stamping) are the batch functions on a streaming frame. Stateful ones
keep what their closed form needs and nothing else: the confirm watermark one number and
the parked tags, the alarm latch two bits, a queue's idle life its last touch, a message with a
deadline that deadline. What time alone brings about hangs on event-time timers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowmill.operators.expiry import stamped
from flowmill.operators.routing import matched, route


def stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def routed(messages: DataFrame, bindings: DataFrame, exchanges: DataFrame) -> DataFrame:
    """R2-R5 on a stream: a row for each binding that matches, without state."""
    return matched(messages, bindings, exchanges)


def deliver_routed(messages: DataFrame, path: str, checkpoint: str, queues: DataFrame, bindings: DataFrame, exchanges: DataFrame, xbindings: DataFrame | None = None, hops: int = 0) -> None:
    """R1-R7 on a stream: default exchange, hops between exchanges, and each queue once per message.
    A message's copies all come from one row, so a micro-batch holds them together and the batch
    operator is exact for it."""
    _each_batch(messages, path, checkpoint, lambda batch: route(batch, queues, bindings, exchanges, xbindings, hops))


def deadlines(messages: DataFrame, queue_ttl_ms: int | None) -> DataFrame:
    """T1 on a stream."""
    return stamped(messages, F.lit(queue_ttl_ms).cast("long"))


def confirm_watermark(done: DataFrame) -> DataFrame:
    """Per channel an ack for each trigger in which the gap-free prefix grew.

    State: the watermark and the tags parked beyond it. Output: channel, ack, multiple.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, parked = state.get if state.exists else (0, [])
        before, waiting = mark, set(parked)
        for pdf in batches:
            waiting.update(int(t) for t in pdf.tag if t > mark)
        while mark + 1 in waiting:
            mark += 1
            waiting.discard(mark)
        state.update((mark, sorted(waiting)))
        if mark > before:
            yield pd.DataFrame({"channel": [key[0]], "ack": [mark], "multiple": [mark > before + 1]})

    return done.groupBy("channel").applyInPandasWithState(step, "channel long, ack long, multiple boolean", "mark long, parked array<long>", "append", GroupStateTimeout.NoTimeout)


def alarm_edges(samples: DataFrame, high: float, floor: float, hysteresis: float) -> DataFrame:
    """Edges of each node's alarm bits, as samples arrive in order of `at`."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bits = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for at, rss, free in zip(rows["at"], rows["rss"], rows["free"]):
            was = bits
            if not pd.isna(rss):
                bits = bits | 1 if rss >= high else bits & ~1 if rss <= high * (1 - hysteresis) else bits
            if not pd.isna(free):
                bits = bits | 2 if free < floor else bits & ~2 if free >= floor * (1 + hysteresis) else bits
            if bool(was) != bool(bits):
                out.append((key[0], at, bits, "blocked" if bits else "unblocked"))
        state.update((bits,))
        yield pd.DataFrame(out, columns=["node", "at", "bits", "edge"])

    return samples.groupBy("node").applyInPandasWithState(step, "node long, at long, bits int, edge string", "bits int", "append", GroupStateTimeout.NoTimeout)


def idle_lives(touches: DataFrame, expires_ms: int, late: str = "0 seconds") -> DataFrame:
    """Lives of queues that have ended: shown by a touch after the end, or by the event-time
    watermark passing it, so a queue that stays idle ends as well. touches: queue, at_ms."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, last, n = state.get if state.exists else (None, None, 0)
        out = []
        if state.hasTimedOut:
            out.append((key[0], begin, last, n, last + expires_ms))
            state.remove()
        else:
            for at in sorted(int(a) for pdf in batches for a in pdf.at_ms):
                if last is not None and at - last >= expires_ms:
                    out.append((key[0], begin, last, n, last + expires_ms))
                    begin, n = at, 0
                begin, last, n = at if begin is None else begin, at, n + 1
            state.update((begin, last, n))
            state.setTimeoutTimestamp(max(last + expires_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["queue", "from_ms", "last_ms", "touches", "ends_ms"])

    timed = touches.select("queue", "at_ms", F.timestamp_millis("at_ms").alias("at")).withWatermark("at", late)
    return timed.groupBy("queue").applyInPandasWithState(step, "queue string, from_ms long, last_ms long, touches long, ends_ms long", "begin long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def reaped(queued: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Messages that are due, as the event-time watermark passes their deadline. queued: queue, tag,
    published_at, deadline_ms (null: never). A message's state lasts until it is due."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append((*key, state.get[0]))
            state.remove()
        else:
            due = int(min(d for pdf in batches for d in pdf.deadline_ms))
            if due <= state.getCurrentWatermarkMs():
                out.append((*key, due))
            else:
                state.update((due,))
                state.setTimeoutTimestamp(due)
        yield pd.DataFrame(out, columns=["queue", "tag", "deadline_ms"])

    timed = queued.where("deadline_ms is not null").select("queue", "tag", "deadline_ms", "published_at").withWatermark("published_at", late)
    return timed.groupBy("queue", "tag").applyInPandasWithState(step, "queue string, tag long, deadline_ms long", "due long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(frame: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, as a table in memory."""
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.table(name)


def _each_batch(frame: DataFrame, path: str, checkpoint: str, of: Callable[[DataFrame], DataFrame]) -> None:
    def write(batch: DataFrame, epoch: int) -> None:
        of(batch).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    frame.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def deliver(frame: DataFrame, path: str, checkpoint: str, key: list[str]) -> None:
    """Consume sink: each micro-batch is one commit, written under its batch id, so a
    replay overwrites its own rows."""
    _each_batch(frame, path, checkpoint, lambda batch: batch.dropDuplicates(key))
