"""Expiry of messages and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions.predicates import deadline, effective_ttl, epoch_ms, expired, message_ttl
from flowmill.operators.ordered import bucket, running

DAY_MS = 86_400_000


def stamped(messages: DataFrame, queue_ttl: Column) -> DataFrame:
    """enqueue_ms only where a TTL applies; ttl_ms and deadline_ms."""
    ttl = effective_ttl(F.col("expiration"), queue_ttl)
    at = F.when(message_ttl(F.col("expiration")).isNotNull() | queue_ttl.isNotNull(), epoch_ms("published_at"))
    return messages.withColumn("enqueue_ms", at).withColumn("ttl_ms", ttl).withColumn("deadline_ms", deadline(F.col("enqueue_ms"), F.col("ttl_ms")))


def expired_at_delivery(deliveries: DataFrame) -> DataFrame:
    """Deliveries whose message was due when it reached the head; reason expired."""
    return deliveries.where(expired(F.col("enqueue_ms"), F.col("ttl_ms"), F.col("deliver_ms"))).withColumn("reason", F.lit("expired"))


def swept(queued: DataFrame, queues: DataFrame, now_ms: Column) -> DataFrame:
    """What the reaper takes: due messages of queues with a TTL of their own and no consumers."""
    q = queues.where(F.col("message_ttl_ms").isNotNull() & (F.col("consumers") == 0)).select("queue")
    return queued.join(q, "queue", "left_semi").where(expired(F.col("enqueue_ms"), F.col("ttl_ms"), now_ms))


def next_deadline(queued: DataFrame, now_ms: Column) -> DataFrame:
    """T4: per queue the earliest deadline still ahead."""
    return queued.groupBy("queue").agg(F.min(F.when(F.col("deadline_ms") > now_ms, F.col("deadline_ms"))).alias("next_ms"))


def lives(touches: DataFrame, expires_ms: Column) -> DataFrame:
    """T5: per queue the lives that x-expires cuts its touches (queue, at_ms) into.

    Idle for `expires` or longer ends a life; a session window would still merge a touch at
    exactly the gap. The last life ends at ends_ms unless a touch follows.
    """
    # touches of one moment are one row, so the order along a queue is strict
    x = touches.groupBy("queue", "at_ms").agg(F.count("*").alias("n"))
    day, at = bucket("at_ms", DAY_MS), [F.col("at_ms")]
    x = running(x, ["queue"], day, at, upto="before", _was=("last", "at_ms"))
    x = running(x, ["queue"], day, at, life=("sum", F.coalesce((F.col("at_ms") - F.col("_was") >= expires_ms).cast("int"), F.lit(0))))
    return x.groupBy("queue", "life").agg(F.min("at_ms").alias("from_ms"), F.max("at_ms").alias("last_ms"), F.sum("n").alias("touches")).withColumn("ends_ms", F.col("last_ms") + expires_ms)
