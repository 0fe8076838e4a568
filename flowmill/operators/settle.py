"""Settlement: acks, nacks, rejects, recovery of unacked deliveries (A1-A14), and the keyed
fold for logs in which claims and publishes interleave (Q5-Q9, Q15 in general).

End states are aggregates and joins. `multiple` settles a range: instead of joining ranges,
each channel's deliveries and settles are merged by sequence and the covering settle is a
running minimum from the end, sorted by ranges of tags (see ordered), not by channel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.operators.ordered import bucket, ranked, running


def wire_tags(deliveries: DataFrame) -> DataFrame:
    """Delivery numbers per channel, from 1."""
    return ranked(deliveries, ["channel"], "seq", "wire_tag")


def first_settles(settles: DataFrame) -> DataFrame:
    """Per delivery the settle that counts, and how many came too late."""
    return settles.groupBy("channel", "wire_tag").agg(F.min_by("action", "seq").alias("action"), F.min_by("requeue", "seq").alias("requeue"), (F.count("*") - 1).alias("late"))


def expanded(deliveries: DataFrame, settles: DataFrame) -> DataFrame:
    """A2: which settle settles each delivery, singles and ranges together; first wins.

    deliveries: channel, wire_tag, seq; settles: channel, wire_tag, seq, action, multiple,
    requeue; multiple covers all delivered and unsettled tags up to its own, 0 all of them.

    A settle counts if it comes after the delivery: one that names a tag not delivered yet settles
    nothing by itself, and a range reaches up to what was delivered before it. So cut, a range of
    tag t comes after all deliveries up to t, as a channel delivers tags in order of sequence;
    the earliest settle with a tag at or above a delivery's is after the delivery too, and going
    down through the tags a running minimum of sequence is enough.
    """
    d = deliveries.select("channel", "seq", F.col("wire_tag").cast("long").alias("wire_tag"))
    s = F.struct("seq", "action", "requeue").alias("s")
    none = lambda kind: F.lit(None).cast(kind)
    kind = "struct<seq:bigint,action:string,requeue:boolean>"
    asks = settles.where("multiple").withColumn("wire_tag", F.col("wire_tag").cast("long"))
    both = d.select("channel", "seq", F.lit(0).alias("kind"), F.col("wire_tag").alias("w"), none("long").alias("upto"), none(kind).alias("s")).union(asks.select("channel", "seq", F.lit(1), none("long"), F.when(F.col("wire_tag") > 0, F.col("wire_tag")), s))
    acts = running(both, ["channel"], bucket("seq"), [F.col("seq"), F.col("kind")], sofar=("max", "w")).where("kind = 1 and sofar is not null")
    line = acts.select("channel", F.least("upto", "sofar").alias("tag"), F.lit(0).alias("kind"), "s").union(d.select("channel", "wire_tag", F.lit(1), none(kind)))
    by_range = running(line, ["channel"], bucket("tag"), [F.col("tag"), -F.col("kind")], down=True, s=("min", "s")).where("kind = 1 and s is not null").select("channel", F.col("tag").alias("wire_tag"), "s")
    single = settles.where("not multiple").select("channel", F.col("wire_tag").cast("long").alias("wire_tag"), s)
    single = single.join(d.withColumnRenamed("seq", "sent"), ["channel", "wire_tag"]).where("s.seq >= sent").groupBy("channel", "wire_tag").agg(F.min("s").alias("s"))
    first = by_range.union(single).groupBy("channel", "wire_tag").agg(F.min("s").alias("s"))
    return d.join(first, ["channel", "wire_tag"], "left").select("channel", "wire_tag", F.col("s.seq").alias("settled_at"), F.col("s.action").alias("action"), F.col("s.requeue").alias("requeue"))


def after_settle(settled: DataFrame) -> DataFrame:
    """What becomes of each delivery: acked, requeued (redelivered), dead-lettered
    or dropped, or still unacked. Deliveries without acks are settled when sent."""
    lost = F.when(F.col("has_dlx"), "dead-lettered").otherwise("dropped")
    return settled.withColumn("state", F.when(F.col("no_ack") | (F.col("action") == "ack"), "acked").when(F.col("action").isNull(), "unacked").when(F.col("requeue"), "requeued").otherwise(lost))


def unacked(deliveries: DataFrame, settled: DataFrame) -> DataFrame:
    """Deliveries without a settle, by (consumer, tag)."""
    return deliveries.where("not no_ack").join(settled, ["channel", "wire_tag"], "left_anti")


def unacked_by_consumer(open_: DataFrame) -> DataFrame:
    return open_.groupBy("consumer").agg(F.count("*").alias("unacked"), F.min("tag").alias("lowest"))


def min_ack_cursor(delivered: DataFrame, open_: DataFrame) -> DataFrame:
    """A10: per queue the lowest unacked tag over its consumers, else the last tag."""
    low = open_.groupBy("queue").agg(F.min("tag").alias("low"))
    return delivered.groupBy("queue").agg(F.max("tag").alias("head")).join(low, "queue", "left").select("queue", F.coalesce("low", "head").alias("cursor"))


def recovered(open_: DataFrame, recovers: DataFrame) -> DataFrame:
    """Basic.recover requeues what its channel has unacked, gets excluded; its flag is ignored."""
    r = recovers.groupBy("channel").agg(F.max("seq").alias("recovered_at"))
    return open_.where("not is_get").join(r, "channel").where(F.col("seq") < F.col("recovered_at"))


def cancelled(open_: DataFrame, cancels: DataFrame) -> DataFrame:
    """Unacked and buffered deliveries of cancelled consumers go back to their queues."""
    return open_.join(cancels.select("consumer"), "consumer", "left_semi")


def auto_deleted_queues(queues: DataFrame, consumers: DataFrame, cancels: DataFrame) -> DataFrame:
    """Auto-delete queues that had consumers and lost the last one."""
    left = consumers.join(cancels.select("consumer"), "consumer", "left_anti").select("queue").distinct()
    had = consumers.select("queue").distinct()
    return queues.where("auto_delete").select(F.col("name").alias("queue")).join(had, "queue", "left_semi").join(left, "queue", "left_anti")


def gets_settled(gets: DataFrame, settles: DataFrame, closed: DataFrame) -> DataFrame:
    """Deliveries of basic.get by their end: acked, requeued or discarded by the first settle,
    requeued by the teardown of their channel, else unacked. gets: channel, wire_tag, seq;
    settles: one delivery each; closed: channel."""
    first = settles.groupBy("channel", "wire_tag").agg(F.min(F.struct("seq", "action", "requeue")).alias("s"))
    x = gets.join(first, ["channel", "wire_tag"], "left").join(closed.select("channel", F.lit(True).alias("_closed")), "channel", "left")
    end = F.when(F.col("s.action") == "ack", "acked").when(F.col("s.requeue"), "requeued").when(F.col("s").isNotNull(), "discarded").when(F.col("_closed"), "requeued at teardown").otherwise("unacked")
    return x.withColumn("state", end).drop("s", "_closed")


def consumer_offsets(settled: DataFrame) -> DataFrame:
    """The highest acknowledged tag per queue and consumer; it never falls."""
    return settled.where("action = 'ack'").groupBy("queue", "consumer").agg(F.max("tag").alias("offset"))


# ------------------------------------------------------------ the keyed fold


def queue_fold(log: DataFrame, max_length: int | None = None, overflow: str = "drop-head", prefetch: int = 0, max_bytes: int | None = None) -> DataFrame:
    """Interleaved publishes, claims and settles of each queue, in order of seq: Q3, Q5-Q9, Q15.

    log: queue, seq, action (publish, claim, ack, requeue, discard), tag (of a publish, or of
    the delivery settled), consumer, and body_len (of a publish) where max_bytes is given. Claims
    take requeued messages first, then the lowest tag, and wait for nothing: without a ready
    message or beyond the prefetch they do nothing. Limits are on ready messages: drop-head evicts
    the head while there are more than max_length, or more bytes than max_bytes and more than one
    message; reject-publish refuses while max_length or max_bytes are reached. Returns queue, seq,
    outcome, tag: accepted, refused, evicted, delivered, empty, blocked, acked, requeued, discarded,
    late. State is what the queue holds at a time; a queue's log streams through in batches, in
    one task, as each step depends on all before it.
    """
    import pandas as pd

    def run(key, batches):
        from collections import deque

        ready: deque = deque()
        again: deque = deque()
        size: dict[int, int] = {}  # of messages that are ready or held
        held: dict[int, str] = {}
        count: dict[str, int] = {}
        total = 0

        def full(n: int, least: int) -> bool:
            """More than n messages, or bytes beyond the limit."""
            return max_length is not None and n > max_length or max_bytes is not None and total > max_bytes and n > least

        def take() -> int:
            nonlocal total
            t = (again or ready).popleft()
            total -= size[t]
            return t

        for pdf in batches:
            rows = []
            for seq, action, tag, consumer, body in zip(pdf.seq, pdf.action, pdf.tag, pdf.consumer, pdf.body_len):
                n = len(ready) + len(again)
                if action == "publish":
                    if overflow == "reject-publish" and (max_length is not None and n >= max_length or max_bytes is not None and total >= max_bytes):
                        rows.append((seq, "refused", tag))
                        continue
                    ready.append(tag)
                    size[tag] = int(body)
                    total += size[tag]
                    rows.append((seq, "accepted", tag))
                    while overflow == "drop-head" and full(len(ready) + len(again), 1):
                        t = take()
                        del size[t]
                        rows.append((seq, "evicted", t))
                elif action == "claim":
                    if prefetch and count.get(consumer, 0) >= prefetch:
                        rows.append((seq, "blocked", None))
                    elif n:
                        t = take()
                        held[t] = consumer
                        count[consumer] = count.get(consumer, 0) + 1
                        rows.append((seq, "delivered", t))
                    else:
                        rows.append((seq, "empty", None))
                elif tag not in held:
                    rows.append((seq, "late", tag))
                else:
                    count[held.pop(tag)] -= 1
                    if action == "requeue":
                        again.append(tag)
                        total += size[tag]
                    else:
                        del size[tag]
                    rows.append((seq, {"ack": "acked", "requeue": "requeued"}.get(action, "discarded"), tag))
            out = pd.DataFrame(rows, columns=["seq", "outcome", "tag"])
            out.insert(0, "queue", key[0])
            out["tag"] = out["tag"].astype("Int64")
            yield out

    from collections.abc import Iterator

    def typed(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(key, batches)

    typed.__annotations__ = {"key": tuple, "batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    body = F.coalesce("body_len", F.lit(0)) if "body_len" in log.columns else F.lit(0)
    log = log.select("queue", "seq", "action", "tag", "consumer", body.cast("long").alias("body_len"))
    return log.repartition("queue").sortWithinPartitions("queue", "seq").groupBy("queue").applyInPandas(typed, "queue string, seq long, outcome string, tag long")
