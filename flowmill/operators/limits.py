"""Queue limits and ready order (Q1-Q19).

The closed forms hold while nothing is consumed between publishes: eviction removes from the
head, so which rows survive depends only on the rows behind them. Running counts and sums go
along the tags of a queue over narrow rows (queue, tag, length), cut into ranges of tags so
that no queue is sorted in one task (see ordered); bodies stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.operators.ordered import WIDTH, bucket, ranked, running


def _by_tag(log: DataFrame, down: bool = False, upto: str = "row", **values: tuple) -> DataFrame:
    return running(log, ["queue"], bucket("tag"), [F.col("tag")], down, upto, **values)


def kept_by_drop_head(log: DataFrame, max_length: Column | None = None, max_bytes: Column | None = None) -> DataFrame:
    """Q5, Q6: what drop-head leaves of log (queue, tag, body_len). Null limits do not bind.

    By bytes the newest row always stays, even if it is larger than the limit alone.
    """
    ok = F.lit(True)
    if max_length is not None:
        ok = ok & F.coalesce(F.col("_n") <= max_length, F.lit(True))
    if max_bytes is not None:
        ok = ok & F.coalesce((F.col("_size") <= max_bytes) | (F.col("_n") == 1), F.lit(True))
    return _by_tag(log, down=True, _n=("count",), _size=("sum", "body_len")).where(ok).drop("_n", "_size")


def evicted_by(log: DataFrame, max_length: int) -> DataFrame:
    """Q7: for each row evicted by count, the tag of the publish that evicted it: the one
    max_length ranks later, met by an equi-join on rank."""
    x = ranked(log, ["queue"], "tag", "_n")
    later = x.select("queue", (F.col("_n") - max_length).alias("_n"), F.col("tag").alias("evicted_by"))
    return x.join(later, ["queue", "_n"]).drop("_n")


def evicted_by_bytes(log: DataFrame, max_bytes: int) -> DataFrame:
    """Q7 by bytes: the first publish at which the bytes from this row on pass the limit.

    Running sums increase along a queue, so the answer is the first tag whose sum exceeds
    this row's own prefix plus the limit. Rows and thresholds are merged into one sequence
    of sums, where the rows above a threshold stand behind it: going down, a running minimum of
    their tags answers it, without a join of ranges.
    """
    x = _by_tag(log, total=("sum", "body_len"))
    # a queue of one ready message keeps it: an oversize row goes with the publish after it
    x = _by_tag(x, down=True, upto="before", next=("min", "tag"))
    rows = x.select("queue", F.col("total").alias("at"), F.lit(1).alias("kind"), "tag", F.lit(None).cast("long").alias("next"))
    asks = x.select("queue", (F.col("total") - F.col("body_len") + max_bytes).alias("at"), F.lit(0).alias("kind"), "tag", "next")
    # at equal values the threshold comes first: a sum that only reaches the limit does not pass it
    hit = running(rows.union(asks), ["queue"], bucket("at", WIDTH << 10), [F.col("at"), -F.col("kind"), -F.col("tag")], down=True, passed=("min", F.when(F.col("kind") == 1, F.col("tag"))))
    point = F.when(F.col("passed") == F.col("tag"), F.col("next")).otherwise(F.col("passed"))
    return hit.where("kind = 0 and passed is not null").select("queue", "tag", point.alias("evicted_by")).where("evicted_by is not null")


def reject_publish_count(log: DataFrame, max_length: int) -> DataFrame:
    """Q8: a publish is refused when N are ready before it."""
    return ranked(log, ["queue"], "tag", "_n").withColumn("accepted", F.col("_n") <= max_length).drop("_n")


def reject_publish_bytes(log: DataFrame, max_bytes: int) -> DataFrame:
    """Q9: refused when L bytes or more are ready before it; the last accepted may overshoot."""
    return _by_tag(log, upto="before", _size=("sum", "body_len")).withColumn("accepted", F.col("_size") < max_bytes).drop("_size")


def publish_outcome(copies: DataFrame) -> DataFrame:
    """Q10: a publish fails as a whole if any target refuses it; the others still get it."""
    return copies.groupBy("tag").agg(F.count("*").alias("targets"), F.count_if("accepted").alias("delivered"), F.max(~F.col("accepted")).alias("refused"))


def ready_bytes(events: DataFrame, limited: DataFrame) -> DataFrame:
    """Q12: bytes ready per queue, counted only where max-length-bytes is set.

    events: queue, action (enqueue, requeue, claim, evict), body_len.
    """
    sign = F.when(F.col("action").isin("enqueue", "requeue"), F.col("body_len")).otherwise(-F.col("body_len"))
    return events.join(limited.select("queue"), "queue", "left_semi").groupBy("queue").agg(F.sum(sign).cast("long").alias("ready_bytes"))


def depth(events: DataFrame, high_water: int) -> DataFrame:
    """Q13: waiting plus inflight after each step, and whether it reached the mark (0: off).

    events: queue, seq, waiting and inflight as changes of those counters.
    """
    x = running(events, ["queue"], bucket("seq"), [F.col("seq")], waiting=("sum", "waiting"), inflight=("sum", "inflight"))
    d = F.greatest("waiting", F.lit(0)) + F.greatest("inflight", F.lit(0))
    return x.select("queue", "seq", d.cast("long").alias("depth")).withColumn("at_mark", (F.col("depth") >= high_water) & F.lit(high_water > 0))


def claim_order(ready: DataFrame) -> DataFrame:
    """Q2: requeued messages first, in the order they came back, then the lowest tag."""
    first, at = F.col("requeue_seq").isNull(), F.coalesce("requeue_seq", "tag")
    return running(ready, ["queue"], F.struct(first.alias("new"), bucket(at).alias("part")), [first, at, F.col("tag")], claim=("count",))


def pop(ready: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """S3, Q4: the message each queue gives next, and how many stay ready behind it.

    Expired messages at the head are dropped on the way, as they are met.
    """
    live = ready if now_ms is None else ready.where(F.col("deadline_ms").isNull() | (F.col("deadline_ms") > now_ms))
    first = F.struct(F.col("requeue_seq").isNull().alias("a"), F.col("requeue_seq").alias("b"), F.col("tag").alias("c"))
    return live.groupBy("queue").agg(F.min_by("tag", first).alias("tag"), F.min_by(F.col("requeue_seq").isNotNull(), first).alias("redelivered"), F.greatest(F.count("*") - 1, F.lit(0)).alias("remaining"))


def visible_head(completions: DataFrame) -> DataFrame:
    """Per queue the head up to which every tag is complete, and the messages ready.

    Tags are sparse: the head is the lowest incomplete tag, or one past the last. Failed tags
    complete but are not ready.
    """
    h = completions.groupBy("queue").agg(F.coalesce(F.min(F.when(~F.col("done"), F.col("tag"))), F.max("tag") + 1).alias("head"))
    ready = F.count_if(F.col("done") & ~F.col("failed") & (F.col("tag") < F.col("head"))).alias("ready")
    return completions.join(h, "queue").groupBy("queue", "head").agg(ready)


def prefetch_violations(log: DataFrame, prefetch: int) -> DataFrame:
    """Q15: deliveries at which a consumer had more than `prefetch` unacked; 0 is 2000.

    log: consumer, seq, change (+1 delivery, -1 settle).
    """
    return running(log, ["consumer"], bucket("seq"), [F.col("seq")], unacked=("sum", "change")).where((F.col("change") > 0) & (F.col("unacked") > (prefetch or 2000)))


def prefetch_in_force(deliveries: DataFrame, settings: DataFrame) -> DataFrame:
    """Q16: the prefetch each delivery ran under: the channel's last setting before it.

    An as-of join as one ordered pass over both logs. prefetch_size other than 0 is refused
    with 540 and changes nothing.
    """
    s = settings.where("prefetch_size = 0").select("channel", "seq", F.lit(0).alias("kind"), F.col("prefetch").alias("_p"), F.lit(None).cast("long").alias("tag"))
    d = deliveries.select("channel", "seq", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("_p"), "tag")
    x = running(s.union(d), ["channel"], bucket("seq"), [F.col("seq"), F.col("kind")], prefetch=("last", "_p"))
    return x.where("kind = 1").select("channel", "tag", F.coalesce("prefetch", F.lit(0)).alias("prefetch"))


def assigned(ready: DataFrame, consumers: int) -> DataFrame:
    """Q17: a deterministic stand-in for consumers racing for the tail: round robin by tag."""
    return ranked(ready, ["queue"], "tag", "_n").withColumn("consumer", ((F.col("_n") - 1) % consumers).cast("int")).drop("_n")
