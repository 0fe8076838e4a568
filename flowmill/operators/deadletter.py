"""Dead-lettering (DL1-DL7).

Deaths are rows (delivery_tag, queue, reason, ...); a hop joins them with their queue's policy,
rewrites exchange and key, routes again, and drops targets a message has already died in.
Expiry and length limits end in a bounded number of hops, because a cycle is cut; rejection
is not cut by design, so chains of it need a hop limit from the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.operators.ordered import ranked
from flowmill.operators.routing import route

REASONS = ("rejected", "expired", "maxlen")


def deaths(rejected: DataFrame | None = None, expired: DataFrame | None = None, evicted: DataFrame | None = None) -> DataFrame:
    """DL7: one relation of all deaths. A message refused by reject-publish has none."""
    parts = [f.withColumn("reason", F.lit(r)) for f, r in ((rejected, "rejected"), (expired, "expired"), (evicted, "maxlen")) if f is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def republished(dead: DataFrame, policies: DataFrame) -> DataFrame:
    """DL1, DL6: deaths of queues with a DLX as new publishes: exchange, routing_key, and for
    expired ones no expiration, which is saved."""
    p = policies.where("dlx is not null").select("queue", "dlx", "dl_rk")
    gone = F.col("reason") == "expired"
    return (
        dead.join(p, "queue")
        .withColumnRenamed("queue", "died_in")
        .withColumn("exchange", F.col("dlx"))
        .withColumn("original_routing_key", F.col("routing_key"))
        .withColumn("routing_key", F.coalesce("dl_rk", "routing_key"))
        .withColumn("original_expiration", F.when(gone, F.col("expiration")))
        .withColumn("expiration", F.when(~gone, F.col("expiration")))
        .drop("dlx", "dl_rk")
    )


def death_history(dead: DataFrame) -> DataFrame:
    """DL2, DL3: per message x_death, newest first: count, last exchange, keys and time by
    (queue, reason); and the first death's queue, reason and exchange, which never change.

    dead: delivery_tag, queue, reason, exchange, routing_key, expiration, at (orders deaths).
    """
    last = F.max_by(F.struct("exchange", "routing_key", "expiration"), "at")
    pair = dead.groupBy("delivery_tag", "queue", "reason").agg(F.count("*").alias("count"), F.max("at").alias("at"), F.min("at").alias("first_at"), last.alias("l"), F.min_by("exchange", "at").alias("e0"))
    entry = F.struct("at", "count", "queue", "reason", F.col("l.exchange").alias("exchange"), F.array("l.routing_key").alias("routing_keys"), F.when(F.col("reason") == "expired", F.col("l.expiration")).alias("original_expiration"))
    first = F.min_by(F.struct("queue", "reason", F.col("e0").alias("exchange")), "first_at")
    return pair.groupBy("delivery_tag").agg(F.sort_array(F.collect_list(entry), asc=False).alias("x_death"), first.alias("f")).select("delivery_tag", "x_death", F.col("f.queue").alias("first_death_queue"), F.col("f.reason").alias("first_death_reason"), F.col("f.exchange").alias("first_death_exchange"))


def without_cycles(targets: DataFrame) -> DataFrame:
    """DL4: an expired or evicted message does not return to a queue it died in before, the
    source included; a rejected one may. targets: queue, reason, prior_queues."""
    return targets.where((F.col("reason") == "rejected") | ~F.array_contains("prior_queues", F.col("queue")))


def hop(dead: DataFrame, policies: DataFrame, queues: DataFrame, bindings: DataFrame, exchanges: DataFrame) -> DataFrame:
    """DL1-DL6 once: where each death's message goes. Adds to prior_queues (DL4).

    No DLX or no route drops the message. A message that died twice at once takes part twice.
    """
    d = dead.withColumn("prior_queues", F.array_distinct(F.concat("prior_queues", F.array("queue"))))
    sent = republished(d, policies)
    # a message may die in several queues: the death, and not the message, identifies the copy
    tagged = sent.withColumn("delivery_tag", F.struct("delivery_tag", "died_in", "reason"))
    out = route(tagged, queues, bindings, exchanges).withColumn("delivery_tag", F.col("delivery_tag.delivery_tag"))
    return without_cycles(out)


def accepted_targets(targets: DataFrame, room: DataFrame) -> DataFrame:
    """DL5: of routed dead letters, those a full reject-publish queue takes: the first `room`
    (its limit minus what is ready) by tag; queues without a row in `room` take all."""
    return ranked(targets, ["queue"], "delivery_tag", "_n").join(room, "queue", "left").where(F.col("room").isNull() | (F.col("_n") <= F.col("room"))).drop("_n", "room")
