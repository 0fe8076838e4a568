"""Topology: declaring, binding, deleting and listing exchanges and queues.

Declarations form a log ordered by `seq`; the state is what its rows leave behind. First
writer wins is a minimum by sequence, deletion an anti-join, and neither needs a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.operators.ordered import bucket, running
from flowmill.operators.routing import closing_edges
from flowmill.sources.tables import dimension

#: The exchanges that are always there.
PREDECLARED = (("", "direct"), ("amq.direct", "direct"), ("amq.fanout", "fanout"), ("amq.topic", "topic"), ("amq.headers", "headers"))


def predeclared(spark: SparkSession) -> DataFrame:
    return dimension(spark, ("name", "kind"), PREDECLARED)


def first_declared(log: DataFrame, fields: list[str]) -> DataFrame:
    """Per name the fields of the first declaration, and how many later ones clash."""
    first = log.groupBy("name").agg(F.min_by(F.struct(*fields), "seq").alias("f"), F.min("seq").alias("declared_at"))
    clash = log.join(first.select("name", "f"), "name").where(~F.struct(*fields).eqNullSafe(F.col("f"))).groupBy("name").agg(F.count("*").alias("clashes"))
    return first.select("name", "declared_at", "f.*").join(clash, "name", "left").na.fill(0, ["clashes"])


def redeclared(log: DataFrame, fields: list[str]) -> DataFrame:
    """Outcome of each declaration: created, same or mismatch (406 for queues and exchanges)."""
    first = log.groupBy("name").agg(F.min_by(F.struct(*fields), "seq").alias("f"), F.min("seq").alias("s0"))
    out = F.when(F.col("seq") == F.col("s0"), "created").when(F.struct(*fields).eqNullSafe(F.col("f")), "same").otherwise("mismatch")
    return log.join(first, "name").select("seq", "name", out.alias("outcome"))


def deletable(names: DataFrame, used: DataFrame) -> DataFrame:
    """if-unused: of the names to delete, those that no row of `used` (name) holds on to."""
    return names.join(used.select("name").distinct(), "name", "left_anti")


def without(frame: DataFrame, column: str, deleted: DataFrame) -> DataFrame:
    """Cascade: rows that do not refer to a deleted name."""
    return frame.join(deleted.select(F.col("name").alias(column)), column, "left_anti")


def bind_outcome(binds: DataFrame, exchanges: DataFrame, queues: DataFrame) -> DataFrame:
    """Both ends of a queue binding must exist."""
    e = exchanges.select(F.col("name").alias("exchange"), F.lit(True).alias("_e"))
    q = queues.select(F.col("name").alias("queue"), F.lit(True).alias("_q"))
    return binds.join(e, "exchange", "left").join(q, "queue", "left").withColumn("outcome", F.when(F.col("_e").isNull(), "no exchange").when(F.col("_q").isNull(), "no queue").otherwise("bound")).drop("_e", "_q")


def exchange_bind_outcome(binds: DataFrame, exchanges: DataFrame, edges: DataFrame | None = None, hops: int = 0) -> DataFrame:
    """Both ends exist, neither is the default exchange, the destination is not internal, and
    (given the edges that are there and the longest path of them) no cycle would close, R8."""
    s = exchanges.select(F.col("name").alias("source"), F.lit(True).alias("_s"))
    d = exchanges.select(F.col("name").alias("destination"), "internal")
    x = binds.join(s, "source", "left").join(d, "destination", "left")
    if edges is not None:
        x = x.join(closing_edges(edges, binds.select("source", "destination").distinct(), hops), ["source", "destination"], "left")
    why = (
        F.when((F.col("source") == "") | (F.col("destination") == ""), "default exchange")
        .when(F.col("_s").isNull(), "no source")
        .when(F.col("internal").isNull(), "no destination")
        .when(F.col("internal"), "internal destination")
        .when(F.col("refused") if edges is not None else F.lit(False), "cycle")
        .otherwise("bound")
    )
    return x.withColumn("outcome", why).drop("_s", "internal", "refused")


def exchange_unbound(edges: DataFrame, unbinds: DataFrame) -> DataFrame:
    """Edges (source, destination, routing_key) that are left; an unbind of one that is not there
    changes nothing."""
    return edges.join(unbinds.select("source", "destination", "routing_key"), ["source", "destination", "routing_key"], "left_anti")


def listed_queues(queues: DataFrame, ready: DataFrame, unacked: DataFrame, consumers: DataFrame, bindings: DataFrame) -> DataFrame:
    """Every queue with what it holds: ready and unacked messages, consumers, bindings."""
    out = queues.withColumnRenamed("name", "queue")
    for name, rows in (("ready", ready), ("unacked", unacked), ("consumers", consumers), ("bindings", bindings)):
        out = out.join(rows.groupBy("queue").agg(F.count("*").alias(name)), "queue", "left")
    return out.na.fill(0, ["ready", "unacked", "consumers", "bindings"])


def listed_exchanges(exchanges: DataFrame, bindings: DataFrame, edges: DataFrame) -> DataFrame:
    """Every exchange with its queue bindings and the exchanges bound to it."""
    q = bindings.groupBy(F.col("exchange").alias("name")).agg(F.count("*").alias("queues"))
    x = edges.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("exchanges"))
    return exchanges.join(q, "name", "left").join(x, "name", "left").na.fill(0, ["queues", "exchanges"])


def listed_consumers(consumers: DataFrame, open_: DataFrame) -> DataFrame:
    """Every consumer with its unacked deliveries."""
    return consumers.join(open_.groupBy("queue", "consumer").agg(F.count("*").alias("unacked")), ["queue", "consumer"], "left").na.fill(0, ["unacked"])


def auto_deleted(unbound: DataFrame, remaining: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Auto-delete exchanges whose last binding an unbind took away."""
    return unbound.select(F.col("exchange").alias("name")).distinct().join(exchanges.where("auto_delete"), "name").join(remaining.select(F.col("exchange").alias("name")).distinct(), "name", "left_anti").select("name")


def purged(messages: DataFrame, purges: DataFrame) -> DataFrame:
    """Per purge, how many ready messages of its queue it removed: those since the purge
    before it. Going back in time, the last purge met is the one that takes a message."""
    both = messages.select("queue", "seq", F.lit(None).cast("long").alias("purge")).union(purges.select("queue", "seq", F.col("seq")))
    taken = running(both, ["queue"], bucket("seq"), [F.col("seq"), F.col("purge").isNull()], down=True, taken_by=("last", "purge")).where("taken_by is not null")
    return taken.groupBy("queue", F.col("taken_by").alias("seq")).agg(F.count_if(F.col("purge").isNull()).alias("removed"))


def server_name(declaration: Column, salt: str = "") -> Column:
    """A name for a queue that was declared without one, made from what identifies its
    declaration: a task that runs again gives the same name, another declaration another one."""
    return F.concat(F.lit("amq.gen."), F.substring(F.sha2(F.concat_ws(":", F.lit(salt), declaration.cast("string")), 256), 1, 32))


def resolved_names(log: DataFrame) -> DataFrame:
    """An empty queue name stands for the channel's last declared queue; none: an error."""
    x = running(log, ["channel"], bucket("seq"), [F.col("seq")], upto="before", _last=("last", F.when(F.col("method") == "declare", F.col("queue"))))
    x = x.withColumn("resolved", F.when(F.col("queue") != "", F.col("queue")).otherwise(F.col("_last"))).drop("_last")
    return x.withColumn("reply_code", F.when(F.col("resolved").isNull(), 404))


def declare_ok(queues: DataFrame, ready: DataFrame, consumers: DataFrame) -> DataFrame:
    """Ready messages (unacked ones do not count) and consumers of every queue."""
    r = ready.groupBy("queue").agg(F.count("*").alias("message_count"))
    c = consumers.groupBy("queue").agg(F.count("*").alias("consumer_count"))
    return queues.select(F.col("name").alias("queue")).join(r, "queue", "left").join(c, "queue", "left").na.fill(0, ["message_count", "consumer_count"])


def exclusive_owner(claims: DataFrame) -> DataFrame:
    """The first connection owns the queue; others are refused with 405."""
    owner = claims.groupBy("queue").agg(F.min_by("connection", "seq").alias("owner"))
    return claims.join(owner, "queue").select("seq", "queue", "connection", "owner", F.when(F.col("connection") != F.col("owner"), 405).alias("reply_code"))


def durable_snapshot(exchanges: DataFrame, queues: DataFrame, bindings: DataFrame) -> dict[str, DataFrame]:
    """Durable entities, and bindings of durable exchanges."""
    e = exchanges.where("durable")
    return {"exchanges": e, "queues": queues.where("durable"), "bindings": bindings.join(e.select(F.col("name").alias("exchange")), "exchange", "left_semi")}


def exclusive_consumers(log: DataFrame) -> DataFrame:
    """Q18: a consumer is refused beside an exclusive one, and an exclusive one beside any.

    Consumers register in order and stay. After the first accepted one a queue accepts
    either nothing (that one was exclusive) or only further shared ones.
    """
    first = log.groupBy("queue").agg(F.min_by(F.struct("seq", "exclusive"), "seq").alias("f"))
    ok = (F.col("seq") == F.col("f.seq")) | (~F.col("f.exclusive") & ~F.col("exclusive"))
    return log.join(first, "queue").select("queue", "consumer", "seq", ok.alias("accepted"))
