"""Publisher confirms and the alarm latch (W1-W8): watermarks over sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.operators.ordered import bucket, ranked, running


def watermark(done: DataFrame) -> DataFrame:
    """Per channel the last tag of the gap-free run 1, 2, ... of completed tags.

    In a dense sequence a tag belongs to the prefix if it equals its rank.
    """
    return ranked(done.select("channel", "tag").distinct(), ["channel"], "tag", "rank").groupBy("channel").agg(F.coalesce(F.max(F.when(F.col("tag") == F.col("rank"), F.col("tag"))), F.lit(0)).alias("watermark"))


def coalesced_acks(completions: DataFrame) -> DataFrame:
    """One ack per flush in which the watermark moved; multiple if it covers more than one.

    completions: channel, tag, flush. A tag is answered in the flush in which the last of
    the tags up to it completes: a running maximum over tags.
    """
    x = running(completions, ["channel"], bucket("tag"), [F.col("tag")], rank=("count",), at=("max", "flush")).where("tag = rank")
    f = running(x.groupBy("channel", "at").agg(F.max("tag").alias("ack")), ["channel"], bucket("at"), [F.col("at")], upto="before", before=("last", "ack"))
    return f.select("channel", F.col("at").alias("flush"), "ack", (F.col("ack") > F.coalesce("before", F.lit(0)) + 1).alias("multiple"))


def settled_answers(outcomes: DataFrame) -> DataFrame:
    """Answers for a finished run of tags: acks up to the tag before each nack, the nack, and
    so on; every tag in exactly one answer. outcomes: channel, tag (dense), ok."""
    x = running(outcomes, ["channel"], bucket("tag"), [F.col("tag")], island=("sum", F.when(~F.col("ok"), 1).otherwise(0)))
    acks = x.where("ok").groupBy("channel", "island").agg(F.max("tag").alias("tag"), F.count("*").alias("covers"))
    nacks = x.where("not ok").select("channel", "tag", F.lit("nack").alias("answer"), F.lit(False).alias("multiple"))
    return acks.select("channel", "tag", F.lit("ack").alias("answer"), (F.col("covers") > 1).alias("multiple")).union(nacks)


def fan_in(copies: DataFrame) -> DataFrame:
    """A publish is confirmed when its last copy is durable; any failure nacks it, the first
    by time (then by text) names the reason. copies: tag, durable, at, error."""
    return copies.groupBy("tag").agg(F.bool_and("durable").alias("confirmed"), F.when(F.bool_and("durable"), F.max("at")).alias("confirmed_at"), F.min(F.when(~F.col("durable"), F.struct("at", "error")))["error"].alias("error"))


def latch_event(value: Column, sets: Column, clears: Column) -> Column:
    """What a sample does to its bit: raises it, lowers it, or (null) leaves it as it is."""
    return F.when(value.isNotNull() & sets, 1).when(value.isNotNull() & clears, 0)


def alarms(samples: DataFrame, high: float, floor: float, hysteresis: float) -> DataFrame:
    """Alarm bits (memory 1, disk 2) after each sample, and the edges to be told.

    samples: node, at, rss, free; a missing reading changes nothing. hysteresis must be
    above 0, else a sample on the threshold would toggle its bit.
    """
    if not hysteresis > 0:
        raise ValueError("the latch has a closed form only with a hysteresis above 0")
    memory = latch_event(F.col("rss"), F.col("rss") >= high, F.col("rss") <= high * (1 - hysteresis))
    disk = latch_event(F.col("free"), F.col("free") < floor, F.col("free") >= floor * (1 + hysteresis))
    x = running(samples, ["node"], bucket("at"), [F.col("at")], _m=("last", memory), _d=("last", disk))
    x = x.withColumn("bits", (F.coalesce("_m", F.lit(0)) + 2 * F.coalesce("_d", F.lit(0))).cast("int")).drop("_m", "_d")
    x = running(x, ["node"], bucket("at"), [F.col("at")], upto="before", _was=("last", "bits"))
    before = F.coalesce("_was", F.lit(0))
    return x.withColumn("edge", F.when((before == 0) & (F.col("bits") != 0), "blocked").when((before != 0) & (F.col("bits") == 0), "unblocked")).drop("_was")


def flow_gated(deliveries: DataFrame, flow: DataFrame) -> DataFrame:
    """Whether each delivery's channel was active: its last flow method before; active at first."""
    f = flow.select("channel", "seq", F.lit(0).alias("kind"), "active", F.lit(None).cast("long").alias("tag"))
    d = deliveries.select("channel", "seq", F.lit(1), F.lit(None).cast("boolean"), "tag")
    x = running(f.union(d), ["channel"], bucket("seq"), [F.col("seq"), F.col("kind")], active=("last", "active"))
    return x.where("kind = 1").select("channel", "tag", F.coalesce("active", F.lit(True)).alias("active"))


def stale(activity: DataFrame, now_ms: Column, heartbeat_ms: int) -> DataFrame:
    """Connections silent for two heartbeats or longer; 0 turns the check off."""
    last = activity.groupBy("connection").agg(F.max("at_ms").alias("last_ms"))
    return last.withColumn("stale", F.lit(heartbeat_ms > 0) & (now_ms - F.col("last_ms") >= 2 * heartbeat_ms))
