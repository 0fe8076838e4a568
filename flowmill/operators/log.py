"""Transactions, the durable log, recovery and compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.operators.ordered import bucket, ranked, running


def committed_ops(ops: DataFrame) -> DataFrame:
    """Buffered operations whose transaction commits; rolled back or open ones vanish.

    ops: channel, seq, op (publish, ack, nack, reject, commit, rollback). A channel's boundaries
    number its transactions; the boundary itself belongs to the one that it ends.
    """
    end = F.col("op").isin("commit", "rollback")
    x = running(ops, ["channel"], bucket("seq"), [F.col("seq")], upto="before", tx=("sum", end.cast("int")))
    done = x.where("op = 'commit'").select("channel", "tx")
    return x.where(~end).join(done, ["channel", "tx"], "left_semi")


def tx_stats(ops: DataFrame) -> DataFrame:
    """Commits, rollbacks, and operations by kind."""
    return ops.agg(*[F.count_if(F.col("op") == o).alias(f"{o}s") for o in ("publish", "ack", "nack", "reject", "commit", "rollback")])


def tx_select_refused(channels: DataFrame) -> DataFrame:
    """Tx.select on a channel in confirm mode, and the other way round."""
    return channels.withColumn("refused", F.col("confirm") & (F.col("method") == "tx.select") | F.col("tx") & (F.col("method") == "confirm.select"))


def intact(records: DataFrame, payload: Column) -> DataFrame:
    """L2: records whose checksum fits; 0 means unchecked."""
    return records.where((F.col("crc") == 0) | (F.col("crc") == F.crc32(payload)))


def visible_records(records: DataFrame) -> DataFrame:
    """L1: messages outside transactions, and those of transactions that committed.

    records: file, pos, type (message, begin, commit), epoch. The last boundary before a record
    says whether it is inside; its epoch must be committed by the next boundary of the file.
    """
    x = running(records, ["file"], bucket("pos"), [F.col("pos")], _b_=("last", F.when(F.col("type").isin("begin", "commit"), F.struct("type", "epoch")))).withColumnRenamed("_b_", "_b")
    done = records.where("type = 'commit'").select("file", "epoch").distinct()
    loose = x.where((F.col("type") == "message") & (F.col("_b").isNull() | (F.col("_b.type") == "commit")))
    held = x.where((F.col("type") == "message") & (F.col("_b.type") == "begin") & (F.col("epoch") == F.col("_b.epoch")))
    return loose.unionByName(held.join(done, ["file", "epoch"], "left_semi").select(loose.columns)).drop("_b")


def with_body(records: DataFrame, bodies: DataFrame) -> DataFrame:
    """L3: body references resolved within their file; a missing body drops the record."""
    own = records.where("body_ref is null").withColumn("shared", F.lit(False))
    shared = records.where("body_ref is not null").join(bodies.select("file", F.col("pos").alias("body_ref"), F.col("body_len").alias("_len")), ["file", "body_ref"]).withColumn("body_len", F.col("_len")).drop("_len").withColumn("shared", F.lit(True))
    return own.unionByName(shared.select(own.columns))


def shared_bodies(copies: DataFrame, at_least: int = 4096) -> DataFrame:
    """Bodies that are stored once: durable, large, and bound for two queues or more.

    Returns per message the copies, the bytes stored, and the bytes one copy each would take.
    """
    x = copies.groupBy("delivery_tag", "body_len", "delivery_mode").agg(F.count("*").alias("copies"))
    once = (F.col("delivery_mode") == 2) & (F.col("copies") >= 2) & (F.col("body_len") >= at_least)
    return x.select("delivery_tag", "copies", once.alias("shared"), F.when(once, F.col("body_len")).otherwise(F.col("body_len") * F.col("copies")).alias("stored_bytes"), (F.col("body_len") * F.col("copies")).alias("copied_bytes"))


def recoverable(logged: DataFrame, segments: DataFrame, acked: DataFrame) -> DataFrame:
    """Logged minus acked, and segment rows that the log does not hold; the log wins.

    Segment recovery knows no acks. Both sides: queue, tag, body_len.
    """
    rows = logged.withColumn("from", F.lit("log")).join(acked.select("queue", "tag"), ["queue", "tag"], "left_anti")
    rest = segments.withColumn("from", F.lit("segment")).join(rows.select("queue", "tag"), ["queue", "tag"], "left_anti").dropDuplicates(["queue", "tag"])
    return rows.dropDuplicates(["queue", "tag"]).unionByName(rest)


def recovery_summary(recovered: DataFrame) -> DataFrame:
    """Per queue the lowest and highest tag and the number of persistent messages."""
    return recovered.groupBy("queue").agg(F.min("tag").alias("min_tag"), F.max("tag").alias("max_tag"), F.count("*").alias("messages"))


def pending_after_restart(pending: DataFrame, now_ms: Column, max_age_ms: int = 3_600_000) -> DataFrame:
    """Pending acks older than an hour are dropped, the rest indexed again."""
    return pending.withColumn("kept", now_ms - F.col("at_ms") <= max_age_ms)


def reclaimable(logged: DataFrame, acked: DataFrame, ages: DataFrame | None = None, retention_ms: int | None = None) -> DataFrame:
    """Files whose every record is acked, or that outlived the retention after a checkpoint."""
    a = acked.select("queue", "tag").distinct().withColumn("_acked", F.lit(True))
    f = logged.join(a, ["queue", "tag"], "left").groupBy("file").agg(F.count("*").alias("records"), F.count("_acked").alias("acked"))
    out = f.withColumn("reclaimable", F.col("records") == F.col("acked"))
    if ages is not None and retention_ms is not None:
        out = out.join(ages, "file", "left").withColumn("reclaimable", F.col("reclaimable") | F.coalesce(F.col("checkpointed") & (F.col("age_ms") > retention_ms), F.lit(False)))
    return out


def checkpointed(logged: DataFrame, acked: DataFrame, files: DataFrame) -> DataFrame:
    """Unacked messages of old files, as they move to segments, with the segment's queue."""
    return logged.join(files.where("old").select("file"), "file", "left_semi").join(acked.select("queue", "tag"), ["queue", "tag"], "left_anti")


def compaction_candidates(segments: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Sealed segments with strictly more than `ratio` of their records deleted."""
    s = segments.where("sealed").groupBy("segment").agg(F.count("*").alias("records"), F.count_if("deleted").alias("deleted"))
    return s.where(F.col("deleted") > F.col("records") * ratio)


def compacted(segments: DataFrame, candidates: DataFrame) -> DataFrame:
    """Segments after compaction: candidates keep their live records, others everything."""
    c = candidates.select("segment", F.lit(True).alias("_c"))
    return segments.join(c, "segment", "left").where(F.col("_c").isNull() | ~F.col("deleted")).drop("_c")


def record_counts(records: DataFrame) -> DataFrame:
    """Records by type."""
    return records.groupBy("type").agg(F.count("*").alias("records"))


def commit_batches(records: DataFrame, size: int = 1000) -> DataFrame:
    """The group commit a record falls into, at most `size` each, per writer in order."""
    return ranked(records, ["writer"], "seq", "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def between(messages: DataFrame, first: int, last: int, delete: bool = False) -> DataFrame:
    """Tags between both ends, inclusive, or all others; nothing if first is above last."""
    hit = F.col("delivery_tag").between(first, last)
    return messages.where(~hit if delete else hit)


def placed(writes: DataFrame, mark: int) -> DataFrame:
    """Where each message is stored. writes: queue, tag, durable, depth (ready before it).

    A durable message goes to the log first, and to the ring as well while the ring is below its
    mark; a transient one to the ring, and only beyond the mark to the log.
    """
    full = F.col("depth") >= mark
    where = F.when(F.col("durable") & ~full, "log and ring").when(F.col("durable") | full, "log").otherwise("ring")
    return writes.withColumn("stored", where)


def async_visible(writes: DataFrame, flushes: DataFrame) -> DataFrame:
    """A write returns at once and becomes visible with the first flush of its writer at or after
    it; what no flush follows is not durable. writes: writer, seq; flushes: writer, seq."""
    both = writes.select("writer", "seq", F.lit(None).cast("long").alias("flush")).union(flushes.select("writer", "seq", F.col("seq")))
    x = running(both, ["writer"], bucket("seq"), [F.col("seq"), F.col("flush").isNotNull()], down=True, visible_at=("last", "flush"))
    return x.where("flush is null").select("writer", "seq", "visible_at", F.col("visible_at").isNotNull().alias("durable"))


def point_read(asked: DataFrame, tiers: dict[str, DataFrame]) -> DataFrame:
    """Of each (queue, tag) asked for, the first tier that has it, in order, and its row; nothing
    for a tag that no tier has. tiers: name to (queue, tag, body_len). One pass over all tiers,
    reduced to the tags asked for before anything is shuffled by tag."""
    parts = [t.select("queue", "tag", "body_len").withColumn("_rank", F.lit(i)).withColumn("tier", F.lit(name)) for i, (name, t) in enumerate(tiers.items())]
    rows = parts[0]
    for t in parts[1:]:
        rows = rows.unionByName(t)
    hit = rows.join(asked.select("queue", "tag").distinct(), ["queue", "tag"], "left_semi")
    return hit.groupBy("queue", "tag").agg(F.min_by(F.struct("tier", "body_len"), "_rank").alias("r")).select("queue", "tag", "r.tier", "r.body_len")
