"""Stream and batch give the same rows."""

from pyspark.sql import functions as F

from flowmill.operators import confirms, expiry, routing
from flowmill.plans import fixtures as X
from flowmill.sources.tables import messages
from flowmill.streaming import twins

SF = "/root/testdata/sf0.001"


def parts(df, path, n=4):
    df.repartition(n).write.parquet(str(path))
    return str(path)


def test_routing(spark, tmp_path):
    m = messages(spark, SF).select("delivery_tag", F.lit("amq.topic").alias("exchange"), "routing_key", "body_len")
    b, e = X.frame(spark, X.TOPIC), X.frame(spark, X.EXCHANGES)
    s = twins.routed(twins.stream(spark, parts(m, tmp_path / "in")), b, e)
    twins.deliver(s.select("delivery_tag", "queue"), str(tmp_path / "out"), str(tmp_path / "cp"), ["delivery_tag", "queue"])
    got = spark.read.parquet(str(tmp_path / "out")).select("delivery_tag", "queue")
    want = routing.route(m, X.frame(spark, X.QUEUES), b, e).select("delivery_tag", "queue")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_confirms(spark, tmp_path):
    done = spark.range(1, 401).select((F.col("id") % 3).alias("channel"), (F.floor(F.col("id") / 3) + F.when(F.col("id") % 3 == 0, 0).otherwise(1)).alias("tag")).where("tag <> 90")
    out = twins.run_to_table(twins.confirm_watermark(twins.stream(spark, parts(done, tmp_path / "in"))), "acks", str(tmp_path / "cp"))
    got = {(r.channel, r.w) for r in out.groupBy("channel").agg(F.max("ack").alias("w")).collect()}
    assert got == {(r.channel, r.watermark) for r in confirms.watermark(done).collect()}


def test_alarms(spark, tmp_path):
    m = messages(spark, SF).select(F.col("channel").cast("long").alias("node"), F.col("delivery_tag").alias("at"), F.col("body_len").alias("rss"), (49000 - F.col("body_len")).alias("free"))
    out = twins.run_to_table(twins.alarm_edges(twins.stream(spark, parts(m, tmp_path / "in", 1)), 40000, 4000, 0.25), "edges", str(tmp_path / "cp"))
    want = confirms.alarms(m, 40000.0, 4000.0, 0.25).where("edge is not null").select("node", "at", "bits", "edge")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_idle_queues(spark, tmp_path):
    from flowmill.functions.predicates import epoch_ms

    t = messages(spark, SF).select(F.col("event_type").alias("queue"), epoch_ms("published_at").alias("at_ms"))
    out = twins.run_to_table(twins.idle_lives(twins.stream(spark, parts(t, tmp_path / "in", 1)), 7_200_000), "lives", str(tmp_path / "cp"))
    end = t.agg(F.max("at_ms")).first()[0]
    lives = expiry.lives(t, F.lit(7_200_000)).select("queue", "from_ms", "last_ms", "touches", "ends_ms")
    assert sorted(map(tuple, out.collect())) == sorted(tuple(r) for r in lives.collect() if r.ends_ms < end)


def test_an_idle_queue_ends_without_another_touch(spark, tmp_path):
    """Only the other queue goes on: the watermark ends the idle one."""
    t = spark.createDataFrame([("idle", 1_000), ("idle", 2_000)] + [("busy", 1_000 * i) for i in range(1, 40)], "queue string, at_ms long")
    out = twins.run_to_table(twins.idle_lives(twins.stream(spark, parts(t, tmp_path / "in", 1)), 10_000), "idle", str(tmp_path / "cp"))
    assert [tuple(r) for r in out.collect()] == [("idle", 1_000, 2_000, 2, 12_000)]


def test_due_messages_are_reaped_by_time(spark, tmp_path):
    rows = [("q", i, 1000 + i * 1000, 1000 + i * 1000 + d) for i, d in enumerate([500, 5_000, None, 100_000, 0, 700, 1, 2, 3, 4]) if d is not None] + [("q", 99, 60_000, None)]
    m = spark.createDataFrame(rows, "queue string, tag long, at long, deadline_ms long").select("queue", "tag", F.timestamp_millis("at").alias("published_at"), "deadline_ms")
    late = spark.createDataFrame([("q", 100, 60_000, 60_001)], "queue string, tag long, at long, deadline_ms long").select("queue", "tag", F.timestamp_millis("at").alias("published_at"), "deadline_ms")
    out = twins.run_to_table(twins.reaped(twins.stream(spark, parts(m.union(late), tmp_path / "in", 1))), "due", str(tmp_path / "cp"))
    assert {(r.tag, r.deadline_ms) for r in out.collect()} == {(t, d) for _, t, _, d in rows if d is not None and d < 60_000}


def test_whole_routing_on_a_stream(spark, tmp_path):
    """Default exchange, hops and one copy a queue, as in the batch."""
    m = messages(spark, SF).withColumn("exchange", F.when(F.col("k") % 3 == 0, "").otherwise("x.in")).select("delivery_tag", "exchange", "routing_key", "body_len")
    q, b, e, x = (X.frame(spark, f) for f in (X.QUEUES, X.XQUEUES, X.EXCHANGES, X.XBINDINGS))
    hops = routing.longest_path([(a, z) for a, z, _ in X.XBINDINGS[1]])
    twins.deliver_routed(twins.stream(spark, parts(m, tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), q, b, e, x, hops)
    got = spark.read.parquet(str(tmp_path / "out")).select("delivery_tag", "queue")
    want = routing.route(m, q, b, e, x, hops).select("delivery_tag", "queue")
    assert want.count() and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
