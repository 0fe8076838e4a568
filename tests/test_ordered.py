"""Running aggregates by buckets against plain windows, and one hot queue spread over tasks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowmill.operators import limits, settle
from flowmill.operators.ordered import bucket, running


@pytest.mark.parametrize("down", [False, True])
@pytest.mark.parametrize("upto", ["row", "before"])
@pytest.mark.parametrize("width", [1, 7, 1000])
def test_like_a_window(spark, down, upto, width):
    r = random.Random(3)
    rows = [(q, t, r.choice([None, 1, 2, 5]), t % 3 or None) for q in ("a", "b", "c") for t in r.sample(range(200), 60 if q == "a" else 5)]
    df = spark.createDataFrame(rows, "q string, t long, v long, w long")
    order = F.desc("t") if down else F.asc("t")
    w = Window.partitionBy("q").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if upto == "row" else -1)
    want = df.select("q", "t", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.count(F.lit(1)).over(w).alias("n"), F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"), F.last("w", ignorenulls=True).over(w).alias("l"), F.max(F.struct("v", "t")).over(w).alias("st"))
    got = running(df, ["q"], bucket("t", width), [F.col("t")], down, upto, s=("sum", "v"), n=("count",), lo=("min", "v"), hi=("max", "v"), l=("last", "w"), st=("max", F.struct("v", "t"))).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_hot_queue_is_not_one_task(spark):
    """All rows in one queue: no partition of the sort holds more than a few buckets."""
    df = spark.range(0, 400_000, 1, 4).select(F.lit("q").alias("queue"), (F.col("id") * 5).alias("tag"), F.lit(1).alias("body_len"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        out = limits.reject_publish_count(df, 100_000).withColumn("p", F.spark_partition_id())
        parts = [r.n for r in out.groupBy("p").agg(F.count("*").alias("n"), F.count_if("accepted")).collect()]
        assert sum(parts) == 400_000 and max(parts) < 100_000
        assert out.where("accepted").agg(F.count("*"), F.max("tag")).first()[:2] == (100_000, 99_999 * 5)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_settles_of_tags_not_yet_delivered(spark):
    """A settle that names a tag before its delivery settles nothing of it, alone or as a range."""
    d = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 3, 30), (1, 4, 40)], "channel int, wire_tag long, seq long")
    s = spark.createDataFrame([(1, 4, 15, "ack", True, False), (1, 3, 25, "nack", False, True), (1, 4, 45, "nack", True, True)], "channel int, wire_tag long, seq long, action string, multiple boolean, requeue boolean")
    got = {r.wire_tag: (r.settled_at, r.action) for r in settle.expanded(d, s).collect()}
    assert got == {1: (15, "ack"), 2: (45, "nack"), 3: (45, "nack"), 4: (45, "nack")}
