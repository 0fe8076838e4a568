"""Counters, rates, histograms and the benchmark gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions.predicates import epoch_ms
from flowmill.operators.ordered import running

#: M2: bucket bounds in seconds: 0.1 ms doubled 14 times.
BOUNDS = tuple(0.0001 * 2**k for k in range(15))


def counters(events: DataFrame, by: list[str]) -> DataFrame:
    """M1: messages and bytes by label."""
    return events.groupBy(*by).agg(F.count("*").alias("messages"), F.sum("body_len").cast("long").alias("bytes"))


def buckets(values: DataFrame, value: str, by: list[str], bounds=BOUNDS) -> DataFrame:
    """M2: cumulative counts per bound, in long form; the bound beyond all is null.

    Each value first counts into its own bucket, so the cumulative form works on a handful
    of rows per label.
    """
    at = F.array_position(F.transform(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: F.col(value) <= b), F.lit(True)).cast("int")
    own = values.select(*by, F.when(at == 0, len(bounds) + 1).otherwise(at).alias("b")).groupBy(*by, "b").agg(F.count("*").alias("n"))
    grid = own.select(*by).distinct().withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(len(bounds) + 1))))
    w = Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    le = F.element_at(F.array(*[F.lit(float(b)) for b in bounds], F.lit(None).cast("double")), F.col("b"))
    return grid.join(own, [*by, "b"], "left").withColumn("cumulative", F.sum(F.coalesce("n", F.lit(0))).over(w).cast("long")).select(*by, le.alias("le"), "cumulative")


def histogram_quantile(cumulative: DataFrame, q: float, by: list[str]) -> DataFrame:
    """M4: the quantile by linear interpolation within its bucket, from 0 in the first; in the
    last, unbounded one it is the bound before."""
    w = Window.partitionBy(*by).orderBy(F.col("le").asc_nulls_last())
    x = cumulative.withColumn("below", F.coalesce(F.lag("cumulative").over(w), F.lit(0))).withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
    x = x.join(cumulative.groupBy(*by).agg(F.max("cumulative").alias("total")), by).withColumn("rank", F.col("total") * F.lit(q))
    hit = x.where((F.col("cumulative") >= F.col("rank")) & ((F.col("below") < F.col("rank")) | (F.col("below") == 0)) & (F.col("cumulative") > F.col("below")))
    v = F.when(F.col("le").isNull(), F.col("low")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("below")) / (F.col("cumulative") - F.col("below")))
    return hit.groupBy(*by).agg(F.min(v).alias("quantile"))


def rates(samples: DataFrame, by: list[str], step: str = "1 minute", seconds: int = 60) -> DataFrame:
    """M3: increase per second of a counter in each window; a fall is a reset, after which the
    value counts from 0. samples: by, ts, value."""
    x = running(samples, by, F.to_date("ts"), [F.col("ts")], upto="before", _last=("last", "value"))
    up = F.when(F.col("_last").isNull(), 0.0).when(F.col("value") < F.col("_last"), F.col("value")).otherwise(F.col("value") - F.col("_last"))
    return x.withColumn("up", up).groupBy(*by, F.window("ts", step).start.alias("window_start")).agg((F.sum("up") / seconds).alias("rate"))


def scraped(events: DataFrame, by: list[str], counters: dict[str, Column], step_s: int = 60) -> DataFrame:
    """The samples a scrape every step_s seconds would see of counters that start at 0: by, name,
    ts (the end of the step), value. events: by, ts; counters: name to what an event adds. Steps
    without an event give no sample; the next one has caught up."""
    end = ((F.floor(epoch_ms("ts") / (step_s * 1000)) + 1) * step_s).cast("long")
    steps = events.groupBy(*by, end.alias("at")).agg(*[F.sum(c).cast("double").alias(n) for n, c in counters.items()])
    x = running(steps, by, F.floor(F.col("at") / (86_400 * 30)), [F.col("at")], **{n: ("sum", n) for n in counters})
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in counters])).alias("s")
    return x.select(*by, F.timestamp_seconds("at").alias("ts"), pairs).select(*by, "s.name", "ts", "s.value")


def latest(samples: DataFrame, by: list[str]) -> DataFrame:
    """M6: the last value of each gauge."""
    return samples.groupBy(*by).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


def percentiles(values: DataFrame, value: str, qs: dict[str, float], by: list[str], width: float = 1.0) -> DataFrame:
    """M8: exact percentiles, interpolated between ranks. Values are counted first, and their
    running counts go by ranges of `width`, so no buffer holds a group's values; the places
    asked for are then minima over the running counts."""
    v = F.col(value).cast("double")
    n = values.where(v.isNotNull()).groupBy(*by, v.alias("v")).agg(F.count("*").alias("n"))
    x = running(n, by, F.floor(F.col("v") / width), [F.col("v")], upto="row", upto_here=("sum", "n"))
    x = x.join(n.groupBy(*by).agg(F.sum("n").alias("total")), by)
    at = lambda rank: F.min(F.when(F.col("upto_here") > rank, F.col("v")))
    out = []
    for i, q in enumerate(qs.values()):
        place = F.lit(q) * (F.col("total") - 1)
        out += [at(F.floor(place)).alias(f"_l{i}"), at(F.ceil(place)).alias(f"_h{i}"), F.first(place - F.floor(place)).alias(f"_p{i}")]
    f = lambda i: F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_p{i}")
    return x.groupBy(*by).agg(*out).select(*by, *[f(i).alias(name) for i, name in enumerate(qs)])


def throughput(events: DataFrame, ts: str, step: str, by: list[str]) -> DataFrame:
    """M9: events per window."""
    return events.groupBy(*by, F.window(ts, step).start.alias("window_start")).agg(F.count("*").alias("events"))


def losses(counts: DataFrame, confirm_mode: Column) -> DataFrame:
    """What should have arrived and did not: confirmed or published minus delivered."""
    target = F.when(confirm_mode, F.col("confirmed")).otherwise(F.col("published"))
    return counts.withColumn("target", target).withColumn("lost", F.greatest(target - F.col("delivered"), F.lit(0)))


def regressions(results: DataFrame, limit_pct: float = 2.0) -> DataFrame:
    """What fails the gate. results: name, metric, status, significant, delta_pct.

    sec/op fails above the limit, any other metric on any increase, both only if significant.
    A benchmark missing from the new run fails once by name; one missing from the baseline
    passes.
    """
    worse = F.col("significant") & F.when(F.col("metric") == "sec/op", F.col("delta_pct") > limit_pct).otherwise(F.col("delta_pct") > 0)
    slow = results.where((F.col("status") == "compared") & worse).select("name", "metric", F.lit("regression").alias("failure"))
    gone = results.where("status = 'missing-from-new'").select("name", F.lit(None).cast("string").alias("metric"), F.lit("missing").alias("failure")).distinct()
    return slow.union(gone)


def compared(base: DataFrame, new: DataFrame) -> DataFrame:
    """Results to gate from two runs' mean values by (name, metric): a full outer join. What is
    significant is for the caller to say; here every difference is."""
    b, n = base.withColumnRenamed("value", "old"), new.withColumnRenamed("value", "now")
    x = b.join(n, ["name", "metric"], "full")
    status = F.when(F.col("now").isNull(), "missing-from-new").when(F.col("old").isNull(), "missing-from-baseline").otherwise("compared")
    return x.withColumn("status", status).withColumn("delta_pct", F.coalesce((F.col("now") / F.col("old") - 1) * 100, F.lit(0.0))).withColumn("significant", F.coalesce(F.col("now") != F.col("old"), F.lit(False)))


def sizes(files: DataFrame, by: str) -> DataFrame:
    """Files and bytes by kind."""
    return files.groupBy(by).agg(F.count("*").alias("files"), F.sum("bytes").cast("long").alias("bytes"))


def server_stats(messages: DataFrame, settled: DataFrame) -> DataFrame:
    """M7: totals in one row."""
    none = lambda kind: F.lit(None).cast(kind)
    both = messages.select("body_len", F.lit(True).alias("sent"), none("string").alias("action")).unionByName(settled.select(none("long").alias("body_len"), F.lit(False).alias("sent"), "action"))
    return both.agg(F.count_if("sent").alias("published"), F.sum("body_len").cast("long").alias("published_bytes"), F.count_if(F.col("action") == "ack").alias("acked"), F.count_if(F.col("action") != "ack").alias("rejected"))
