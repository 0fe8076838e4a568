"""Registered queries of confirms, alarms, the log, authorization and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.operators import authz as Z
from flowmill.operators import confirms as W
from flowmill.operators import limits as Q
from flowmill.operators import log as L
from flowmill.operators import metrics as G
from flowmill.operators.ordered import bucket, ranked, running
from flowmill.plans import fixtures as X
from flowmill.plans.queues import NOW_MS
from flowmill.plans.routing import TOPIC_SQL, topic
from flowmill.functions.predicates import epoch_ms
from flowmill.sources.tables import MESSAGES_SQL, dimension, messages, table
from flowmill.sources.text import bench_results, bench_sections, benchstat_rows

M = f"with {MESSAGES_SQL}"

# ------------------------------------------------------------ confirms


def publishes(spark, sf):
    """Channels number their publishes; `flush` is when each completes, out of order."""
    m = ranked(messages(spark, sf).select("channel", "delivery_tag", "k"), ["channel"], "delivery_tag", "tag")
    return m.select("channel", "tag", (F.floor(F.col("delivery_tag") / 50) + F.col("k") % 3).cast("long").alias("flush"), "k", "delivery_tag")


PUBLISHES_SQL = f"{M}, p as (select channel, row_number() over (partition by channel order by delivery_tag) as tag, (delivery_tag // 50 + k % 3)::bigint as flush, k, delivery_tag from messages)"


def confirm_watermark(spark, sf):
    """Completed are all publishes but those with key 77."""
    return W.watermark(publishes(spark, sf).where("k <> 77"))


def conversation_watermark(spark, sf):
    """Turns of conversations as tags: the longest gap-free start of each."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("channel"), (F.col("turn") + 1).alias("tag"))
    return W.watermark(c.where("channel % 7 <> tag"))


def confirm_coalesced(spark, sf):
    return W.coalesced_acks(publishes(spark, sf).select("channel", "tag", "flush"))


def confirm_nacks(spark, sf):
    return W.settled_answers(publishes(spark, sf).select("channel", "tag", (F.col("k") % 23 != 5).alias("ok")))


def confirm_fanin(spark, sf):
    r = topic(spark, sf).select(F.col("delivery_tag").alias("tag"), "queue")
    n = F.col("tag") * 7 + F.length("queue") * 13
    c = r.select("tag", (n % 19 != 0).alias("durable"), (n % 1009).alias("at"), F.when(n % 19 == 0, F.concat(F.lit("disk of "), "queue")).alias("error"))
    return W.fan_in(c)


FANIN_SQL = f"""{M}, {X.sql("bindings", X.TOPIC)}, h as (select distinct delivery_tag as tag, queue from (select m.*, b.queue, b.routing_key as pattern from messages m, bindings b) where {TOPIC_SQL}),
c as (select tag, n % 19 <> 0 as durable, n % 1009 as at_ms, case when n % 19 = 0 then 'disk of ' || queue end as error from (select *, tag * 7 + length(queue) * 13 as n from h))
select tag, bool_and(durable) as confirmed, case when bool_and(durable) then max(at_ms) end as confirmed_at, (min({{'a': at_ms, 'e': error}}) filter (not durable)).e as error from c group by tag"""


def visibility_frontier(spark, sf):
    c = messages(spark, sf).select(F.col("event_type").alias("queue"), F.col("delivery_tag").alias("tag"), ((F.col("delivery_tag") < 5000) | (F.col("k") > 60)).alias("done"), (F.col("k") % 10 == 0).alias("failed"))
    return Q.visible_head(c)


def alarm_latch(spark, sf):
    s = messages(spark, sf).select("channel", "delivery_tag", F.when(F.col("k") != 13, F.col("body_len")).alias("rss"), F.when(F.col("k") != 14, 49000 - F.col("body_len")).alias("free"))
    a = W.alarms(s.withColumnsRenamed({"channel": "node", "delivery_tag": "at"}), 40000.0, 4000.0, 0.25)
    return a.groupBy("node", "bits", "edge").agg(F.count("*").alias("samples"), F.max("at").alias("last"))


ALARM_SQL = f"""{M}, s as (select channel as node, delivery_tag as t, case when k <> 13 then body_len end as rss, case when k <> 14 then 49000 - body_len end as free from messages),
e as (select *, case when rss >= 40000 then 1 when rss <= 30000 then 0 end as m, case when free < 4000 then 1 when free >= 5000 then 0 end as d from s),
b as (select node, t, (coalesce(last_value(m ignore nulls) over w, 0) + 2 * coalesce(last_value(d ignore nulls) over w, 0))::integer as bits from e window w as (partition by node order by t rows between unbounded preceding and current row)),
g as (select *, coalesce(lag(bits) over (partition by node order by t), 0) as before from b)
select node, bits, case when before = 0 and bits <> 0 then 'blocked' when before <> 0 and bits = 0 then 'unblocked' end as edge, count(*) as samples, max(t) as last from g group by 1, 2, 3"""


def flow_gated(spark, sf):
    m = messages(spark, sf)
    f = m.where("k in (3, 4)").select("channel", F.col("delivery_tag").alias("seq"), (F.col("k") == 4).alias("active"))
    return W.flow_gated(m.select("channel", F.col("delivery_tag").alias("seq"), F.col("delivery_tag").alias("tag")), f)


def stale_connections(spark, sf):
    a = messages(spark, sf).select(F.col("user_id").alias("connection"), epoch_ms("published_at").alias("at_ms"))
    return W.stale(a, F.lit(NOW_MS + 1_300_000_000), 15_000_000)


# ------------------------------------------------------------ log


def _ops(spark, sf):
    m = messages(spark, sf)
    op = F.when(F.col("k") == 98, "commit").when(F.col("k") == 99, "rollback").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("publish", "ack", "nack", "reject")]), F.col("k") % 4 + 1))
    return m.select("channel", F.col("delivery_tag").alias("seq"), op.alias("op"))


def tx_committed(spark, sf):
    return L.committed_ops(_ops(spark, sf)).select("channel", "seq", "op")


def tx_stats(spark, sf):
    return L.tx_stats(_ops(spark, sf))


OP_SQL = "case when k = 98 then 'commit' when k = 99 then 'rollback' else case k % 4 when 0 then 'publish' when 1 then 'ack' when 2 then 'nack' else 'reject' end end"


def tx_select_refused(spark, sf):
    m = messages(spark, sf).select("delivery_tag", (F.col("k") % 2 == 0).alias("confirm"), (F.col("k") % 3 == 0).alias("tx"), F.when(F.col("k") % 5 < 2, "tx.select").otherwise("confirm.select").alias("method"))
    return L.tx_select_refused(m).groupBy("method", "refused").agg(F.count("*").alias("channels"))


def _records(spark, sf):
    """Log files of 1000 records: a begin at key 1, a commit at key 2, epochs by hundreds."""
    m = messages(spark, sf)
    kind = F.when(F.col("k") == 1, "begin").when(F.col("k") == 2, "commit").otherwise("message")
    return m.select(F.floor(F.col("delivery_tag") / 1000).cast("long").alias("file"), F.col("delivery_tag").alias("pos"), kind.alias("type"), F.floor(F.col("delivery_tag") / 100).cast("long").alias("epoch"), F.col("event_type").alias("queue"), F.col("delivery_tag").alias("tag"), "body_len", "k")


RECORDS_SQL = f"{M}, r as (select delivery_tag // 1000 as file, delivery_tag as pos, case k when 1 then 'begin' when 2 then 'commit' else 'message' end as type, delivery_tag // 100 as epoch, event_type as queue, delivery_tag as tag, body_len, k from messages)"


def log_tx_filter(spark, sf):
    return L.visible_records(_records(spark, sf)).select("file", "pos")


LOG_TX_SQL = f"""{RECORDS_SQL}, b as (select *, last_value(case when type <> 'message' then type end ignore nulls) over w as bt, last_value(case when type <> 'message' then epoch end ignore nulls) over w as be
  from r window w as (partition by file order by pos rows between unbounded preceding and current row))
select file, pos from b where type = 'message' and (bt is null or bt = 'commit' or (bt = 'begin' and epoch = be and exists (select 1 from r c where c.type = 'commit' and c.file = b.file and c.epoch = b.epoch)))"""


def log_crc_filter(spark, sf):
    payload = F.concat_ws(",", F.col("queue"), F.col("tag").cast("string"))
    r = _records(spark, sf).withColumn("crc", F.when(F.col("k") % 10 == 0, F.lit(0)).when(F.col("k") % 10 == 1, F.crc32(payload) + 1).otherwise(F.crc32(payload)))
    return L.intact(r, payload).groupBy("file").agg(F.count("*").alias("records"))


def log_body_refs(spark, sf):
    r = _records(spark, sf).withColumn("body_ref", F.when(F.col("k") % 4 == 0, F.col("pos") - F.col("k")))
    bodies = r.where("k % 4 <> 0 and k % 5 <> 0").select("file", "pos", "body_len")
    return L.with_body(r, bodies).groupBy("file", "shared").agg(F.count("*").alias("records"), F.sum("body_len").cast("long").alias("bytes"))


def shared_bodies(spark, sf):
    t = topic(spark, sf).select("delivery_tag", "body_len", "queue")
    mode = messages(spark, sf).select("delivery_tag", "delivery_mode")
    return L.shared_bodies(t.join(mode, "delivery_tag"), 20000)


def _logged(spark, sf):
    r = _records(spark, sf).where("type = 'message'")
    return r.where("k < 90"), r.where("k % 3 = 0 or pos < 2000"), r.where("k >= 60")


LOGGED_SQL = f"{RECORDS_SQL}, logged as (select * from r where type = 'message' and k < 90), acked as (select * from r where type = 'message' and (k % 3 = 0 or pos < 2000)), seg as (select * from r where type = 'message' and k >= 60)"


def recover_messages(spark, sf):
    logged, acked, seg = _logged(spark, sf)
    cols = ("queue", "tag", "body_len")
    return L.recoverable(logged.select(*cols), seg.select(*cols), acked)


RECOVER_SQL = f"""{LOGGED_SQL}, a as (select queue, tag, body_len, 'log' as "from" from logged where tag not in (select tag from acked)),
x as (select * from a union all select queue, tag, body_len, 'segment' from seg where tag not in (select tag from a))"""


def recover_summary(spark, sf):
    return L.recovery_summary(recover_messages(spark, sf))


def pending_after_restart(spark, sf):
    p = messages(spark, sf).select("delivery_tag", epoch_ms("published_at").alias("at_ms"))
    return L.pending_after_restart(p, F.lit(NOW_MS), 86_400_000).groupBy("kept").agg(F.count("*").alias("pending"))


def wal_reclaimable(spark, sf):
    logged, acked, _ = _logged(spark, sf)
    return L.reclaimable(logged, acked)


def wal_checkpoint(spark, sf):
    logged, acked, _ = _logged(spark, sf)
    files = logged.select("file").distinct().withColumn("old", F.col("file") < 6)
    return L.checkpointed(logged, acked, files).groupBy("queue").agg(F.count("*").alias("moved"), F.sum("body_len").cast("long").alias("bytes"))


def _segments(spark, sf):
    return _records(spark, sf).where("type = 'message'").select(F.floor(F.col("pos") / 64).cast("long").alias("segment"), "queue", "tag", (F.col("k") % 2 == F.floor(F.col("pos") / 640) % 2).alias("deleted"), (F.col("pos") < 9600).alias("sealed"))


SEGMENTS_SQL = f"{RECORDS_SQL}, s as (select pos // 64 as segment, queue, tag, k % 2 = (pos // 640) % 2 as deleted, pos < 9600 as sealed from r where type = 'message'), c as (select segment, count(*) as records, count(*) filter (deleted) as deleted from s where sealed group by segment having count(*) filter (deleted) > count(*) * 0.5)"


def compaction_candidates(spark, sf):
    return L.compaction_candidates(_segments(spark, sf))


def compaction_rewrite(spark, sf):
    s = _segments(spark, sf)
    return L.compacted(s, L.compaction_candidates(s)).groupBy("segment").agg(F.count("*").alias("records"))


def wal_record_counts(spark, sf):
    return L.record_counts(_records(spark, sf))


def group_commit(spark, sf):
    return L.commit_batches(messages(spark, sf).select(F.col("channel").alias("writer"), F.col("delivery_tag").alias("seq"), "body_len"), 1000).groupBy("writer", "batch").agg(F.count("*").alias("records"), F.sum("body_len").cast("long").alias("bytes"))


def range_read(spark, sf):
    return L.between(messages(spark, sf), 101, 300).select("delivery_tag", "body_len")


def range_delete(spark, sf):
    return L.between(messages(spark, sf), 101, 9900, delete=True).select("delivery_tag", "body_len")


# ------------------------------------------------------------ authorization


def _requests(spark, sf):
    ops = F.array(*[F.lit(o) for o in dict.fromkeys(o for o, _, _ in Z.OPERATIONS)])
    m = messages(spark, sf)
    return m.select(F.col("delivery_tag").alias("id"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("username"), F.lit("/").alias("vhost"), F.element_at(ops, (F.col("k") % 12 + 1).cast("int")).alias("operation"), F.element_at(F.array(*[F.lit(e) for e in ("", "amq.topic", "click.x", "u5-x")]), F.col("k") % 4 + 1).alias("exchange"), F.element_at(F.array(*[F.lit(q) for q in ("q.1", "view.all", "u5-q")]), F.col("k") % 3 + 1).alias("queue"), F.lit("amq.fanout").alias("destination"))


OPERATIONS = (("operation", "permission", "part"), Z.OPERATIONS)


def authz_decisions(spark, sf):
    return Z.decisions(_requests(spark, sf), X.frame(spark, X.PERMISSIONS), dimension(spark, *OPERATIONS)).select("id", "username", "operation", "allowed")


_OPS = list(dict.fromkeys(o for o, _, _ in Z.OPERATIONS))
AUTHZ_SQL = f"""{M}, {X.sql("perms", X.PERMISSIONS)}, {X.sql("ops", OPERATIONS)},
r as (select delivery_tag as id, 'u' || (user_id % 7) as username, ({_OPS!r})[k % 12 + 1] as operation, ['', 'amq.topic', 'click.x', 'u5-x'][k % 4 + 1] as exchange, ['q.1', 'view.all', 'u5-q'][k % 3 + 1] as queue from messages),
x as (select r.*, case part when 'exchange' then case when exchange = '' then 'amq.default' else exchange end when 'queue' then queue else 'amq.fanout' end as name,
  case permission when 'configure' then configure when 'write' then write else read end as pattern from r join ops using (operation) left join perms p on p.username = r.username and p.vhost = '/')
select id, username, operation, bool_and(coalesce(pattern <> '' and regexp_matches(name, pattern), false)) as allowed from x group by all"""


def _connections(spark, sf):
    return messages(spark, sf).select(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("username"), F.when(F.col("k") % 2 == 0, "/").otherwise("/other").alias("vhost"), F.element_at(F.array(*[F.lit(i) for i in ("127.0.0.1", "::1", "10.0.0.7", "::ffff:127.0.0.9")]), F.col("k") % 4 + 1).alias("remote_ip"), "delivery_tag")


def vhost_refused(spark, sf):
    return Z.vhost_refused(_connections(spark, sf), X.frame(spark, X.PERMISSIONS)).groupBy("username", "vhost", "reply_code").agg(F.count("*").alias("refused"))


def loopback_refused(spark, sf):
    users = dimension(spark, ("username", "loopback_only"), [("u0", True), ("u1", False), ("u4", True)])
    return Z.loopback_refused(_connections(spark, sf), users).groupBy("username", "remote_ip").agg(F.count("*").alias("refused"))


CONNECTIONS_SQL = f"{M}, c as (select 'u' || (user_id % 7) as username, case when k % 2 = 0 then '/' else '/other' end as vhost, ['127.0.0.1', '::1', '10.0.0.7', '::ffff:127.0.0.9'][k % 4 + 1] as remote_ip from messages)"


# ------------------------------------------------------------ metrics


def metric_counters(spark, sf):
    return G.counters(messages(spark, sf).withColumn("queue", F.col("event_type")), ["queue", "delivery_mode"])


def _latency(spark, sf):
    return messages(spark, sf).select(F.col("event_type").alias("queue"), (F.col("body_len") / F.lit(100000.0)).alias("seconds"))


def latency_buckets(spark, sf):
    return G.buckets(_latency(spark, sf), "seconds", ["queue"])


BUCKETS_SQL = f"""{M}, v as (select event_type as queue, body_len / 100000.0::double as s from messages), b as (select 0.0001::double * pow(2, i) as le from range(15) t(i) union all select null),
c as (select queue, le, count(*) filter (le is null or s <= le) as cumulative from v, b group by queue, le)"""


def histogram_quantile(spark, sf):
    b = G.buckets(_latency(spark, sf), "seconds", ["queue"])
    out = [G.histogram_quantile(b, q, ["queue"]).withColumn("q", F.lit(q)) for q in (0.5, 0.95, 0.99)]
    return out[0].union(out[1]).union(out[2]).select("queue", "q", F.round("quantile", 9).alias("quantile"))


QUANTILE_SQL = BUCKETS_SQL + """, x as (select *, coalesce(lag(cumulative) over w, 0) as below, coalesce(lag(le) over w, 0) as low, max(cumulative) over (partition by queue) as total from c window w as (partition by queue order by le nulls last)),
q as (select x.*, q, total * q as rank from x, (values (0.5::double), (0.95), (0.99)) as t(q))
select queue, q, round(min(case when le is null then low else low + (le - low) * (rank - below) / (cumulative - below) end), 9) as quantile
from q where cumulative >= rank and (below < rank or below = 0) and cumulative > below group by queue, q"""


def rate_1m(spark, sf):
    """A counter per channel that restarts whenever a key of 0 is published."""
    m = messages(spark, sf).select("channel", "delivery_tag", "published_at", "k")
    m = running(m, ["channel"], bucket("delivery_tag"), [F.col("delivery_tag")], run=("sum", F.when(F.col("k") == 0, 1).otherwise(0)))
    s = ranked(m, ["channel", "run"], "delivery_tag", "n").select("channel", F.col("published_at").alias("ts"), F.col("n").cast("double").alias("value"))
    return G.rates(s, ["channel"], "1 hour", 3600).select("channel", F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), F.round("rate", 9).alias("rate"))


RATE_SQL = f"""{M}, r as (select *, sum(case when k = 0 then 1 else 0 end) over (partition by channel order by delivery_tag) as run from messages),
c as (select channel, published_at, delivery_tag, row_number() over (partition by channel, run order by delivery_tag)::double as v from r),
u as (select *, lag(v) over (partition by channel order by published_at) as last from c)
select channel, strftime(published_at, '%Y-%m-%d %H') as hour, round(sum(case when last is null then 0 when v < last then v else v - last end) / 3600, 9) as rate from u group by 1, 2"""


def depth_by_queue(spark, sf):
    """Ready and unacked by queue, from the log."""
    m = messages(spark, sf)
    return m.groupBy(F.col("event_type").alias("queue")).agg(F.count_if(F.col("k") % 3 == 0).alias("ready"), F.count_if(F.col("k") % 3 == 1).alias("unacked"))


def latest_gauge(spark, sf):
    s = messages(spark, sf).select(F.concat_ws(".", "event_type", F.col("channel").cast("string")).alias("metric"), F.col("delivery_tag").alias("ts"), F.col("body_len").cast("double").alias("value"))
    return G.latest(s, ["metric"])


def server_stats(spark, sf):
    m = messages(spark, sf)
    return G.server_stats(m, m.withColumn("action", F.when(F.col("k") < 70, "ack").otherwise("nack")))


def latency_percentiles(spark, sf):
    p = G.percentiles(_latency(spark, sf), "seconds", {"p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p999": 0.999}, ["queue"])
    return p.select("queue", *[F.round(c, 9).alias(c) for c in ("p50", "p75", "p95", "p99", "p999")])


def throughput_per_second(spark, sf):
    t = G.throughput(messages(spark, sf), "published_at", "1 second", ["event_type"])
    return t.groupBy("event_type", F.col("events").alias("events_in_second")).agg(F.count("*").alias("seconds"))


def loss_accounting(spark, sf):
    c = messages(spark, sf).groupBy("channel").agg(F.count("*").alias("published"), F.count_if(F.col("k") < 95).alias("confirmed"), F.count_if(F.col("k") % 10 != 9).alias("delivered"))
    return G.losses(c, F.col("channel") % 2 == 0)


def bench_regressions(spark, sf):
    """Two runs: mean price by part type is sec/op, mean size is allocs/op; parts of odd and
    even keys are the runs."""
    p = table(spark, sf, "part")
    run = lambda r: p.where(F.col("p_partkey") % 2 == r).where(F.col("p_size") > r).groupBy(F.col("p_type").alias("name")).agg(F.avg("p_retailprice").alias("sec/op"), F.avg("p_size").alias("allocs/op")).selectExpr("name", "stack(2, 'sec/op', `sec/op`, 'allocs/op', `allocs/op`) as (metric, value)")
    return G.regressions(G.compared(run(0), run(1)))


REGRESSION_SQL = """with t as (select p_type as name, p_partkey % 2 as run, avg(p_retailprice) as s, avg(p_size) as a from part where p_size > p_partkey % 2 group by 1, 2),
u as (select name, run, 'sec/op' as metric, s as value from t union all select name, run, 'allocs/op', a from t),
x as (select coalesce(b.name, n.name) as name, coalesce(b.metric, n.metric) as metric, b.value as old, n.value as now from (select * from u where run = 0) b full join (select * from u where run = 1) n on b.name = n.name and b.metric = n.metric)
select name, metric, 'regression' as failure from x where old is not null and now is not null and now <> old and ((metric = 'sec/op' and (now / old - 1) * 100 > 2) or (metric <> 'sec/op' and (now / old - 1) * 100 > 0))
union all select distinct name, null, 'missing' from x where now is null"""

BENCH_LINES = (
    ("file", "line_no", "value"),
    [("a", 0, "noise before"), ("a", 1, "goos: linux"), ("a", 2, "cpu: fast"), ("a", 3, "pkg: one"), ("a", 4, "BenchmarkA-8 100 12.5 ns/op 3 allocs/op"), ("a", 5, "PASS"), ("a", 6, "goos: linux"), ("a", 7, "pkg: two"), ("a", 8, "BenchmarkA-8 50 99 ns/op"), ("a", 9, "goos: linux"), ("a", 10, "pkg: one"), ("a", 11, "BenchmarkB 7 1 ns/op"), ("a", 12, "cpu: last")],
)
STAT_LINES = (
    ("file", "line_no", "value"),
    [("s", 0, "goos: linux"), ("s", 1, ",old.txt,,new.txt,,,"), ("s", 2, ",sec/op,CI,sec/op,CI,vs base,P"), ("s", 3, "A-8,1e-08,2%,2e-08,1%,+100.00%,p=0.001 n=10"), ("s", 4, "B-8,1e-08,2%,1e-08,1%,~,p=0.9 n=10"), ("s", 5, "C-8,5e-08,1%"), ("s", 6, "D-8,,,4e-08,1%"), ("s", 7, "geomean,1e-08,,2e-08,,+50%,"), ("s", 8, ",allocs/op,CI,allocs/op,CI,vs base,P"), ("s", 9, "A-8,3,0%,4,0%,+33.33%,p=0.001 n=10"), ("s", 10, "B-8,3,0%,2,0%,-33.33%,p=0.001 n=10"), ("s", 11, "C-8,5,1%"), ("s", 12, "E-8,3,0%,2,0%,?,p=1 n=2"), ("s", 13, "F-8,3,0%,3,0%,+1.50%,p=0.01 n=10")],
)


def bench_text(spark, sf):
    return bench_results(bench_sections(X.frame(spark, BENCH_LINES)))


def benchstat_gate(spark, sf):
    return G.regressions(benchstat_rows(X.frame(spark, STAT_LINES)))


def file_sizes(spark, sf):
    d = table(spark, sf, "documents")
    return G.sizes(d.select(F.col("source").alias("kind"), F.octet_length("text").alias("bytes")), "kind")


QUERIES = {
    "confirm_watermark": (confirm_watermark, f"{PUBLISHES_SQL}, d as (select channel, tag, row_number() over (partition by channel order by tag) as r from p where k <> 77) select channel, coalesce(max(tag) filter (tag = r), 0) as watermark from d group by channel"),
    "conversation_watermark": (conversation_watermark, "with d as (select distinct conv_id as channel, turn + 1 as tag from conversations where conv_id % 7 <> turn + 1), r as (select *, row_number() over (partition by channel order by tag) as r from d) select channel, coalesce(max(tag) filter (tag = r), 0) as watermark from r group by channel"),
    "confirm_coalesced": (confirm_coalesced, f"""{PUBLISHES_SQL}, x as (select channel, tag, max(flush) over (partition by channel order by tag) as flush from p), f as (select channel, flush, max(tag) as ack from x group by all)
select channel, flush, ack, ack > coalesce(lag(ack) over (partition by channel order by flush), 0) + 1 as multiple from f"""),
    "confirm_nacks": (confirm_nacks, f"""{PUBLISHES_SQL}, x as (select channel, tag, k % 23 <> 5 as ok, sum(case when k % 23 = 5 then 1 else 0 end) over (partition by channel order by tag) as island from p)
select channel, max(tag) as tag, 'ack' as answer, count(*) > 1 as multiple from x where ok group by channel, island union all select channel, tag, 'nack', false from x where not ok"""),
    "confirm_fanin": (confirm_fanin, FANIN_SQL),
    "visibility_frontier": (visibility_frontier, f"""{M}, c as (select event_type as queue, delivery_tag as tag, delivery_tag < 5000 or k > 60 as done, k % 10 = 0 as failed from messages), h as (select queue, coalesce(min(tag) filter (not done), max(tag) + 1) as head from c group by queue)
select queue, head, count(*) filter (done and not failed and tag < head) as ready from c join h using (queue) group by all"""),
    "alarm_latch": (alarm_latch, ALARM_SQL),
    "flow_gated": (flow_gated, f"""{M} select channel, delivery_tag as tag, coalesce(last_value(case when k = 4 then true when k = 3 then false end ignore nulls) over (partition by channel order by delivery_tag rows between unbounded preceding and current row), true) as active from messages"""),
    "stale_connections": (stale_connections, f"{M} select user_id as connection, max(epoch_us(published_at) // 1000) as last_ms, {NOW_MS + 1_300_000_000} - max(epoch_us(published_at) // 1000) >= 30000000 as stale from messages group by 1"),
    "tx_committed": (tx_committed, f"""{M}, o as (select channel, delivery_tag as seq, {OP_SQL} as op from messages), x as (select *, coalesce(sum(case when op in ('commit', 'rollback') then 1 else 0 end) over (partition by channel order by seq rows between unbounded preceding and 1 preceding), 0) as tx from o)
select channel, seq, op from x where op not in ('commit', 'rollback') and exists (select 1 from x c where c.channel = x.channel and c.tx = x.tx and c.op = 'commit')"""),
    "tx_stats": (tx_stats, f"{M}, o as (select {OP_SQL} as op from messages) select " + ", ".join(f"count(*) filter (op = '{o}') as {o}s" for o in ("publish", "ack", "nack", "reject", "commit", "rollback")) + " from o"),
    "tx_select_refused": (tx_select_refused, f"{M}, x as (select k % 2 = 0 as c, k % 3 = 0 as t, case when k % 5 < 2 then 'tx.select' else 'confirm.select' end as method from messages) select method, (c and method = 'tx.select') or (t and method = 'confirm.select') as refused, count(*) as channels from x group by 1, 2"),
    "log_tx_filter": (log_tx_filter, LOG_TX_SQL),
    "log_crc_filter": (log_crc_filter, f"{RECORDS_SQL} select file, count(*) filter (k % 10 <> 1) as records from r group by file"),
    "log_body_refs": (log_body_refs, f"""{RECORDS_SQL}, b as (select file, pos, body_len from r where k % 4 <> 0 and k % 5 <> 0), x as (select file, false as shared, body_len from r where k % 4 <> 0 union all select r.file, true, b.body_len from r join b on b.file = r.file and b.pos = r.pos - r.k where r.k % 4 = 0)
select file, shared, count(*) as records, sum(body_len)::bigint as bytes from x group by all"""),
    "shared_bodies": (shared_bodies, f"""{M}, {X.sql("bindings", X.TOPIC)}, h as (select distinct delivery_tag, body_len, delivery_mode, queue from (select m.*, b.queue, b.routing_key as pattern from messages m, bindings b) where {TOPIC_SQL}), c as (select delivery_tag, body_len, delivery_mode, count(*) as copies from h group by all)
select delivery_tag, copies, delivery_mode = 2 and copies >= 2 and body_len >= 20000 as shared, case when delivery_mode = 2 and copies >= 2 and body_len >= 20000 then body_len else body_len * copies end as stored_bytes, body_len * copies as copied_bytes from c"""),
    "recover_messages": (recover_messages, f"{RECOVER_SQL} select * from x"),
    "recover_summary": (recover_summary, f"{RECOVER_SQL} select queue, min(tag) as min_tag, max(tag) as max_tag, count(*) as messages from x group by queue"),
    "pending_after_restart": (pending_after_restart, f"{M} select {NOW_MS} - epoch_us(published_at) // 1000 <= 86400000 as kept, count(*) as pending from messages group by 1"),
    "wal_reclaimable": (wal_reclaimable, f"{LOGGED_SQL} select file, count(*) as records, count(*) filter (tag in (select tag from acked)) as acked, count(*) = count(*) filter (tag in (select tag from acked)) as reclaimable from logged group by file"),
    "wal_checkpoint": (wal_checkpoint, f"{LOGGED_SQL} select queue, count(*) as moved, sum(body_len)::bigint as bytes from logged where file < 6 and tag not in (select tag from acked) group by queue"),
    "compaction_candidates": (compaction_candidates, f"{SEGMENTS_SQL} select * from c"),
    "compaction_rewrite": (compaction_rewrite, f"{SEGMENTS_SQL} select segment, count(*) as records from s where not deleted or segment not in (select segment from c) group by segment"),
    "wal_record_counts": (wal_record_counts, f"{RECORDS_SQL} select type, count(*) as records from r group by type"),
    "group_commit": (group_commit, f"{M}, x as (select channel as writer, ((row_number() over (partition by channel order by delivery_tag) - 1) // 1000)::bigint as batch, body_len from messages) select writer, batch, count(*) as records, sum(body_len)::bigint as bytes from x group by all"),
    "range_read": (range_read, f"{M} select delivery_tag, body_len from messages where delivery_tag between 101 and 300"),
    "range_delete": (range_delete, f"{M} select delivery_tag, body_len from messages where delivery_tag not between 101 and 9900"),
    "authz_decisions": (authz_decisions, AUTHZ_SQL),
    "vhost_refused": (vhost_refused, f"{CONNECTIONS_SQL}, {X.sql('perms', X.PERMISSIONS)} select username, vhost, 402 as reply_code, count(*) as refused from c where not exists (select 1 from perms p where p.username = c.username and p.vhost = c.vhost) group by 1, 2"),
    "loopback_refused": (loopback_refused, f"{CONNECTIONS_SQL} select username, remote_ip, count(*) as refused from c where username in ('u0', 'u4') and remote_ip = '10.0.0.7' group by all"),
    "metric_counters": (metric_counters, f"{M} select event_type as queue, delivery_mode, count(*) as messages, sum(body_len)::bigint as bytes from messages group by all"),
    "latency_buckets": (latency_buckets, BUCKETS_SQL + " select queue, le, cumulative from c"),
    "histogram_quantile": (histogram_quantile, QUANTILE_SQL),
    "rate_1m": (rate_1m, RATE_SQL),
    "depth_by_queue": (depth_by_queue, f"{M} select event_type as queue, count(*) filter (k % 3 = 0) as ready, count(*) filter (k % 3 = 1) as unacked from messages group by 1"),
    "latest_gauge": (latest_gauge, f"{M} select event_type || '.' || channel as metric, arg_max(body_len, delivery_tag)::double as value, max(delivery_tag) as ts from messages group by 1"),
    "server_stats": (server_stats, f"{M} select count(*) as published, sum(body_len)::bigint as published_bytes, count(*) filter (k < 70) as acked, count(*) filter (k >= 70) as rejected from messages"),
    "latency_percentiles": (latency_percentiles, f"{M} select event_type as queue, " + ", ".join(f"round(quantile_cont(body_len / 100000.0::double, {q}), 9) as {n}" for n, q in (("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))) + " from messages group by 1"),
    "throughput_per_second": (throughput_per_second, f"{M}, s as (select event_type, date_trunc('second', published_at) as t, count(*) as n from messages group by 1, 2) select event_type, n as events_in_second, count(*) as seconds from s group by 1, 2"),
    "loss_accounting": (loss_accounting, f"""{M}, c as (select channel, count(*) as published, count(*) filter (k < 95) as confirmed, count(*) filter (k % 10 <> 9) as delivered from messages group by 1), t as (select *, case when channel % 2 = 0 then confirmed else published end as target from c)
select *, greatest(target - delivered, 0) as lost from t"""),
    "bench_regressions": (bench_regressions, REGRESSION_SQL),
    "bench_text": (bench_text, "select * from (values ('one', 'BenchmarkA-8', 100::bigint, 12.5::double, 'ns/op'), ('one', 'BenchmarkA-8', 100, 3, 'allocs/op'), ('two', 'BenchmarkA-8', 50, 99, 'ns/op'), ('one', 'BenchmarkB', 7, 1, 'ns/op')) as t(pkg, name, iterations, value, unit)"),
    "benchstat_gate": (benchstat_gate, "select * from (values ('A-8', 'sec/op', 'regression'), ('A-8', 'allocs/op', 'regression'), ('F-8', 'allocs/op', 'regression'), ('C-8', null, 'missing')) as t(name, metric, failure)"),
    "file_sizes": (file_sizes, "select source as kind, count(*) as files, sum(strlen(text))::bigint as bytes from documents group by 1"),
}
