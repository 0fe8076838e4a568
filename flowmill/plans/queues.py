"""Registered queries of policies, limits, expiry, dead-lettering and settlement."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.functions import predicates as P
from flowmill.operators import deadletter as DL
from flowmill.operators import expiry as T
from flowmill.operators import limits as Q
from flowmill.operators import settle as A
from flowmill.plans import fixtures as X
from flowmill.sources.tables import MESSAGES_SQL, dimension, messages, table

M = f"with {MESSAGES_SQL}"
QM = f"{M}, m as (select event_type as queue, delivery_tag as tag, body_len, k, user_id, channel from messages)"


def queued(spark, sf):
    """The log read as one queue per event type."""
    return messages(spark, sf).select(F.col("event_type").alias("queue"), F.col("delivery_tag").alias("tag"), "body_len", "k", "user_id", "channel")


# ------------------------------------------------------------ policies and scalars

ARGUMENTS = (
    ("id", "key", "t", "v"),
    [(1, "x-message-ttl", "I", "1000"), (2, "x-message-ttl", "l", "-1"), (3, "x-message-ttl", "d", "2.0"), (4, "x-message-ttl", "d", "2.5"), (5, "x-message-ttl", "S", "7"), (6, "x-expires", "I", "0"), (7, "x-expires", "s", "5"),
     (8, "x-max-length", "b", "0"), (9, "x-max-length-bytes", "L", "18446744073709551615"), (10, "x-dead-letter-exchange", "S", "dlx"), (10, "x-dead-letter-routing-key", "S", "rk"), (11, "x-dead-letter-routing-key", "S", "rk"),
     (12, "x-overflow", "S", "reject-publish"), (13, "x-overflow", "S", "sideways"), (14, "x-unknown", "S", "?"), (15, "x-max-length", "t", "1"), (16, "x-dead-letter-exchange", "I", "5"), (17, "x-max-length", "f", "3.0"), (17, "x-message-ttl", "I", "0")],
)


def policy_resolve(spark, sf):
    a = dimension(spark, *ARGUMENTS).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("t", "v")))).alias("args"))
    return a.select(F.col("id").cast("int").alias("id"), P.resolve_policy(F.col("args")).alias("p")).select("id", "p.*")


POLICY_SQL = f"""with {X.sql("a", ARGUMENTS)},
n as (select *, case when t in ('b','B','s','u','I','i','l','L') then try_cast(v as bigint)
                when t in ('f','d') and try_cast(v as double) = floor(try_cast(v as double)) then try_cast(try_cast(v as double) as bigint) end as n from a),
p as (select id, count(*) filter (key = 'x-message-ttl') > 0 as h1, max(n) filter (key = 'x-message-ttl') as ttl,
  count(*) filter (key = 'x-expires') > 0 as h2, max(n) filter (key = 'x-expires') as exp,
  count(*) filter (key = 'x-dead-letter-exchange') > 0 as h3, max(v) filter (key = 'x-dead-letter-exchange' and t = 'S') as dlx,
  count(*) filter (key = 'x-dead-letter-routing-key') > 0 as h4, max(v) filter (key = 'x-dead-letter-routing-key' and t = 'S') as rk,
  count(*) filter (key = 'x-max-length') > 0 as h5, max(n) filter (key = 'x-max-length') as len,
  count(*) filter (key = 'x-max-length-bytes') > 0 as h6, max(n) filter (key = 'x-max-length-bytes') as bytes,
  count(*) filter (key = 'x-overflow') > 0 as h7, max(v) filter (key = 'x-overflow' and t = 'S') as o from n group by id),
e as (select *, case when h1 and (ttl is null or ttl < 0) then 'x-message-ttl' when h2 and (exp is null or exp < 1) then 'x-expires'
  when h3 and dlx is null then 'x-dead-letter-exchange' when h4 and (rk is null or not h3) then 'x-dead-letter-routing-key'
  when h5 and (len is null or len < 0) then 'x-max-length' when h6 and (bytes is null or bytes < 0) then 'x-max-length-bytes'
  when h7 and coalesce(o, '') not in ('drop-head', 'reject-publish') then 'x-overflow' end as error from p)
select id, case when error is null then ttl end as message_ttl_ms, case when error is null then exp end as expires_ms, case when error is null then dlx end as dlx,
  case when error is null then rk end as dl_rk, case when error is null then len end as max_length, case when error is null then bytes end as max_length_bytes,
  case when error is null then coalesce(o, 'drop-head') end as overflow, error from e"""

#: Message expiration by key: numbers, signs, blanks, a fraction, nothing.
def expiration():
    k = F.col("k")
    return F.when(k % 9 == 0, F.lit(None).cast("string")).when(k % 9 == 1, "+70").when(k % 9 == 2, "-5").when(k % 9 == 3, " 5 ").when(k % 9 == 4, "5.7").when(k % 9 == 5, "soon").when(k % 9 == 6, "0").otherwise((k * 1000).cast("string"))


EXPIRATION_SQL = "case k % 9 when 0 then null when 1 then '+70' when 2 then '-5' when 3 then ' 5 ' when 4 then '5.7' when 5 then 'soon' when 6 then '0' else (k * 1000)::varchar end"


def with_deadlines(spark, sf):
    m = messages(spark, sf).withColumn("queue", F.col("event_type")).withColumn("expiration", expiration())
    return T.stamped(m.join(X.policies(spark).select("queue", "message_ttl_ms"), "queue"), F.col("message_ttl_ms"))


DEADLINES_SQL = f"""{M}, {X.sql("policies", X.POLICIES)}, x as (select m.*, event_type as queue, {EXPIRATION_SQL} as expiration from messages m),
y as (select x.*, p.message_ttl_ms, case when regexp_full_match(expiration, '[+-]?[0-9]+') then try_cast(expiration as bigint) end as raw from x join policies p using (queue)),
z as (select *, case when raw >= 0 then raw end as own from y),
d as (select *, case when own is not null or message_ttl_ms is not null then epoch_us(published_at) // 1000 end as enqueue_ms, least(own, message_ttl_ms)::bigint as ttl_ms from z),
dead as (select *, enqueue_ms + ttl_ms as deadline_ms from d)"""


def ttl_effective(spark, sf):
    return with_deadlines(spark, sf).select("delivery_tag", "enqueue_ms", "ttl_ms", "deadline_ms")


#: A reference time in the middle of the log.
NOW_MS = 1705276800000


def ttl_expired_asof(spark, sf):
    q = X.policies(spark).select("queue", "message_ttl_ms", (F.col("queue") == "click").cast("int").alias("consumers"))
    return T.swept(with_deadlines(spark, sf).drop("message_ttl_ms"), q, F.lit(NOW_MS)).groupBy("queue").agg(F.count("*").alias("expired"), F.max("deadline_ms").alias("last_deadline_ms"))


def ttl_at_delivery(spark, sf):
    d = with_deadlines(spark, sf).withColumn("deliver_ms", P.epoch_ms("published_at") + F.col("user_id") * 500)
    return T.expired_at_delivery(d).select("delivery_tag", "queue", "reason")


def ttl_next_deadline(spark, sf):
    return T.next_deadline(with_deadlines(spark, sf), F.lit(NOW_MS))


EXPIRES_MS = 3_600_000


def queue_idle_expiry(spark, sf):
    t = messages(spark, sf).select(F.concat_ws("-", "event_type", F.col("channel").cast("string")).alias("queue"), P.epoch_ms("published_at").alias("at_ms"))
    return T.lives(t, F.lit(EXPIRES_MS)).select("queue", "from_ms", "last_ms", "touches", "ends_ms")


FLAG_SQL = "(case when k > 0 then 8192 else 0 end) + 4096 + (case when k % 4 > 0 then 2048 else 0 end) + (case when coalesce(e, '') <> '' then 256 else 0 end) + 32"


def property_flags(spark, sf):
    m = messages(spark, sf).withColumn("e", expiration())
    flags = P.property_flags({"headers": F.col("k") > 0, "delivery_mode": F.col("delivery_mode") > 0, "priority": F.col("k") % 4 > 0, "expiration": F.coalesce(F.col("e"), F.lit("")) != "", "type": F.col("event_type") != ""})
    return m.groupBy(flags.alias("flags")).agg(F.count("*").alias("messages"))


def negotiated_limits(spark, sf):
    m = messages(spark, sf)
    return m.groupBy(P.negotiated(F.col("k") % 5 * 1000, F.col("user_id") % 3 * 2047).cast("long").alias("frame_max")).agg(F.count("*").alias("connections"))


def high_water_marks(spark, sf):
    c = dimension(spark, ("id", "override", "ring", "pct"), [(1, 0, 65536, 80), (2, 500, 65536, 80), (3, 0, 0, 0), (4, 0, 1001, 33), (5, 0, -5, 50)])
    return c.select("id", P.high_water_mark(F.col("override"), F.col("ring"), F.col("pct")).cast("long").alias("mark"))


def short_strings(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", P.short_string(F.coalesce("text", F.lit(""))).alias("s"))
    return d.select("doc_id", F.length("s").cast("long").alias("chars"), F.octet_length("s").cast("long").alias("bytes"), F.md5("s").alias("digest"))


SHORT_SQL = """with b as (select doc_id, coalesce(text, '') as t from documents),
c as (select doc_id, t, unnest(range(0, least(len(t), 256) + 1)) as n from b),
f as (select doc_id, max(n) as n from c where strlen(left(t, n)) <= 255 group by doc_id)
select doc_id, n::bigint as chars, strlen(left(t, n))::bigint as bytes, md5(left(t, n)) as digest from b join f using (doc_id)"""


def settle_flags(spark, sf):
    m = messages(spark, sf).select(F.when(F.col("k") % 7 < 6, (F.col("k") % 7).cast("int")).alias("octet"), F.element_at(F.array(F.lit("ack"), F.lit("nack"), F.lit("reject")), 1 + F.col("k") % 3).alias("method"))
    f = F.when(F.col("method") == "ack", P.settle_flags(F.col("octet"), "ack")).when(F.col("method") == "nack", P.settle_flags(F.col("octet"), "nack")).otherwise(P.settle_flags(F.col("octet"), "reject"))
    return m.withColumn("f", f).groupBy("method", F.col("f.multiple").alias("multiple"), F.col("f.requeue").alias("requeue")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------ limits

N, L = 200, 400_000


def drop_head_count(spark, sf):
    return Q.kept_by_drop_head(queued(spark, sf), F.lit(N)).select("queue", "tag")


def drop_head_bytes(spark, sf):
    return Q.kept_by_drop_head(queued(spark, sf), None, F.lit(L)).select("queue", "tag")


def drop_head_policy(spark, sf):
    q = queued(spark, sf).join(X.policies(spark), "queue")
    return Q.kept_by_drop_head(q, F.col("max_length"), F.col("max_length_bytes")).groupBy("queue").agg(F.count("*").alias("kept"), F.min("tag").alias("oldest"), F.sum("body_len").cast("long").alias("bytes"))


def drop_head_eviction_point(spark, sf):
    return Q.evicted_by(queued(spark, sf), N).select("queue", "tag", "evicted_by")


def drop_head_eviction_point_bytes(spark, sf):
    return Q.evicted_by_bytes(queued(spark, sf), 90_000)


def reject_publish_count(spark, sf):
    return Q.reject_publish_count(queued(spark, sf), N).groupBy("queue", "accepted").agg(F.count("*").alias("messages"), F.max("tag").alias("last"))


def reject_publish_bytes(spark, sf):
    return Q.reject_publish_bytes(queued(spark, sf), L).groupBy("queue", "accepted").agg(F.count("*").alias("messages"), F.max("tag").alias("last"), F.sum("body_len").cast("long").alias("bytes"))


def fanout_partial_reject(spark, sf):
    q = queued(spark, sf)
    two = q.select("tag", "body_len", F.explode(F.array(F.concat(F.lit("q."), "queue"), F.concat(F.lit("c."), F.col("channel").cast("string")))).alias("queue"))
    return Q.publish_outcome(Q.reject_publish_count(two, 1500)).groupBy("targets", "delivered", "refused").agg(F.count("*").alias("publishes"))


def ready_bytes(spark, sf):
    e = queued(spark, sf).withColumn("action", F.element_at(F.array(*[F.lit(x) for x in ("enqueue", "enqueue", "claim", "requeue", "evict")]), F.col("k") % 5 + 1))
    return Q.ready_bytes(e, X.policies(spark).where("max_length_bytes is not null"))


def queue_depth(spark, sf):
    e = queued(spark, sf).select("queue", F.col("tag").alias("seq"), F.when(F.col("k") % 3 == 0, -1).otherwise(1).alias("waiting"), F.when(F.col("k") % 3 == 0, 1).when(F.col("k") % 3 == 1, -1).otherwise(0).alias("inflight"))
    return Q.depth(e, 100)


def claim_order(spark, sf):
    r = queued(spark, sf).withColumn("requeue_seq", F.when(F.col("k") % 11 == 0, -F.col("tag")))
    return Q.claim_order(r).select("queue", "tag", F.col("claim").cast("long").alias("claim"))


def get_one(spark, sf):
    r = queued(spark, sf).withColumn("requeue_seq", F.when((F.col("k") % 11 == 0) & (F.col("queue") != "view"), 20000 - F.col("tag"))).withColumn("deadline_ms", F.when(F.col("tag") % 2 == 0, F.col("tag") * 10))
    return Q.pop(r, F.lit(5000))


def prefetch_violations(spark, sf):
    log = queued(spark, sf).select(F.col("user_id").alias("consumer"), F.col("tag").alias("seq"), F.when(F.col("k") % 2 == 0, 1).otherwise(-1).alias("change"))
    return Q.prefetch_violations(log, 5).select("consumer", "seq", "unacked")


def prefetch_in_force(spark, sf):
    q = queued(spark, sf)
    s = q.where("k < 3").select("channel", F.col("tag").alias("seq"), (F.col("user_id") % 2).cast("int").alias("prefetch_size"), (F.col("user_id") * 10).cast("int").alias("prefetch"))
    return Q.prefetch_in_force(q.select("channel", F.col("tag").alias("seq"), "tag"), s)


def competing_consumers(spark, sf):
    return Q.assigned(queued(spark, sf), 3).groupBy("queue", "consumer").agg(F.count("*").alias("messages"), F.sum("body_len").cast("long").alias("bytes"))


# ------------------------------------------------------------ dead letters

DLQ = (("queue", "exchange", "routing_key"), [("dead.all", "x.dead", "#"), ("dead.error", "x.dead", "dead.error"), ("click", "x.dead", "click.#"), ("purchase", "x.dead", "purchase.*.1"), ("late", "x.late", "late")])
DLX = (("name", "kind"), [("x.dead", "topic"), ("x.late", "direct")])


def _deaths(spark, sf):
    m = messages(spark, sf).select("delivery_tag", F.col("event_type").alias("queue"), "routing_key", F.lit("amq.topic").alias("exchange"), expiration().alias("expiration"), "k", F.col("delivery_tag").alias("at"))
    none = F.array().cast("array<string>")
    m = m.withColumn("prior_queues", none)
    return DL.deaths(m.where("k % 10 = 1"), m.where("k % 10 = 2"), m.where("k % 10 = 3"))


DEATHS_SQL = f"""{M}, {X.sql("policies", X.POLICIES)}, {X.sql("dlq", DLQ)},
dead as (select delivery_tag, event_type as queue, routing_key, {EXPIRATION_SQL} as expiration, k, case k % 10 when 1 then 'rejected' when 2 then 'expired' else 'maxlen' end as reason from messages where k % 10 in (1, 2, 3)),
pub as (select d.*, p.dlx, coalesce(p.dl_rk, d.routing_key) as key from dead d join policies p using (queue) where dlx is not null),
hop as (select distinct delivery_tag, pub.queue as died_in, reason, key, b.queue, expiration from pub join dlq b on b.exchange = dlx
  and ((dlx = 'x.late' and b.routing_key = key) or (dlx = 'x.dead' and (b.routing_key = '#' or b.routing_key = key
    or (b.routing_key = 'click.#' and (key = 'click' or key like 'click.%')) or (b.routing_key = 'purchase.*.1' and regexp_full_match(key, 'purchase\\.[^.]+\\.1'))))))"""


def dead_letter_route(spark, sf):
    h = DL.hop(_deaths(spark, sf), X.policies(spark), dimension(spark, ("name",), [("dead.all",)]), X.frame(spark, DLQ), X.frame(spark, DLX))
    return h.select("delivery_tag", "queue", "died_in", "reason", "routing_key", "expiration")


def dead_letter_cycle(spark, sf):
    h = DL.hop(_deaths(spark, sf), X.policies(spark), dimension(spark, ("name",), [("dead.all",)]), X.frame(spark, DLQ), X.frame(spark, DLX))
    return h.where("queue = died_in").groupBy("reason").agg(F.count("*").alias("returned"))


def dead_letter_second_hop(spark, sf):
    """What goes on from click and purchase after they expire there again."""
    env = (X.policies(spark), dimension(spark, ("name",), [("dead.all",)]), X.frame(spark, DLQ), X.frame(spark, DLX))
    first = DL.hop(_deaths(spark, sf), *env).where("queue in ('click', 'purchase')")
    dead = first.select("delivery_tag", "queue", "routing_key", "expiration", "prior_queues").withColumn("exchange", F.lit("x.dead")).withColumn("reason", F.lit("expired"))
    return DL.hop(dead, *env).select("delivery_tag", "queue", "died_in")


def dead_letter_full_target(spark, sf):
    h = DL.hop(_deaths(spark, sf), X.policies(spark), dimension(spark, ("name",), [("dead.all",)]), X.frame(spark, DLQ), X.frame(spark, DLX))
    room = dimension(spark, ("queue", "room"), [("dead.all", 50), ("dead.error", 0), ("late", 7)])
    t = h.select("delivery_tag", "queue").distinct()
    return DL.accepted_targets(t, room).groupBy("queue").agg(F.count("*").alias("taken"), F.max("delivery_tag").alias("last"))


def x_death_aggregate(spark, sf):
    m = messages(spark, sf)
    dead = m.select(F.col("user_id").alias("delivery_tag"), F.concat(F.lit("q"), (F.col("k") % 3).cast("string")).alias("queue"), F.element_at(F.array(*[F.lit(r) for r in DL.REASONS]), F.col("k") % 3 + 1).alias("reason"), F.concat(F.lit("x"), (F.col("k") % 4).cast("string")).alias("exchange"), "routing_key", expiration().alias("expiration"), F.col("delivery_tag").alias("at"))
    h = DL.death_history(dead)
    e = F.col("x_death")
    text = F.array_join(F.transform(e, lambda d: F.concat_ws("/", d["queue"], d["reason"], d["count"].cast("string"), d["exchange"], d["routing_keys"][0], F.coalesce(d["original_expiration"], F.lit("-")))), ";")
    return h.select("delivery_tag", text.alias("x_death"), "first_death_queue", "first_death_reason", "first_death_exchange")


XDEATH_SQL = f"""{M}, d as (select user_id as delivery_tag, 'q' || (k % 3) as queue, case k % 3 when 0 then 'rejected' when 1 then 'expired' else 'maxlen' end as reason, 'x' || (k % 4) as exchange, routing_key,
  {EXPIRATION_SQL} as expiration, delivery_tag as at_seq from messages),
p as (select delivery_tag, queue, reason, count(*) as n, max(at_seq) as last, min(at_seq) as first, arg_max(struct_pack(e := exchange, r := routing_key, x := expiration), at_seq) as l, arg_min(exchange, at_seq) as e0 from d group by all)
select delivery_tag, string_agg(queue || '/' || reason || '/' || n || '/' || l.e || '/' || l.r || '/' || coalesce(case when reason = 'expired' then l.x end, '-'), ';' order by last desc) as x_death,
  arg_min(queue, first) as first_death_queue, arg_min(reason, first) as first_death_reason, arg_min(e0, first) as first_death_exchange from p group by delivery_tag"""


# ------------------------------------------------------------ settlement


def deliveries(spark, sf):
    m = queued(spark, sf).select("channel", F.col("tag").alias("seq"), "tag", "queue", (F.col("user_id") % 10).alias("consumer"), "k", (F.col("k") % 13 == 0).alias("no_ack"), (F.col("k") % 5 == 0).alias("is_get"))
    return A.wire_tags(m)


def settles(spark, sf):
    """Each delivery asks for a settle of one a little before it, two of three times singly."""
    d = deliveries(spark, sf)
    tag = F.when(F.col("k") % 29 == 0, 0).otherwise(F.greatest(F.col("wire_tag") - F.col("k") % 7, F.lit(1)))
    return d.where("k % 4 <> 3").select("channel", tag.cast("long").alias("wire_tag"), "seq", F.when(F.col("k") % 5 < 3, "ack").otherwise("nack").alias("action"), (F.col("k") % 29 == 0).alias("multiple"), (F.col("k") % 2 == 0).alias("requeue"))


DELIVERIES_SQL = f"""{QM}, d as (select channel, tag as seq, tag, queue, user_id % 10 as consumer, k, k % 13 = 0 as no_ack, k % 5 = 0 as is_get, row_number() over (partition by channel order by tag) as wire_tag from m),
s as (select channel, case when k % 29 = 0 then 0 else greatest(wire_tag - k % 7, 1) end as wire_tag, seq, case when k % 5 < 3 then 'ack' else 'nack' end as action, k % 29 = 0 as multiple, k % 2 = 0 as requeue from d where k % 4 <> 3),
c as (select d.channel, d.wire_tag, d.tag, d.consumer, d.queue, d.no_ack, d.is_get, d.seq as delivered_at, s.seq as at_seq, s.action, s.requeue
  from d join s on s.channel = d.channel and ((not s.multiple and s.wire_tag = d.wire_tag) or (s.multiple and d.seq <= s.seq and (s.wire_tag = 0 or d.wire_tag <= s.wire_tag)))),
f as (select channel, wire_tag, min(at_seq) as settled_at, arg_min(action, at_seq) as action, arg_min(requeue, at_seq) as requeue from c group by channel, wire_tag)"""


def wire_tags(spark, sf):
    return deliveries(spark, sf).select("channel", "tag", F.col("wire_tag").cast("long").alias("wire_tag"))


def ack_first_winner(spark, sf):
    return A.first_settles(settles(spark, sf).where("not multiple"))


def ack_multiple(spark, sf):
    return A.expanded(deliveries(spark, sf), settles(spark, sf))


def settle_states(spark, sf):
    d = deliveries(spark, sf).withColumn("wire_tag", F.col("wire_tag").cast("long"))
    x = d.join(A.expanded(d, settles(spark, sf)), ["channel", "wire_tag"]).join(X.policies(spark).select("queue", F.col("dlx").isNotNull().alias("has_dlx")), "queue")
    return A.after_settle(x).groupBy("queue", "state").agg(F.count("*").alias("messages"))


def _open(spark, sf):
    d = deliveries(spark, sf).withColumn("wire_tag", F.col("wire_tag").cast("long"))
    return d, A.unacked(d, A.expanded(d, settles(spark, sf)).where("action is not null"))


def unacked_by_consumer(spark, sf):
    return A.unacked_by_consumer(_open(spark, sf)[1])


def min_ack_cursor(spark, sf):
    return A.min_ack_cursor(*_open(spark, sf))


def basic_recover(spark, sf):
    d, o = _open(spark, sf)
    r = d.where("k = 50 and channel < 3").select("channel", "seq")
    return A.recovered(o, r).groupBy("channel").agg(F.count("*").alias("requeued"), F.max("tag").alias("last"))


def consumer_cancel(spark, sf):
    c = dimension(spark, ("consumer",), [(1,), (4,)])
    return A.cancelled(_open(spark, sf)[1], c).groupBy("queue", "consumer").agg(F.count("*").alias("requeued"))


def auto_deleted_queues(spark, sf):
    q = queued(spark, sf)
    consumers = q.select(F.concat_ws("-", "queue", F.col("k").cast("string")).alias("queue"), F.col("user_id").alias("consumer")).distinct()
    names = consumers.select(F.col("queue").alias("name")).distinct().withColumn("auto_delete", F.length("name") % 2 == 0)
    return A.auto_deleted_queues(names, consumers, q.where("user_id % 20 <> 0").select(F.col("user_id").alias("consumer")).distinct())


def consumer_offsets(spark, sf):
    d = deliveries(spark, sf).withColumn("wire_tag", F.col("wire_tag").cast("long"))
    return A.consumer_offsets(d.join(A.expanded(d, settles(spark, sf)), ["channel", "wire_tag"]))


def interleaved_fold(spark, sf):
    """Publishes, claims and settles interleaved, with a limit and a prefetch: order matters."""
    q = queued(spark, sf)
    act = F.element_at(F.array(*[F.lit(x) for x in ("publish", "publish", "publish", "claim", "claim", "ack", "requeue", "discard")]), F.col("k") % 8 + 1)
    log = q.select("queue", F.col("tag").alias("seq"), act.alias("action"), F.when(F.col("k") % 8 < 5, F.col("tag")).otherwise(F.col("tag") - F.col("k") - 1).alias("tag"), (F.col("user_id") % 3).cast("string").alias("consumer"))
    return A.queue_fold(log, 50, "drop-head", 20).groupBy("queue", "outcome").agg(F.count("*").alias("steps"), F.sum("tag").alias("tags"))


#: One step of every queue at a time: what is ready, what came back, what is held, and what happened.
FOLD_SQL = f"""{QM.replace("with messages", "with recursive messages", 1)},
e as (select queue, row_number() over (partition by queue order by tag) as n, ['publish', 'publish', 'publish', 'claim', 'claim', 'ack', 'requeue', 'discard'][k % 8 + 1] as action,
  case when k % 8 < 5 then tag else tag - k - 1 end as tag, (user_id % 3)::varchar as consumer from m),
f as (
  select queue, 0::bigint as n, []::bigint[] as ready, []::bigint[] as again, []::struct(t bigint, c varchar)[] as held, null::varchar as outcome, null::bigint as tag, null::bigint as evicted from e group by queue
  union all
  select queue, n,
    case when evicted is not null and len(again) = 0 then (ready || [arg])[2:] when outcome = 'accepted' then ready || [arg] when outcome = 'delivered' and len(again) = 0 then ready[2:] else ready end,
    case when (evicted is not null or outcome = 'delivered') and len(again) > 0 then again[2:] when outcome = 'requeued' then again || [arg] else again end,
    case when outcome = 'delivered' then held || [{{'t': head, 'c': consumer}}] when outcome in ('acked', 'requeued', 'discarded') then list_filter(held, lambda h: h.t <> arg) else held end,
    outcome, case outcome when 'delivered' then head when 'blocked' then null when 'empty' then null else arg end, evicted
  from (
    select f.queue, e.n, ready, again, held, e.tag as arg, e.consumer, coalesce(again[1], ready[1]) as head,
      case when action = 'publish' then 'accepted'
           when action = 'claim' then case when len(list_filter(held, lambda h: h.c = e.consumer)) >= 20 then 'blocked' when len(ready) + len(again) > 0 then 'delivered' else 'empty' end
           when len(list_filter(held, lambda h: h.t = e.tag)) = 0 then 'late'
           else case action when 'ack' then 'acked' when 'requeue' then 'requeued' else 'discarded' end end as outcome,
      case when action = 'publish' and len(ready) + len(again) >= 50 then coalesce(again[1], ready[1], e.tag) end as evicted
    from f join e on e.queue = f.queue and e.n = f.n + 1)),
o as (select queue, outcome, tag from f where n > 0 union all select queue, 'evicted', evicted from f where evicted is not null)
select queue, outcome, count(*) as steps, sum(tag)::bigint as tags from o group by all"""


QUERIES = {
    "policy_resolve": (policy_resolve, POLICY_SQL),
    "ttl_effective": (ttl_effective, f"{DEADLINES_SQL} select delivery_tag, enqueue_ms, ttl_ms, deadline_ms from dead"),
    "ttl_expired_asof": (ttl_expired_asof, f"{DEADLINES_SQL} select queue, count(*) as expired, max(deadline_ms) as last_deadline_ms from dead where message_ttl_ms is not null and queue <> 'click' and deadline_ms <= {NOW_MS} group by queue"),
    "ttl_at_delivery": (ttl_at_delivery, f"{DEADLINES_SQL} select delivery_tag, queue, 'expired' as reason from dead where deadline_ms <= epoch_us(published_at) // 1000 + user_id * 500"),
    "ttl_next_deadline": (ttl_next_deadline, f"{DEADLINES_SQL} select queue, min(deadline_ms) filter (deadline_ms > {NOW_MS}) as next_ms from dead group by queue"),
    "queue_idle_expiry": (queue_idle_expiry, f"""{M}, t as (select event_type || '-' || channel as queue, epoch_us(published_at) // 1000 as at_ms from messages),
n as (select *, case when at_ms - lag(at_ms) over (partition by queue order by at_ms) >= {EXPIRES_MS} then 1 else 0 end as new from t),
l as (select *, sum(new) over (partition by queue order by at_ms) as life from n)
select queue, min(at_ms) as from_ms, max(at_ms) as last_ms, count(*) as touches, max(at_ms) + {EXPIRES_MS} as ends_ms from l group by queue, life"""),
    "property_flags": (property_flags, f"{M}, x as (select *, {EXPIRATION_SQL} as e from messages) select {FLAG_SQL} as flags, count(*) as messages from x group by 1"),
    "negotiated_limits": (negotiated_limits, f"{M}, x as (select k % 5 * 1000 as c, user_id % 3 * 2047 as s from messages) select (case when c = 0 then s when s = 0 then c else least(c, s) end)::bigint as frame_max, count(*) as connections from x group by 1"),
    "high_water_marks": (high_water_marks, "select id, (case when o > 0 then o else (case when ring > 0 then ring else 262144 end) * (case when pct > 0 then pct else 80 end) // 100 end)::bigint as mark from (values (1, 0, 65536, 80), (2, 500, 65536, 80), (3, 0, 0, 0), (4, 0, 1001, 33), (5, 0, -5, 50)) as t(id, o, ring, pct)"),
    "short_strings": (short_strings, SHORT_SQL),
    "settle_flags": (settle_flags, f"""{M}, x as (select case when k % 7 < 6 then k % 7 end as o, case k % 3 when 0 then 'ack' when 1 then 'nack' else 'reject' end as method from messages)
select method, method <> 'reject' and coalesce(o & 1, 0) = 1 as multiple, case method when 'ack' then false when 'nack' then coalesce(o & 2, 2) = 2 else coalesce(o & 1, 1) = 1 end as requeue, count(*) as n from x group by all"""),
    "drop_head_count": (drop_head_count, f"{QM} select queue, tag from (select *, row_number() over (partition by queue order by tag desc) as n from m) where n <= {N}"),
    "drop_head_bytes": (drop_head_bytes, f"{QM} select queue, tag from (select *, row_number() over w as n, sum(body_len) over w as s from m window w as (partition by queue order by tag desc)) where s <= {L} or n = 1"),
    "drop_head_policy": (drop_head_policy, f"""{QM}, {X.sql("policies", X.POLICIES)}, x as (select *, row_number() over w as n, sum(body_len) over w as s from m join policies using (queue) window w as (partition by queue order by tag desc))
select queue, count(*) as kept, min(tag) as oldest, sum(body_len)::bigint as bytes from x where (max_length is null or n <= max_length) and (max_length_bytes is null or s <= max_length_bytes or n = 1) group by queue"""),
    "drop_head_eviction_point": (drop_head_eviction_point, f"{QM} select * from (select queue, tag, lead(tag, {N}) over (partition by queue order by tag) as evicted_by from m) where evicted_by is not null"),
    "drop_head_eviction_point_bytes": (drop_head_eviction_point_bytes, f"""{QM}, p as (select queue, tag, body_len, sum(body_len) over (partition by queue order by tag) as total, lead(tag) over (partition by queue order by tag) as nxt from m)
select * from (select queue, tag, (select min(case when i.tag = j.tag then j.nxt else i.tag end) from p i where i.queue = j.queue and i.tag >= j.tag and i.total - (j.total - j.body_len) > 90000) as evicted_by from p j) where evicted_by is not null"""),
    "reject_publish_count": (reject_publish_count, f"{QM}, x as (select *, row_number() over (partition by queue order by tag) <= {N} as accepted from m) select queue, accepted, count(*) as messages, max(tag) as last from x group by all"),
    "reject_publish_bytes": (reject_publish_bytes, f"{QM}, x as (select *, coalesce(sum(body_len) over (partition by queue order by tag rows between unbounded preceding and 1 preceding), 0) < {L} as accepted from m) select queue, accepted, count(*) as messages, max(tag) as last, sum(body_len)::bigint as bytes from x group by all"),
    "fanout_partial_reject": (fanout_partial_reject, f"""{QM}, t as (select tag, 'q.' || queue as queue from m union all select tag, 'c.' || channel from m), x as (select *, row_number() over (partition by queue order by tag) <= 1500 as ok from t),
p as (select tag, count(*) as targets, count(*) filter (ok) as delivered, bool_or(not ok) as refused from x group by tag) select targets, delivered, refused, count(*) as publishes from p group by all"""),
    "ready_bytes": (ready_bytes, f"{QM} select queue, sum(case when k % 5 in (0, 1, 3) then body_len else -body_len end)::bigint as ready_bytes from m where queue in ('click', 'view', 'signup') group by queue"),
    "queue_depth": (queue_depth, f"""{QM}, x as (select queue, tag as seq, sum(case when k % 3 = 0 then -1 else 1 end) over w as a, sum(case k % 3 when 0 then 1 when 1 then -1 else 0 end) over w as b from m window w as (partition by queue order by tag))
select queue, seq, (greatest(a, 0) + greatest(b, 0))::bigint as depth, greatest(a, 0) + greatest(b, 0) >= 100 as at_mark from x"""),
    "claim_order": (claim_order, f"{QM} select queue, tag, row_number() over (partition by queue order by case when k % 11 = 0 then 0 else 1 end, case when k % 11 = 0 then -tag end, tag) as claim from m"),
    "get_one": (get_one, f"""{QM}, x as (select *, case when k % 11 = 0 and queue <> 'view' then 20000 - tag end as r from m where not (tag % 2 = 0 and tag * 10 <= 5000)),
y as (select *, row_number() over (partition by queue order by r is null, r, tag) as n, count(*) over (partition by queue) - 1 as remaining from x) select queue, tag, r is not null as redelivered, remaining from y where n = 1"""),
    "prefetch_violations": (prefetch_violations, f"{QM}, x as (select user_id as consumer, tag as seq, k % 2 = 0 as d, (sum(case when k % 2 = 0 then 1 else -1 end) over (partition by user_id order by tag))::bigint as unacked from m) select consumer, seq, unacked from x where d and unacked > 5"),
    "prefetch_in_force": (prefetch_in_force, f"{QM}, s as (select channel, tag, user_id * 10 as p from m where k < 3 and user_id % 2 = 0) select channel, tag, coalesce((select arg_max(p, s.tag) from s where s.channel = m.channel and s.tag <= m.tag), 0)::integer as prefetch from m"),
    "competing_consumers": (competing_consumers, f"{QM}, x as (select *, ((row_number() over (partition by queue order by tag) - 1) % 3)::integer as consumer from m) select queue, consumer, count(*) as messages, sum(body_len)::bigint as bytes from x group by all"),
    "dead_letter_route": (dead_letter_route, f"{DEATHS_SQL} select delivery_tag, queue, died_in, reason, key as routing_key, case when reason <> 'expired' then expiration end as expiration from hop where reason = 'rejected' or queue <> died_in"),
    "dead_letter_cycle": (dead_letter_cycle, f"{DEATHS_SQL} select reason, count(*) as returned from hop where queue = died_in and reason = 'rejected' group by reason"),
    "dead_letter_second_hop": (dead_letter_second_hop, f"""{DEATHS_SQL}, one as (select * from hop where (reason = 'rejected' or queue <> died_in) and queue in ('click', 'purchase')),
two as (select delivery_tag, one.queue as second, died_in as first, key from one)
select distinct delivery_tag, b.queue, second as died_in from two join dlq b on b.exchange = 'x.dead' and (b.routing_key = '#' or b.routing_key = key or (b.routing_key = 'click.#' and (key = 'click' or key like 'click.%')) or (b.routing_key = 'purchase.*.1' and regexp_full_match(key, 'purchase\\.[^.]+\\.1')))
where b.queue <> second and b.queue <> first"""),
    "dead_letter_full_target": (dead_letter_full_target, f"""{DEATHS_SQL}, t as (select distinct delivery_tag, queue from hop where reason = 'rejected' or queue <> died_in), r as (select *, row_number() over (partition by queue order by delivery_tag) as n from t)
select queue, count(*) as taken, max(delivery_tag) as last from r where (queue <> 'dead.all' or n <= 50) and queue <> 'dead.error' and (queue <> 'late' or n <= 7) group by queue"""),
    "x_death_aggregate": (x_death_aggregate, XDEATH_SQL),
    "wire_tags": (wire_tags, f"{DELIVERIES_SQL} select channel, tag, wire_tag from d"),
    "ack_first_winner": (ack_first_winner, f"{DELIVERIES_SQL} select channel, wire_tag, arg_min(action, seq) as action, arg_min(requeue, seq) as requeue, count(*) - 1 as late from s where not multiple group by channel, wire_tag"),
    "ack_multiple": (ack_multiple, f"{DELIVERIES_SQL} select channel, wire_tag, settled_at, action, requeue from d left join f using (channel, wire_tag)"),
    "settle_states": (settle_states, f"""{DELIVERIES_SQL}, {X.sql("policies", X.POLICIES)} select queue, case when no_ack or action = 'ack' then 'acked' when action is null then 'unacked' when requeue then 'requeued' when dlx is not null then 'dead-lettered' else 'dropped' end as state, count(*) as messages
from d left join f using (channel, wire_tag) join policies using (queue) group by 1, 2"""),
    "unacked_by_consumer": (unacked_by_consumer, f"{DELIVERIES_SQL} select consumer, count(*) as unacked, min(tag) as lowest from d left join f using (channel, wire_tag) where not no_ack and action is null group by consumer"),
    "min_ack_cursor": (min_ack_cursor, f"{DELIVERIES_SQL} select queue, coalesce(min(tag) filter (not no_ack and action is null), max(tag)) as cursor from d left join f using (channel, wire_tag) group by queue"),
    "basic_recover": (basic_recover, f"""{DELIVERIES_SQL}, r as (select channel, max(seq) as at_seq from d where k = 50 and channel < 3 group by channel)
select channel, count(*) as requeued, max(tag) as last from d left join f using (channel, wire_tag) join r using (channel) where not no_ack and action is null and not is_get and seq < at_seq group by channel"""),
    "consumer_cancel": (consumer_cancel, f"{DELIVERIES_SQL} select queue, consumer, count(*) as requeued from d left join f using (channel, wire_tag) where not no_ack and action is null and consumer in (1, 4) group by all"),
    "auto_deleted_queues": (auto_deleted_queues, f"""{QM}, c as (select distinct queue || '-' || k as queue, user_id from m) select queue from c where length(queue) % 2 = 0 group by queue having count(*) filter (user_id % 20 = 0) = 0"""),
    "consumer_offsets": (consumer_offsets, f"{DELIVERIES_SQL} select queue, consumer, max(tag) as \"offset\" from d join f using (channel, wire_tag) where action = 'ack' group by all"),
    "interleaved_fold": (interleaved_fold, FOLD_SQL),
}
