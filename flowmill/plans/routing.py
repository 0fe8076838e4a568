"""Registered queries of routing and topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.functions.predicates import TABLE
from flowmill.operators import routing as R
from flowmill.operators import topology as D
from flowmill.plans import fixtures as X
from flowmill.sources.tables import MESSAGES_SQL, messages, table, typed

#: The topic recipe in DuckDB's dialect: every word brings its dot.
TOPIC_SQL = """regexp_full_match(case when routing_key = '' then '' else '.' || routing_key end,
  case when pattern = '' then '' else array_to_string(list_transform(string_split(pattern, '.'), lambda w:
    case w when '*' then '\\.[^.]+' when '#' then '(?:\\.[^.]+)*' else '\\.\\Q' || w || '\\E' end), '') end)"""


def on(spark, sf, exchange):
    return messages(spark, sf).select("delivery_tag", F.lit(exchange).alias("exchange"), "routing_key", "headers", "mandatory", "body_len")


def route_default(spark, sf):
    return R.default_exchange(on(spark, sf, ""), X.frame(spark, X.QUEUES)).select("delivery_tag", "queue")


def route_direct(spark, sf):
    return R.route(on(spark, sf, "amq.direct"), X.frame(spark, X.QUEUES), X.frame(spark, X.DIRECT), X.frame(spark, X.EXCHANGES)).select("delivery_tag", "queue")


def route_fanout(spark, sf):
    r = R.route(on(spark, sf, "amq.fanout"), X.frame(spark, X.QUEUES), X.frame(spark, X.FANOUT), X.frame(spark, X.EXCHANGES))
    return r.groupBy("queue").agg(F.count("*").alias("copies"), F.sum("body_len").cast("long").alias("bytes"))


def topic(spark, sf):
    return R.route(on(spark, sf, "amq.topic"), X.frame(spark, X.QUEUES), X.frame(spark, X.TOPIC), X.frame(spark, X.EXCHANGES))


def route_topic(spark, sf):
    return topic(spark, sf).groupBy("queue").agg(F.count("*").alias("copies"), F.sum("body_len").cast("long").alias("bytes"))


def _headers(spark, sf, rows):
    """rows: queue to its arguments."""
    b = None
    for q, args in rows.items():
        one = spark.sql("select 1").select(F.lit(q).alias("queue"), F.lit("amq.headers").alias("exchange"), F.lit("").alias("routing_key"), args.alias("arguments"))
        b = one if b is None else b.union(one)
    return R.route(on(spark, sf, "amq.headers"), X.frame(spark, X.QUEUES), b, X.frame(spark, X.EXCHANGES)).select("delivery_tag", "queue")


def _args(*items):
    return F.create_map(*[x for k, t, v in items for x in (F.lit(k), typed(t, F.lit(v)))])


def route_headers_all(spark, sf):
    return _headers(spark, sf, {
        "q.click7": _args(("x-match", "S", "all"), ("k", "I", "7"), ("type", "S", "click")),
        "q.k9": _args(("k", "I", "9")),
        "q.long9": _args(("k", "l", "9")),
        "q.text9": _args(("k", "S", "9")),
        "q.absent": _args(("k", "I", "9"), ("other", "S", "x")),
        "q.only": _args(("x-match", "S", "all")),
        "q.empty": F.create_map().cast(TABLE),
    })


def route_headers_any(spark, sf):
    return _headers(spark, sf, {
        "q.either": _args(("x-match", "S", "any"), ("k", "I", "7"), ("type", "S", "error")),
        "q.typed": _args(("x-match", "S", "any"), ("k", "l", "7"), ("type", "S", "signup")),
        "q.none": _args(("x-match", "S", "any"), ("k", "S", "7")),
        "q.odd": _args(("x-match", "S", "ANY"), ("k", "I", "7"), ("type", "S", "error")),
    })


def e2e(spark, sf):
    edges = [(a, b) for a, b, _ in X.XBINDINGS[1]]
    return R.route(on(spark, sf, "x.in"), X.frame(spark, X.QUEUES), X.frame(spark, X.XQUEUES), X.frame(spark, X.EXCHANGES), X.frame(spark, X.XBINDINGS), R.longest_path(edges))


def route_e2e(spark, sf):
    return e2e(spark, sf).select("delivery_tag", "queue")


E2E_SQL = f"""with recursive {MESSAGES_SQL}, {X.sql("exchanges", X.EXCHANGES)}, {X.sql("xb", X.XBINDINGS)}, {X.sql("qb", X.XQUEUES)},
reach(delivery_tag, routing_key, exchange) as (
  select delivery_tag, routing_key, 'x.in' from messages
  union
  select a.delivery_tag, a.routing_key, a.destination from (
    select a.delivery_tag, a.routing_key, b.destination, b.routing_key as pattern, e.kind
    from reach a join xb b on b.source = a.exchange join exchanges e on e.name = b.source join exchanges d on d.name = b.destination) a
  where kind = 'fanout' or (kind = 'direct' and pattern = routing_key) or (kind = 'topic' and {TOPIC_SQL})),
hits as (
  select a.delivery_tag, a.routing_key, b.queue, b.routing_key as pattern, e.kind
  from reach a join qb b on b.exchange = a.exchange join exchanges e on e.name = a.exchange)
select distinct delivery_tag, queue from hits
where kind = 'fanout' or (kind = 'direct' and pattern = routing_key) or (kind = 'topic' and {TOPIC_SQL})"""


def bind_cycle_check(spark, sf):
    """Edges from each nation to the later ones of its region make the graph; candidates are
    all pairs of nations three keys apart, in both directions, and each nation with itself."""
    n = table(spark, sf, "nation")
    name = lambda c: F.concat(F.lit("x"), c.cast("string"))
    a, b = n.alias("a"), n.alias("b")
    nxt = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("b.n_nationkey") > F.col("a.n_nationkey"))).groupBy(F.col("a.n_nationkey").alias("k")).agg(F.min("b.n_nationkey").alias("m"))
    edges = nxt.select(name(F.col("k")).alias("source"), name(F.col("m")).alias("destination"))
    key = F.col("n_nationkey")
    cand = n.select(F.explode(F.array(*[F.struct(name(key).alias("source"), name((key + d) % 25).alias("destination")) for d in (0, 3, 5, 20, 22)])).alias("c")).select("c.*")
    return R.closing_edges(edges, cand, 24)


def missing_exchange(spark, sf):
    m = messages(spark, sf).select("delivery_tag", F.when(F.col("k") < 50, "amq.topic").when(F.col("k") < 60, "x.gone").when(F.col("k") < 70, "").otherwise("nowhere").alias("exchange"))
    return R.missing_exchange(m, X.frame(spark, X.EXCHANGES)).select("delivery_tag", "exchange", "reply_code")


def unroutable_return(spark, sf):
    m = on(spark, sf, "amq.direct")
    r = R.route(m, X.frame(spark, X.QUEUES), X.frame(spark, X.DIRECT), X.frame(spark, X.EXCHANGES))
    return R.unroutable(m, r).select("delivery_tag", "outcome", "reply_code")


def unknown_kind(spark, sf):
    b = X.frame(spark, X.XQUEUES)
    m = on(spark, sf, "x.odd")
    return R.unroutable(m, R.route(m, X.frame(spark, X.QUEUES), b, X.frame(spark, X.EXCHANGES))).groupBy("outcome").agg(F.count("*").alias("messages"))


def targets_per_message(spark, sf):
    return R.targets(topic(spark, sf)).select("delivery_tag", F.array_join("targets", ",").alias("targets"))


def publish_refused(spark, sf):
    m = messages(spark, sf).select("delivery_tag", (F.col("k") % 17 == 0).alias("immediate"), F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"))).alias("claimed_user"), F.concat(F.lit("u"), F.when(F.col("k") % 3 == 0, F.col("user_id") % 10).otherwise(3).cast("string")).alias("connection_user"))
    return R.refused_publish(m).select("delivery_tag", "reply_code")


# ------------------------------------------------------------ topology


def _exchange_log(spark, sf):
    kinds = F.array(*[F.lit(k) for k in R.KINDS])
    return table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.concat_ws("-", "p_brand", F.split("p_type", " ")[0]).alias("name"), F.element_at(kinds, 1 + F.col("p_size") % 2).alias("kind"))


def exchange_declare(spark, sf):
    return D.redeclared(_exchange_log(spark, sf), ["kind"]).groupBy("name").agg(F.min(F.when(F.col("outcome") == "created", F.col("seq"))).alias("created_at"), F.count_if(F.col("outcome") == "same").alias("same"), F.count_if(F.col("outcome") == "mismatch").alias("mismatch"))


PART_SQL = "select p_partkey as seq, p_brand || '-' || split_part(p_type, ' ', 1) as name, case p_size % 2 when 0 then 'direct' else 'fanout' end as kind, p_size, p_retailprice, p_type from part"


def queue_declare(spark, sf):
    log = table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.concat_ws("-", "p_brand", F.split("p_type", " ")[0]).alias("name"), (F.col("p_size") % 3 != 0).alias("durable"), (F.col("p_size") % 5 == 0).alias("auto_delete"), F.lit(False).alias("exclusive"))
    return D.first_declared(log, ["durable", "auto_delete", "exclusive"])


def _topology(spark, sf):
    p = table(spark, sf, "part")
    e = p.groupBy(F.col("p_brand").alias("name")).agg((F.min("p_partkey") % 2 == 0).alias("durable"), (F.max("p_size") % 2 == 0).alias("auto_delete"))
    b = p.select(F.col("p_type").alias("queue"), F.col("p_brand").alias("exchange"), F.col("p_size").alias("size")).groupBy("queue", "exchange").agg(F.max("size").alias("size"))
    return e, b


TOPOLOGY_SQL = """e as (select p_brand as name, min(p_partkey) % 2 = 0 as durable, max(p_size) % 2 = 0 as auto_delete from part group by p_brand),
b as (select p_type as queue, p_brand as exchange, max(p_size) as size from part group by all)"""


def exchange_delete(spark, sf):
    """Deletes the exchanges of which all bindings are small (if-unused looks at the others)."""
    e, b = _topology(spark, sf)
    used = b.where("size >= 50").select(F.col("exchange").alias("name"))
    gone = D.deletable(e.select("name"), used)
    return D.without(b, "exchange", gone).groupBy("exchange").agg(F.count("*").alias("bindings"))


def queue_delete(spark, sf):
    """Deletes queues without consumers (no binding of size 50 to an exchange below Brand#2) and counts what goes with each."""
    _, b = _topology(spark, sf)
    q = b.select(F.col("queue").alias("name")).distinct()
    gone = D.deletable(q, b.where("size >= 50 and exchange < 'Brand#2'").select(F.col("queue").alias("name")))
    ready = table(spark, sf, "part").groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("purged"))
    bindings = b.groupBy(F.col("queue").alias("name")).agg(F.count("*").alias("bindings"))
    return gone.join(ready, "name").join(bindings, "name")


def queue_bind(spark, sf):
    e, b = _topology(spark, sf)
    q = b.where("size >= 40").select(F.col("queue").alias("name")).distinct()
    return D.bind_outcome(b.select("queue", "exchange"), e.where("durable"), q).groupBy("exchange", "outcome").agg(F.count("*").alias("bindings"))


def queue_unbind(spark, sf):
    e, b = _topology(spark, sf)
    return D.auto_deleted(b.where("size < 50"), b.where("size >= 50"), e)


def exchange_bind(spark, sf):
    x = X.frame(spark, X.XBINDINGS).select("source", "destination").union(X.frame(spark, (("source", "destination"), [("", "x.in"), ("x.in", ""), ("x.in", "amq.topic"), ("x.void", "x.in")])))
    e = X.frame(spark, X.EXCHANGES).withColumn("internal", F.col("name").startswith("amq."))
    return D.exchange_bind_outcome(x, e)


EXCHANGE_BIND_SQL = f"""with {X.sql("xb", X.XBINDINGS)}, {X.sql("exchanges", X.EXCHANGES)},
c as (select source, destination from xb union all values ('', 'x.in'), ('x.in', ''), ('x.in', 'amq.topic'), ('x.void', 'x.in'))
select c.source, c.destination, case when c.source = '' or c.destination = '' then 'default exchange' when s.name is null then 'no source'
  when d.name is null then 'no destination' when d.name like 'amq.%' then 'internal destination' else 'bound' end as outcome
from c left join exchanges s on s.name = c.source left join exchanges d on d.name = c.destination"""


def queue_purge(spark, sf):
    m = messages(spark, sf).select(F.col("event_type").alias("queue"), F.col("delivery_tag").alias("seq"), "k")
    return D.purged(m.where("k <> 42").select("queue", "seq"), m.where("k = 42").select("queue", "seq"))


def empty_name_resolved(spark, sf):
    m = messages(spark, sf)
    log = m.select("channel", F.col("delivery_tag").alias("seq"), F.when(F.col("k") % 10 == 0, "declare").otherwise("bind").alias("method"), F.when((F.col("k") % 10 == 0) | (F.col("k") % 4 == 1), F.concat(F.lit("q"), F.col("k").cast("string"))).otherwise("").alias("queue"))
    return D.resolved_names(log).select("channel", "seq", "resolved", "reply_code")


def declare_ok_counts(spark, sf):
    m = messages(spark, sf).select(F.col("event_type").alias("queue"), "channel", "k", "user_id")
    q = m.select(F.concat(F.col("queue"), F.lit("")).alias("name")).distinct().union(spark.sql("select 'idle' as name"))
    return D.declare_ok(q, m.where("k < 30"), m.where("k < 90").select("queue", "channel", "user_id").distinct())


def exclusive_owner(spark, sf):
    m = messages(spark, sf).select(F.concat_ws("-", "event_type", F.col("k").cast("string")).alias("queue"), F.col("delivery_tag").alias("seq"), (F.col("user_id") % 7).alias("connection"))
    return D.exclusive_owner(m)


def durable_bindings(spark, sf):
    e, b = _topology(spark, sf)
    return D.durable_snapshot(e, e, b)["bindings"].groupBy("exchange").agg(F.count("*").alias("bindings"))


def exclusive_consumers(spark, sf):
    m = messages(spark, sf).select(F.concat_ws("-", "event_type", F.col("k").cast("string")).alias("queue"), F.col("user_id").alias("consumer"), F.col("delivery_tag").alias("seq"), (F.col("user_id") % 4 == 0).alias("exclusive"))
    return D.exclusive_consumers(m).groupBy("queue").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))


def reserved_names(spark, sf):
    from flowmill.functions.predicates import is_reserved

    names = X.frame(spark, X.EXCHANGES)
    return names.select("name", F.when(is_reserved(F.col("name")), 403).alias("reply_code"))


def _topic_sql(select: str) -> str:
    return f"""with {MESSAGES_SQL}, {X.sql("bindings", X.TOPIC)},
hits as (select distinct delivery_tag, body_len, queue from (
  select m.*, b.queue, b.routing_key as pattern from messages m, bindings b) where {TOPIC_SQL})
{select}"""


_HEADERS = "select delivery_tag, '{}' as queue from messages where {}"


def _headers_sql(rows: dict[str, str]) -> str:
    return f"with {MESSAGES_SQL} " + " union all ".join(_HEADERS.format(q, c) for q, c in rows.items())


QUERIES = {
    "route_default": (route_default, f"with {MESSAGES_SQL}, {X.sql('queues', X.QUEUES)} select delivery_tag, name as queue from messages join queues on routing_key = name"),
    "route_direct": (route_direct, f"with {MESSAGES_SQL}, {X.sql('b', X.DIRECT)} select distinct delivery_tag, queue from messages m join b on m.routing_key = b.routing_key and b.exchange = 'amq.direct'"),
    "route_fanout": (route_fanout, f"with {MESSAGES_SQL}, {X.sql('b', X.FANOUT)} select queue, count(*) as copies, sum(body_len)::bigint as bytes from messages, (select distinct queue from b where exchange = 'amq.fanout') group by queue"),
    "route_topic": (route_topic, _topic_sql("select queue, count(*) as copies, sum(body_len)::bigint as bytes from hits group by queue")),
    "route_headers_all": (route_headers_all, _headers_sql({"q.click7": "k = 7 and event_type = 'click'", "q.k9": "k = 9", "q.only": "true"})),
    "route_headers_any": (route_headers_any, _headers_sql({"q.either": "k = 7 or event_type = 'error'", "q.typed": "event_type = 'signup'", "q.odd": "k = 7 and event_type = 'error'"})),
    "route_e2e": (route_e2e, E2E_SQL),
    "bind_cycle_check": (bind_cycle_check, """with recursive edges as (
  select 'x' || a.n_nationkey as source, 'x' || min(b.n_nationkey) as destination from nation a join nation b on a.n_regionkey = b.n_regionkey and b.n_nationkey > a.n_nationkey group by a.n_nationkey),
paths(source, destination) as (select * from edges union select p.source, e.destination from paths p join edges e on p.destination = e.source),
c as (select 'x' || n_nationkey as source, 'x' || ((n_nationkey + d) % 25) as destination from nation, (values (0), (3), (5), (20), (22)) as t(d))
select source, destination, source = destination or exists (select 1 from paths p where p.source = c.destination and p.destination = c.source) as refused from c"""),
    "unknown_kind": (unknown_kind, "select case when event_id % 3 = 0 then 'returned' else 'dropped' end as outcome, count(*) as messages from events group by 1"),
    "publish_missing_exchange": (missing_exchange, f"with {MESSAGES_SQL} select delivery_tag, case when k < 60 then 'x.gone' else 'nowhere' end as exchange, 404 as reply_code from messages where k between 50 and 59 or k >= 70"),
    "unroutable_return": (unroutable_return, f"""with {MESSAGES_SQL}, {X.sql('b', X.DIRECT)}
select delivery_tag, case when mandatory then 'returned' else 'dropped' end as outcome, case when mandatory then 312 end as reply_code
from messages where routing_key not in (select routing_key from b where exchange = 'amq.direct')"""),
    "targets_per_message": (targets_per_message, _topic_sql("select delivery_tag, string_agg(queue, ',' order by queue) as targets from hits group by delivery_tag")),
    "publish_refused": (publish_refused, f"""with {MESSAGES_SQL}, p as (
  select delivery_tag, k % 17 = 0 as immediate, case when k % 5 = 0 then '' else 'u' || (user_id % 10) end as c, 'u' || case when k % 3 = 0 then user_id % 10 else 3 end as o from messages)
select delivery_tag, case when immediate then 540 else 406 end as reply_code from p where immediate or (c <> '' and c <> o)"""),
    "exchange_declare": (exchange_declare, f"""with log as ({PART_SQL}), f as (select name, min(seq) as s0, arg_min(kind, seq) as k0 from log group by name)
select name, s0 as created_at, count(*) filter (seq > s0 and kind = k0) as same, count(*) filter (kind <> k0) as mismatch from log join f using (name) group by name, s0"""),
    "queue_declare": (queue_declare, f"""with log as (select *, p_size % 3 <> 0 as durable, p_size % 5 = 0 as auto_delete from ({PART_SQL})),
f as (select name, min(seq) as s0, arg_min(durable, seq) as d0, arg_min(auto_delete, seq) as a0 from log group by name)
select name, s0 as declared_at, d0 as durable, a0 as auto_delete, false as exclusive, count(*) filter (durable <> d0 or auto_delete <> a0) as clashes from log join f using (name) group by all"""),
    "exchange_delete": (exchange_delete, f"with {TOPOLOGY_SQL} select exchange, count(*) as bindings from b where exchange in (select exchange from b where size >= 50) group by exchange"),
    "queue_delete": (queue_delete, f"""with {TOPOLOGY_SQL} select queue as name, (select count(*) from part where p_type = queue) as purged, count(*) as bindings
from b group by queue having count(*) filter (size >= 50 and exchange < 'Brand#2') = 0"""),
    "queue_bind": (queue_bind, f"""with {TOPOLOGY_SQL} select exchange, case when not durable then 'no exchange' when queue in (select queue from b where size >= 40) then 'bound' else 'no queue' end as outcome, count(*) as bindings
from b join e on e.name = b.exchange group by 1, 2"""),
    "queue_unbind": (queue_unbind, f"with {TOPOLOGY_SQL} select name from e where auto_delete and name in (select exchange from b where size < 50) and name not in (select exchange from b where size >= 50)"),
    "exchange_bind": (exchange_bind, EXCHANGE_BIND_SQL),
    "queue_purge": (queue_purge, f"""with {MESSAGES_SQL}, m as (select event_type as queue, delivery_tag as seq, k from messages),
p as (select queue, seq, coalesce(lag(seq) over (partition by queue order by seq), -1) as since from m where k = 42)
select queue, seq, (select count(*) from m where k <> 42 and m.queue = p.queue and m.seq < p.seq and m.seq > p.since) as removed from p"""),
    "empty_name_resolved": (empty_name_resolved, f"""with {MESSAGES_SQL}, l as (
  select channel, delivery_tag as seq, k % 10 = 0 as d, case when k % 10 = 0 or k % 4 = 1 then 'q' || k else '' end as queue from messages),
r as (select *, last_value(case when d then queue end ignore nulls) over (partition by channel order by seq rows between unbounded preceding and 1 preceding) as last from l)
select channel, seq, case when queue <> '' then queue else last end as resolved, case when queue = '' and last is null then 404 end as reply_code from r"""),
    "declare_ok_counts": (declare_ok_counts, f"""with {MESSAGES_SQL} select q.queue, (select count(*) from messages where event_type = q.queue and k < 30) as message_count,
(select count(distinct user_id) from messages where event_type = q.queue and k < 90) as consumer_count from (select distinct event_type as queue from messages union all select 'idle') q"""),
    "exclusive_owner": (exclusive_owner, f"""with {MESSAGES_SQL}, c as (select event_type || '-' || k as queue, delivery_tag as seq, user_id % 7 as connection from messages),
o as (select queue, arg_min(connection, seq) as owner from c group by queue)
select seq, queue, connection, owner, case when connection <> owner then 405 end as reply_code from c join o using (queue)"""),
    "durable_bindings": (durable_bindings, f"with {TOPOLOGY_SQL} select exchange, count(*) as bindings from b join e on e.name = exchange where durable group by exchange"),
    "exclusive_consumers": (exclusive_consumers, f"""with {MESSAGES_SQL}, c as (select event_type || '-' || k as queue, user_id % 4 = 0 as x, delivery_tag as seq from messages),
f as (select queue, min(seq) as s0, arg_min(x, seq) as x0 from c group by queue), r as (select queue, seq = s0 or (not x0 and not x) as ok from c join f using (queue))
select queue, count(*) filter (ok) as accepted, count(*) filter (not ok) as refused from r group by queue"""),
    "reserved_names": (reserved_names, f"with {X.sql('e', X.EXCHANGES)} select name, case when name like 'amq.%' then 403 end as reply_code from e"),
}
