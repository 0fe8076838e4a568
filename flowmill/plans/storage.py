"""Registered queries of listings, exchange unbinding, storage tiers, get settles and scraped metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.functions import predicates as P
from flowmill.operators import log as L
from flowmill.operators import metrics as G
from flowmill.operators import routing as R
from flowmill.operators import settle as A
from flowmill.operators import topology as D
from flowmill.operators.ordered import ranked
from flowmill.plans import fixtures as X
from flowmill.plans.flows import LOGGED_SQL, M, _logged
from flowmill.plans.queues import DELIVERIES_SQL, QM, deliveries, queued, settles
from flowmill.plans.routing import TOPOLOGY_SQL, _topology
from flowmill.sources.tables import dimension, messages

# ------------------------------------------------------------ listings and topology


def _held(spark, sf):
    m = queued(spark, sf)
    return m.where("k < 30"), m.where("k >= 60"), m.select("queue", F.col("user_id").alias("consumer")).distinct()


def list_queues(spark, sf):
    ready, unacked, consumers = _held(spark, sf)
    names = messages(spark, sf).select(F.col("event_type").alias("name")).distinct().union(spark.sql("select 'idle' as name"))
    bindings = messages(spark, sf).select(F.col("event_type").alias("queue"), "routing_key").distinct()
    return D.listed_queues(names, ready, unacked, consumers, bindings)


LIST_QUEUES_SQL = f"""{QM}, n as (select distinct queue from m union all select 'idle')
select n.queue, (select count(*) from m where m.queue = n.queue and k < 30) as ready, (select count(*) from m where m.queue = n.queue and k >= 60) as unacked,
  (select count(distinct user_id) from m where m.queue = n.queue) as consumers, (select count(distinct routing_key) from messages where event_type = n.queue) as bindings from n"""


def list_exchanges(spark, sf):
    e, b = _topology(spark, sf)
    edges = b.where("size >= 50").select(F.col("exchange").alias("source"), F.col("queue").alias("destination"))
    return D.listed_exchanges(e, b, edges)


LIST_EXCHANGES_SQL = f"""with {TOPOLOGY_SQL} select e.*, (select count(*) from b where exchange = name) as queues, (select count(*) from b where exchange = name and size >= 50) as exchanges from e"""


def list_consumers(spark, sf):
    _, unacked, consumers = _held(spark, sf)
    return D.listed_consumers(consumers, unacked.withColumnRenamed("user_id", "consumer"))


LIST_CONSUMERS_SQL = f"{QM} select queue, user_id as consumer, count(*) filter (k >= 60) as unacked from m group by all"


def predeclared(spark, sf):
    return D.predeclared(spark)


def server_names(spark, sf):
    names = messages(spark, sf).select("delivery_tag", D.server_name(F.col("delivery_tag")).alias("name"))
    return names.select("delivery_tag", "name", P.is_reserved(F.col("name")).alias("reserved"))


UNBINDS = (("source", "destination", "routing_key"), [("x.in", "x.errors", "error.#"), ("x.sales", "x.last", "purchase.1.1"), ("x.in", "x.last", "not.there"), ("x.errors", "x.last", "")])


def exchange_unbind(spark, sf):
    """Exchange bindings left by some unbinds, and the sources that lost their last one."""
    edges, unbinds = X.frame(spark, X.XBINDINGS), X.frame(spark, UNBINDS)
    left = D.exchange_unbound(edges, unbinds)
    gone = edges.select("source").distinct().join(left, "source", "left_anti")
    return left.withColumn("state", F.lit("bound")).unionByName(gone.select("source", F.lit(None).cast("string").alias("destination"), F.lit(None).cast("string").alias("routing_key"), F.lit("unused").alias("state")))


EXCHANGE_UNBIND_SQL = f"""with {X.sql("x", X.XBINDINGS)}, {X.sql("u", UNBINDS)}, l as (select * from x where (source, destination, routing_key) not in (select (source, destination, routing_key) from u))
select *, 'bound' as state from l union all select distinct source, null, null, 'unused' from x where source not in (select source from l)"""

CANDIDATES = (("source", "destination"), [("x.last", "x.in"), ("x.last", "x.sales"), ("x.errors", "x.sales"), ("x.in", "x.in"), ("x.odd", "x.in"), ("", "x.in"), ("x.sales", "amq.fanout")])


def exchange_bind_cycle(spark, sf):
    """Outcomes of exchange bindings, those that would close a cycle included."""
    names = {r[0] for r in X.EXCHANGES[1]}
    edges = [(a, b) for a, b, _ in X.XBINDINGS[1] if b in names]
    e = X.frame(spark, X.EXCHANGES).withColumn("internal", F.col("name").startswith("amq."))
    return D.exchange_bind_outcome(X.frame(spark, CANDIDATES), e, dimension(spark, ("source", "destination"), edges), R.longest_path(edges))


EXCHANGE_BIND_CYCLE_SQL = f"""with recursive {X.sql("xb", X.XBINDINGS)}, {X.sql("exchanges", X.EXCHANGES)}, {X.sql("c", CANDIDATES)},
r as (select source, destination from xb where destination in (select name from exchanges) union select r.source, xb.destination from r join xb on r.destination = xb.source where xb.destination in (select name from exchanges))
select c.source, c.destination, case when c.source = '' or c.destination = '' then 'default exchange' when s.name is null then 'no source' when d.name is null then 'no destination' when d.name like 'amq.%' then 'internal destination'
  when c.source = c.destination or exists (select 1 from r where r.source = c.destination and r.destination = c.source) then 'cycle' else 'bound' end as outcome
from c left join exchanges s on s.name = c.source left join exchanges d on d.name = c.destination"""


def durable_topology(spark, sf):
    """What a restart finds again, by kind."""
    e, b = _topology(spark, sf)
    parts = D.durable_snapshot(e, e.withColumn("durable", F.col("auto_delete")), b)
    out = [df.agg(F.lit(k).alias("kind"), F.count("*").alias("entities")) for k, df in parts.items()]
    return out[0].union(out[1]).union(out[2])


DURABLE_SQL = f"""with {TOPOLOGY_SQL} select 'exchanges' as kind, count(*) as entities from e where durable union all select 'queues', count(*) from e where auto_delete
union all select 'bindings', count(*) from b join e on e.name = exchange where durable"""


def alarm_reasons(spark, sf):
    m = messages(spark, sf)
    return m.groupBy(P.alarm_reason((F.col("k") % 4).cast("int")).alias("reason")).agg(F.count("*").alias("samples"))


def property_flags_all(spark, sf):
    """All fourteen bits: property i of a message is there if bit i of its tag is set."""
    m = messages(spark, sf)
    bit = lambda i: F.col("delivery_tag").bitwiseAND(1 << i) != 0
    flags = P.property_flags({name: bit(i) for i, name in enumerate(P.PROPERTIES)})
    return m.select("delivery_tag", flags.cast("int").alias("flags"))


FLAGS_ALL_SQL = f"""{M} select delivery_tag, ({" + ".join(f"case when delivery_tag & {1 << i} <> 0 then {1 << (15 - i)} else 0 end" for i in range(14))})::integer as flags from messages"""

# ------------------------------------------------------------ storage


def durable_write(spark, sf):
    """Where messages go when the ring is full at 150: every third publish is taken at once."""
    w = ranked(queued(spark, sf), ["queue"], "tag", "n").join(messages(spark, sf).select(F.col("delivery_tag").alias("tag"), "delivery_mode"), "tag")
    w = w.withColumn("durable", F.col("delivery_mode") == 2).withColumn("depth", F.col("n") - 1 - F.floor(F.col("n") / 3))
    return L.placed(w, 150).groupBy("queue", "stored").agg(F.count("*").alias("messages"), F.max("tag").alias("last"))


DURABLE_WRITE_SQL = f"""{M}, w as (select event_type as queue, delivery_tag as tag, delivery_mode = 2 as durable, row_number() over (partition by event_type order by delivery_tag) as n from messages),
p as (select *, case when durable and n - 1 - n // 3 < 150 then 'log and ring' when durable or n - 1 - n // 3 >= 150 then 'log' else 'ring' end as stored from w)
select queue, stored, count(*) as messages, max(tag) as last from p group by all"""


def async_visible(spark, sf):
    m = messages(spark, sf).select(F.col("channel").alias("writer"), F.col("delivery_tag").alias("seq"), "k")
    return L.async_visible(m.select("writer", "seq"), m.where("k = 7"))


ASYNC_SQL = f"""{M}, x as (select channel as writer, delivery_tag as seq, min(case when k = 7 then delivery_tag end) over (partition by channel order by delivery_tag rows between current row and unbounded following) as visible_at from messages)
select writer, seq, visible_at, visible_at is not null as durable from x"""


def point_read(spark, sf):
    """Tags that are multiples of 7, looked up in the ring (the newest), the log and the segments."""
    logged, _, seg = _logged(spark, sf)
    asked = queued(spark, sf).where("tag % 7 = 0")
    ring = queued(spark, sf).where("k < 20")
    return L.point_read(asked, {"ring": ring, "log": logged, "segment": seg})


POINT_SQL = f"""{LOGGED_SQL}, t as (select event_type as queue, delivery_tag as tag, body_len, 0 as r, 'ring' as tier from messages where k < 20 union all select queue, tag, body_len, 1, 'log' from logged union all select queue, tag, body_len, 2, 'segment' from seg)
select queue, tag, arg_min(tier, r) as tier, arg_min(body_len, r) as body_len from t where tag % 7 = 0 group by all"""


def wal_retention(spark, sf):
    """Files that outlive the retention after a checkpoint go, whatever is unacked in them."""
    logged, acked, _ = _logged(spark, sf)
    ages = logged.select("file").distinct().withColumn("checkpointed", F.col("file") % 2 == 0).withColumn("age_ms", F.col("file") * 1000)
    return L.reclaimable(logged, acked, ages, 4000).select("file", "records", "acked", "reclaimable")


RETENTION_SQL = f"{LOGGED_SQL} select file, count(*) as records, count(*) filter (tag in (select tag from acked)) as acked, count(*) = count(*) filter (tag in (select tag from acked)) or (file % 2 = 0 and file * 1000 > 4000) as reclaimable from logged group by file"

# ------------------------------------------------------------ gets and metrics


def get_settles(spark, sf):
    """Deliveries of basic.get; channels 1 and 3 are torn down in the end."""
    g = deliveries(spark, sf).where("is_get and not no_ack")
    s = settles(spark, sf).where("not multiple")
    return A.gets_settled(g, s, dimension(spark, ("channel",), [(1,), (3,)])).groupBy("channel", "state").agg(F.count("*").alias("messages"), F.max("tag").alias("last"))


GET_SQL = f"""{DELIVERIES_SQL}, w as (select channel, wire_tag, arg_min(action, seq) as a, arg_min(requeue, seq) as r from s where not multiple group by all)
select channel, case when a = 'ack' then 'acked' when r then 'requeued' when a is not null then 'discarded' when channel in (1, 3) then 'requeued at teardown' else 'unacked' end as state, count(*) as messages, max(tag) as last
from d left join w using (channel, wire_tag) where is_get and not no_ack group by all"""


def metric_samples(spark, sf):
    """Counters of each queue as a scrape every hour sees them."""
    m = messages(spark, sf).select(F.col("event_type").alias("queue"), F.col("published_at").alias("ts"), "body_len")
    s = G.scraped(m, ["queue"], {"messages": F.lit(1), "bytes": F.col("body_len")}, 3600)
    return s.select("queue", "name", F.unix_seconds("ts").alias("at"), "value")


SAMPLES_SQL = f"""{M}, h as (select event_type as queue, (epoch_us(published_at) // 3600000000 + 1) * 3600 as at_s, count(*) as n, sum(body_len) as b from messages group by all),
c as (select queue, at_s, sum(n) over w as n, sum(b) over w as b from h window w as (partition by queue order by at_s))
select queue, 'messages' as name, at_s::bigint as "at", n::double as value from c union all select queue, 'bytes', at_s::bigint, b::double from c"""


QUERIES = {
    "list_queues": (list_queues, LIST_QUEUES_SQL),
    "list_exchanges": (list_exchanges, LIST_EXCHANGES_SQL),
    "list_consumers": (list_consumers, LIST_CONSUMERS_SQL),
    "predeclared": (predeclared, "select * from (values ('', 'direct'), ('amq.direct', 'direct'), ('amq.fanout', 'fanout'), ('amq.topic', 'topic'), ('amq.headers', 'headers')) as t(name, kind)"),
    "server_names": (server_names, f"{M} select delivery_tag, 'amq.gen.' || substr(sha256(':' || delivery_tag), 1, 32) as name, true as reserved from messages"),
    "exchange_unbind": (exchange_unbind, EXCHANGE_UNBIND_SQL),
    "exchange_bind_cycle": (exchange_bind_cycle, EXCHANGE_BIND_CYCLE_SQL),
    "durable_topology": (durable_topology, DURABLE_SQL),
    "alarm_reasons": (alarm_reasons, f"{M} select case k % 4 when 3 then 'low on disk & memory' when 1 then 'low on memory' when 2 then 'low on disk' else '' end as reason, count(*) as samples from messages group by 1"),
    "property_flags_all": (property_flags_all, FLAGS_ALL_SQL),
    "durable_write": (durable_write, DURABLE_WRITE_SQL),
    "async_visible": (async_visible, ASYNC_SQL),
    "point_read": (point_read, POINT_SQL),
    "wal_retention": (wal_retention, RETENTION_SQL),
    "get_settles": (get_settles, GET_SQL),
    "metric_samples": (metric_samples, SAMPLES_SQL),
}
