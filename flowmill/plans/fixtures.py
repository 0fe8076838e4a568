"""Literal dimensions of the registered queries, as columns and rows: used by Spark and SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.sources.tables import dimension, typed, values_sql

QUEUES = (("name",), [("click.3.2",), ("view.0.1",), ("purchase.5.4",), ("error.1.0",), ("signup.7.3",), ("audit",)])
DIRECT = (("queue", "exchange", "routing_key"), [("q.clicks", "amq.direct", "click.1.1"), ("q.clicks", "amq.direct", "click.2.1"), ("q.mix", "amq.direct", "click.1.1"), ("q.mix", "amq.direct", "error.4.4"), ("q.other", "x.none", "click.1.1")])
FANOUT = (("queue", "exchange", "routing_key"), [("q.a", "amq.fanout", ""), ("q.b", "amq.fanout", "ignored"), ("q.b", "amq.fanout", "also"), ("q.c", "x.other", "")])
TOPIC = (
    ("queue", "exchange", "routing_key"),
    [("q.all", "amq.topic", "#"), ("q.errors", "amq.topic", "error.#"), ("q.errors", "amq.topic", "*.*.0"), ("q.mid", "amq.topic", "*.3.*"), ("q.exact", "amq.topic", "view.0.1"), ("q.tail", "amq.topic", "#.4"), ("q.never", "amq.topic", "*.*"), ("q.two", "amq.topic", "signup.#.2.#")],
)
EXCHANGES = (("name", "kind"), [("", "direct"), ("amq.direct", "direct"), ("amq.fanout", "fanout"), ("amq.topic", "topic"), ("amq.headers", "headers"), ("x.in", "topic"), ("x.errors", "fanout"), ("x.sales", "direct"), ("x.last", "fanout"), ("x.odd", "random")])
XBINDINGS = (("source", "destination", "routing_key"), [("x.in", "x.errors", "error.#"), ("x.in", "x.sales", "purchase.*.*"), ("x.errors", "x.last", ""), ("x.sales", "x.last", "purchase.1.1"), ("x.in", "x.last", "*.9.*"), ("x.in", "x.gone", "#")])
XQUEUES = (("queue", "exchange", "routing_key"), [("q.in", "x.in", "view.#"), ("q.err", "x.errors", ""), ("q.sale", "x.sales", "purchase.1.1"), ("q.sale", "x.sales", "purchase.2.2"), ("q.last", "x.last", ""), ("q.odd", "x.odd", "#")])
#: Per event type: time to live, dead-letter exchange and key, limits.
POLICIES = (
    ("queue", "message_ttl_ms", "dlx", "dl_rk", "max_length", "max_length_bytes"),
    [("click", 40000, "x.dead", None, 25, 400000), ("error", None, "x.dead", "dead.error", 10, None), ("view", 5000, None, None, None, 250000), ("purchase", None, "x.dead", None, 3, None), ("signup", 0, "x.late", "late", None, 120000)],
)
PERMISSIONS = (
    ("username", "vhost", "configure", "write", "read"),
    [("u0", "/", ".*", ".*", ".*"), ("u1", "/", "^$", "^click", "view"), ("u2", "/", "", "amq[.]default", ".*"), ("u3", "/", "^q[.]", "^(amq[.]topic|q[.].*)$", "^amq[.]"), ("u4", "/other", ".*", ".*", ".*"), ("u5", "/", "^u5-", "^u5-", "^u5-")],
)


def frame(spark: SparkSession, fixture) -> DataFrame:
    return dimension(spark, *fixture)


def sql(name: str, fixture) -> str:
    """A `with` entry: name as (select ...)."""
    return f"{name} as ({values_sql(*fixture)})"


def policies(spark: SparkSession) -> DataFrame:
    return frame(spark, POLICIES).select("queue", F.col("message_ttl_ms").cast("long").alias("message_ttl_ms"), "dlx", "dl_rk", F.col("max_length").cast("long").alias("max_length"), F.col("max_length_bytes").cast("long").alias("max_length_bytes"))


def arguments(**values):
    """A table column: key to (type, value) literals."""
    items = []
    for k, (t, v) in values.items():
        items += [F.lit(k.replace("_", "-")), typed(t, F.lit(v))]
    return F.create_map(*items)
