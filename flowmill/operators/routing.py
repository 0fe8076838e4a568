"""Routing: which queues a message reaches.

A binding's predicate depends on its exchange's kind, so bindings are split by kind at plan
time into two joins: direct keys and topic patterns without wildcards are equi-joins on
(exchange, key); fanout, wildcard patterns and headers are one equi-join on exchange with
their predicates side by side. So the messages are read twice, not once a kind. Bindings are
joined without a hint: the optimizer broadcasts them where their size allows. Message bodies never
go through here.

An exchange with very many wildcard or header bindings would compare each of its messages with
each of them, under one join key. `indexed` joins on (exchange, what a match needs) instead: a
pattern's first literal word, else its last one, else its number of words; a header pair. Only
bindings that any message fits are then compared with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.functions.predicates import has_wildcard, headers_match, match_any, topic_regex, topic_subject

KINDS = ("direct", "fanout", "topic", "headers")


def _with_kind(bindings: DataFrame, exchanges: DataFrame, by: str) -> DataFrame:
    return bindings.join(exchanges.select(F.col("name").alias(by), "kind"), by)


ANY = "*"


def _pair_key(e: Column) -> Column:
    return F.concat_ws("\x1f", F.lit("h"), e["key"], e["value"]["t"], e["value"]["v"])


def _word_keys(words: Column) -> list[Column]:
    return [F.concat(F.lit("f."), F.element_at(words, 1)), F.concat(F.lit("l."), F.element_at(words, -1)), F.concat(F.lit("n."), F.size(words).cast("string"))]


def _needed(kind: Column, pattern: Column, args: Column | None) -> Column:
    """What a message must have, one of them at least, for a binding to match."""
    words = F.split(pattern, r"\.")
    wild = lambda w: w.isin("*", "#")
    first, last, count = _word_keys(words)
    topic = F.when(~wild(F.element_at(words, 1)), first).when(~wild(F.element_at(words, -1)), last).when(~F.array_contains(words, "#"), count).otherwise(ANY)
    out = F.when(kind == "topic", F.array(topic))
    if args is not None:
        pairs = F.transform(F.map_entries(F.map_filter(args, lambda k, v: k != "x-match")), _pair_key)
        out = out.when((kind == "headers") & (F.size(pairs) > 0), F.when(match_any(args), pairs).otherwise(F.array(F.array_min(pairs))))
    return out.otherwise(F.array(F.lit(ANY)))


def _offered(messages: DataFrame) -> Column:
    """What a message has."""
    out = F.array(F.lit(ANY), *_word_keys(F.split(messages["routing_key"], r"\.")))
    if "headers" in messages.columns:
        out = F.concat(out, F.coalesce(F.transform(F.map_entries(messages["headers"]), _pair_key), F.array().cast("array<string>")))
    return F.array_distinct(out)


def _by_needs(messages: DataFrame, rest: DataFrame, keep: list[str], target: str) -> DataFrame:
    """The join of matched() by exchange and need. A binding of several needs counts by the least."""
    m = messages.withColumn("_has", F.explode(_offered(messages)))
    args = F.col("_args") if "_args" in rest.columns else None
    b = rest.withColumn("_need", F.explode(_needed(F.col("_kind"), F.col("_pattern"), args)))
    x = m.join(b, (m["exchange"] == b["_from"]) & (m["_has"] == b["_need"]) & _fits(m, b))
    if args is not None and "headers" in messages.columns:
        met = F.filter(F.map_entries(F.map_filter(args, lambda k, v: k != "x-match")), lambda e: F.coalesce(m["headers"][e["key"]] == e["value"], F.lit(False)))
        x = x.where((F.col("_need") == ANY) | (F.col("_kind") != "headers") | ~match_any(args) | (F.col("_need") == F.array_min(F.transform(met, _pair_key))))
    return x.select(*[m[c] for c in keep], F.col("_to").alias(target))


def matched(messages: DataFrame, bindings: DataFrame, exchanges: DataFrame, source: str = "exchange", target: str = "queue", indexed: bool = False) -> DataFrame:
    """messages with each `target` whose binding on its `exchange` matches; once per binding.

    bindings: source, target, routing_key, and arguments where headers exchanges are used. indexed:
    for exchanges with very many wildcard or header bindings.
    """
    b = _with_kind(bindings, exchanges, source)
    args = [F.col("arguments").alias("_args")] if "arguments" in bindings.columns else []
    b = b.select(F.col(source).alias("_from"), F.col(target).alias("_to"), F.col("kind").alias("_kind"), F.col("routing_key").alias("_pattern"), *args)
    here = messages["exchange"] == F.col("_from")
    literal = (F.col("_kind") == "direct") | ((F.col("_kind") == "topic") & ~has_wildcard(F.col("_pattern")))
    keep = [*[messages[c] for c in messages.columns], F.col("_to").alias(target)]
    by_key = messages.join(b.where(literal).select("_from", "_to", "_pattern"), here & (messages["routing_key"] == F.col("_pattern"))).select(*keep)
    rest = b.where(~literal).withColumn("_regex", topic_regex(F.col("_pattern")))
    if indexed:
        return by_key.union(_by_needs(messages, rest, messages.columns, target))
    return by_key.union(messages.join(rest, here & _fits(messages, rest)).select(*keep))


def _fits(messages: DataFrame, b: DataFrame):
    """The predicates of all kinds side by side; an unknown kind fits nothing."""
    key = messages["routing_key"]
    out = F.when(F.col("_kind") == "fanout", True).when(F.col("_kind") == "direct", F.col("_pattern") == key).when(F.col("_kind") == "topic", F.regexp(topic_subject(key), F.col("_regex")))
    if "headers" in messages.columns and "_args" in b.columns:
        out = out.when(F.col("_kind") == "headers", headers_match(F.col("_args"), messages["headers"]))
    return out


def default_exchange(messages: DataFrame, queues: DataFrame) -> DataFrame:
    """The key names the queue, if it exists."""
    return messages.where(F.col("exchange") == "").join(queues.select(F.col("name").alias("queue")), F.col("routing_key") == F.col("queue"))


def longest_path(edges: list[tuple[str, str]]) -> int:
    """Hops of the longest chain of exchange bindings; they form no cycle."""
    depth: dict[str, int] = {}
    after: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)

    def of(x: str, seen: tuple = ()) -> int:
        if x in seen:
            raise ValueError(f"exchange bindings form a cycle through {x}")
        if x not in depth:
            depth[x] = max((1 + of(y, (*seen, x)) for y in after.get(x, ())), default=0)
        return depth[x]

    return max((of(a) for a in after), default=0)


def _next_exchanges(messages: DataFrame, x: DataFrame) -> DataFrame:
    """messages at the exchanges one hop on. There are few edges, so all kinds share one join
    on the source with their predicates side by side, and a hop reads its input once."""
    keep = [F.col("_to").alias(c) if c == "exchange" else messages[c] for c in messages.columns]
    return messages.join(x, (messages["exchange"] == F.col("_from")) & _fits(messages, x)).select(*keep).dropDuplicates(["delivery_tag", "exchange"])


def reached_exchanges(messages: DataFrame, xbindings: DataFrame, exchanges: DataFrame, hops: int) -> DataFrame:
    """Each message at every exchange it gets to, its own first; duplicate paths once.

    The key and headers of the message decide at every hop. hops: longest_path() of the edges.
    """
    x = xbindings.join(exchanges.select(F.col("name").alias("destination")), "destination", "left_semi")
    args = [F.col("arguments").alias("_args")] if "arguments" in xbindings.columns else []
    x = _with_kind(x, exchanges, "source").select(F.col("source").alias("_from"), F.col("destination").alias("_to"), F.col("kind").alias("_kind"), F.col("routing_key").alias("_pattern"), topic_regex(F.col("routing_key")).alias("_regex"), *args)
    level = out = messages
    for _ in range(hops):
        level = _next_exchanges(level, x)
        out = out.union(level)
    return out.dropDuplicates(["delivery_tag", "exchange"]) if hops > 1 else out


def route(messages: DataFrame, queues: DataFrame, bindings: DataFrame, exchanges: DataFrame, xbindings: DataFrame | None = None, hops: int = 0, indexed: bool = False) -> DataFrame:
    """Each message with each queue it reaches, once."""
    own = messages.where(F.col("exchange") != "")
    if xbindings is not None and hops:
        own = reached_exchanges(own, xbindings, exchanges, hops)
    named = matched(own, bindings, exchanges, indexed=indexed).drop("exchange")
    direct = default_exchange(messages, queues).drop("exchange").select(named.columns)
    return named.dropDuplicates(["delivery_tag", "queue"]).union(direct)


def targets(routed: DataFrame) -> DataFrame:
    """The sorted queues of each message that reaches any."""
    return routed.groupBy("delivery_tag").agg(F.sort_array(F.collect_set("queue")).alias("targets"))


def unroutable(messages: DataFrame, routed: DataFrame) -> DataFrame:
    """Messages without a queue; mandatory ones come back with 312, others vanish."""
    lost = messages.join(routed.select("delivery_tag").distinct(), "delivery_tag", "left_anti")
    return lost.withColumn("outcome", F.when(F.col("mandatory"), "returned").otherwise("dropped")).withColumn("reply_code", F.when(F.col("mandatory"), 312))


def missing_exchange(messages: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Publishes to an exchange that does not exist."""
    return messages.where(F.col("exchange") != "").join(exchanges.select(F.col("name").alias("exchange")), "exchange", "left_anti").withColumn("reply_code", F.lit(404))


def refused_publish(publishes: DataFrame) -> DataFrame:
    """A foreign user id (406) and the immediate flag (540); both are validations."""
    code = F.when(F.col("immediate"), 540).when((F.coalesce("claimed_user", F.lit("")) != "") & (F.col("claimed_user") != F.col("connection_user")), 406)
    return publishes.withColumn("reply_code", code).where("reply_code is not null")


def closing_edges(edges: DataFrame, candidates: DataFrame, hops: int) -> DataFrame:
    """Candidates (source, destination) that would close a cycle: a self-binding, or a
    source that its destination already reaches. `hops` bounds the paths of the acyclic edges."""
    paths = edges.select("source", "destination")
    level = paths
    for _ in range(hops - 1):
        level = level.alias("a").join(edges.alias("b"), F.col("a.destination") == F.col("b.source")).select("a.source", "b.destination").distinct()
        paths = paths.union(level)
    back = paths.distinct().select(F.col("source").alias("_from"), F.col("destination").alias("_to"))
    c = candidates.join(back, (F.col("destination") == F.col("_from")) & (F.col("source") == F.col("_to")), "left")
    return c.select("source", "destination", ((F.col("source") == F.col("destination")) | F.col("_from").isNotNull()).alias("refused"))
