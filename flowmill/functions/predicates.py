"""Scalar rules of the broker as column expressions; no Python runs per row.

A header or argument value is struct<t: string, v: string>: a type tag and canonical text.
Comparing structs keeps typed equality: an int32 5 is neither an int64 5 nor a string "5".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The type of headers and arguments.
TABLE = "map<string,struct<t:string,v:string>>"

# ------------------------------------------------------------ routing


def topic_regex(pattern: Column) -> Column:
    """A topic pattern as a regular expression over topic_subject(): * is one word, # any number.

    Every word, and so every wildcard, brings its own leading dot; that makes `#` match zero
    words without a special case at either end. Empty words are words: "a." does not match "a".
    """
    word = lambda w: (
        F.when(w == "*", F.lit(r"\.[^.]+"))
        .when(w == "#", F.lit(r"(?:\.[^.]+)*"))
        .otherwise(F.concat(F.lit(r"\.\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    )
    return F.when(pattern == "", F.lit("^$")).otherwise(F.concat(F.lit("^"), F.array_join(F.transform(F.split(pattern, r"\."), word), ""), F.lit("$")))


def topic_subject(key: Column) -> Column:
    return F.when(key == "", F.lit("")).otherwise(F.concat(F.lit("."), key))


def topic_match(pattern: Column, key: Column) -> Column:
    return F.regexp(topic_subject(key), topic_regex(pattern))


def has_wildcard(pattern: Column) -> Column:
    return pattern.rlike(r"(^|\.)[*#](\.|$)")


def match_any(args: Column) -> Column:
    """Whether a headers binding wants any of its pairs, and not all."""
    return F.coalesce((args["x-match"]["v"] == "any") & (args["x-match"]["t"] == "S"), F.lit(False))


def headers_match(args: Column, headers: Column) -> Column:
    """x-match any needs one equal header, anything else all; without arguments nothing matches."""
    wanted = F.map_filter(args, lambda k, v: k != "x-match")
    same = lambda e: F.coalesce(headers[e["key"]] == e["value"], F.lit(False))
    return (
        F.when(args.isNull() | (F.size(args) == 0), False)
        .when(F.size(wanted) == 0, True)
        .when(headers.isNull(), False)
        .when(match_any(args), F.exists(F.map_entries(wanted), same))
        .otherwise(F.forall(F.map_entries(wanted), same))
    )


# ------------------------------------------------------------ policies

_INTEGERS = ("b", "B", "s", "u", "I", "i", "l", "L")


def integer_value(x: Column) -> Column:
    """A table value as long; null if it is no integer. Floats count if integral."""
    whole = F.when(x["t"].isin("f", "d"), x["v"].try_cast("double"))
    return F.when(x["t"].isin(*_INTEGERS), x["v"].try_cast("long")).when((whole == F.floor(whole)) & (F.abs(whole) < 2.0**63), whole.cast("long"))


def resolve_policy(args: Column) -> Column:
    """Struct of nullable policy columns, `overflow` drop-head by default, and `error`:
    the first rule that the arguments break."""
    at = lambda k: args[k]
    n = lambda k: integer_value(at(k))
    text = lambda k: F.when(at(k)["t"] == "S", at(k)["v"])
    bad = lambda k, low: at(k).isNotNull() & (n(k).isNull() | (n(k) < low))
    error = (
        F.when(bad("x-message-ttl", 0), "x-message-ttl")
        .when(bad("x-expires", 1), "x-expires")
        .when(at("x-dead-letter-exchange").isNotNull() & text("x-dead-letter-exchange").isNull(), "x-dead-letter-exchange")
        .when(at("x-dead-letter-routing-key").isNotNull() & (text("x-dead-letter-routing-key").isNull() | at("x-dead-letter-exchange").isNull()), "x-dead-letter-routing-key")
        .when(bad("x-max-length", 0), "x-max-length")
        .when(bad("x-max-length-bytes", 0), "x-max-length-bytes")
        .when(at("x-overflow").isNotNull() & ~F.coalesce(text("x-overflow").isin("drop-head", "reject-publish"), F.lit(False)), "x-overflow")
    )
    ok = lambda c: F.when(error.isNull(), c)
    return F.struct(
        ok(n("x-message-ttl")).alias("message_ttl_ms"),
        ok(n("x-expires")).alias("expires_ms"),
        ok(text("x-dead-letter-exchange")).alias("dlx"),
        ok(text("x-dead-letter-routing-key")).alias("dl_rk"),
        ok(n("x-max-length")).alias("max_length"),
        ok(n("x-max-length-bytes")).alias("max_length_bytes"),
        ok(F.coalesce(text("x-overflow"), F.lit("drop-head"))).alias("overflow"),
        error.alias("error"),
    )


# ------------------------------------------------------------ expiry


def epoch_ms(ts: str) -> Column:
    """Milliseconds since 1970 of a zone-less timestamp column, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def message_ttl(expiration: Column) -> Column:
    """A message's own TTL in ms; null if it is malformed or negative."""
    n = F.when(expiration.rlike("^[+-]?[0-9]+$"), expiration.try_cast("long"))
    return F.when(n >= 0, n)


def effective_ttl(expiration: Column, queue_ttl: Column) -> Column:
    """The smaller of both TTLs; null if there is neither."""
    return F.least(message_ttl(expiration), queue_ttl)


def deadline(enqueue_ms: Column, ttl: Column) -> Column:
    return enqueue_ms + ttl


def expired(enqueue_ms: Column, ttl: Column, now_ms: Column) -> Column:
    """The deadline itself is too late; without a deadline never."""
    return F.coalesce(now_ms >= deadline(enqueue_ms, ttl), F.lit(False))


# ------------------------------------------------------------ permissions


def permission_name(name: Column) -> Column:
    """The default exchange is checked under its own name."""
    return F.when(name == "", F.lit("amq.default")).otherwise(name)


def permitted(pattern: Column, name: Column) -> Column:
    """Unanchored; an empty or missing pattern denies."""
    return F.coalesce((pattern != "") & F.regexp(name, pattern), F.lit(False))


def is_reserved(name: Column) -> Column:
    return F.startswith(name, F.lit("amq."))


def is_loopback(ip: Column) -> Column:
    return ip.rlike(r"^127\.|^::1$|^::ffff:127\.")


# ------------------------------------------------------------ alarms and limits

MEMORY, DISK = 1, 2


def alarm_reason(bits: Column) -> Column:
    """P10: the text of a latched alarm (fixed values)."""
    return F.when(bits == MEMORY | DISK, "low on disk & memory").when(bits == MEMORY, "low on memory").when(bits == DISK, "low on disk").otherwise("")


def short_string(text: Column, limit: int = 255) -> Column:
    """At most `limit` bytes of UTF-8, cut between characters.

    The cut falls on the last character start at or before the limit: the first byte left out
    tells by its two upper bits whether it continues a character.
    """
    cut = text
    for n in (limit, limit - 1, limit - 2, limit - 3):
        b = F.conv(F.hex(F.substring(text.cast("binary"), n + 1, 1)), 16, 10).cast("int")
        step = F.when((F.octet_length(text) > n) & (b.bitwiseAND(0xC0) != 0x80), F.substring(text.cast("binary"), 1, n).cast("string"))
        cut = step if n == limit else F.coalesce(cut, step)
    return F.when(F.octet_length(text) <= limit, text).otherwise(cut)


# The optional properties in the order of their presence bits, highest first.
PROPERTIES = ("content_type", "content_encoding", "headers", "delivery_mode", "priority", "correlation_id", "reply_to", "expiration", "message_id", "timestamp", "type", "user_id", "app_id", "cluster_id")


def property_flags(present: dict[str, Column]) -> Column:
    """The bitmap of properties that are there, from bit 15 down. An empty text or table
    and the number 0 count as absent, as does null. present: name to a boolean column."""
    out = F.lit(0)
    for i, name in enumerate(PROPERTIES):
        if name in present:
            out = out + F.when(present[name], 1 << (15 - i)).otherwise(0)
    return out


def negotiated(client: Column, server: Column) -> Column:
    """The smaller limit; 0 is no limit."""
    return F.coalesce(F.least(F.nullif(client, F.lit(0)), F.nullif(server, F.lit(0))), F.lit(0))


def high_water_mark(override: Column, ring: Column, percent: Column, default_ring: int = 262144, default_percent: int = 80) -> Column:
    """An override above 0, else ring * percent / 100 in whole numbers, with defaults for either."""
    size = F.when(ring > 0, ring).otherwise(default_ring)
    pct = F.when(percent > 0, percent).otherwise(default_percent)
    return F.when(override > 0, override).otherwise(F.floor(size * pct / 100).cast("long"))


def settle_flags(octet: Column, method: str) -> Column:
    """The flags of an ack, nack or reject octet; without one a nack or reject requeues."""
    bit = lambda n, absent: F.coalesce(octet.bitwiseAND(1 << n) != 0, F.lit(absent))
    if method == "reject":
        return F.struct(F.lit(False).alias("multiple"), bit(0, True).alias("requeue"))
    return F.struct(bit(0, False).alias("multiple"), (bit(1, True) if method == "nack" else F.lit(False)).alias("requeue"))
