import pytest
from pyspark.sql import functions as F

from flowmill.functions import predicates as P

TOPIC = [
    ("a.b", "a.b", True), ("a.b", "a.c", False), ("a.b", "a", False), ("a", "a.b", False), ("", "", True), ("", "a", False), ("a", "", False),
    ("#", "", True), ("#", "a", True), ("#", "a.b.c", True), ("*", "", False), ("*", "a", True), ("*", "a.b", False), ("*.*", "a.b", True), ("*.*", "a", False),
    ("#.a", "a", True), ("#.a", "x.y.a", True), ("#.a", "a.x", False), ("a.#", "a", True), ("a.#", "a.b.c", True), ("a.#", "b", False), ("a.#.c", "a.c", True), ("a.#.c", "a.b.b.c", True), ("a.#.c", "a.b", False),
    ("*.#", "a", True), ("*.#", "", False), ("#.*", "a.b", True), ("#.#", "", True), ("#.#", "a.b.c", True), ("a.*.c", "a.b.c", True), ("a.*.c", "a.c", False), ("a.*.#.d", "a.b.d", True), ("a.*.#.d", "a.d", False),
    ("a+b.(c", "a+b.(c", True), ("a.b", "axb", False), ("a#", "ab", False), ("a#", "a#", True), ("a*.b", "a*.b", True), ("x\\Ey.b", "x\\Ey.b", True), ("a", "a.", False),
]


def test_topic(spark):
    df = spark.createDataFrame(TOPIC, "p string, k string, want boolean")
    assert df.where(P.topic_match(F.col("p"), F.col("k")) != F.col("want")).collect() == []


def table(**items):
    return {k.replace("_", "-"): v for k, v in items.items()}


S, I, L = (lambda v: ("S", v)), (lambda v: ("I", v)), (lambda v: ("l", v))
HEADERS = [
    (table(x_match=S("all"), a=S("1"), b=I("2")), table(a=S("1"), b=I("2")), True),
    (table(x_match=S("all"), a=S("1"), b=I("2")), table(a=S("1")), False),
    (table(a=S("1"), b=I("2")), table(a=S("1"), b=I("2"), c=S("x")), True),
    (table(a=S("1")), table(a=S("2")), False),
    (table(x_match=S("any"), a=S("1"), b=I("2")), table(b=I("2")), True),
    (table(x_match=S("any"), a=S("1")), table(c=S("1")), False),
    (table(a=I("5")), table(a=L("5")), False),
    (table(a=I("5")), table(a=S("5")), False),
    (table(x_match=S("odd"), a=S("1"), b=S("2")), table(a=S("1")), False),
    (table(x_match=S("all")), table(), True),
    (table(x_match=S("any")), None, True),
    (table(a=S("1")), None, False),
    ({}, table(a=S("1")), False),
    (None, table(a=S("1")), False),
]


def test_headers(spark):
    df = spark.createDataFrame(HEADERS, f"a {P.TABLE}, h {P.TABLE}, want boolean")
    assert df.where(P.headers_match(F.col("a"), F.col("h")) != F.col("want")).collect() == []


TTL = [(None, None, None), ("5", None, 5), (None, 7, 7), ("5", 7, 5), ("9", 7, 7), ("7", 7, 7), ("0", 7, 0), ("x", 7, 7), ("-1", 7, 7), (" 5", None, None), ("5.5", None, None), ("+5", None, 5), ("99999999999999999999", 7, 7)]


def test_ttl(spark):
    df = spark.createDataFrame(TTL, "e string, q long, want long")
    assert df.where(~P.effective_ttl(F.col("e"), F.col("q")).eqNullSafe(F.col("want"))).collect() == []


@pytest.mark.parametrize(("now", "want"), [(99, False), (100, True), (101, True)])
def test_deadline_is_too_late(spark, now, want):
    assert spark.range(1).select(P.expired(F.lit(60), F.lit(40), F.lit(now))).first()[0] is want


def test_no_deadline(spark):
    assert spark.range(1).select(P.expired(F.lit(None).cast("long"), F.lit(0), F.lit(9))).first()[0] is False


PERMISSIONS = [("", "x", False), (None, "x", False), ("^$", "x", False), ("^$", "", True), (".*", "x", True), ("b", "abc", True), ("^b", "abc", False)]


def test_permissions(spark):
    df = spark.createDataFrame(PERMISSIONS, "p string, n string, want boolean")
    assert df.where(P.permitted(F.col("p"), F.col("n")) != F.col("want")).collect() == []


def test_short_string_cuts_between_characters(spark):
    texts = ["a" * 255, "a" * 256, "é" * 128, "a" + "é" * 127, "a" * 254 + "é", "€" * 85 + "x", "😀" * 64, "a" * 253 + "😀", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.short_string(F.col("t")).alias("s"))
    for t, s in df.collect():
        want = t.encode()[:255].decode(errors="ignore")
        assert s == want


def test_integers(spark):
    cases = [("I", "5", 5), ("d", "5.0", 5), ("d", "5.5", None), ("L", "18446744073709551615", None), ("S", "5", None), ("t", "1", None), ("d", "NaN", None), ("d", "1e300", None)]
    df = spark.createDataFrame([((t, v), w) for t, v, w in cases], "x struct<t:string,v:string>, want long")
    assert df.where(~P.integer_value(F.col("x")).eqNullSafe(F.col("want"))).collect() == []
