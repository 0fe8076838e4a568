"""Closed forms against plain simulations, and cases that the big queries do not reach."""

import random

import pytest
from pyspark.sql import functions as F

from flowmill.operators import confirms, limits, routing, settle
from flowmill.sources.text import load_config


def logs(n=40, seed=1):
    r = random.Random(seed)
    return [(f"q{i}", t, r.choice([0, 1, 5, 10, 30])) for i in range(n) for t in sorted(r.sample(range(100), r.randint(1, 25)))]


def by_queue(rows):
    out: dict = {}
    for q, t, b in rows:
        out.setdefault(q, []).append((t, b))
    return out


@pytest.mark.parametrize(("n", "size"), [(0, None), (1, None), (3, None), (None, 0), (None, 10), (None, 50), (3, 20)])
def test_drop_head(spark, n, size):
    rows = logs()
    want = set()
    for q, items in by_queue(rows).items():
        ready: list = []
        for t, b in items:
            ready.append((t, b))
            while ready and ((n is not None and len(ready) > n) or (size is not None and sum(x[1] for x in ready) > size and len(ready) > 1)):
                ready.pop(0)
        want |= {(q, t) for t, _ in ready}
    df = spark.createDataFrame(rows, "queue string, tag long, body_len long")
    got = limits.kept_by_drop_head(df, None if n is None else F.lit(n), None if size is None else F.lit(size))
    assert {(r.queue, r.tag) for r in got.collect()} == want


@pytest.mark.parametrize("size", [0, 10, 50])
def test_eviction_points_by_bytes(spark, size):
    rows = logs(seed=2)
    want = set()
    for q, items in by_queue(rows).items():
        ready: list = []
        for t, b in items:
            ready.append((t, b))
            while sum(x[1] for x in ready) > size and len(ready) > 1:
                want.add((q, ready.pop(0)[0], t))
    df = spark.createDataFrame(rows, "queue string, tag long, body_len long")
    assert {(r.queue, r.tag, r.evicted_by) for r in limits.evicted_by_bytes(df, size).collect()} == want


def test_reject_publish_bytes_may_overshoot(spark):
    df = spark.createDataFrame([("q", 1, 5), ("q", 2, 10), ("q", 3, 1)], "queue string, tag long, body_len long")
    assert [r.accepted for r in limits.reject_publish_bytes(df, 10).orderBy("tag").collect()] == [True, True, False]
    assert [r.accepted for r in limits.reject_publish_count(df, 0).orderBy("tag").collect()] == [False] * 3


def test_watermark_and_answers(spark):
    done = spark.createDataFrame([(1, t) for t in (1, 2, 3, 5)] + [(2, 2)], "channel int, tag long")
    assert {(r.channel, r.watermark) for r in confirms.watermark(done).collect()} == {(1, 3), (2, 0)}
    out = spark.createDataFrame([(1, t, t not in (1, 4)) for t in range(1, 7)], "channel int, tag long, ok boolean")
    got = {(r.tag, r.answer, r.multiple) for r in confirms.settled_answers(out).collect()}
    assert got == {(1, "nack", False), (3, "ack", True), (4, "nack", False), (6, "ack", True)}


def test_latch_needs_hysteresis(spark):
    with pytest.raises(ValueError):
        confirms.alarms(spark.range(1), 1.0, 1.0, 0.0)


def test_cycles():
    assert routing.longest_path([("a", "b"), ("b", "c"), ("a", "c")]) == 2
    with pytest.raises(ValueError):
        routing.longest_path([("a", "b"), ("b", "a")])


def test_fold_orders_requeued_first_and_gates_prefetch(spark):
    log = [(1, "publish", 1, None), (2, "publish", 2, None), (3, "claim", None, "c"), (4, "claim", None, "c"), (5, "requeue", 1, "c"), (6, "publish", 3, None), (7, "publish", 4, None), (8, "claim", None, "c"), (9, "ack", 1, "c"), (10, "ack", 1, "c"), (11, "claim", None, "c"), (12, "claim", None, "d")]
    df = spark.createDataFrame([("q", s, a, t, c) for s, a, t, c in log], "queue string, seq long, action string, tag long, consumer string")
    got = [(r.seq, r.outcome, r.tag) for r in settle.queue_fold(df, 2, "drop-head", 1).orderBy("seq", "outcome").collect()]
    assert got == [(1, "accepted", 1), (2, "accepted", 2), (3, "delivered", 1), (4, "blocked", None), (5, "requeued", 1), (6, "accepted", 3), (6, "evicted", 1), (7, "accepted", 4), (7, "evicted", 2), (8, "delivered", 3), (9, "late", 1), (10, "late", 1), (11, "blocked", None), (12, "delivered", 4)]


def test_indexed_bindings_match_alike(spark):
    """Wildcards and header pairs by what they need: the same copies, once per binding."""
    r = random.Random(4)
    word = lambda: r.choice(["a", "b", "c", "x1", ""])
    pair = lambda: (r.choice("klm"), r.choice(["I", "S"]), str(r.randint(0, 2)))
    kind = "map<string,struct<t:string,v:string>>"
    table = lambda ps: {k: (t, v) for k, t, v in ps}
    m = [(i, r.choice(["t", "h", "f", "odd"]), ".".join(word() for _ in range(r.randint(0, 4))), table(pair() for _ in range(r.randint(0, 3))) if i % 7 else None) for i in range(300)]
    b = [(f"q{i}", "t", ".".join(r.choice(["*", "#", "a", "b", "c", ""]) for _ in range(r.randint(1, 4))), None) for i in range(60)]
    b += [(f"h{i}", "h", "", {**table(pair() for _ in range(r.randint(0, 3))), **({"x-match": ("S", r.choice(["any", "all"]))} if i % 3 else {})}) for i in range(60)]
    b += [("none", "h", "", None), ("f1", "f", "x", None), ("odd", "odd", "#", None)]
    messages = spark.createDataFrame(m, f"delivery_tag long, exchange string, routing_key string, headers {kind}")
    bindings = spark.createDataFrame(b, f"queue string, exchange string, routing_key string, arguments {kind}")
    exchanges = spark.createDataFrame([("t", "topic"), ("h", "headers"), ("f", "fanout"), ("odd", "random")], "name string, kind string")
    cols = lambda x: sorted((c.delivery_tag, c.queue) for c in x.collect())
    plain = cols(routing.matched(messages, bindings, exchanges))
    assert plain and cols(routing.matched(messages, bindings, exchanges, indexed=True)) == plain


class Queue:
    """A plain queue with limits, one step at a time: messages in the order in which they would be claimed."""

    def __init__(self, max_length, max_bytes, overflow, prefetch):
        self.limits = max_length, max_bytes
        self.overflow, self.prefetch = overflow, prefetch
        self.waiting, self.unacked, self.size = [], {}, {}

    def bytes(self):
        return sum(self.size[t] for _, _, t in self.waiting)

    def step(self, seq, action, tag, consumer, body):
        longest, largest = self.limits
        if action == "publish":
            if self.overflow == "reject-publish" and (longest is not None and len(self.waiting) >= longest or largest is not None and self.bytes() >= largest):
                return [("refused", tag)]
            self.size[tag] = body
            self.waiting.append((1, tag, tag))
            out = [("accepted", tag)]
            while self.overflow == "drop-head" and (longest is not None and len(self.waiting) > longest or largest is not None and self.bytes() > largest and len(self.waiting) > 1):
                out.append(("evicted", self.pop()))
            return out
        if action == "claim":
            if self.prefetch and sum(c == consumer for c in self.unacked.values()) >= self.prefetch:
                return [("blocked", None)]
            if not self.waiting:
                return [("empty", None)]
            t = self.pop()
            self.unacked[t] = consumer
            return [("delivered", t)]
        if self.unacked.pop(tag, None) is None:
            return [("late", tag)]
        if action == "requeue":
            self.waiting.append((0, seq, tag))
        return [({"ack": "acked", "requeue": "requeued"}.get(action, "discarded"), tag)]

    def pop(self):
        first = min(self.waiting)
        self.waiting.remove(first)
        return first[2]


@pytest.mark.parametrize(("length", "size", "overflow", "prefetch"), [(None, None, "drop-head", 0), (3, None, "drop-head", 2), (3, None, "reject-publish", 0), (None, 40, "drop-head", 3), (None, 40, "reject-publish", 0), (4, 30, "drop-head", 1), (4, 30, "reject-publish", 2), (0, 0, "drop-head", 0)])
def test_fold_against_a_simulation(spark, length, size, overflow, prefetch):
    r = random.Random(11)
    log, want = [], []
    for q in ("a", "b", "c"):
        sim, tag = Queue(length, size, overflow, prefetch), 0
        for seq in range(300):
            action = r.choices(["publish", "claim", "ack", "requeue", "discard"], [5, 4, 1, 1, 1])[0]
            if action == "publish":
                tag += 1
            of = tag if action == "publish" else None if action == "claim" else r.randint(max(1, tag - 8), tag + 1)
            row = (seq, action, of, r.choice("xy"), r.choice([0, 1, 10, 25, 60]))
            log.append((q, *row))
            want += [(q, seq, *x) for x in sim.step(*row)]
    r.shuffle(log)
    df = spark.createDataFrame(log, "queue string, seq long, action string, tag long, consumer string, body_len long")
    got = [tuple(x) for x in settle.queue_fold(df, length, overflow, prefetch, size).collect()]
    order = lambda x: (x[0], x[1], x[2], -1 if x[3] is None else x[3])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"ring_size": 10, "other": 1}')
    c = load_config(str(p), {"FLOWMILL_HYSTERESIS": "0.2"})
    assert (c.ring_size, c.hysteresis, c.extra) == (10, 0.2, {"other": 1})
    with pytest.raises(ValueError):
        load_config(None, {"FLOWMILL_SPILL_PERCENT": "0"})
