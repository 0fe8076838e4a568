"""Queries whose result must cover every message, against plain simulations of the whole log."""

import json
import re

import pyarrow.parquet as pq
import pytest

from flowmill.operators.authz import OPERATIONS
from flowmill.plans import fixtures, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log():
    """tag, event, k, user, bytes and milliseconds of every message, by tag."""
    events = pq.read_table(f"{SF}/events.parquet").sort_by("event_id").to_pylist()
    return [(e["event_id"] + 1, e["event_type"], json.loads(e["props"])["k"], e["user_id"], round(e["value"] * 100), int(e["ts"].timestamp() * 1000)) for e in events]


def result(spark, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in registry.queries()[name](spark, SF).collect())


def test_eviction_points_by_bytes_of_the_whole_log(spark, log):
    ready: dict = {}
    want = []
    for tag, queue, _, _, size, _ in log:
        q = ready.setdefault(queue, [])
        q.append((tag, size))
        while sum(b for _, b in q) > 90_000 and len(q) > 1:
            want.append((queue, q.pop(0)[0], tag))
    assert want and result(spark, "drop_head_eviction_point_bytes", "queue", "tag", "evicted_by") == sorted(want)


def test_idle_expiry_counts_every_touch(spark, log):
    lives: dict = {}
    for _, event, _, user, _, at in sorted(log, key=lambda m: m[5]):
        own = lives.setdefault(f"{event}-{user % 4}", [])
        if own and at - own[-1][1] < 3_600_000:
            own[-1][1:] = [at, own[-1][2] + 1]
        else:
            own.append([at, at, 1])
    want = sorted((q, a, b, n, b + 3_600_000) for q, own in lives.items() for a, b, n in own)
    assert sum(x[3] for x in want) == len(log)
    assert result(spark, "queue_idle_expiry", "queue", "from_ms", "last_ms", "touches", "ends_ms") == want


def test_every_request_is_decided(spark, log):
    operations = list(dict.fromkeys(o for o, _, _ in OPERATIONS))
    granted = {u: {"configure": c, "write": w, "read": r} for u, vhost, c, w, r in fixtures.PERMISSIONS[1] if vhost == "/"}
    want = []
    for tag, _, k, user, _, _ in log:
        username, operation = f"u{user % 7}", operations[k % 12]
        name = {"exchange": ("amq.default", "amq.topic", "click.x", "u5-x")[k % 4], "queue": ("q.1", "view.all", "u5-q")[k % 3], "destination": "amq.fanout"}
        patterns = [(granted.get(username, {}).get(p), name[part]) for o, p, part in OPERATIONS if o == operation]
        want.append((tag, username, operation, all(bool(p and re.search(p, n)) for p, n in patterns)))
    assert result(spark, "authz_decisions", "id", "username", "operation", "allowed") == want


def test_exclusive_queues_of_every_key(spark, log):
    owner: dict = {}
    want = []
    for tag, event, k, user, _, _ in log:
        own = owner.setdefault(f"{event}-{k}", user % 7)
        want.append((tag, f"{event}-{k}", user % 7, own, 405 if user % 7 != own else None))
    assert result(spark, "exclusive_owner", "seq", "queue", "connection", "owner", "reply_code") == want


def test_exclusive_consumers_of_every_key(spark, log):
    there: dict = {}
    for _, event, k, user, _, _ in log:
        q = there.setdefault(f"{event}-{k}", {"accepted": [], "refused": 0})
        exclusive = user % 4 == 0
        if q["accepted"] and (exclusive or any(q["accepted"])):
            q["refused"] += 1
        else:
            q["accepted"].append(exclusive)
    want = sorted((name, len(q["accepted"]), q["refused"]) for name, q in there.items())
    assert result(spark, "exclusive_consumers", "queue", "accepted", "refused") == want
