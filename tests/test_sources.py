import json

from flowmill.operators.authz import user_permissions
from flowmill.sources import text


def test_auth_file_with_legacy_permissions(spark, tmp_path):
    p = tmp_path / "auth.json"
    p.write_text(json.dumps({"users": [
        {"username": "new", "vhost_permissions": [{"vhost": "/", "permission": {"configure": ".*", "write": "a", "read": ""}}]},
        {"username": "old", "permissions": [{"resource": "queue", "action": "read", "pattern": "q"}]},
        {"username": "none"},
    ]}))
    rows = {tuple(r) for r in user_permissions(text.read_auth(spark, str(p))).select("username", "vhost", "configure", "write", "read").collect()}
    assert rows == {("new", "/", ".*", "a", ""), ("old", "/", "^$", "^$", "q")}


def test_bench_file(spark, tmp_path):
    p = tmp_path / "bench.txt"
    p.write_text("goos: x\npkg: a\nBenchmarkOne-4 10 2.5 ns/op\ngoos: x\npkg: b\nBenchmarkOne-4 10 3 ns/op 1 B/op\n")
    s = text.bench_sections(text.read_lines(spark, str(p)))
    assert {(r.pkg, r.unit, r.value) for r in text.bench_results(s).collect()} == {("a", "ns/op", 2.5), ("b", "ns/op", 3.0), ("b", "B/op", 1.0)}
    assert {(r.pkg, r.line_no) for r in s.where("value like 'goos%'").collect()} == {("a", 0), ("b", 3)}


def test_metadata_round_trip(spark, tmp_path):
    schema = "name string, durable boolean, note string"
    rows = [(f"q{i}", i % 2 == 0, None if i == 3 else f"line\n{i}") for i in range(6)]
    q = spark.createDataFrame(rows, schema)
    text.write_metadata(q.repartition(3), str(tmp_path), "queues")
    assert sorted(map(tuple, text.read_metadata(spark, str(tmp_path), "queues", schema).collect())) == rows
    text.write_metadata(q.limit(0), str(tmp_path), "queues")
    assert text.read_metadata(spark, str(tmp_path), "queues", schema).collect() == []


def test_metadata_of_one_document_a_file(spark, tmp_path):
    (tmp_path / "exchanges").mkdir()
    for name in ("a", "b"):
        (tmp_path / "exchanges" / f"{name}.json").write_text(json.dumps({"name": name, "durable": True}, indent=2))
    got = text.read_metadata(spark, str(tmp_path), "exchanges", "name string, durable boolean", one_a_file=True)
    assert sorted(map(tuple, got.collect())) == [("a", True), ("b", True)]
