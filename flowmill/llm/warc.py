"""Deterministic sharded WARC writer and reader.

Records are sorted by (id, payload's SHA-1) over shards whose borders depend on the data alone:
a fixed hash sample of the records, weighted by payload size. One task writes one shard, as files
that roll over when their compressed size passes a limit, one gzip member per record, with
headers, record ids, dates and digests regenerated from the record, so equal input gives
equal bytes, and a task that runs twice writes the same files. Members go to the file as they
are compressed; a file has a temporary name until it is complete. The driver then writes a
manifest of all files the same way. Readers take files from the manifest only, so a failed or
half-done write is never seen. Reader and writer hold one record at a time.

Of records with equal payloads the one with the largest id is the response and the others
revisit it. Which record that is comes from an aggregation over digests; the revisits find
their response by sorting as small rows just before their own record, so the payloads
themselves are shuffled once. As borders are pairs of id and digest, neither rows without an id
nor many payloads of one id need to share a shard.

Files are written through pyarrow's file systems, which open local, HDFS and object-store
addresses alike; the folder is a parameter and lies under the shared folder by default.

Defined cases: a null html is an empty payload; a null id is smaller than any other, its
record has no number and cannot be referred to by one; of rows with equal id and payload
the first in url order is the response (or as the id's order demands, a revisit), the
others revisit it; a null url is written as the unknown URI; a very long payload is one
record, whatever the limit of a file; other columns are not archived; an empty table gives a
manifest without files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import zlib
from bisect import bisect_right
from itertools import islice, pairwise

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.llm.common import discard, fresh_path, materialize

#: Compressed bytes after which a file ends, payload bytes of a shard, and fewest shards. A shard of
#: web pages makes several files.
ROLL, SHARD, SHARDS = 64 << 20, 1 << 30, 24
#: Records that decide the borders, at least and per shard, about; and that a reader returns at once.
SAMPLE, PER_SHARD, ROWS = 20_000, 20, 1000
SMALLEST = 0
DATE = "2000-01-01T00:00:00Z"
UNKNOWN = "urn:unknown"
MANIFEST = "manifest.json"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":" in path else "file://" + path)


class _Pending:
    """A file under a temporary name of this attempt; close() renames it: complete or absent."""

    def __init__(self, path: str) -> None:
        self.fs, self.path = _open(path)
        folder, name = self.path.rsplit("/", 1)
        self.fs.create_dir(folder, recursive=True)
        self.tmp = f"{folder}/.{name}.{os.getpid()}.{os.urandom(4).hex()}.tmp"
        self.out = self.fs.open_output_stream(self.tmp)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        if self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.path)  # of an attempt that was lost: the same bytes
        self.fs.move(self.tmp, self.path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha1: str, again: int = 0) -> str:
    """From page id, digest and repetition."""
    n = hashlib.sha1(f"{page_id} {sha1} {again}".encode()).hexdigest()
    return f"<urn:uuid:{n[:8]}-{n[8:12]}-5{n[13:16]}-8{n[17:20]}-{n[20:32]}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool, again: int = 0) -> bytes:
    """One WARC/1.1 record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url) if url else UNKNOWN
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, sha1, again)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to, sha1)}")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def file_info(name: str) -> bytes:
    """The warcinfo record at the head of a file."""
    block = b"software: flowmill\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(None, name)}", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(chunks):
    """The gzip members in consecutive parts of a file, uncompressed one after another."""
    d, out = zlib.decompressobj(31), []
    for part in chunks:
        while part:
            out.append(d.decompress(part))
            part = d.unused_data
            if d.eof:
                yield b"".join(out)
                d, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("the last record is cut off")


def parse(raw: bytes) -> dict:
    """The fields of a record; its block digest and, for a response, payload digest are checked.
    Of a warcinfo record the type only."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or "sha1:" + digest(block) != h["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {h['WARC-Record-ID']}")
    if h["WARC-Type"] == "warcinfo":
        return {"record_type": "warcinfo"}
    http, _, payload = block.partition(b"\r\n\r\n")
    if h["WARC-Type"] == "response" and "sha1:" + digest(payload) != h["WARC-Payload-Digest"]:
        raise ValueError(f"damaged payload {h['WARC-Record-ID']}")
    size = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    of = lambda k: int(h[k]) if k in h else None
    return {"page_id": of("X-Page-ID"), "url": h["WARC-Target-URI"], "payload_bytes": size, "payload_digest": h["WARC-Payload-Digest"][5:], "record_type": h["WARC-Type"], "refers_to": of("X-Refers-To-Page-ID"), "payload": payload if h["WARC-Type"] == "response" else None}


Border = tuple[bool, int, str]


def borders(ids: DataFrame, shard: int) -> list[Border]:
    """Where a new shard begins, from a sample by hash. ids: page_id, sha, size."""
    n, total = ids.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return []
    parts = max(SHARDS, -(-total // shard))
    every = max(1, n // max(SAMPLE, PER_SHARD * parts))
    picked = ids.where(F.pmod(F.xxhash64("page_id", "sha"), F.lit(every)) == 0).groupBy("page_id", "sha").agg(F.sum("size").alias("s")).select(*_place(), "s").orderBy("known", "id", "sha").collect()
    step, sofar, out = sum(r.s + 200 for r in picked) / parts, 0.0, []
    for a, b in pairwise(picked):
        sofar += a.s + 200
        if sofar >= step * (len(out) + 1):
            out.append((b.known, b.id, b.sha))
    return out


def _place() -> list:
    """The order of records: without an id first, then by id, both by digest."""
    return [F.col("page_id").isNotNull().alias("known"), F.coalesce("page_id", F.lit(0)).alias("id"), F.col("sha")]


def _shard(cut: list[Border]):
    """The shard of a record: how many borders are at or below its place."""
    if not cut:
        return F.lit(0)

    @F.pandas_udf("int")
    def find(known: pd.Series, i: pd.Series, sha: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cut, p) for p in zip(known, i, sha)], dtype="int32")

    return find(*_place())


def write(pages: DataFrame, path: str, roll: int = ROLL, shard: int = SHARD, smallest: int = SMALLEST, level: int = 3) -> dict:
    """Write all rows of pages (page_id, url, html) below path; returns the manifest."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    ids = materialize(rows.select("page_id", F.sha1("html").alias("sha"), F.octet_length("html").cast("long").alias("size")), "warc-ids")
    cut = borders(ids, shard)
    # written before it is joined, so that a common payload's key can be split
    same = materialize(ids.where(F.col("size") >= smallest).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("c")).where("c > 1").select("sha", "last"), "warc-same")
    # one small row for each revisit: it sorts before the record it is about
    none = F.lit(None).cast("string")
    notes = ids.select("page_id", "sha").distinct().join(same, "sha").where(F.col("page_id").isNull() | (F.col("page_id") <= F.col("last"))).select("page_id", none.alias("url"), none.alias("html"), "sha", "last", F.lit(0).alias("kind"))
    recs = rows.select("page_id", "url", "html", F.sha1("html").alias("sha"), F.lit(None).cast("long").alias("last"), F.lit(1).alias("kind"))

    def run(it):
        files: list[tuple] = []
        now, note, again = None, None, 0
        out = None
        size = count = seq = 0
        part = first = last = sha256 = None

        def put(raw: bytes) -> int:
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            data = z.compress(raw) + z.flush()
            out.write(data)
            sha256.update(data)
            return len(data)

        def close():
            nonlocal out, seq
            out.close()
            files.append((name, part, seq, count, size, sha256.hexdigest(), first, last))
            out, seq = None, seq + 1

        for b in it:
            for i in range(b.num_rows):
                pid, url, html, sha, top, kind, sh = (c[i].as_py() for c in b.columns)
                if sh != part:
                    if out:
                        close()
                    part, seq = sh, 0
                if now != (pid, sha):
                    now, note, again = (pid, sha), None, 0
                if kind == 0:
                    note = (top,)
                    continue
                revisit = note is not None and (again > 0 or note[0] != pid)
                b32 = base64.b32encode(bytes.fromhex(sha)).decode()
                if out is None:
                    name = f"part-{part:06d}-{seq:05d}.warc.gz"
                    out, sha256, count, first = _Pending(f"{path}/{name}"), hashlib.sha256(), 0, pid
                    size = put(file_info(name))
                size += put(record(pid, url, html.encode(), b32, note[0] if revisit else None, revisit, again))
                again, count, last = again + 1, count + 1, pid
                if size >= roll:
                    close()
        if out:
            close()
        names = ["name", "shard", "seq", "records", "bytes", "sha256", "first_id", "last_id"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in files], k) for i, k in enumerate(kinds)], names=names)

    written = (
        notes.unionByName(recs)
        .withColumn("shard", _shard(cut))
        .select("page_id", "url", "html", "sha", "last", "kind", "shard")
        .repartitionById(len(cut) + 1, "shard")
        .sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "sha", "kind", F.asc_nulls_first("url"))
        .mapInArrow(run, "name string, shard int, seq int, records long, bytes long, sha256 string, first_id long, last_id long")
    )
    manifest = {"files": [r.asDict() for r in sorted(written.collect(), key=lambda r: r.name)]}
    manifest["records"] = sum(f["records"] for f in manifest["files"])
    out = _Pending(f"{path}/{MANIFEST}")
    out.write(json.dumps(manifest, indent=1).encode())
    out.close()
    discard(ids, same)
    return manifest


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    fs, p = _open(path)
    with fs.open_input_stream(f"{p}/{MANIFEST}") as f:
        files = json.loads(f.read())["files"]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if not files:
        return spark.createDataFrame([], schema)
    names = spark.createDataFrame([(i, f["name"], f["sha256"]) for i, f in enumerate(files)], "i int, name string, sha256 string").repartitionById(len(files), "i")
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def records(name: str, sha: str):
        own, base = _open(path)
        seen = hashlib.sha256()

        def chunks():
            with own.open_input_stream(f"{base}/{name}", compression=None) as f:
                while part := f.read(1 << 20):
                    seen.update(part)
                    yield part
            if seen.hexdigest() != sha:
                raise ValueError("its SHA-256 differs")

        try:
            for raw in members(chunks()):
                r = parse(raw)
                if r["record_type"] != "warcinfo":
                    yield r
        except (ValueError, zlib.error) as e:
            raise ValueError(f"{name} is not what the manifest says: {e}") from e

    def run(it):
        for b in it:
            for name, sha in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                got = iter(records(name, sha))
                while some := [{k: r[k] for k in kinds} for r in islice(got, ROWS)]:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], t) for k, t in kinds.items()], names=list(kinds))

    return names.mapInArrow(run, schema)


def op7(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path).drop("url")


#: The contract's result in plain SQL: five hexadecimal digits are four of base 32.
OP7_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
s as (select page_id, octet_length(encode(h))::bigint as payload_bytes, upper(sha1(h)) as x from p),
r as (
  select *, max(page_id) over (partition by x) as last, row_number() over (partition by x, page_id) as n from s),
b as (
  select *, list_transform(range(0, 8), lambda j: ('0x' || substr(x, 5 * j + 1, 5))::integer) as part,
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' as letters, n > 1 or page_id is distinct from last as again
  from r)
select page_id, payload_bytes,
       array_to_string(list_transform(part, lambda v: substr(letters, (v // 32768) + 1, 1) || substr(letters, (v // 1024) % 32 + 1, 1)
                                                   || substr(letters, (v // 32) % 32 + 1, 1) || substr(letters, v % 32 + 1, 1)), '') as payload_digest,
       case when again then 'revisit' else 'response' end as record_type,
       case when again then last end as refers_to
from b
"""
