"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, union-find.

A document is the set of hashes of its k-word shingles. SuperMinHash gives every element a
random permutation of the m signature places, dealt out one place a round: in round j the
element offers j + r (r random in [0, 1)) to the j-th place of its permutation, and each
place keeps its smallest offer. Offers of later rounds are larger, so a document stops once
no place holds more than the rounds played: after one or a few rounds if it is long. The
places' estimates are negatively correlated, which lowers the variance against MinHash.

Documents with equal sets are one class from the start. `bands` keys of `rows` places each
put classes into buckets; a pair with similarity 0.8 shares none of 51 buckets of 5 places
with probability 1.6e-9. Links are then settled without pairing whole buckets:

1. Star: each class is compared with the bucket minimum it shares most buckets with.
   Verified links are contracted to components.
2. Best: in buckets that still hold several components, the members outside the bucket's
   largest component are compared with all members of other components by signature, in blocks
   of about `block` rows a side, and each member's most alike partner is verified. Repeated
   while that finds links, at most `rounds` times: large groups grow together by about one
   verification a member. A bucket of a million members of which ten are late costs a million
   rows, not their square.
3. Rest: where several components still share a bucket, all pairs between them that can be
   links are verified. No partner is capped.

A pair can be a link if it agrees in at least `agree` of 255 places (0.8 gives 204, with a
deviation under 6.4; 140 is ten deviations below, rarer than a clash of 64-bit hashes), and if
the shingles that both sets have in each of 1,024 classes of hashes, at most, are enough: that
bound is exact, and close to the count itself unless the sets are large.

Verification counts shared shingles of the full sets: 100 * both >= 80 * either.

Defined cases: words are lower-cased in A-Z only; a text of fewer than k words is one
shingle, its word sequence; no words or a null text: an empty set, linked with nothing;
a component is named by its smallest id, a null doc_id counting as the smallest, and a row of
null id is kept if its own document names its component; rows of equal id and different text
are different documents; rows equal in both are one document, and each gets its result;
partners that are equally alike are taken in order of their place in the block; very long
texts are hashed as a whole, in steps of bounded size; an empty table gives no rows; other
columns may have any names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.llm.common import batches, discard, flat, grouped, materialize, mix, scratch, signed, window_hashes, word_hashes, words
from flowmill.llm.components import components
from flowmill.llm.repeats import few, keyed

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_32 = np.uint64(32)
#: Classes of hashes (by their upper ten bits), and shingles beyond which a class may overflow.
CLASSES, MANY = 1024, 50_000
_HALF = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Spec:
    k: int = 4
    num: int = 80  # links: 100 * both >= num * either
    bands: int = 51
    rows: int = 5
    agree: int = 140
    block: int = 512
    rounds: int = 3

    @property
    def m(self) -> int:
        return self.bands * self.rows


def sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Each document's distinct shingle hashes, sorted."""
    data = _LOWER[data]
    ws, we, wo = words(data, offs)
    h = word_hashes(data, ws, we)
    full = window_hashes(h, k)
    out = []
    for a, z in zip(wo[:-1].tolist(), wo[1:].tolist()):
        if z - a >= k:
            out.append(np.unique(full[a : z - k + 1]))
        elif z > a:
            out.append(window_hashes(h[a:z], z - a) + np.uint64(z - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def superminhash(elements: list[np.ndarray], m: int, limit: int = 50_000) -> np.ndarray:
    """Signatures (documents x m, uint64: round in the upper half, fraction in the lower)."""
    sig = np.full((len(elements), m), np.uint64(0xFFFFFFFFFFFFFFFF))
    size = np.array([len(e) for e in elements])
    begin = 0
    while begin < len(elements):
        end = begin + 1
        total = size[begin]
        while end < len(elements) and total + size[end] <= limit:
            total += size[end]
            end += 1
        h = np.concatenate(elements[begin:end])
        doc = np.repeat(np.arange(begin, end), size[begin:end])
        perm = None
        for j in range(m):
            if not len(h):
                break
            x = mix(h + np.uint64((j + 1) * int(_STEP) % 2**64))
            pick = j + (((x & _HALF) * np.uint64(m - j)) >> _32).astype(np.int64)
            if perm is not None:
                row = np.arange(len(h))
                place = perm[row, pick].copy()
                perm[row, pick] = perm[:, j]
                perm[:, j] = place
            else:
                place = pick
            np.minimum.at(sig.reshape(-1), doc * m + place, (np.uint64(j) << _32) | (x >> _32))
            done = sig[begin:end].max(axis=1) < (np.uint64(j + 1) << _32)
            left = ~done[doc - begin]
            if perm is None:
                h, doc, pick = h[left], doc[left], pick[left]
                if len(h) <= limit:
                    perm = np.tile(np.arange(m, dtype=np.uint16), (len(h), 1))
                    perm[np.arange(len(h)), pick] = 0
                    perm[:, 0] = pick
                else:  # one very long document whose first round left a place empty: go by parts
                    for part in np.array_split(np.arange(len(h)), len(h) // limit + 1):
                        _later_rounds(sig, h[part], doc[part], pick[part], m)
                    break
            elif not left.all():
                h, doc, perm = h[left], doc[left], perm[left]
        begin = end
    return sig


def _later_rounds(sig: np.ndarray, h: np.ndarray, doc: np.ndarray, pick: np.ndarray, m: int) -> None:
    row = np.arange(len(h))
    perm = np.tile(np.arange(m, dtype=np.uint16), (len(h), 1))
    perm[row, pick] = 0
    perm[:, 0] = pick
    for j in range(1, m):
        if sig[doc[0]].max() < (np.uint64(j) << _32):
            return
        x = mix(h + np.uint64((j + 1) * int(_STEP) % 2**64))
        p = j + (((x & _HALF) * np.uint64(m - j)) >> _32).astype(np.int64)
        place = perm[row, p].copy()
        perm[row, p] = perm[:, j]
        perm[:, j] = place
        np.minimum.at(sig.reshape(-1), doc * m + place, (np.uint64(j) << _32) | (x >> _32))


def _signed_rows(spec: Spec, base: DataFrame) -> DataFrame:
    """key, n (shingles), same (hash of the set), bands, sig (one byte a place), cls (shingles
    by class of hash)."""

    def run(it):
        for b in batches(it, 2 << 20):
            data, offs = flat(b.column(1))
            els = sets(data, offs, spec.k)
            sig = superminhash(els, spec.m)
            band = sig.reshape(len(els), spec.bands, spec.rows)
            key = np.zeros((len(els), spec.bands), np.uint64) + np.arange(spec.bands, dtype=np.uint64)
            for r in range(spec.rows):
                key = mix(key * _STEP + band[:, :, r])
            byte = (mix(sig) & np.uint64(255)).astype(np.uint8)
            full = np.array([len(e) > 0 for e in els], bool)
            doc = np.repeat(np.arange(len(els)), [len(e) for e in els])
            cls = np.bincount(doc * CLASSES + (np.concatenate(els) >> np.uint64(54)).astype(np.int64), minlength=len(els) * CLASSES).reshape(-1, CLASSES)
            cls = np.minimum(cls, 255).astype(np.uint8)
            offsets = np.concatenate([[0], np.cumsum(full * spec.bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(e) for e in els], pa.int64()),
                    pa.array([hashlib.blake2b(e.tobytes(), digest_size=16).digest() if len(e) else None for e in els], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(np.ascontiguousarray(key[full]).reshape(-1)))),
                    pa.array([x.tobytes() for x in byte], pa.binary()),
                    pa.array([x.tobytes() for x in cls], pa.binary()),
                ],
                names=["key", "n", "same", "bands", "sig", "cls"],
            )

    kind = base.schema["key"].dataType
    return base.select("key", "text").mapInArrow(run, T.StructType([T.StructField("key", kind), *T._parse_datatype_string("n long, same binary, bands array<long>, sig binary, cls binary").fields]))


def _verified(spec: Spec, base: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) that are links, counted on full sets. pairs: distinct, written."""
    ids = materialize(pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))).distinct(), "involved")
    docs = base.select("key", "text")
    kind = base.schema["key"].dataType
    texts = docs.join(few(ids), "key", "left_semi")

    def make(it):
        for b in batches(it, 4 << 20):
            els = sets(*flat(b.column(1)), spec.k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.tobytes() for e in els], pa.binary())], names=["key", "els"])

    s = texts.mapInArrow(make, T.StructType([T.StructField("key", kind), T.StructField("els", T.BinaryType())]))
    if not isinstance(kind, T.LongType):
        s = s.dropDuplicates(["key"])
    s = materialize(s, "sets")
    both = pairs.join(s.select(F.col("key").alias("u"), F.col("els").alias("a")), "u").join(s.select(F.col("key").alias("v"), F.col("els").alias("b")), "v").select("u", "v", "a", "b")

    def run(it):
        for b in it:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(small) < spec.num * len(large):
                    keep.append(False)
                    continue
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                n = int((large[at] == small).sum())
                keep.append(100 * n >= spec.num * (len(x) + len(y) - n))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, T.StructType([T.StructField("u", kind), T.StructField("v", kind)]))


def _dealt(spec: Spec, inside: DataFrame) -> DataFrame:
    """inside: b, key, comp (members of buckets). Members of buckets with several components, dealt
    into blocks b, i, j: slice i (side 0) of the members outside the largest component and slice
    j (side 1) of all members, each part of either meeting each of the other once."""
    counts = materialize(inside.groupBy("b", "comp").agg(F.count("*").alias("c")), "bucket-components")
    open_ = counts.groupBy("b").agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("most"), F.count("*").alias("m")).where("m > 1")
    parts = lambda n: F.ceil(n / spec.block).cast("int")
    open_ = materialize(open_.select("b", F.col("most.comp").alias("most"), parts(F.col("size") - F.col("most.c")).alias("few"), parts(F.col("size")).alias("all")), "open-buckets")
    x = inside.join(open_, "b")
    slice_ = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ask = x.where("comp != most").select("b", slice_("few", 1).alias("i"), each("all").alias("j"), F.lit(0).alias("side"), "key", "comp")
    all_ = x.select("b", each("few").alias("i"), slice_("all", 2).alias("j"), F.lit(1).alias("side"), "key", "comp")
    return materialize(ask.unionByName(all_), "blocks")


def _between(spec: Spec, blocks: DataFrame, t: DataFrame, best: bool) -> DataFrame:
    """blocks: _dealt(); t: key, n, sig, cls -> possible pairs (u, v) of different components in a
    bucket: all of them, or each member's most alike partner in each block."""
    kind = blocks.schema["key"].dataType
    x = blocks.join(t.select("key", "n", "sig", "cls"), "key")

    def run(it):
        for t in grouped(it, ["b", "i", "j"]):
            key = t["key"].combine_chunks()
            comp = pc.rank(t["comp"].combine_chunks(), tiebreaker="dense").to_numpy()
            n = t["n"].to_numpy()
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(n), -1)
            cls = np.frombuffer(b"".join(t["cls"].to_pylist()), np.uint8).reshape(len(n), -1)
            side = t["side"].to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            us, vs, like = [], [], []
            for u in left:
                v = right[(comp[right] != comp[u]) & (100 * np.minimum(n[right], n[u]) >= spec.num * np.maximum(n[right], n[u]))]
                if len(v):
                    a = (sig[v] == sig[u]).sum(axis=1)
                    at = np.flatnonzero(a >= spec.agree)
                    both = np.minimum(cls[v[at]], cls[u]).sum(axis=1, dtype=np.int64)
                    at = at[(100 * both >= spec.num * (n[v[at]] + n[u] - both)) | (n[u] > MANY)]
                    us.append(np.full(len(at), u))
                    vs.append(v[at])
                    like.append(a[at])
            if us:
                us, vs, like = np.concatenate(us), np.concatenate(vs), np.concatenate(like)
                if best and len(us):
                    o = np.argsort(-like, kind="stable")
                    keep = np.unique(np.concatenate([o[np.unique(us[o], return_index=True)[1]], o[np.unique(vs[o], return_index=True)[1]]]))
                    us, vs = us[keep], vs[keep]
                yield pa.RecordBatch.from_arrays([key.take(pa.array(us)), key.take(pa.array(vs))], names=["u", "v"])

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = x.repartition(parts, "b", "i", "j").sortWithinPartitions("b", "i", "j").mapInArrow(run, T.StructType([T.StructField("u", kind), T.StructField("v", kind)]))
    return out.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, spec: Spec = Spec(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(keyed rows, per key: key, n_shingles, component: the smallest key reachable)."""
    base = keyed(docs, id_col, text_col)
    with scratch() as tables:
        return base, tables.keep(materialize(_grouped_keys(base, spec), "near-components"))


def _grouped_keys(base: DataFrame, spec: Spec) -> DataFrame:
    unique = isinstance(base.schema["key"].dataType, T.LongType)
    t = materialize(_signed_rows(spec, base if unique else base.select("key", "text").dropDuplicates(["key"])), "signatures")
    # aggregates are written before they are joined, so that hot keys of the join can be split
    first = materialize(t.where("n > 0").groupBy("same").agg(F.min("key").alias("rep"), F.count("*").alias("c")).where("c > 1").select("same", "rep"), "equal-sets")
    info = materialize(t.select("key", "n", "same").join(first, "same", "left").select("key", "n", F.coalesce("rep", "key").alias("rep")), "classes")
    reps = t.join(info.where("key != rep").select("key"), "key", "left_anti")
    entry = reps.select("key", F.explode("bands").alias("b"))
    shared = materialize(entry.groupBy("b").agg(F.min("key").alias("v"), F.count("*").alias("c")).where("c > 1").select("b", "v"), "shared-buckets")
    bucket = materialize(entry.join(shared, "b"), "buckets")
    most = bucket.where("key != v").groupBy("key", "v").agg(F.count("*").alias("c")).groupBy("key").agg(F.min(F.struct(-F.col("c"), "v")).alias("x")).select(F.col("key").alias("u"), F.col("x.v").alias("v"))
    stars = materialize(most, "stars")
    links = materialize(_verified(spec, base, stars), "links")
    comp = components(links)
    done, best = stars, True
    for turn in range(spec.rounds + 1):
        best = best and turn < spec.rounds
        inside = bucket.join(comp.select(F.col("u").alias("key"), "root"), "key", "left").select("b", "key", F.coalesce("root", "key").alias("comp"))
        blocks = _dealt(spec, inside)
        pairs = materialize(_between(spec, blocks, t, best).join(done, ["u", "v"], "left_anti"), "pairs")
        discard(blocks)
        found = 0
        if pairs.limit(1).count():
            new = materialize(_verified(spec, base, pairs), "links")
            found = new.limit(1).count()
            links, done = links.unionByName(new), done.unionByName(pairs)
        if found:
            comp = components(links)
        if not best:
            break
        best = bool(found)  # else what remains is looked at pair by pair
    return info.join(comp.select(F.col("u").alias("rep"), "root"), "rep", "left").select("key", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component"))


def dedup(docs: DataFrame, spec: Spec = Spec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept."""
    base, out = near_duplicates(docs, spec, id_col, text_col)
    if isinstance(base.schema["key"].dataType, T.LongType):
        return out.select(F.col("key").alias(id_col), "n_shingles", F.col("component").alias("component_id"), (F.col("key") == F.col("component")).alias("kept"))
    ids = base.select(F.col("key").alias("component"), F.col(f"row.{id_col}").alias("component_id")).dropDuplicates(["component"])
    rows = base.select("key", F.col(f"row.{id_col}").alias(id_col))
    return rows.join(out, "key").join(ids, "component").select(id_col, "n_shingles", "component_id", (F.col("key") == F.col("component")).alias("kept"))


def kept_rows(docs: DataFrame, spec: Spec = Spec(k=5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which each group keeps one, all columns as they are."""
    base, out = near_duplicates(docs, spec, id_col, text_col)
    gone = materialize(out.where("key != component").select("key"), "dropped")
    rows = base if isinstance(base.schema["key"].dataType, T.LongType) else base.dropDuplicates(["key"])
    return rows.join(few(gone), "key", "left_anti").select("row.*")


def op9(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The contract's result in plain SQL, for small tables.
OP9_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, md5(array_to_string(w[i:i + 3], ' ')) as h
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*)::bigint as n from s group by doc_id),
p as (select a.doc_id as u, b.doc_id as v, count(*) as shared from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * shared >= 80 * (x.n + y.n - shared)),
e as (select u, v from l union all select v, u from l),
r as (select u as doc_id, v as other from e union select r.doc_id, e.v from r join e on r.other = e.u),
c as (select doc_id, min(other) as least from r group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) as component_id,
       c.least is null or d.doc_id <= c.least as kept
from d left join n on d.doc_id = n.doc_id left join c on d.doc_id = c.doc_id
"""
