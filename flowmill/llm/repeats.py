"""Finding every passage of `span` units that also starts earlier, for bytes or words.

A unit is a byte or a word. A window is `span` consecutive units of one document; the
task is to know, for each window, whether an equal one starts earlier (smaller document,
or earlier in the same one). Comparing all windows would move the corpus many times over,
so this module narrows down where to look, without losing any pair; what is removed is
decided by the caller's engine alone, on the text itself.

1. Each window picks the smallest hash among the runs of `k` units in it (the leftmost,
   if several). Equal windows pick equal seeds at equal places, and neighbouring windows
   mostly share theirs: one seed stands for about (span - k) / 2 windows. A document
   becomes an array of seed hashes.
2. Documents with equal texts are aggregated to their first one, with the number of them;
   what is found counts that often, and the engine's result for "any further copy" of the first
   is that of the others. Seeds that occur once cannot be part of a repeat. Counting them is one
   aggregation over hashes, and joining the repeated ones back leaves the documents with
   candidates.
3. Only those documents' texts are moved. All windows of one seed form a segment. Equal
   segments are aggregated to one row with its count and earliest place; they are told apart by
   their seed and 128 bits of a cryptographic digest of their text, and so are as narrow as
   places: the text of a segment is cut out of its first document where an engine needs it.
4. A seed with more than `hot` different segments would make one deal too large. Its segments are
   seeded once more, with longer runs, halfway up to the whole span, and so on while a seed of
   them is too large; at the latest each window is its own seed, and has one segment.

Counts are aggregated before they are shuffled, joins on hot seeds are plain joins that
adaptive execution can split, and no step gathers a group of documents.

Documents are told apart by `key`: the id itself where ids are unique and not null, else
16 sortable bytes made of id and a hash of the text. So a null id is smallest, rows of
equal id and different text are different documents, and rows equal in both are one
document whose result each of them gets. Columns of the input may have any names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.llm.common import batches, discard, flat, materialize, mix, signed, text_of, window_hashes, word_hashes, words

#: Units that are handled at once in one array, small enough for a processor's cache; also
#: the longest run of a long document.
CHUNK = 1 << 17
#: Longer words are compared by SHA-256.
LONG = 64
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_BITS = np.uint64(CHUNK.bit_length() + 1)
_LOW = np.uint64((1 << int(_BITS)) - 1)
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class Spec:
    """unit: "byte" or "word"; span: units of a window; k: units of a seed (k <= span);
    hot: segments of one seed that one task may compare; deal: bytes of segments an
    engine gets at once, more only if a single seed has more."""

    unit: str
    span: int
    k: int
    hot: int = 2000
    deal: int = 1 << 20


@dataclass
class Pieces:
    """Units of documents end to end, with the place of each piece in its document."""

    units: np.ndarray
    offs: np.ndarray
    doc: np.ndarray
    base: np.ndarray


def pieces(spec: Spec, data: np.ndarray, offs: np.ndarray):
    """Arrays of at most CHUNK units, about; a longer document comes in runs that overlap by
    span - 1 units, so that each of its windows is in exactly one run."""
    if spec.unit == "word":
        ws, we, wo = words(data, offs)
        units, offs = word_hashes(data, ws, we), wo
    else:
        units = data
    n, i = len(offs) - 1, 0
    of = (lambda x: x) if spec.unit == "word" else (lambda x: BYTE[x])
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK, "right")) - 1)
        size = int(offs[j] - offs[i])
        if size <= CHUNK:
            yield Pieces(of(units[offs[i] : offs[j]]), offs[i : j + 1] - offs[i], np.arange(i, j), np.zeros(j - i, np.int64))
        else:
            for at in range(0, max(1, size - spec.span + 1), CHUNK - spec.span):
                part = units[offs[i] + at : offs[i] + min(size, at + CHUNK - 1)]
                yield Pieces(of(part), np.array([0, len(part)]), np.array([i]), np.array([at]))
        i = j


def seeds(spec: Spec, p: Pieces) -> dict[str, np.ndarray]:
    """For each seed: doc, its hash h, the first and last window lo, hi that picked it (in
    units of the document), and at, the same as lo within the piece; off: seed minus lo."""
    n, w = len(p.units), spec.span - spec.k + 1
    none = {k: np.zeros(0, np.int64) for k in ("doc", "lo", "hi", "off", "at")} | {"h": np.zeros(0, np.uint64)}
    if n < spec.span:
        return none
    h = window_hashes(p.units, spec.k)
    left = np.repeat(p.offs[1:], np.diff(p.offs)) - np.arange(n)
    order = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    order[left[: len(h)] < spec.k] = _TOP
    size = 1
    low = order
    while 2 * size <= w:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if size < w:
        low = np.minimum(low[: len(low) - (w - size)], low[w - size :])
    start = np.flatnonzero(left[: len(low)] >= spec.span)
    if not len(start):
        return none
    pos = (low[start] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(pos) != 0) | (np.diff(start) != 1)]))
    lo, hi, pos = start[new], start[np.append(new[1:], len(start)) - 1], pos[new]
    piece = np.searchsorted(p.offs, lo, "right") - 1
    shift = p.base[piece] - p.offs[piece]
    return {"doc": p.doc[piece], "h": h[pos], "lo": lo + shift, "hi": hi + shift, "off": pos - lo, "at": lo}


def _list(values: np.ndarray, doc: np.ndarray, n: int, kind) -> pa.Array:
    """values, ordered by doc, as one list per document."""
    offs = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns key and text in front of the columns of docs, which are kept in a struct `row`."""
    t, i = text_of(text_col), F.col(id_col)
    stats = docs.agg(F.count("*").alias("n"), F.count(i).alias("some"), F.countDistinct(i).alias("d")).first()
    if stats.n == stats.d == stats.some and isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType)):
        key: Column = i.cast("long")
    else:
        sign = F.lit(-(2**63))
        at = lambda c: F.lpad(F.hex(c.bitwiseXOR(sign)), 16, "0")
        key = F.unhex(F.concat(F.when(i.isNull(), F.lit("00")).otherwise(F.concat(F.lit("01"), at(i.cast("long")))), at(F.xxhash64(t))))
    return docs.select(key.alias("key"), t.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _seed_rows(spec: Spec, df: DataFrame) -> DataFrame:
    """key, n (units), size (bytes), sha (of the whole text's kept form), hs (seed hashes)."""

    def run(it):
        for b in batches(it):
            data, offs = flat(b.column(1))
            n = b.num_rows
            hs, doc, count = [], [], np.diff(offs)
            for p in pieces(spec, data, offs):
                s = seeds(spec, p)
                hs.append(s["h"])
                doc.append(s["doc"])
            if spec.unit == "word":
                ws, we, wo = words(data, offs)
                count = np.diff(wo)
                sha = [hashlib.sha256(b" ".join(data[offs[i] : offs[i + 1]].tobytes().split())).hexdigest() for i in range(n)]
                # bytes.split() cuts at the six separators and nothing else
            else:
                sha = [hashlib.sha256(data[offs[i] : offs[i + 1]]).hexdigest() for i in range(n)]
            h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
            d = np.concatenate(doc) if doc else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(np.diff(offs), pa.int64()), pa.array(sha, pa.string()), _list(signed(h), d, n, pa.int64())], names=["key", "n", "size", "sha", "hs"])

    return df.select("key", "text").mapInArrow(run, T.StructType([T.StructField("key", df.schema["key"].dataType), *T._parse_datatype_string("n long, size long, sha string, hs array<long>").fields]))


def tokens(raw: bytes) -> list[bytes]:
    """The words of raw, those of more than LONG bytes as digests: no other word is as long."""
    ws = raw.split()
    if len(raw) > LONG and max(map(len, ws), default=0) > LONG:
        ws = [w if len(w) <= LONG else b"#" + hashlib.sha256(w).hexdigest().encode() for w in ws]
    return ws


def _digest(seg) -> bytes:
    return hashlib.blake2b(seg, digest_size=16).digest()


def _segments(spec: Spec, x: DataFrame) -> DataFrame:
    """A row for each occurrence of a repeated seed: h, s (digest), key, lo, n (units), c (equal texts)."""

    def run(it):
        for b in batches(it):
            data, offs = flat(b.column(1))
            wanted = b.column(2)
            wanted_doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(wanted).to_numpy(zero_copy_only=False).astype(np.int64))
            pairs = np.sort(mix(wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64) + mix(wanted_doc.astype(np.uint64))))
            if spec.unit == "word":
                ws, we, wo = words(data, offs)
            for p in pieces(spec, data, offs):
                s = seeds(spec, p)
                if not len(s["h"]) or not len(pairs):
                    continue
                mine = mix(s["h"] + mix(s["doc"].astype(np.uint64)))
                at = np.minimum(np.searchsorted(pairs, mine), len(pairs) - 1)
                s = {k: v[pairs[at] == mine] for k, v in s.items()}
                if not len(s["h"]):
                    continue
                if spec.unit == "word":
                    first, last = wo[s["doc"]] + s["lo"], wo[s["doc"]] + s["hi"] + spec.span - 1
                    name = [_digest(b" ".join(tokens(data[a:z].tobytes()))) for a, z in zip(ws[first].tolist(), we[last].tolist())]
                else:
                    a, z = offs[s["doc"]] + s["lo"], offs[s["doc"]] + s["hi"] + spec.span
                    name = [_digest(data[i:j]) for i, j in zip(a.tolist(), z.tolist())]
                doc = pa.array(s["doc"])
                yield pa.RecordBatch.from_arrays([pa.array(signed(s["h"])), pa.array(name, pa.binary()), b.column(0).take(doc), pa.array(s["lo"], pa.int32()), pa.array(s["hi"] - s["lo"] + spec.span, pa.int32()), b.column(3).take(doc)], names=["h", "s", "key", "lo", "n", "c"])

    return x.select("key", "text", "hs", "c").mapInArrow(run, _schema(x, "h long, s binary", "lo int, n int, c long"))


def _schema(df: DataFrame, before: str, after: str) -> T.StructType:
    """before, the key of df, after."""
    f = lambda d: T._parse_datatype_string(d).fields
    return T.StructType([*f(before), T.StructField("key", df.schema["key"].dataType), *f(after)])


def with_text(texts: DataFrame, segs: DataFrame) -> DataFrame:
    """key, text, at: of each document the given segments (lo, n, h, s, c), by place."""
    at = segs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("lo", "n", "h", "s", "c"))).alias("at"))
    return texts.select("key", "text").join(at, "key")


@dataclass
class Cut:
    """Segments of one document: lo and n as numbers, h, s and c as Arrow arrays, segs: their texts
    (bytes, or words joined by one space)."""

    lo: np.ndarray
    n: np.ndarray
    h: pa.Array
    s: pa.Array
    c: pa.Array
    segs: list[bytes]

    def parts(self, size: int):
        """Runs of segments of about size units of text."""
        cut = np.flatnonzero(np.diff(self.lo // size)) + 1
        for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(self.lo)]):
            yield Cut(self.lo[a:z], self.n[a:z], self.h.slice(a, z - a), self.s.slice(a, z - a), self.c.slice(a, z - a), self.segs[a:z])


def cut_out(spec: Spec, b: pa.RecordBatch):
    """with_text() rows -> (key, its Cut), row by row."""
    at = b.column(2)
    count = pc.list_value_length(at).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(count)
    rows = at.flatten()
    lo, n = (rows.field(rows.type.get_field_index(c)).to_numpy().astype(np.int64) for c in ("lo", "n"))
    other = [rows.field(rows.type.get_field_index(c)) for c in ("h", "s", "c")]
    data, offs = flat(b.column(1))
    for i, z in enumerate(end.tolist()):
        a = z - int(count[i])
        own = data[offs[i] : offs[i + 1]]
        raw = own.tobytes()
        if spec.unit == "byte":
            segs = [raw[x:y] for x, y in zip(lo[a:z].tolist(), (lo[a:z] + n[a:z]).tolist())]
        else:
            ws, we, _ = words(own, np.array([0, len(own)]))
            segs = [b" ".join(tokens(raw[x:y])) for x, y in zip(ws[lo[a:z]].tolist(), we[lo[a:z] + n[a:z] - 1].tolist())]
        yield b.column(0)[i].as_py(), Cut(lo[a:z], n[a:z], *[x.slice(a, z - a) for x in other], segs)


def segment_texts(spec: Spec, texts: DataFrame, segs: DataFrame) -> DataFrame:
    """h, s, key, lo, c, seg of the given segments."""

    def run(it):
        for b in it:
            got = list(cut_out(spec, b))
            join = lambda xs: pa.chunked_array(xs).combine_chunks()
            doc = np.repeat(np.arange(len(got)), [len(x.lo) for _, x in got])
            yield pa.RecordBatch.from_arrays([join([x.h for _, x in got]), join([x.s for _, x in got]), b.column(0).take(pa.array(doc)), pa.array(np.concatenate([x.lo for _, x in got]), pa.int32()), join([x.c for _, x in got]), pa.array([g for _, x in got for g in x.segs], pa.binary())], names=["h", "s", "key", "lo", "c", "seg"])

    return with_text(texts, segs).mapInArrow(run, _schema(segs, "h long, s binary", "lo int, c long, seg binary"))


def _refined(spec: Spec, k: int, texts: DataFrame, places: DataFrame) -> DataFrame:
    """The given occurrences cut up by seeds of k units within them: h, s, key, lo, n, c."""
    finer = replace(spec, k=k)

    def run(it):
        for b in it:
            for key, x in cut_out(spec, b):
                for part in x.parts(CHUNK // 8):
                    if spec.unit == "word":
                        data = np.frombuffer(b" ".join(part.segs), np.uint8)
                        ws, we, _ = words(data, np.array([0, len(data)]))
                        units = word_hashes(data, ws, we)
                    else:
                        data = np.frombuffer(b"".join(part.segs), np.uint8)
                        units = BYTE[data]
                    for a, z in _bounded(part.n, CHUNK):
                        offs = np.concatenate([[0], np.cumsum(part.n[a:z])])
                        begin = int(part.n[:a].sum())
                        s = seeds(finer, Pieces(units[begin : begin + offs[-1]], offs, np.arange(a, z), part.lo[a:z]))
                        first, last = begin + s["at"], begin + s["at"] + s["hi"] - s["lo"] + spec.span
                        if spec.unit == "word":
                            first, last = ws[first], we[last - 1]
                        name = [_digest(data[i:j]) for i, j in zip(first.tolist(), last.tolist())]
                        doc = pa.array(s["doc"])
                        h = mix(part.h.to_numpy().view(np.uint64)[s["doc"]] * np.uint64(0x9E3779B97F4A7C15) + s["h"])
                        yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(name, pa.binary()), pa.array([key] * len(name), b.column(0).type), pa.array(s["lo"], pa.int32()), pa.array(s["hi"] - s["lo"] + spec.span, pa.int32()), part.c.take(doc)], names=["h", "s", "key", "lo", "n", "c"])

    return with_text(texts, places).mapInArrow(run, _schema(places, "h long, s binary", "lo int, n int, c long"))


def _bounded(n: np.ndarray, limit: int):
    """Runs of segments of at most limit units together, or of one."""
    end = np.cumsum(n)
    a = 0
    while a < len(n):
        z = max(a + 1, int(np.searchsorted(end, end[a] - n[a] + limit, "right")))
        yield a, z
        a = z


@dataclass
class Found:
    """info: key, n, sha of every document, and rep, the first document of equal text;
    texts: key, size, c (equal texts), text of first documents with repeated seeds;
    segs: h, s, n, c (occurrences), key and lo (the earliest), each different segment once;
    places: h, s, key, lo, c of every occurrence in texts; shared: h, m of seeds with several
    (m) different segments; several: those that make a deal, the others being refined."""

    info: DataFrame
    texts: DataFrame
    segs: DataFrame
    places: DataFrame
    shared: DataFrame
    several: DataFrame


def find(spec: Spec, base: DataFrame) -> Found:
    """base: keyed(). Where equal windows can be; see above."""
    t1 = materialize(_seed_rows(spec, base), "seeds")
    once = t1.dropDuplicates(["key"]) if not isinstance(base.schema["key"].dataType, T.LongType) else t1
    # aggregates are written before they are joined: a join of two plain exchanges is one whose
    # hot keys adaptive execution can split
    equal = materialize(once.where(F.col("n") >= spec.span).groupBy("sha").agg(F.min("key").alias("rep"), F.count("*").alias("c")).where("c > 1"), "equal-texts")
    info = materialize(once.select("key", "n", "sha").join(equal, "sha", "left").select("key", "n", "sha", F.coalesce("rep", "key").alias("rep"), F.coalesce("c", F.lit(1)).alias("c")), "lengths")
    marks = materialize(info.where("c > 1").select("key", "c", (F.col("key") == F.col("rep")).alias("own")), "marks")
    occ = once.join(few(marks), "key", "left").where("own is null or own").select("key", "size", F.coalesce("c", F.lit(1).cast("long")).alias("c"), F.explode("hs").alias("h"))
    again = materialize(occ.groupBy("h").agg(F.sum("c").alias("c")).where("c > 1").select("h"), "repeated-seeds")
    cand = occ.join(again, "h").groupBy("key").agg(F.first("size").alias("size"), F.first("c").alias("c"), F.collect_set("h").alias("hs"))
    cand = materialize(cand, "candidates")
    discard(t1, again, equal, marks)
    x = materialize(_with_text(base, cand), "candidate-texts")
    discard(cand)
    texts = x.select("key", "size", "c", "text")
    places = materialize(_segments(spec, x), "places")
    segs = materialize(_once_each(places), "segments")
    # seeds with too many different segments for one deal; their own segments take part in none
    shared, k, now = _shared(segs), spec.k, places
    hot = shared.where(F.col("m") > spec.hot).select("h")
    while k < spec.span and hot.limit(1).count():
        k = (k + spec.span + 1) // 2
        large = materialize(now.join(few(hot), "h", "left_semi"), "hot-places")
        now = materialize(_refined(spec, k, _only(texts, large.select("key").distinct()), large), "refined")
        discard(large)
        finer = materialize(_once_each(now), "segments")
        more = _shared(finer)
        hot = more.where(F.col("m") > spec.hot).select("h")
        segs, places, shared = segs.unionByName(finer), places.unionByName(now), shared.unionByName(more)
    return Found(info, texts, segs, places, shared, shared.where(F.col("m") <= spec.hot).select("h"))


def _shared(segs: DataFrame) -> DataFrame:
    return materialize(segs.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "shared-seeds")


def _once_each(places: DataFrame) -> DataFrame:
    """Equal segments as one row: h, s, n, c, and key and lo of the earliest."""
    by = places.groupBy("h", "s")
    if not isinstance(places.schema["key"].dataType, T.LongType):
        return by.agg(F.min(F.struct("key", "lo")).alias("f"), F.first("n").alias("n"), F.sum("c").alias("c")).select("h", "s", "n", "c", "f.*")
    # key and place as one number, which a hash aggregation can keep the least of
    one = F.lit(1 << 32).cast("decimal(10,0)")
    x = by.agg(F.min((F.col("key").cast("decimal(19,0)") * one + F.col("lo")).cast("decimal(38,0)")).alias("f"), F.first("n").alias("n"), F.sum("c").alias("c"))
    key = F.floor(F.col("f") / one).cast("long")
    return x.withColumn("key", key).withColumn("lo", (F.col("f") - F.col("key").cast("decimal(19,0)") * one).cast("int")).select("h", "s", "n", "c", "key", "lo")


#: Bytes of candidates' keys that may be sent to every executor; more are joined by shuffle. A key in
#: a hash table takes about 64.
FEW_BYTES, KEY_BYTES = 32 << 20, 64


def few(keys: DataFrame) -> DataFrame:
    """The keys, marked for broadcast if they are known to be small."""
    return F.broadcast(keys) if keys.count() * KEY_BYTES <= FEW_BYTES else keys


def _only(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """texts without most of those that a join with keys (distinct) would shuffle in vain: where the
    keys are few, other texts are dropped before it."""
    return texts.join(F.broadcast(keys), "key", "left_semi") if keys.count() * KEY_BYTES <= FEW_BYTES else texts


def _with_text(base: DataFrame, cand: DataFrame) -> DataFrame:
    """Candidates' texts. Where the keys are few, other texts are dropped before the shuffle."""
    docs = base.select("key", "text")
    keys = few(cand.select("key"))
    if not isinstance(base.schema["key"].dataType, T.LongType):
        docs = docs.join(keys, "key", "left_semi").dropDuplicates(["key"])
    else:
        docs = docs.join(keys, "key", "left_semi")
    return docs.join(cand, "key")


def merged(runs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal covered runs: overlapping and touching ones become one."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out]
