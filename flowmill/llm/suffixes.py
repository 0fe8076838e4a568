"""Suffix-array dedup: bytes of 100-byte strings that also start earlier are removed.

The corpus is reduced to segments around repeated seeds (see repeats), dealt out by seed,
so equal 100-byte strings always meet in one deal. A segment that is the only one of its seed
meets no other; such segments are dealt by document instead, where neighbours join to one
stretch of text and their common bytes are sorted once. Each deal is sorted by the
difference-cover algorithm: the suffixes at places 1 and 2 modulo 3 are sorted by their
triples and named, names that repeat are sorted by recursion, the suffixes at places 0
follow from the letter before a named suffix, and the two orders are merged. Adjacent
suffixes that agree in 100 bytes are then one string, and all but its earliest place are
covered. Nothing else removes a byte.

A deal holds every different segment once, with the number of its occurrences: that many
equal suffixes stand side by side in the order. A string is repeated if its places, so counted, are more than one. In
the earliest occurrence of a segment those strings are covered that start earlier elsewhere;
in its later ones all. Documents of equal text are dealt out once, their segments counting as
often, and a further copy of one has what is covered in later occurrences. Only runs of strings that can be repeated are sorted: of segments
that occur again, and those whose hash occurs twice in the deal.

Sorting the whole corpus as one array would move every one of its suffixes through several
shuffles; the deals hold the only suffixes that can have an equal neighbour.

Defined cases: a null, empty or short text has nothing to remove; matches never cross
documents; strings are judged on the input; a string that overlaps its own repeat (as in
a run of one byte) counts; of equal texts of 100 bytes or more all but the first are
removed whole, a null doc_id being smallest; rows equal in id and text are one document, and
each gets its result; a very long text is cut into runs that overlap by 99 bytes; an empty
table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.llm.common import grouped, materialize, scratch, window_hashes
from flowmill.llm.repeats import BYTE, Spec, _schema, cut_out, find, keyed, merged, segment_texts, with_text

SPAN = 100
SPEC = Spec("byte", SPAN, 28)


def _named(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the tuples (keys[0][i], keys[1][i], ...), and their names from 1 in that order."""
    top = [int(k.max()) + 1 if len(k) else 1 for k in keys]
    if float(np.prod([float(t) for t in top])) < 2**62:
        one = keys[0].astype(np.int64)
        for k, t in zip(keys[1:], top[1:]):
            one = one * t + k
        order = np.argsort(one)
        new = np.diff(one[order]) != 0
    else:
        order = np.lexsort(keys[::-1])
        new = np.any([np.diff(k[order]) != 0 for k in keys], axis=0)
    return order, np.concatenate([[1], 1 + np.cumsum(new)])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Places of s (values of 1 or more) in the order of their suffixes."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    # letters that fit into one key: more than three name longer beginnings, to the same order
    bits = int(s.max()).bit_length()
    m = max(3, 62 // bits)
    t = np.concatenate([s.astype(np.int64), np.zeros(m + 1, np.int64)])
    # sample: places 1 and 2 modulo 3, the end of text included, so that halves are told apart
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    if m > 3:
        first = t[: n + 1]
        for j in range(1, m):
            first = first << bits | t[j : n + 1 + j]
        order, names = _named([first[sample]])
    else:
        order, names = _named([t[sample], t[sample + 1], t[sample + 2]])
    name = np.empty(len(sample), np.int64)
    name[order] = names
    if names[-1] < len(sample):
        order = suffix_array(name)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    ordered = sample[order]
    ordered = ordered[ordered < n]
    zero = np.arange(0, n, 3)
    zero = zero[_named([t[zero], rank[zero + 1]])[0]]
    # how many sampled suffixes come before each of the others
    big = n + 3
    s1, s2 = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    pair = lambda i: t[i] * big + rank[i + 1]
    top = int(t.max()) + 1
    if top * float(top) * big < 2**62:
        before2 = np.searchsorted((t[s2] * top + t[s2 + 1]) * big + rank[s2 + 2], (t[zero] * top + t[zero + 1]) * big + rank[zero + 2])
    else:
        both = np.concatenate([s2, zero])
        o, nm = _named([t[both], t[both + 1], rank[both + 2]])
        code = np.empty(len(both), np.int64)
        code[o] = nm
        before2 = np.searchsorted(code[: len(s2)], code[len(s2) :])
    place = np.arange(len(zero)) + np.searchsorted(pair(s1), pair(zero)) + before2
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = zero
    out[~taken] = ordered
    return out


def _laid_out(span: int, segs: list[bytes], joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segments end to end, a zero byte after each stretch; where each segment begins; where
    each stretch ends. A joined segment continues the one before, with which it shares span - 1
    bytes."""
    parts, pos, ends, at = [], [], [], 0
    for seg, on in zip(segs, joined.tolist()):
        if on:
            pos.append(at - span + 1)
            parts.append(seg[span - 1 :])
        else:
            if at:
                ends.append(at)
                parts.append(b"\0")
                at += 1
            pos.append(at)
            parts.append(seg)
        at += len(parts[-1])
    return np.frombuffer(b"".join([*parts, b"\0"]), np.uint8), np.array(pos, np.int64), np.array([*ends, at], np.int64)


def _alike(span: int, text: np.ndarray, pos: np.ndarray, ends: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs [a, z) of text that consist of windows that can be repeated: their segment occurs
    more than once, or another window shares their hash.

    Equal windows have equal hashes, so nothing is lost; the suffix sort decides.
    """
    begin = np.concatenate([[0], ends[:-1] + 1])
    left = np.repeat(ends, ends - begin + 1) - np.arange(len(text))
    at = np.flatnonzero(left >= span)
    keep = c[np.searchsorted(pos, at, "right") - 1] > 1
    if not keep.all():
        h = window_hashes(BYTE[text], span)[at]
        s = np.sort(h)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            keep |= twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
        at = at[keep]
    if not len(at):
        return at, at
    new = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
    return at[new], at[np.append(new[1:], len(at)) - 1] + span


def engine(spec: Spec, segs: list[bytes], rank: np.ndarray, lo: np.ndarray, c: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """segs: different segments, with the rank of their first document, their place in it, how often
    they occur, and whether one continues the segment before. Where they stand when laid end to
    end; the places of repeated windows, by adjacent prefixes of the suffix array; and of those
    that start earlier elsewhere."""
    span, none = spec.span, np.zeros(0, np.int64)
    whole, pos, ends = _laid_out(span, segs, joined)
    a, z = _alike(span, whole, pos, ends, c)
    if not len(a):
        return pos, none, none
    # the runs, each with a separator after it: letter 1, which no byte uses
    size = z - a + 1
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    source = np.arange(int(size.sum())) - np.repeat(start - a, size)
    text = whole[source]
    letters = text.astype(np.int64) + 2
    letters[start + size - 1] = 1
    sa = suffix_array(letters)
    window = np.ones(len(letters), bool)  # where a whole window begins
    for k in range(span):
        window[(start + size - 1 - k)] = False
    sa = sa[window[sa]]
    text = np.append(text, np.zeros(8, np.uint8))
    at8 = np.lib.stride_tricks.sliding_window_view(text, 8)
    same = np.ones(len(sa) - 1, bool)
    for k in [*range(0, span - 8, 8), span - 8] if span >= 8 else []:
        left = np.flatnonzero(same)
        same[left] = at8[sa[left] + k].view(np.uint64).ravel() == at8[sa[left + 1] + k].view(np.uint64).ravel()
    for k in range(span) if span < 8 else []:
        same &= text[sa[:-1] + k] == text[sa[1:] + k]
    begin = np.flatnonzero(np.concatenate([[True], ~same]))
    place = source[sa]
    seg = np.searchsorted(pos, place, "right") - 1
    # how often a string occurs: each of its places as often as the segment
    times = np.add.reduceat(c[seg], begin)
    count = np.diff(np.append(begin, len(sa)))
    repeated = np.sort(place[np.repeat(times > 1, count)])
    shared = np.repeat(count > 1, count)
    place, seg, group = place[shared], seg[shared], np.repeat(np.arange(len(begin)), count)[shared]
    if not len(seg):
        return pos, repeated, none
    at = lo[seg] + place - pos[seg]
    o = np.lexsort((at, rank[seg], group))
    head = np.concatenate([[True], np.diff(group[o]) != 0])
    # one place of one document may be in two segments of a deal: it is not later than itself
    r, p, which = rank[seg[o]], at[o], np.cumsum(head) - 1
    later = (r != r[head][which]) | (p != p[head][which])
    return pos, repeated, np.sort(place[o][later])


def _runs(span: int, pos: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows at these places that follow or overlap one another as runs [a, z) of a segment."""
    if not len(at):
        return at, at, at
    seg = np.searchsorted(pos, at, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (np.diff(seg) != 0) | (np.diff(at) > span)]))
    last = np.append(new[1:], len(at)) - 1
    return seg[new], at[new] - pos[seg[new]], at[last] - pos[seg[new]] + span


def _settled(find: Callable, spec: Spec, key: pa.Array, h: pa.Array, s: pa.Array, lo: np.ndarray, c: np.ndarray, segs: list[bytes], joined: np.ndarray) -> pa.RecordBatch:
    """Rows h, s, key, lo, later, a, b: units of a segment that are covered, in its earliest place
    (key, lo) or else (later) in all its other ones."""
    rank = pc.rank(key, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    pos, repeated, earlier = find(spec, segs, rank, lo, c, joined)
    first, again = _runs(spec.span, pos, earlier), _runs(spec.span, pos, repeated)
    again = tuple(x[c[again[0]] > 1] for x in again)
    of, a, b = (np.concatenate(x) for x in zip(first, again))
    later = np.arange(len(of)) >= len(first[0])
    t = pa.array(of)
    return pa.RecordBatch.from_arrays([h.take(t), s.take(t), key.take(t), pa.array(lo[of], pa.int32()), pa.array(later), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["h", "s", "key", "lo", "later", "a", "b"])


def compare_deals(spec: Spec, segs: DataFrame) -> DataFrame:
    """segs with their texts, all of a seed in one partition and sorted by it: _settled() rows."""

    def run(it):
        for t in grouped(it, ["h"], spec.deal):
            t = t.combine_chunks()
            yield _settled(engine, spec, t["key"].combine_chunks(), t["h"].combine_chunks(), t["s"].combine_chunks(), t["lo"].to_numpy().astype(np.int64), t["c"].to_numpy(), t["seg"].to_pylist(), np.zeros(len(t), bool))

    return segs.select("h", "s", "key", "lo", "seg", "c").mapInArrow(run, _schema(segs, "h long, s binary", "lo int, later boolean, a int, b int"))


def compare_stretches(spec: Spec, docs: DataFrame) -> DataFrame:
    """docs: key, text, at (segments without others of their seed, by place): _settled() rows."""

    def run(it):
        held: list[tuple] = []
        size = 0

        def settle(kind):
            cuts = [x for _, x in held]
            many = [len(x.lo) for x in cuts]
            join = lambda xs: pa.chunked_array(xs).combine_chunks()
            on = [np.append(False, x.lo[1:] == x.lo[:-1] + x.n[:-1] - spec.span + 1) for x in cuts]
            key = pa.array([k for k, _ in held], kind).take(pa.array(np.repeat(np.arange(len(cuts)), many)))
            return _settled(engine, spec, key, join([x.h for x in cuts]), join([x.s for x in cuts]), np.concatenate([x.lo for x in cuts]), join([x.c for x in cuts]).to_numpy(), [g for x in cuts for g in x.segs], np.concatenate(on))

        for b in it:
            kind = b.column(0).type
            for key, x in cut_out(spec, b):
                for part in x.parts(spec.deal):
                    held.append((key, part))
                    size += int(part.n.sum())
                    if size >= 3 * spec.deal:  # of overlapping segments
                        yield settle(kind)
                        held, size = [], 0
        if held:
            yield settle(kind)

    return docs.mapInArrow(run, _schema(docs, "h long, s binary", "lo int, later boolean, a int, b int"))


def covered(spec: Spec, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n, sha, rep) of every document, and (key, copy, text, runs) of those with something to
    remove: first documents of equal text, and their copies (one row for all of them)."""
    found = find(spec, base)
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deals = segment_texts(spec, found.texts, found.segs.join(found.several, "h", "left_semi")).repartition(parts, "h").sortWithinPartitions("h")
    lone = with_text(found.texts, found.segs.where("c > 1").join(found.shared.select("h"), "h", "left_anti"))
    cover = materialize(compare_deals(spec, deals).unionByName(compare_stretches(spec, lone)), "covered")
    run = [(F.col("lo") + F.col(x)).alias(x) for x in "ab"]
    first = cover.where("not later").select("key", F.lit(False).alias("copy"), *run)
    other = cover.where("later").select("h", "s", F.col("key").alias("k0"), F.col("lo").alias("l0"), "a", "b")
    # a copy's places are all later than its first document's
    elsewhere = (F.col("key") != F.col("k0")) | (F.col("lo") != F.col("l0"))
    of = F.array_compact(F.array(F.when(elsewhere, F.lit(False)), F.when(F.col("c") > 1, F.lit(True))))
    again = found.places.join(other, ["h", "s"]).select("key", F.explode(of).alias("copy"), *run)
    runs = first.unionByName(again).groupBy("key", "copy").agg(F.collect_set(F.struct("a", "b")).alias("runs"))
    return found.info, found.texts.select("key", "text").join(runs, "key").select("key", "copy", "text", "runs")


def remove(docs: DataFrame, spec: Spec = SPEC, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256; with keep_text
    also kept, the remaining text, for documents of which a part goes: null where nothing
    or everything is removed. There a run shrinks to whole characters."""
    base = keyed(docs, id_col, text_col)

    def run(it):
        for b in it:
            out: list = [[], [], [], []]
            for text, runs in zip(b.column(2), b.column(3)):
                raw = text.as_py().encode()
                spans = merged([(r["a"], r["b"]) for r in runs.as_py()], len(raw))
                kept, at, whole, upto = [], 0, [], 0
                for a, z in spans:
                    kept.append(raw[at:a])
                    at = z
                    while a < z and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while z > a and z < len(raw) and raw[z] & 0xC0 == 0x80:
                        z -= 1
                    whole.append(raw[upto:a])
                    upto = z
                kept.append(raw[at:])
                whole.append(raw[upto:])
                left = b"".join(kept)
                out[0].append(len(raw) - len(left))
                out[1].append(len(spans))
                out[2].append(hashlib.sha256(left).hexdigest())
                out[3].append(b"".join(whole).decode() if keep_text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["rep", "copy", "removed", "spans", "left", "kept"])

    kind = base.schema["key"].dataType
    with scratch() as tables:
        info, cut = covered(spec, base)
        changed = tables.keep(materialize(cut.mapInArrow(run, T.StructType([T.StructField("rep", kind), *T._parse_datatype_string("copy boolean, removed long, spans long, left string, kept string").fields])), "changed"))
        tables.keep(info)
    per_key = info.withColumn("copy", F.col("key") != F.col("rep")).join(changed, ["rep", "copy"], "left").select(
        "key",
        F.col("n").alias("n_bytes"),
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("left", "sha").alias("kept_sha256"),
        *(["kept"] if keep_text else []),
    )
    if isinstance(kind, T.LongType) and not keep_text:
        return per_key.withColumnRenamed("key", id_col)
    rows = base.select("key", "row" if keep_text else F.col(f"row.`{id_col}`").alias(id_col))
    return rows.join(per_key, "key").drop("key")


def op8(spark, sf_dir: str) -> DataFrame:
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The contract's result in plain SQL, for small tables: two hexadecimal digits stand for a byte.
OP8_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
p as (select doc_id, unnest(range(0, len(x) // 2 - 99)) as pos, x from d),
w as (select doc_id, pos, md5(substr(x, 2 * pos + 1, 200)) as h from p),
f as (select h, min((doc_id, pos)) as first from w group by h having count(*) > 1),
t as (select w.doc_id, w.pos from w join f on w.h = f.h and (w.doc_id, w.pos) <> f.first),
o as (select doc_id, pos, max(pos) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as was from t),
g as (select doc_id, pos, sum(case when was is null or pos > was + 100 then 1 else 0 end) over (partition by doc_id order by pos) as span from o),
r as (select doc_id, span, min(pos) as a, max(pos) + 100 as b from g group by doc_id, span),
n as (select doc_id, a, b, lead(a) over (partition by doc_id order by a) as next from r),
k as (
  select doc_id, count(*) as spans, sum(b - a) as gone, min(a) as first,
         list(b order by a) as b, list(next order by a) as next
  from n group by doc_id)
select d.doc_id, (len(x) // 2)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
       sha256(unhex(case when gone is null then x else
         substr(x, 1, 2 * first) || array_to_string(list_transform(range(1, len(b) + 1), lambda i: substr(x, 2 * b[i] + 1, 2 * (coalesce(next[i], len(x) // 2) - b[i]))), '') end)) as kept_sha256
from d left join k on d.doc_id = k.doc_id
"""
