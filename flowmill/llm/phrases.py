"""Repeated-phrase automata: words of 20-word windows that also start earlier are removed.

1. Candidates come from repeats, with words as units: segments of words around seeds that
   occur more than once.
2. Recurring passages are confirmed. A segment that occurs again as a whole is one passage; where
   segments of one seed differ, their words are compared, and the windows that several of them
   hold make passages, as long as they follow one another in all of these. A passage comes with
   its earliest place.
3. Each document gets the passages of its segments, as places. Those that overlap there and at
   their earliest place alike are one longer passage. Documents are taken in blocks of about
   `BLOCK` bytes of text, and a block's passages are compiled with pyahocorasick into automata:
   one per shard of at most `SHARD` words of passages. The alphabet is words, each standing as
   one character, and any other word as a character that no passage has. So a match is whole words.
4. Each document streams, whole, through all automata of its block. What they locate later than
   a passage's earliest place is covered. Nothing else removes a word. A document without a
   repeated seed cannot hold a recurring window; none is sent to it, and it keeps all words.
   Documents of equal words stream once: in all but the first, everything located is covered, as
   it starts earlier in the first.

A task holds the texts of one block and one automaton at a time.

Defined cases: a null, empty or short text loses nothing; words are maximal runs of anything
but bytes 0x20 and 0x09-0x0D and are compared as they are, those of more than 64 bytes by
their SHA-256; kept words are joined by one space; windows never cross documents and are
judged on the input; a window that overlaps its own repeat counts; of equal windows the one
of the smallest doc_id stays, a null doc_id being smallest; rows equal in id and text are one
document, and each gets its result; a very long text is cut into overlapping runs for its
seeds and streamed whole; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmill.llm.common import grouped, materialize, scratch, words
from flowmill.llm.repeats import Found, Spec, _schema, find, keyed, merged, segment_texts, tokens

SPAN = 20
SPEC = Spec("word", SPAN, 7)
#: Words, and bytes, of passages in one automaton (a word is at most one node); bytes of text in a block.
SHARD, SHARD_BYTES, BLOCK = 1_000_000, 16 << 20, 4 << 20
#: Words of a text that are turned into letters at once.
STEP = 1 << 16
OTHER = "\x01"
_SPACE = re.compile(b" ")


def recurring(spec: Spec, segs: list[bytes]) -> list[tuple[int, list[tuple[int, int]]]]:
    """Passages that several of the segments hold, or one holds twice: (words, where: segment and
    first word, in order). Windows that follow one another wherever they stand are one passage."""
    at: dict[bytes, list[tuple[int, int]]] = {}
    for i, raw in enumerate(segs):
        ends = [-1, *[m.start() for m in _SPACE.finditer(raw)], len(raw)]
        for j, (a, z) in enumerate(zip(ends, ends[spec.span :])):
            at.setdefault(raw[a + 1 : z], []).append((i, j))
    where = sorted(x for x in at.values() if len(x) > 1)
    begun = {x[0]: n for n, x in enumerate(where)}
    done = [False] * len(where)
    out = []
    for n, x in enumerate(where):
        if done[n]:
            continue
        last = x
        while (m := begun.get((last[0][0], last[0][1] + 1))) is not None and where[m] == [(i, j + 1) for i, j in last]:
            last = where[m]
            done[m] = True
        out.append((last[0][1] - x[0][1] + spec.span, x))
    return out


def _confirmed(spec: Spec, segs: DataFrame) -> DataFrame:
    """segs with their words, all of a seed in one partition -> h, s, key, lo, off, n: passages of
    different segments, as n words from word off of the segment."""

    def run(it):
        for t in grouped(it, ["h"], spec.deal):
            t = t.combine_chunks()
            h, s, key, lo, text = (t[c].to_pylist() for c in ("h", "s", "key", "lo", "seg"))
            out: list = [[], [], [], [], [], []]
            a = 0
            for z in range(1, len(h) + 1):
                if z < len(h) and h[z] == h[a]:
                    continue
                if z - a > 1:
                    for n, at in recurring(spec, text[a:z]):
                        k, p = min((key[a + i], lo[a + i] + j) for i, j in at)
                        for i, j in dict(reversed(at)).items():  # the first place in each segment
                            for col, v in zip(out, (h[a], s[a + i], k, p, j, n)):
                                col.append(v)
                a = z
            if out[0]:
                kinds = (pa.int64(), pa.binary(), t.schema.field("key").type, pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["h", "s", "key", "lo", "off", "n"])

    return segs.select("h", "s", "key", "lo", "seg").mapInArrow(run, _schema(segs, "h long, s binary", "lo int, off int, n int"))


def passages(spec: Spec, found: Found) -> DataFrame:
    """h, s, off, n: a passage is n words from word off of this segment; key, lo: its earliest place."""
    segs = found.segs
    parts = int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deals = segment_texts(spec, found.texts, segs.join(found.several, "h", "left_semi")).repartition(parts, "h").sortWithinPartitions("h")
    whole = segs.where("c > 1").select("h", "s", "key", "lo", F.lit(0).alias("off"), "n")
    return materialize(whole.unionByName(_confirmed(spec, deals)), "passages")


class Letters(dict):
    """A character for each word that is asked for; words of passages only."""

    def __missing__(self, w: bytes) -> str:
        i = len(self) + 256
        c = self[w] = chr(i if i < 0xD800 else i + 0x800)
        return c


def machine(shard: dict[bytes, tuple]) -> tuple:
    """The automaton of passages (words joined by spaces -> first place), and its letters."""
    letters = Letters()
    m = ahocorasick.Automaton()
    for p, first in shard.items():
        word = "".join([letters[w] for w in p.split(b" ")])
        m.add_word(word, (len(word) - 1, first))
    m.make_automaton()
    return m, letters


class Document:
    """The words of a text, by their places in it."""

    def __init__(self, raw: bytes, copies: int) -> None:
        self.raw, self.copies = raw, copies
        self.own: list[tuple[int, int]] = []
        self.every: list[tuple[int, int]] = []
        self.ws, self.we, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))

    def passage(self, at: int, n: int) -> bytes:
        return b" ".join(tokens(self.raw[self.ws[at] : self.we[at + n - 1]]))

    def spelled(self, letters: dict) -> str:
        """The words as letters, in steps of bounded size."""
        step = range(0, len(self.ws), STEP)
        return "".join(["".join([letters.get(w, OTHER) for w in tokens(self.raw[self.ws[a] : self.we[min(a + STEP, len(self.we)) - 1]])]) for a in step])

    def without(self, runs: list[tuple[int, int]]) -> tuple[int, bytes]:
        """How many words the runs cover, and the others joined by spaces."""
        kept, gone, at = [], 0, 0
        for a, z in [*merged(runs, len(self.ws)), (len(self.ws), len(self.ws))]:
            if a > at:
                kept.append(b" ".join(self.raw[self.ws[at] : self.we[a - 1]].split()))
            gone, at = gone + z - a, z
        return gone, b" ".join(kept)


def locate(shard: dict[bytes, tuple], docs: dict) -> None:
    """Stream docs (by key) through the shard's automaton; add what is later than a passage's first
    place to a document's own runs, and all to those of its copies."""
    m, letters = machine(shard)
    for key, doc in docs.items():
        for end, (back, first) in m.iter(doc.spelled(letters)):
            if (key, end - back) > first:
                _extend(doc.own, end - back, end + 1)
            if doc.copies > 1:
                _extend(doc.every, end - back, end + 1)


def _extend(runs: list, a: int, z: int) -> None:
    if runs and runs[-1][0] <= a <= runs[-1][1]:
        runs[-1] = (runs[-1][0], max(runs[-1][1], z))
    else:
        runs.append((a, z))


def joined(key: pa.Array, copies: np.ndarray, at: pa.Array) -> tuple[np.ndarray, ...]:
    """at: of each document the passages lo, n, key0, lo0 (words from lo, earliest place). Those that
    touch at a constant distance from one earlier document are one; those that are their own
    earliest place go, unless there are copies. Columns doc, lo, n, lo0 and a row with its key0."""
    doc = np.repeat(np.arange(len(key)), pc.list_value_length(at).to_numpy(zero_copy_only=False).astype(np.int64))
    rows = at.flatten()
    field = lambda c: rows.field(rows.type.get_field_index(c))
    lo, n, lo0 = (field(c).to_numpy().astype(np.int64) for c in ("lo", "n", "lo0"))
    both = pc.dictionary_encode(pa.chunked_array([key, field("key0")])).combine_chunks().indices.to_numpy()
    own, first = both[: len(key)], both[len(key) :]
    o = np.lexsort((lo, lo0 - lo, first, doc))
    doc, lo, end, lo0, first = doc[o], lo[o], (lo + n)[o], lo0[o], first[o]
    group = np.cumsum(np.append(True, (np.diff(doc) != 0) | (np.diff(first) != 0) | (np.diff(lo0 - lo) != 0))) if len(o) else o
    big = int(end.max()) + 1 if len(o) else 1
    far = np.maximum.accumulate(end + group * big)
    new = np.flatnonzero(np.append(True, lo[1:] + group[1:] * big > far[:-1])) if len(o) else o
    last = np.append(new[1:], len(o))[: len(new)] - 1
    size = far[last] - group[last] * big - lo[new]
    keep = (first[new] != own[doc[new]]) | (lo0[new] != lo[new]) | (copies[doc[new]] > 1)
    new, size = new[keep], size[keep]
    return doc[new], lo[new], size, lo0[new], o[new]


def _streamed(spec: Spec, docs: DataFrame, keep_text: bool) -> DataFrame:
    """docs: key, c (equal texts), text, at (its passages) -> rep, copy, removed, left, kept."""
    kind = pa.int64() if isinstance(docs.schema["key"].dataType, T.LongType) else pa.binary()

    def settle(block: dict, asked: list[tuple]) -> pa.RecordBatch:
        shard: dict[bytes, tuple] = {}
        nodes = size = 0
        for key, lo, n, first in asked:
            p = block[key].passage(lo, n)
            if p in shard:
                shard[p] = min(shard[p], first)
                continue
            shard[p] = first
            nodes, size = nodes + n, size + len(p)
            if nodes >= SHARD or size >= SHARD_BYTES:
                locate(shard, block)
                shard, nodes, size = {}, 0, 0
        if shard:
            locate(shard, block)
        out: list = [[], [], [], [], []]
        for key, doc in block.items():
            for copy, runs in enumerate((doc.own, doc.every)):
                if runs:
                    gone, left = doc.without(runs)
                    for col, v in zip(out, (key, bool(copy), gone, hashlib.sha256(left).hexdigest(), left.decode() if keep_text else None)):
                        col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], pa.string())], names=["rep", "copy", "removed", "left", "kept"])

    def run(it):
        block, asked, size = {}, [], 0
        for b in it:
            copies = b.column(1).to_numpy()
            doc, lo, n, lo0, row = joined(b.column(0), copies, b.column(3))
            rows = b.column(3).flatten()
            key0 = rows.field(rows.type.get_field_index("key0")).take(pa.array(row)).to_pylist()
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            lo, n, lo0 = lo.tolist(), n.tolist(), lo0.tolist()
            for i, (key, text) in enumerate(zip(b.column(0).to_pylist(), b.column(2))):
                a, z = int(cut[i]), int(cut[i + 1])
                raw = text.as_py().encode()
                block[key] = Document(raw, int(copies[i]))
                asked += [(key, x, m, (k, f)) for x, m, k, f in zip(lo[a:z], n[a:z], key0[a:z], lo0[a:z])]
                size += len(raw)
                if size >= BLOCK:
                    yield settle(block, asked)
                    block, asked, size = {}, [], 0
        if block:
            yield settle(block, asked)

    return docs.mapInArrow(run, T.StructType([T.StructField("rep", docs.schema["key"].dataType), *T._parse_datatype_string("copy boolean, removed long, left string, kept string").fields]))


def remove(docs: DataFrame, spec: Spec = SPEC, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256 (and kept, the remaining
    words, for documents of which a part goes)."""
    base = keyed(docs, id_col, text_col)
    kind = base.schema["key"].dataType
    with scratch() as tables:
        found = find(spec, base)
        known = passages(spec, found).withColumnsRenamed({"key": "key0", "lo": "lo0"})
        at = found.places.select("h", "s", "key", "lo").join(known, ["h", "s"]).select("key", F.struct((F.col("lo") + F.col("off")).alias("lo"), "n", "key0", "lo0").alias("p"))
        rows = found.texts.select("key", "c", "text").join(at.groupBy("key").agg(F.collect_list("p").alias("at")), "key").select("key", "c", "text", "at")
        changed = tables.keep(materialize(_streamed(spec, rows, keep_text), "changed"))
        info = tables.keep(found.info)
    per_key = info.withColumn("copy", F.col("key") != F.col("rep")).join(changed, ["rep", "copy"], "left").select(
        "key",
        F.col("n").alias("n_words"),
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("left", "sha").alias("kept_sha256"),
        *(["kept"] if keep_text else []),
    )
    if isinstance(kind, T.LongType) and not keep_text:
        return per_key.withColumnRenamed("key", id_col)
    return base.select("key", "row" if keep_text else F.col(f"row.`{id_col}`").alias(id_col)).join(per_key, "key").drop("key")


def op3(spark, sf_dir: str) -> DataFrame:
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The contract's result in plain SQL, for small tables.
OP3_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, unnest(range(1, len(w) - 18)) as pos, w from d),
x as (select doc_id, pos, md5(array_to_string(w[pos:pos + 19], ' ')) as h from p),
f as (select h, min((doc_id, pos)) as first from x group by h having count(*) > 1),
c as (select x.doc_id, unnest(range(x.pos, x.pos + 20)) as pos from x join f on x.h = f.h and (x.doc_id, x.pos) <> f.first),
g as (select doc_id, list(distinct pos) as gone from c group by doc_id),
k as (
  select d.doc_id, w, coalesce(gone, []) as gone,
         case when gone is null then w else list_filter(w, lambda v, i: not list_contains(gone, i::bigint)) end as kept
  from d left join g on d.doc_id = g.doc_id)
select doc_id, len(w)::bigint as n_words, len(gone)::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k
"""
