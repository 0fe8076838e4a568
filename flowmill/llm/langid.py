"""Language ID by Bayesian evidence fusion.

For each document the log posterior of a language adds up

- the text: log likelihood of its byte trigrams (hashed to 2**16 classes, smoothed), times
  `temper`, as overlapping trigrams are not independent;
- the declared markup language: how often documents whose text speaks for a language declare
  each value, counted over all documents and smoothed towards a share of right ones;
- the address suffix: how often documents whose text speaks for a language stand under each
  suffix, counted over all documents and smoothed towards the suffix's share of all;
- the host: a prior smoothed towards that of its domain (its last two labels), itself smoothed
  towards that of all documents; the counts behind these are grouped aggregations over all
  documents.

Trigram counts are fitted on about `max_rows` rows with a declared language, dealt to the
languages evenly: all rows of a small language, and of a larger one those that a salted hash
of id and text picks. Every declared value that gets a row is a language. Tables on the driver
are bounded by that sample: at most `max_rows` languages, each with 2**16 classes. Hosts and
suffixes stay tables; they are broadcast if they take less than `broadcast` bytes and joined by
shuffle beyond.

A document is rejected if its text has no letters, or if no language reaches `least`.

Defined cases: a null or empty text is rejected, and its best guess comes from the other
evidence; a null declaration or host, or a host without a dot, says nothing about language or
suffix; a host that no vote was counted for has its domain's prior, or that of all documents;
rows with equal or null ids are judged one by one; equal posteriors go to the alphabetically
first language; a very long text is scored whole; with no usable language at all, everything
is rejected with a null language; an empty table gives no rows; other columns may have any
names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import batches, flat, materialize, text_of

CLASSES = 1 << 16
#: Of the hash that picks fitted rows: its range and its salt.
SPREAD, SALT = 1 << 40, "langid"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass(frozen=True)
class Spec:
    max_rows: int = 20_000
    temper: float = 1 / 3
    right: float = 0.9
    suffix_weight: float = 20.0
    host_weight: float = 20.0
    domain_weight: float = 100.0
    least: float = 0.5
    broadcast: int = 16 << 20


def trigrams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The class of the trigram at each byte; CLASSES where it would leave the document."""
    n = len(data)
    x = _LOWER[data].astype(np.uint32)
    idx = np.full(n, CLASSES, np.int64)
    if n > 2:
        idx[: n - 2] = ((x[: n - 2] << 16 | x[1 : n - 1] << 8 | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    ends = offs[1:]
    for k in (1, 2):
        at = ends - k
        idx[at[(at >= offs[:-1])]] = CLASSES
    return idx


@dataclass
class Text:
    """Trigram log likelihoods: one row per class (the last, for none, is zero)."""

    langs: list[str]
    table: np.ndarray

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offs) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(offs) > 0)
        if len(full):
            idx = trigrams(data, offs)
            for j in range(len(self.langs)):
                out[full, j] = np.add.reduceat(self.table[:, j][idx], offs[:-1][full], dtype=np.float64)
        return out


def evidence(docs: DataFrame, text: str | Column = "text", declared: str | Column = "lang", host: str | Column = "source", suffix: Column | None = None, key: str = "doc_id") -> DataFrame:
    """Columns _key, _text, _declared, _host, _suffix beside those of docs."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    host = F.lower(c(host))
    suffix = F.regexp_extract(host, r"\.([a-z]+)$", 1) if suffix is None else suffix
    return docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("_row"), F.col(key).alias("_key"), text_of(c(text)).alias("_text"), F.lower(F.regexp_extract(F.coalesce(c(declared), F.lit("")), "^([A-Za-z]+)", 1)).alias("_declared"), F.coalesce(host, F.lit("")).alias("_host"), F.coalesce(suffix, F.lit("")).alias("_suffix"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Of web pages: visible text, the lang attribute of html, host and suffix of the url."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    site = F.regexp_replace(host, r"^(www|m|blog)\.", "")
    return evidence(pages, body, F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1), site, key="page_id")


def shares(sizes: dict[str, int], max_rows: int) -> dict[str, float]:
    """The part of each language's rows to fit: max_rows dealt evenly, and what small languages
    leave over dealt to the others."""
    out, left = {}, float(max_rows)
    for i, (x, n) in enumerate(sorted(sizes.items(), key=lambda s: (s[1], s[0]))):
        out[x] = min(1.0, left / (len(sizes) - i) / n)
        left -= out[x] * n
    return out


def learn_text(ev: DataFrame, spec: Spec = Spec()) -> Text:
    said = ev.where((F.col("_declared") != "") & (F.octet_length("_text") > 2))
    sizes = {r["_declared"]: r.n for r in said.groupBy("_declared").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_declared").limit(spec.max_rows).collect()}
    part, limit = shares(sizes, spec.max_rows), F.lit(SPREAD)
    for x in sorted(sizes):
        if part[x] < 1:
            limit = F.when(F.col("_declared") == x, F.lit(int(part[x] * SPREAD))).otherwise(limit)
    rows = said.where(F.col("_declared").isin(list(sizes)) & (F.pmod(F.xxhash64(F.lit(SALT), "_key", "_text"), F.lit(SPREAD)) < limit))
    none = Text([], np.zeros((CLASSES + 1, 0), np.float32))

    def run(it):
        for b in batches(it, 4 << 20, "_text"):
            data, offs = flat(b.column(0))
            lang = pc.dictionary_encode(b.column(1))
            of = np.repeat(lang.indices.to_numpy().astype(np.int64), np.diff(offs))
            at, n = np.unique(of * (CLASSES + 1) + trigrams(data, offs), return_counts=True)
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(at // (CLASSES + 1))), pa.array(at % (CLASSES + 1)), pa.array(n)], names=["lang", "at", "n"])

    got = rows.select("_text", "_declared").mapInArrow(run, "lang string, at long, n long").where(F.col("at") < CLASSES).groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow() if sizes else None
    if got is None or not got.num_rows:
        return none
    langs = sorted(set(got["lang"].to_pylist()))
    counts = np.zeros((len(langs), CLASSES))
    counts[np.searchsorted(np.array(langs, object), got["lang"].to_numpy(zero_copy_only=False)), got["at"].to_numpy()] = got["n"].to_numpy()
    counts += 0.05
    table = np.log(counts / counts.sum(axis=1, keepdims=True)).T
    return Text(langs, np.vstack([table, np.zeros((1, len(langs)))]).astype(np.float32))


@dataclass
class Model:
    text: Text
    declared: dict[str, np.ndarray]
    other: np.ndarray
    world: np.ndarray
    hosts: DataFrame | None
    suffixes: DataFrame | None
    spec: Spec


def _domain(host: Column) -> Column:
    """The last two labels of a host, or all of a shorter one."""
    two = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return F.when(two != "", two).otherwise(host)


def learn(ev: DataFrame, spec: Spec = Spec()) -> Model:
    text = learn_text(ev, spec)
    langs, n = text.langs, len(text.langs)
    if not n:
        return Model(text, {}, np.zeros(0), np.zeros(0), None, None, spec)

    def best(it):
        for b in batches(it, 4 << 20, "_text"):
            data, offs = flat(b.column(0))
            s = text.scores(data, offs)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(np.where(np.diff(offs) > 2, s.argmax(axis=1), -1), pa.int32())], names=["declared", "host", "suffix", "best"])

    votes = ev.select("_text", "_declared", "_host", "_suffix").mapInArrow(best, "declared string, host string, suffix string, best int").where("best >= 0")
    votes = votes.withColumn("declared", F.when(F.col("declared").isin(*langs, ""), F.col("declared")).otherwise("?"))
    votes = materialize(votes.groupBy("declared", "host", "suffix", "best").agg(F.count("*").alias("n")), "language-votes")
    # declared values, given the language
    table, of = np.zeros((n + 1, n)), {x: i for i, x in enumerate(langs)}
    for r in votes.where("declared != ''").groupBy("declared", "best").agg(F.sum("n").alias("n")).collect():
        table[of.get(r.declared, n), r.best] += r.n
    prior = np.full((n + 1, n), (1 - spec.right) / n)
    prior[np.arange(n), np.arange(n)] = spec.right
    p = (table + 10 * prior) / (table.sum(axis=0) + 10)
    declared = {x: np.log(p[i]) for i, x in enumerate(langs)}
    world = np.ones(n)
    for r in votes.groupBy("best").agg(F.sum("n").alias("n")).collect():
        world[r.best] += r.n
    world /= world.sum()
    counts = F.array(*[F.sum(F.when(F.col("best") == i, F.col("n")).otherwise(0)).cast("double") for i in range(n)])
    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    # suffixes, given the language
    under = materialize(votes.where("suffix != ''").groupBy("suffix").agg(counts.alias("c"), F.sum("n").alias("n")), "suffix-votes")
    kinds, all_, *each = under.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), *[F.coalesce(F.sum(F.col("c")[i]), F.lit(0.0)) for i in range(n)]).first()
    w = spec.suffix_weight
    share = (F.col("n") + 1) / F.lit(float(all_ + kinds))
    like = F.transform(F.arrays_zip(F.col("c"), array(each).alias("e")), lambda z: F.log((z["c"] + w * share) / (z["e"] + w)))
    suffixes = materialize(under.select(F.col("suffix").alias("_suffix"), like.alias("_like")), "suffix-likelihoods")
    # the languages of hosts, by domain
    smoothed = lambda c, parent, w: F.transform(F.arrays_zip(c.alias("c"), parent.alias("p")), lambda z: (z["c"] + w * z["p"]) / (F.aggregate(c, F.lit(0.0), lambda a, x: a + x) + w))
    own = votes.groupBy("host").agg(counts.alias("c")).withColumn("domain", _domain(F.col("host")))
    sums = F.array(*[F.sum(F.col("c")[i]) for i in range(n)])
    domains = materialize(own.groupBy("domain").agg(sums.alias("c")).select("domain", smoothed(F.col("c"), array(world), spec.domain_weight).alias("dp")), "domain-priors")
    hosts = materialize(own.join(domains, "domain").select(F.col("host").alias("_host"), smoothed(F.col("c"), F.col("dp"), spec.host_weight).alias("_prior")), "host-priors")
    return Model(text, declared, np.log(p[n]), world, hosts, suffixes, spec)


def _beside(ev: DataFrame, table: DataFrame, key: str, m: Model) -> DataFrame:
    """ev with the columns of table, sent along if it is known to be small."""
    small = table.count() * (8 * len(m.text.langs) + 64) <= m.spec.broadcast
    return ev.join(F.broadcast(table) if small else table, key, "left")


def judged(ev: DataFrame, m: Model) -> DataFrame:
    """The fields of _row and lang_id, text_lang, confidence, kept."""
    spec, text, langs, declared, other = m.spec, m.text, m.text.langs, m.declared, m.other
    kind = ev.schema["_row"].dataType
    if m.hosts is None:
        return ev.select("_row.*", F.lit(None).cast("string").alias("lang_id"), F.lit(None).cast("string").alias("text_lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    x = _beside(_beside(ev, m.hosts, "_host", m), m.suffixes, "_suffix", m).select("_text", "_declared", "_like", "_prior", "_row")
    world = np.log(m.world)

    def run(it):
        for b in batches(it, 4 << 20, "_text"):
            data, offs = flat(b.column(0))
            ll = text.scores(data, offs)
            post = spec.temper * ll
            for i, (d, s, h) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())):
                if d:
                    post[i] += declared.get(d, other)
                if s is not None:
                    post[i] += s
                post[i] += np.log(h) if h is not None else world
            top = post.argmax(axis=1)
            p = np.exp(post - post.max(axis=1, keepdims=True))
            conf = 1 / p.sum(axis=1)
            seen = np.concatenate([[0], np.cumsum(_LETTER[data])])
            letters = seen[offs[1:]] - seen[offs[:-1]] > 0
            row = b.column(4)
            names = [langs[i] for i in top]
            said = [langs[i] if z > a + 2 else None for i, a, z in zip(ll.argmax(axis=1), offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays([row, pa.array(names, pa.string()), pa.array(said, pa.string()), pa.array(conf, pa.float64()), pa.array(letters & (conf >= spec.least))], names=["_row", "lang_id", "text_lang", "confidence", "kept"])

    return x.mapInArrow(run, f"_row {kind.simpleString()}, lang_id string, text_lang string, confidence double, kept boolean").select("_row.*", "lang_id", "text_lang", "confidence", "kept")


def identify(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """doc_id, declared, lang_id, text_lang, confidence, kept for each row of documents."""
    ev = evidence(docs)
    m = learn(ev, spec)
    small = evidence(docs).withColumn("_row", F.struct("_row.doc_id", F.col("_row.lang").alias("declared")))
    return judged(small, m)


def accepted(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """The rows of docs that are not rejected, all columns as they are."""
    ev = evidence(docs).withColumn("_row", F.struct("_row"))
    return judged(ev, learn(evidence(docs), spec)).where("kept").select("_row.*")


def op2(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pages(spark, sf_dir: str) -> DataFrame:
    """The same fusion over web pages, with markup, address and host as evidence."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    m = learn(page_evidence(p))
    return judged(page_evidence(p).withColumn("_row", F.struct("_row.page_id", F.col("_declared").alias("declared"))), m)
