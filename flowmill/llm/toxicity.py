"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: density and count of words of a fixed list of insults and of a
lexicon learnt from labels (words and word beginnings that toxic rows over-use, by
likelihood ratio, so that inflected and foreign insults count too), how close such words
stand to a second-person word, and the rates of capitals, punctuation, exclamation marks, digits,
characters that replace letters inside words, and letters repeated three times or more.

Labels are used of rows outside the held-out third only, and of about `max_rows` of them,
chosen by a hash of the id; where ids repeat in documents, of about as many different texts,
chosen by a hash of the text. They form two folds. Each fold's features use the lexicon of the
other, and the trees that calibrate a fold are fitted on the other, so that neither lexicon
nor calibration sees a row twice; the final lexicon and trees use both folds. Everything
collected is bounded: max_rows rows of 18 numbers and the lexicon.

Defined cases: a null or empty text scores as a text without words; ids that repeat or are
null score row by row; a null id counts as the text "" in the split; labels that contradict
each other for an id count as toxic if any says so; equal texts with equal labels are learnt
from once; entries that tie for the lexicon are taken in order of their letters; without labels
of both kinds each score is the base rate, drawn towards 0 (one pseudo-count for, nine
against); a very long text is scored whole; an empty table gives no rows; other columns may
have any names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.boosting import Trees, calibrated, fit, isotonic
from flowmill.llm.common import materialize, text_of

#: Labelled rows that may be used to learn, and entries of the learnt lexicon.
MAX_ROWS, ENTRIES = 20_000, 400
#: Documents in which an entry must occur.
SUPPORT = 4
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7)
# Insults and second-person words.
INSULTS = frozenset(
    "idiot moron stupid dumb loser scum trash clown pathetic worthless disgusting fool jerk ugly liar pig freak creep coward filth vermin imbecile "
    "idiota estúpido imbécil basura payaso asqueroso cretino connard idiote crétin débile ordure minable dummkopf trottel abschaum versager widerlich dreck".split()
)
SECOND = frozenset("you your yours yourself u ur ya tu te toi ton ta tes vous votre vos du dich dir dein deine euch ihr tú ti usted ustedes vosotros vuestro tus".split())
_STRIP = ".,;:!?\"'()[]{}<>*#$%&|~`_-+=/\\…«»“”’‘¡¿"
_PLAIN = str.maketrans("@$0134!|5", "asoieaiis"[:9])
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_PUNCT = bytes(i for i in range(33, 127) if not chr(i).isalnum())
_MASKED = re.compile(r"[A-Za-z][@$0134!|5*][A-Za-z]")
_DRAWN = re.compile(r"([^\W\d_])\1\1")


def tokens(text: str) -> list[str]:
    return text.lower().split()


def bare(w: str) -> str:
    return w.strip(_STRIP)


def grams(w: str) -> list[str]:
    """What of a bare word can be in a lexicon: itself, and its beginnings, marked by ~."""
    return [w, *(w[:k] + "~" for k in PREFIXES if len(w) > k)] if w else []


class Marks(dict):
    """Of each raw word: its weight in the lexicon, 0 if none; -1 for a second-person word."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, raw: str) -> float:
        w = bare(raw)
        best = max((self.lexicon.get(g, 0.0) for g in grams(w)), default=0.0)
        if w in INSULTS or (not w.isalpha() and w.translate(_PLAIN) in INSULTS):
            best = max(best, 8.0)
        v = best or (-1.0 if w in SECOND else 0.0)
        if len(self) > 500_000:
            self.clear()
        self[raw] = v
        return v


NAMES = ("log_words", "insult_density", "insults", "learnt_density", "learnt", "distinct", "strongest", "mean_weight", "near_you", "you_rate", "capitals", "punctuation", "exclamations", "digits", "masked", "drawn_out", "word_length", "repeat_rate")


def features(text: str, marks: Marks) -> list[float]:
    ws = tokens(text)
    n = len(ws)
    raw = text.encode()
    size = max(1, len(raw))
    m = list(map(marks.__getitem__, ws))
    hits = [i for i, v in enumerate(m) if v > 0]
    you = [i for i, v in enumerate(m) if v < 0]
    kinds = {bare(ws[i]) for i in hits}
    insults = sum(bare(ws[i]) in INSULTS for i in hits)
    near, at = 0.0, 0
    for i in hits:  # distance to the closest second-person word, both lists in order
        while at + 1 < len(you) and abs(you[at + 1] - i) <= abs(you[at] - i):
            at += 1
        if you:
            near = max(near, 1 / (1 + abs(you[at] - i)))
    weights = [m[i] for i in hits]
    count = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    d = max(1, n)
    return [
        math.log1p(n), insults / d, insults, len(hits) / d, len(hits), len(kinds), max(weights, default=0.0), sum(weights) / max(1, len(hits)), near, len(you) / d,
        count(_UPPER), count(_PUNCT), raw.count(b"!") / size, count(_DIGIT), len(_MASKED.findall(text)) / d, len(_DRAWN.findall(text)) / d, len(raw) / d, 1 - len(set(ws)) / d,
    ]


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    knots: np.ndarray
    values: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return calibrated(self.trees.margin(x), self.knots, self.values)


def _remainder(c="doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(3))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """text, toxic, fold (0 or 2): the labelled rows to learn from."""
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (_remainder() != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = y.count()
    if n > max_rows:  # a fixed part of all hashes
        y = y.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(y), "doc_id").select("text", "toxic", _remainder().cast("int").alias("fold"))
    rows = materialize(rows.dropDuplicates(["text", "toxic", "fold"]), "toxicity-rows")
    n = rows.count()
    return rows.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * max_rows / n)) if n > 1.1 * max_rows else rows


def _gram_counts(rows: DataFrame) -> DataFrame:
    """gram, and in how many toxic and other rows of either fold it occurs."""

    def run(it):
        from collections import Counter

        c: Counter = Counter()
        for b in it:
            for text, toxic, fold in zip(*(x.to_pylist() for x in b.columns)):
                k = (2 if fold else 0) + (1 if toxic else 0)
                c.update([(k, g) for g in {g for w in set(tokens(text)) for g in grams(bare(w))}])
            if len(c) > 1_000_000:
                yield _counted(c)
                c = Counter()
        if c:
            yield _counted(c)

    out = rows.select("text", "toxic", "fold").mapInArrow(run, "k int, gram string, n long")
    n = lambda k: F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0))
    return out.groupBy("gram").agg(n(0).alias("n0"), n(1).alias("t0"), n(2).alias("n2"), n(3).alias("t2")).where(F.col("t0") + F.col("t2") >= SUPPORT)


def _counted(c) -> pa.RecordBatch:
    ks, gs = zip(*c.keys())
    return pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(gs, pa.string()), pa.array(list(c.values()), pa.int64())], names=["k", "gram", "n"])


def _lexicon(counts: DataFrame, toxic, other, n_toxic: int, n_other: int, entries: int) -> dict[str, float]:
    """The entries most over-used by toxic rows: by log-likelihood ratio; weight: log odds."""
    if not n_toxic or not n_other:
        return {}
    t, n = toxic.cast("double"), other.cast("double")
    rate_t, rate_n = (t + 0.5) / (n_toxic + 1), (n + 0.5) / (n_other + 1)
    weight = F.log(rate_t / rate_n)
    both = (t + n) / (n_toxic + n_other)
    ratio = t * F.log(t / (n_toxic * both)) + F.when(n > 0, n * F.log(n / (n_other * both))).otherwise(0.0)
    top = counts.where((toxic >= SUPPORT) & (rate_t > 3 * rate_n)).select("gram", weight.alias("w"), ratio.alias("r")).orderBy(F.desc("r"), "gram").limit(entries)
    return {r.gram: float(r.w) for r in top.collect()}


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, entries: int = ENTRIES) -> Model:
    rows = training_rows(docs, labels, max_rows)
    counts = materialize(_gram_counts(rows), "toxicity-grams")
    size = {(r.fold, int(r.toxic > 0)): r.n for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    s = lambda *folds: [sum(size.get((f, t), 0) for f in folds) for t in (1, 0)]
    c = F.col
    lex = {0: _lexicon(counts, c("t2"), c("n2"), *s(2), entries), 2: _lexicon(counts, c("t0"), c("n0"), *s(0), entries)}
    full = _lexicon(counts, c("t0") + c("t2"), c("n0") + c("n2"), *s(0, 2), entries)

    def run(it):
        marks = {f: Marks(w) for f, w in lex.items()}
        for b in it:
            ts, ys, fs = (x.to_pylist() for x in b.columns)
            x = [features(t, marks[f]) for t, f in zip(ts, fs)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array([int(y > 0) for y in ys], pa.int32()), pa.array(fs, pa.int32())], names=["x", "y", "fold"])

    got = rows.select("text", "toxic", "fold").mapInArrow(run, "x array<double>, y int, fold int").toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
    y, fold = got["y"].to_numpy().astype(float), got["fold"].to_numpy()
    o = np.lexsort((*x.T, y, fold))  # whatever order the rows came in
    x, y, fold = x[o], y[o], fold[o]
    if len(np.unique(y)) < 2:
        p = (y.sum() + 1) / (len(y) + 10)
        return Model(full, Trees([np.zeros(0)] * len(NAMES)), np.array([0.0]), np.array([p]))
    z = np.zeros(len(y))
    for f in (0, 2):
        mine = fold == f
        z[mine] = fit(x[~mine], y[~mine]).margin(x[mine])
    return Model(full, fit(x, y), *isotonic(z, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it):
        marks = Marks(model.lexicon)
        for b in it:
            x = np.array([features(t.as_py(), marks) for t in b.column(2)]).reshape(-1, len(NAMES))
            p = np.clip(model.scores(x), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return docs.select(F.col(id_col), (_remainder(id_col) == 1).alias("held_out"), text_of(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
