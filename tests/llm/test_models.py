"""Codecs, models and sampling: round trips, held-out accuracy, brute force, and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from flowmill.llm import boosting, bpe, langid, mixing, toxicity, webp
from flowmill.llm import queries as registered
from flowmill.llm.common import flat, grouped, word_hashes, words

SF = "/root/testdata/sf0.001"
TEXTS = ["", None, "a", "two words", " \t\n ", "é" * 500, "x" * 70_000, "word " * 20_000, "it's we'll I'd  \n\n x", "日本語 テキスト 123", "a b c   d", "😀 👍🏽 é", "tab\tsep\r\nline", "1234567890" * 50, "don't" * 3000]


def plain(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    f = lambda v: f"{v:.12g}" if isinstance(v, float) else str(v)
    return sorted(tuple(f(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registered.queries()[name](spark, SF)
    c = con.execute(registered.oracle_sql()[name])
    assert plain(df.columns, df.collect()) == plain([d[0] for d in c.description], c.fetchall())


# ------------------------------------------------------------ text primitives


def test_words_are_those_of_the_pattern():
    import re

    texts = [t or "" for t in TEXTS]
    data, offs = flat(pa.array(texts))
    ws, we, wo = words(data, offs)
    h = word_hashes(data, ws, we)
    seen: dict = {}
    for i, t in enumerate(texts):
        got = [data[a:z].tobytes() for a, z in zip(ws[wo[i] : wo[i + 1]], we[wo[i] : wo[i + 1]])]
        assert got == [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
        for w, x in zip(got, h[wo[i] : wo[i + 1]]):
            assert seen.setdefault(w, x) == x
    assert len(set(map(int, seen.values()))) == len(seen)


def test_flat_of_slices_and_nulls():
    a = pa.array(["ab", None, "", "é", "z"])
    data, offs = flat(a.slice(1, 3))
    assert data.tobytes() == "é".encode() and offs.tolist() == [0, 0, 0, 2]
    assert flat(pa.array([], pa.string()))[1].tolist() == [0]


def test_grouped_keeps_groups_whole():
    h = np.sort(np.random.default_rng(0).integers(0, 20, 150))
    b = pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])
    for size in (0, 100, 10_000):
        out = list(grouped([b.slice(i, 7) for i in range(0, 150, 7)], ["h"], size))
        assert np.concatenate([t["h"].to_numpy() for t in out]).tolist() == h.tolist()
        assert sum(len(set(t["h"].to_pylist())) for t in out) == len(set(h.tolist()))


# ------------------------------------------------------------ BPE


def encoder():
    return bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.mark.parametrize("size", [1, 3, 17, 1000])
def test_cut_texts_have_the_same_ids(size):
    enc, rng = encoder(), random.Random(1)
    texts = [t or "" for t in TEXTS if len(t or "") < 5000] + ["".join(rng.choice("ab1'!é \n\t ") for _ in range(300)) for _ in range(60)]
    for t in texts:
        ids = bpe.encode(enc, t, size)
        assert ids == enc.encode_ordinary(t)
        assert enc.decode_bytes(ids) == t.encode()


def test_bpe_rows(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    enc = encoder()
    for r in bpe.bpe(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True).collect():
        t = TEXTS[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert (r.n_tokens, r.ids, bytes(r.decoded)) == (len(ids), ids, t.encode())
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


# ------------------------------------------------------------ WebP


def trip(w, h, pix, steps):
    m = webp.container(webp.encode_images([(w, h, pix)], [steps])[0])
    a, b, p = webp.decode_images([m])[0]
    assert (a, b) == (w, h)
    assert (p == pix).all()


@pytest.mark.parametrize("shape", [(1, 1), (2, 3), (17, 33), (64, 5), (40, 40)])
@pytest.mark.parametrize("steps", [(), ("green",), ("cross",), ("predictor",), ("predictor", "cross", "green"), ("green", "predictor")])
def test_pixels_survive(shape, steps):
    (w, h), rng = shape, np.random.default_rng(0)
    y, x = np.divmod(np.arange(w * h), w)
    trip(w, h, rng.integers(0, 2**32, w * h).astype(np.uint32), steps)
    trip(w, h, np.uint32(0xFF000000) | rng.integers(0, 2**24, w * h).astype(np.uint32), steps)
    trip(w, h, (0xFF000000 | (x * 3 & 255) << 16 | (y * 5 & 255) << 8 | (x + y) & 255).astype(np.uint32), steps)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes(colours):
    rng = np.random.default_rng(colours)
    table = rng.integers(0, 2**32, colours).astype(np.uint32)
    pix = np.append(table, rng.choice(table, 33 * 21 - colours))
    for steps in (("palette",), ("palette", "predictor")):
        trip(33, 21, pix, steps)


def test_lockstep_and_scalar_agree():
    rng = np.random.default_rng(4)
    images = []
    for i in range(150):
        n = int(rng.integers(1, 40))
        raw = rng.integers(97, 97 + int(rng.integers(2, 26)), (64 * n, 3)).astype(np.uint32)
        images.append((64, n, np.uint32(0xFF000000) | raw[:, 0] << 16 | raw[:, 1] << 8 | raw[:, 2]))
    images.append((64, 200, np.tile(images[0][2][:64], 200)))
    media = [webp.container(x) for x in webp.encode_images(images)]
    for (w, h, pix), m, (a, b, got) in zip(images, media, webp.decode_images(media)):
        assert (a, b) == (w, h)
        assert (got == pix).all()
        assert (webp.Open(webp.chunks(m)[b"VP8L"]).scalar() == pix).all()


def test_known_stream():
    """A stream written by hand: simple codes, one colour, no cache: 3 x 2 pixels of #FF204080."""
    bits = webp._shape_bits(3, 2, False) + "0" + "0" + "0"
    for v in (0x40, 0x20, 0x80, 0xFF):
        bits += "1" + "0" + "1" + webp._bits(v, 8)
    bits += "1" + "0" + "0" + "0"
    raw = int(bits[::-1], 2).to_bytes(-(-len(bits) // 8), "little")
    (w, h, pix), = webp.decode_images([webp.container(raw)])
    assert (w, h) == (3, 2) and set(pix.tolist()) == {0xFF204080}


def test_damaged_streams():
    m = webp.container(webp.encode_images([(64, 8, np.random.default_rng(0).integers(0, 2**32, 512).astype(np.uint32))])[0])
    for bad in (b"", b"RIFF", m[:40], m[:-200], m[:20] + b"\0" + m[21:]):
        with pytest.raises(ValueError):
            webp.decode_images([bad])


def test_code_lengths_are_complete():
    rng = np.random.default_rng(0)
    hist = (rng.pareto(0.5, (200, 60)) * (rng.random((200, 60)) < 0.5)).astype(np.int64)
    hist[:3] = 0
    hist[1, 5], hist[2, 5], hist[2, 6] = 9, 1, 10**9
    for longest in (7, 11):
        ln = webp.code_lengths(hist, longest).astype(int)
        for h, x in zip(hist, ln):
            n = (h > 0).sum()
            assert x.max() <= longest and ((x > 0) == ((h > 0) & (n > 1))).all()
            if n > 1:
                assert sum(2.0 ** -v for v in x if v) == 1


def test_media_rows(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (99, "two words")], "doc_id long, text string")
    rows = {r.doc_id: r for r in webp.media_column(df, keep=True).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        full = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, bytes(r.pixels)) == (len(raw), len(full), full)
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
    assert rows[99][1:] == rows[3][1:]


def test_very_long_texts_get_wider_rows(monkeypatch):
    data = np.random.default_rng(0).integers(97, 103, 192 * 16384 + 500).astype(np.uint8)
    (m,) = webp.texts_to_media(data, np.array([0, len(data)]))
    ((w, _, payload),) = webp.media_to_payloads([m])
    assert w == 128 and payload == data.tobytes() + b" " * (-len(data) % 192)


# ------------------------------------------------------------ mixing


def check_mix(docs, rows, weights=(5, 2, 1)):
    size = {s: 0 for _, s, _ in docs}
    for _, s, t in docs:
        size[s] += len((t or "").split())
    order = sorted((s is None, s or "", s) for s in size)
    w = {s: weights[i % 3] for i, (_, _, s) in enumerate(order)}
    total, open_, target = 1.5 * sum(size.values()), set(size), {}
    while open_:
        share = (total - sum(target.values())) / sum(w[s] for s in open_)
        full = {s for s in open_ if share * w[s] > 2 * size[s]}
        if not full:
            target |= {s: share * w[s] for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        open_ -= full
    of = {d: s for d, s, _ in docs}
    taken: Counter = Counter()
    largest: Counter = Counter()
    for r in rows:
        s = of[r.doc_id]
        assert r.target == pytest.approx(target[s]) and r.source_size == size[s]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6


def test_mixing(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r.doc_id, r.source, r.text) for r in df.collect()]
    p = mixing.plan(df)
    check_mix(docs, p.collect())
    assert sorted(map(tuple, p.collect())) == sorted(map(tuple, mixing.plan(df.repartition(5)).collect()))


def test_pareto_ranks_by_unequal_odds(spark):
    """Whole copies, odds by size, and the lowest ratios of random to inclusion odds."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: (r.source, r.text or "") for r in df.collect()}
    by: dict = {}
    for r in mixing.plan(df).collect():
        by.setdefault(text[r.doc_id][0], []).append(r)
    differs = 0
    for rows in by.values():
        assert sum((r.whole + r.p) * r.size for r in rows) == pytest.approx(rows[0].target)
        drawn = [r for r in rows if r.p > 0]
        ranked = []
        for r in drawn:
            inner = hashlib.md5(text[r.doc_id][1].encode()).hexdigest()
            u = (int(hashlib.md5(f"{r.doc_id}:{inner}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            assert r.pareto == pytest.approx((u / (1 - u)) / (r.p / (1 - r.p)))
            ranked.append((r.pareto, u, r))
        if not drawn:
            continue
        longer, shorter = max(drawn, key=lambda r: r.size), min(drawn, key=lambda r: r.size)
        assert longer.whole + longer.p > shorter.whole + shorter.p
        ranked.sort(key=lambda x: x[0])
        rest, sofar, want = sum(r.p * r.size for r in drawn), 0, set()
        for _, _, r in ranked:
            if sofar + r.size / 2 <= rest:
                want.add(r.doc_id)
            sofar += r.size
        got = {r.doc_id for r in drawn if r.copies > r.whole}
        assert got == want
        differs += got != {r.doc_id for _, _, r in sorted(ranked, key=lambda x: x[1])[: len(got)]}
    assert differs  # the random number alone would take others


def test_repeated_rows_are_mixed_together(spark):
    rows = [(None, "s", "a b c d")] * 40 + [(i, "s", "e f " * (i + 1)) for i in range(9)] + [(i, "t", "g " * 500) for i in range(100, 120)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    copies = {r.copies for r in mixing.plan(df).collect() if r.doc_id is None}
    assert len(copies) == 1
    assert sum(r.doc_id is None for r in mixing.mix(df).collect()) == 40 * copies.pop()


def test_mixing_odd(spark):
    docs = [(1, None, "a b c"), (2, "", "d e"), (3, "s", None), (4, "s", ""), (5, "z", "w " * 1000), (6, "é", "q r"), (7, "Z", "one"), (8, None, "x y z w")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    check_mix(docs, mixing.plan(df).collect())
    assert mixing.plan(df.limit(0)).collect() == []


def test_mixed_rows_follow_the_plan(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_copies", F.lit(1)).withColumn("size", F.lit("x"))
    df = df.union(df.where("doc_id < 5")).union(df.where("doc_id < 3"))
    mixed = mixing.mix(df)
    assert mixed.dtypes == df.dtypes
    got = Counter(r.doc_id for r in mixed.collect())
    want: Counter = Counter()
    for r in mixing.plan(df).collect():
        want[r.doc_id] += r.copies
    assert got == {k: v for k, v in want.items() if v}


# ------------------------------------------------------------ toxicity


def test_isotonic():
    rng = np.random.default_rng(0)
    z = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * z))).astype(float)
    k, v = boosting.isotonic(z, y)
    assert (np.diff(v) >= 0).all() and (np.diff(k) >= 0).all()
    p = boosting.calibrated(z, k, v)
    assert abs(p.mean() - y.mean()) < 0.03 and 0 < p.min() <= p.max() < 1


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = boosting.fit(x[:2000], y[:2000])
    assert ((m.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.95


@pytest.fixture(scope="module")
def sf01(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_accuracy(sf01):
    docs, labels = sf01
    rows = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97
    found = [r.predicted for r in rows if r.toxic]
    assert sum(found) / len(found) > 0.85
    assert sum(r.predicted for r in rows if not r.toxic) < 0.005 * len(rows)


def test_labels_of_the_held_out_third_are_not_used(sf01):
    docs, labels = sf01
    docs, labels = docs.where("doc_id < 1500"), labels.where("doc_id < 1500")
    other = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score(docs, toxicity.learn(docs, x)).orderBy("doc_id").collect() for x in (labels, other))
    assert a == b


def test_toxicity_odd(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "you idiot"), (3, "again"), (3, "again")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(0, 1, 1), (3, 1, None)], none.schema)):
        rows = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
        assert len(rows) == len(TEXTS) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.learn(docs, none)).collect() == []


# ------------------------------------------------------------ language ID


def test_languages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(df).collect()
    assert len(rows) == df.count()
    assert sum(r.lang_id == r.declared for r in rows) / len(rows) > 0.98
    assert all(r.kept for r in rows)


def posterior(rows, spec=langid.Spec()):
    """Everything once more in plain Python: row -> (language, confidence). rows: id, text, lang, host."""
    import math

    def classes(t):
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
        return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1 % 2**32) >> 16 for i in range(len(b) - 2)]

    said = {i: re.match("[a-z]*", (d or "").lower())[0] for i, _, d, _ in rows}
    grams: dict = {}
    for i, t, _, _ in rows:
        if said[i] and len(classes(t)):
            grams.setdefault(said[i], Counter()).update(classes(t))
    langs = sorted(grams)
    total = {x: sum(grams[x].values()) + 0.05 * 2**16 for x in langs}
    ll = {i: [sum(float(np.float32(math.log((grams[x][c] + 0.05) / total[x]))) for c in classes(t)) for x in langs] for i, t, _, _ in rows}
    voters = [r for r in rows if len((r[1] or "").encode()) > 2]
    vote = {r[0]: int(np.argmax(ll[r[0]])) for r in voters}
    host = {i: (h or "").lower() for i, _, _, h in rows}
    suffix = {i: h.rsplit(".", 1)[1] if "." in h and h.rsplit(".", 1)[1].isalpha() else "" for i, h in host.items()}
    domain = lambda h: ".".join(h.split(".")[-2:])
    count = lambda keep, x: sum(keep(i) and v == x for i, v in vote.items())
    n = range(len(langs))
    world = [1 + count(lambda i: True, x) for x in n]
    world = [w / sum(world) for w in world]
    kinds = {suffix[i] for i in vote} - {""}
    out = {}
    for i, t, _, _ in rows:
        post = [spec.temper * x for x in ll[i]]
        for x in n:
            if said[i]:
                y = langs.index(said[i]) if said[i] in langs else len(langs)
                prior = spec.right if y == x else (1 - spec.right) / len(langs)
                hits = count(lambda j: said[j] == said[i] if y < len(langs) else said[j] not in ("", *langs), x)
                post[x] += math.log((hits + 10 * prior) / (count(lambda j: said[j] != "", x) + 10))
            if suffix[i] in kinds:
                share = (sum(suffix[j] == suffix[i] for j in vote) + 1) / (sum(suffix[j] != "" for j in vote) + len(kinds))
                w = spec.suffix_weight
                post[x] += math.log((count(lambda j: suffix[j] == suffix[i], x) + w * share) / (count(lambda j: suffix[j] != "", x) + w))
            near = [j for j in vote if domain(host[j]) == domain(host[i])]
            d = (count(lambda j: j in near, x) + spec.domain_weight * world[x]) / (len(near) + spec.domain_weight)
            same = [j for j in vote if host[j] == host[i]]
            post[x] += math.log((count(lambda j: j in same, x) + spec.host_weight * d) / (len(same) + spec.host_weight) if same else world[x])
        out[i] = (langs[int(np.argmax(post))], 1 / sum(math.exp(p - max(post)) for p in post))
    return out


def test_evidence_adds_up(spark):
    """Brute force: labels and posteriors of texts that lean on declaration, suffix and host."""
    rows = [(i, "the house of the king and the queen", "en", f"a{i % 3}.x.uk") for i in range(40)] + [(100 + i, "der hund und die katze sind nicht hier", "de", f"{'b' if i % 2 else 'c.b'}.de") for i in range(40)]
    rows += [(200, "x", None, "b.de"), (201, "x", None, "a1.x.uk"), (202, "x", "de", None), (203, "123", "de", "b.de"), (204, None, "en", "a.uk"), (205, "the king and the queen of the house", "de", "b.de"), (206, "of the house", None, "Q.B.De"), (207, "qqq", "xx", "x.uk"), (208, "hund", "?", "nodot"), (209, "the", None, "a.b.7")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("kept", F.lit("clash")).withColumn("_row", F.lit(1))
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    want = posterior(rows)
    for i, (lang, confidence) in want.items():
        assert got[i].lang_id == lang and got[i].confidence == pytest.approx(confidence, abs=1e-9), i
    assert [got[i].lang_id for i in (0, 100, 200, 201, 202, 205)] == ["en", "de", "de", "en", "de", "en"]
    assert not got[203].kept and not got[204].kept and got[0].kept and got[100].kept
    kept = langid.accepted(df)
    assert kept.dtypes == df.dtypes and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_the_suffix_alone_decides(spark):
    """No words to go by, nothing declared, hosts never seen: only the suffix differs."""
    rows = [(i, "the house of the king and the queen", "en", f"h{i}.uk") for i in range(60)] + [(100 + i, "der hund und die katze sind nicht hier", "de", f"h{i}.de") for i in range(60)]
    rows += [(300, "", None, "new.de"), (301, "", None, "new.uk"), (302, None, None, "new.xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert got[300].lang_id == "de" and got[301].lang_id == "en" and got[300].confidence > 0.7
    assert got[302].confidence < 0.6


def test_no_language_at_all(spark):
    df = spark.createDataFrame([(1, "text", None, None), (2, None, None, "h")], "doc_id long, text string, lang string, source string")
    assert [(r.lang_id, r.kept) for r in langid.identify(df).collect()] == [(None, False)] * 2
    assert langid.identify(df.limit(0)).collect() == []


def test_pages(spark):
    rows = langid.pages(spark, SF).collect()
    assert rows and sum(r.lang_id == r.declared for r in rows) / len(rows) > 0.9


def test_rare_languages_are_fitted(spark):
    """However many rows the others have, a language that is counted is also fitted."""
    r = random.Random(5)
    of = {"en": "the house of king and queen with their old garden near river", "cs": "dum krale zahrada stara kralovna blizko reky jejich ktery neni", "es": "casa del rey jardin viejo reina cerca rio donde siempre estaba"}
    rows = [(i, " ".join(r.choices(of[x].split(), k=30)), x, None) for i, x in enumerate(["en"] * 3000 + ["cs"] * 6 + ["es"] * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = langid.identify(df, langid.Spec(max_rows=60)).where("doc_id >= 2990").collect()
    assert len(got) == 22 and all(x.text_lang == x.lang_id == x.declared for x in got)
    # whatever is fitted is a language; the others are none, instead of flat ones
    assert set(langid.learn_text(langid.evidence(df), langid.Spec(max_rows=6)).langs) <= set(of)


def test_many_declared_values_are_all_languages(spark):
    rows = [(i, f"w{i % 100}a w{i % 100}b w{i % 100}c", chr(97 + i % 100 // 10) + chr(97 + i % 10), None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert len(langid.learn_text(langid.evidence(df)).langs) == 100


def test_language_shares():
    assert langid.shares({"a": 10, "b": 1000, "c": 3000}, 110) == {"a": 1.0, "b": 0.05, "c": 50 / 3000}
    assert langid.shares({"a": 10, "b": 20}, 100) == {"a": 1.0, "b": 1.0}


# ------------------------------------------------------------ any table


@pytest.fixture(scope="module")
def awkward(spark):
    """Null and repeated ids, repeated rows, a long text, and columns named like those used inside."""
    rows = [(None, "a null id", "en", "s"), (None, "a null id", "en", "s"), (1, None, None, None), (1, "", "en", "s"), (2, "long words here " * 60_000, "en", "t.de"), (3, "you idiot!!!", "xx", "S"), (3, "you idiot!!!", "xx", "S")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in ("_id", "_text", "key", "row", "n", "size", "media", "score", "kept", "_row", "_key", "_host", "lang_id", "ids", "n_tokens", "src", "cls", "pareto", "copies", "last", "bucket"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def labelled(spark):
    return spark.createDataFrame([(3, 1, 1), (1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")


RUNS = {
    "webp": lambda spark, df: webp.media_column(df),
    "langid": lambda spark, df: langid.identify(df),
    "mixing": lambda spark, df: mixing.plan(df),
    "toxicity": lambda spark, df: toxicity.score(df, toxicity.learn(df, labelled(spark))),
    "bpe": lambda spark, df: bpe.bpe(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_awkward_tables(spark, awkward, name):
    rows = RUNS[name](spark, awkward).collect()
    assert Counter(r.doc_id for r in rows) == {None: 2, 1: 2, 2: 1, 3: 2}
    twins = [tuple(r) for r in rows if r.doc_id == 3]
    assert twins[0] == twins[1]
    assert RUNS[name](spark, awkward.limit(0)).collect() == []


def test_columns_pass_through(spark, awkward):
    assert langid.accepted(awkward).dtypes == mixing.mix(awkward).dtypes == awkward.dtypes


def test_labelled_ids_that_repeat_are_bounded(spark):
    """One labelled id holds all rows: what is learnt from stays about max_rows."""
    docs = spark.range(0, 4000).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.training_rows(docs, labels, 500).count() < 700
