"""Operators against brute force: whole small tables, and cases made to be awkward."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowmill.llm import neardup, neighbours, phrases, repeats, suffixes, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, "a" * 300), (2, "ab" * 100), (3, None), (4, ""), (5, "a" * 99), (6, "xyz" + "a" * 120 + "q"), (7, "é" * 80), (8, "zé" + "é" * 80), (9, "ab" * 100), (10, "b" + "ab" * 70),
    (11, "w " * 60), (12, "u v " * 30), (13, "u\tv\n" * 12 + "x"), (14, "one two three"), (15, "ONE Two three"), (16, " \n\t "), (17, "x" * 5000 + " w" * 30), (18, "long " * 3000), (19, "α β γ δ ε " * 20),
]


def pairs(docs):
    return [(d, t or "") for d, t in sorted(docs)]


def brute_bytes(docs, span):
    seen, out = set(), {}
    for d, t in pairs(docs):
        raw = t.encode()
        cover = bytearray(len(raw))
        for i in range(len(raw) - span + 1):
            w = raw[i : i + span]
            if w in seen:
                cover[i : i + span] = b"\1" * span
            seen.add(w)
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        out[d] = (len(raw), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    return out


def brute_words(docs, span):
    seen, out = set(), {}
    for d, t in pairs(docs):
        ws = WORD.findall(t)
        cover = [0] * len(ws)
        for i in range(len(ws) - span + 1):
            w = tuple(ws[i : i + span])
            if w in seen:
                cover[i : i + span] = [1] * span
            seen.add(w)
        out[d] = (len(ws), sum(cover), hashlib.sha256(" ".join(w for w, c in zip(ws, cover) if not c).encode()).hexdigest())
    return out


def brute_links(docs, k, num=80):
    sets = {}
    for d, t in docs:
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for d in sorted(sets):
        both = Counter(e for s in sets[d] for e in where[s])
        for e, n in both.items():
            if 100 * n >= num * (len(sets[d]) + len(sets[e]) - n):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            where[s].append(d)
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.fixture(scope="module")
def documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_bytes(spark, documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove(documents[0]).collect()}
    assert got == brute_bytes(documents[1], 100)


def test_bytes_odd(spark):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove(odd(spark)).collect()}
    assert got == brute_bytes(ODD, 100)


@pytest.mark.parametrize("hot", [0, 3, 2000])
def test_bytes_hot_seeds(spark, hot):
    """Segments of one seed with different surroundings, settled in deals and spread out."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    core = word(150)
    docs = [(i, word(80) + core[rng.integers(0, 40) :] + word(60)) for i in range(60)]
    spec = repeats.Spec("byte", 100, 28, hot=hot, deal=2000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove(odd(spark, docs), spec).collect()}
    assert got == brute_bytes(docs, 100)


@pytest.mark.parametrize(("span", "k"), [(5, 2), (12, 5), (100, 28)])
def test_bytes_other_spans(spark, span, k):
    docs = ODD[:17] if span < 20 else ODD
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove(odd(spark, docs), repeats.Spec("byte", span, k)).collect()}
    assert got == brute_bytes(docs, span)


def test_kept_text_is_whole_characters(spark):
    rest = "".join(chr(0x180 + i) for i in range(60))
    # U+0141 and U+0101 share their second byte, with which the repeat begins
    docs = [(1, "\u0101" + rest), (2, "x" + rest + "y"), (3, "\u0141" + rest), (4, "other")]
    rows = {r.row.doc_id: r for r in suffixes.remove(odd(spark, docs), keep_text=True).collect()}
    assert {d: r.kept for d, r in rows.items()} == {1: None, 2: "xy", 3: "\u0141", 4: None}
    assert rows[3].n_removed == 121


def test_long_documents_are_cut_into_overlapping_runs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    part = rng.integers(97, 123, 5000).astype(np.uint8)
    data = np.concatenate([part, rng.integers(97, 123, 4000).astype(np.uint8), part])
    whole = next(iter(repeats.pieces(suffixes.SPEC, data, np.array([0, len(data)]))))
    one = repeats.seeds(suffixes.SPEC, whole)
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    windows = set()
    for p in repeats.pieces(suffixes.SPEC, data, np.array([0, len(data)])):
        s = repeats.seeds(suffixes.SPEC, p)
        for h, lo, hi, off in zip(s["h"], s["lo"], s["hi"], s["off"]):
            windows |= {(int(h), w, int(lo + off)) for w in range(lo, hi + 1)}
    want = {(int(h), w, int(lo + off)) for h, lo, hi, off in zip(one["h"], one["lo"], one["hi"], one["off"]) for w in range(lo, hi + 1)}
    assert windows == want


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 7, 8, 30, 400):
        for a in (1, 2, 30, 2**40):
            x = rng.integers(1, a + 1, n)
            assert suffixes.suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_words(spark, documents):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrases.remove(documents[0]).collect()}
    assert got == brute_words(documents[1], 20)


@pytest.mark.parametrize("hot", [0, 2000])
def test_words_odd(spark, hot):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrases.remove(odd(spark), repeats.Spec("word", 20, 7, hot=hot)).collect()}
    assert got == brute_words(ODD, 20)


@pytest.mark.parametrize("few", [0, 32 << 20])
def test_refining_moves_the_texts_of_hot_seeds_only(spark, monkeypatch, few):
    """Texts without a hot seed are not joined again; where the keys are too many to be sent, all are."""
    rng = np.random.default_rng(11)
    line = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    core, twice = line(30), [line(30) for _ in range(5)]
    hot = [(i, f"{line(9)} {core} {line(7)}") for i in range(8)]
    docs = hot + [(100 + i, f"{line(9)} {twice[i // 2]} {line(7)}") for i in range(10)]
    moved, refined = [], repeats._refined
    monkeypatch.setattr(repeats, "FEW_BYTES", few)
    monkeypatch.setattr(repeats, "_refined", lambda spec, k, texts, places: moved.append({r.key for r in texts.select("key").collect()}) or refined(spec, k, texts, places))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrases.remove(odd(spark, docs), repeats.Spec("word", 20, 7, hot=3)).collect()}
    assert got == brute_words(docs, 20)
    assert moved and len(moved[0]) == (len(hot) if few else len(docs))


def test_nothing_goes_without_the_engines(spark, documents, monkeypatch):
    """Candidate search removes nothing by itself: every removal is the automata's or the arrays'."""
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(suffixes, "suffix_array", lambda s: none)
    monkeypatch.setattr(suffixes, "engine", lambda *a: (none, none, none))
    monkeypatch.setattr(phrases, "locate", lambda *a: None)
    assert suffixes.remove(documents[0]).where("n_removed > 0").count() == 0
    assert phrases.remove(documents[0]).where("n_removed > 0").count() == 0


def test_automata_in_shards_and_blocks(spark, documents, monkeypatch):
    """Few words to an automaton, few documents to a block."""
    for name, v in {"SHARD": 300, "BLOCK": 20_000, "STEP": 100}.items():
        monkeypatch.setattr(phrases, name, v)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrases.remove(documents[0]).collect()}
    assert got == brute_words(documents[1], 20)


def test_long_words(spark):
    """Words longer than a digest, in and around repeats; some differ in their last letter only."""
    big = ["x" * n + c for n in (63, 64, 65, 70_000) for c in "ab"]
    line = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join([*line[: i % 7 + 5], big[i % 8], *line, big[(i * 3) % 8], *line[: i % 5 + 2]])) for i in range(24)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrases.remove(odd(spark, docs)).collect()}
    assert got == brute_words(docs, 20)


CLASH = [(None, "p q r s t " * 9), (None, "p q r s t " * 9), (None, "other words of a null id"), (7, "p q r s t " * 9), (7, "p q r s t " * 8), (8, None), (8, ""), (9, "p q r s t " * 9)]


def clashing(spark):
    """Null and repeated ids, repeated rows, and columns named like those used inside."""
    df = spark.createDataFrame(CLASH, "doc_id long, text string")
    for c in ("key", "row", "h", "s", "n", "n_words", "kept", "block", "c", "component", "u", "size"):
        df = df.withColumn(c, F.lit("x"))
    return df


def told_apart():
    """The rows of CLASH as documents in their order: null first; equal rows are one document."""
    return sorted({(d, t or "") for d, t in CLASH}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_null_and_repeated_ids(spark):
    """Against brute force, for each order in which documents of equal id may stand."""
    from itertools import permutations, product

    docs = told_apart()
    groups = [[x for x in docs if x[0] == d] for d in (None, 7, 8, 9)]
    ways = [[x for g in way for x in g] for way in product(*[list(permutations(g)) for g in groups])]
    for brute, run in ((lambda x: brute_words(x, 20), lambda df: phrases.remove(df)), (lambda x: brute_bytes(x, 30), lambda df: suffixes.remove(df, repeats.Spec("byte", 30, 9)))):
        rows = run(clashing(spark)).collect()
        got = Counter((r[0], *r[1:]) for r in rows)
        assert len(rows) == len(CLASH)
        wants = []
        for way in ways:
            want = brute(list(enumerate(t for _, t in way)))
            of = {(d, t): want[i] for i, (d, t) in enumerate(way)}
            wants.append(Counter((d, *of[d, t or ""]) for d, t in CLASH))
        assert got in wants


def test_empty_tables(spark):
    none = clashing(spark).limit(0)
    for f in (phrases.remove, suffixes.remove, neardup.dedup, neardup.kept_rows):
        assert f(none).collect() == []


@pytest.mark.parametrize("k", [4, 5])
def test_links(spark, documents, k):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.dedup(documents[0], neardup.Spec(k=k)).collect()}
    assert got == brute_links(documents[1], k)


def test_links_odd(spark):
    rows = neardup.dedup(odd(spark)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_links(ODD, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_links_of_a_family(spark):
    """Variants of one text, at all similarities around the limit, in small blocks."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    docs = []
    for i in range(120):
        ws = list(base)
        for j in rng.choice(120, rng.integers(0, 12), replace=False):
            ws[j] = f"n{rng.integers(0, 10**6)}"
        docs.append((i, " ".join(ws)))
    got = {r.doc_id: r.component_id for r in neardup.dedup(odd(spark, docs), neardup.Spec(block=16)).collect()}
    assert got == {d: c for d, (_, c) in brute_links(docs, 4).items()}


def test_a_late_joiner_of_a_large_component(spark):
    """One component of 2,000 and one bucket member outside it: rows for each, not for each pair."""
    rows = [(1, i, 0) for i in range(2000)] + [(1, 5000, 5000), (2, 0, 0), (2, 1, 0), (3, 7, 7), (3, 8, 8)]
    inside = spark.createDataFrame(rows, "b long, key long, comp long")
    got = neardup._dealt(neardup.Spec(block=100), inside).collect()
    assert len([r for r in got if r.b == 1]) == 2001 + 21
    assert {r.b for r in got} == {1, 3}
    blocks = defaultdict(set)
    for r in got:
        blocks[r.b, r.i, r.j].add((r.side, r.key))
    met = {(b, k) for (b, _, _), x in blocks.items() for s, k in x if s == 1 and any(s == 0 and k != o for s, o in x)}
    assert {k for b, k in met if b == 1} >= set(range(2000))
    assert {k for b, k in met if b == 3} >= {7} or {k for b, k in met if b == 3} >= {8}


def test_links_of_null_and_repeated_ids(spark):
    rows = neardup.dedup(clashing(spark), neardup.Spec(k=4)).collect()
    assert len(rows) == len(CLASH)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows)
    # nine and eight times the same five words have the same five windows
    want = Counter([(None, 5, None, True)] * 2 + [(None, 3, None, True), (7, 5, None, False), (7, 5, None, False), (8, 0, 8, True), (8, 0, 8, True), (9, 5, None, False)])
    assert got == want


def test_superminhash_estimates_and_varies_less():
    rng = np.random.default_rng(0)
    new = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    a = [new(120) for _ in range(500)]
    b = [np.concatenate([x[:96], new(24)]) for x in a]
    sig = neardup.superminhash(a + b, 255)
    same = (sig[:500] == sig[500:]).mean(axis=1)
    true = 96 / 144
    assert abs(same.mean() - true) < 0.01
    assert same.std() < 0.85 * (true * (1 - true) / 255) ** 0.5
    one = neardup.superminhash([np.concatenate([a[0], a[1]])], 255)  # order and batches do not matter
    assert (one == np.minimum(sig[0], sig[1])).all()
    assert (neardup.superminhash([a[0]], 255, limit=50) == sig[0]).all()


def test_nearest(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in v.collect()]
    got = defaultdict(list)
    for r in neighbours.nearest(v).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q, x in rows:
        if q % 20 == 0:
            want = sorted((-float(np.add.accumulate(x * y)[-1]), i) for i, y in rows if i != q)[:20]
            assert got.pop(q) == [(i, -s) for s, i in want]
    assert not got


def test_nearest_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 1.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (7, [1.0, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [1.0, 1.0])]
    df = spark.createDataFrame(bad, "vec_id long, embedding array<float>")
    for c in ("row", "d", "u", "q", "x", "id", "vec", "scale"):
        df = df.withColumn(c, F.lit("clash"))
    got = sorted(tuple(r) for r in neighbours.nearest(df).collect())
    own = [(0, 1, 20, 5.0), (0, 2, 20, 5.0), (0, 3, 7, 3.0), (0, 4, 9, 3.0)]
    assert got == sorted(own + 2 * [(20, 1, 0, 5.0), (20, 2, 20, 5.0), (20, 3, 7, 3.0), (20, 4, 9, 3.0)])
    assert neighbours.nearest(df.limit(0)).collect() == []


def test_repeated_rows_are_candidates_and_lengths_differ(spark):
    """Each row is a row: it meets all but itself, of its own length only."""
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (40, [1.0]), (41, [3.0]), (60, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in neighbours.nearest(df).collect())
    assert got == sorted([(0, 1, 0, 2.0), (0, 2, 3, 1.0), (0, 3, 3, 1.0), (0, 1, 0, 2.0), (0, 2, 3, 2.0), (0, 3, 3, 2.0), (40, 1, 41, 3.0)])


def test_a_common_vector_does_not_multiply(spark, monkeypatch):
    """Half of all rows are one vector: the smallest ids win, and survivors stay few."""
    rng = np.random.default_rng(4)
    rows = [(i, [3.0, 1.0, 2.0] if i % 2 else rng.normal(size=3).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen = []
    monkeypatch.setattr(neighbours, "_pruned", lambda found, k, own=neighbours._pruned: (seen.append(found.count()), own(found, k))[1])
    got = defaultdict(list)
    for r in neighbours.nearest(df, 5, 3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q, x in rows[::3]:
        want = sorted((-float(np.add.accumulate(np.array(x) * np.array(y))[-1]), i) for i, y in rows if i != q)[:5]
        assert got.pop(q) == [(i, -s + 0.0) for s, i in want]
    assert not got and seen[0] < 200 * 32 * 12


@pytest.mark.parametrize(("blocks", "tile"), [(7, 11), (100, 1), (1000, 100)])
def test_blocks_and_tiles(spark, monkeypatch, blocks, tile):
    """Any size of blocks, tiles and steps, and wide ranges of length: the exact neighbours."""
    for name, v in {"QUERY_BLOCK": blocks, "TILE": tile, "STEP": 3, "HELD": 50, "LEAST_TASKS": 3, "TASKS": 9}.items():
        monkeypatch.setattr(neighbours, name, v)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 24)) * np.exp(rng.normal(size=(300, 1)) * 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 300, 20):
        want = sorted((-float(np.add.accumulate(x[q] * x[i])[-1]), i) for i in range(300) if i != q)[:7]
        assert got.pop(q) == [(i, -s) for s, i in want]
    assert not got


def expected_records(rows):
    by = defaultdict(list)
    for i, h in rows:
        by[(h or "").encode()].append(i)
    out = Counter()
    for p, ids in by.items():
        known = [i for i in ids if i is not None]
        last, sha = max(known, default=None), base64.b32encode(hashlib.sha1(p).digest()).decode()
        first = True
        for i in ids:
            response = i == last and first
            first = first and not response
            out[(i, len(p), sha, "response" if response else "revisit", None if response else last)] += 1
    return out


def records(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


@pytest.mark.parametrize("roll", [1, 2000, 1 << 30])
def test_warc(spark, tmp_path, roll):
    p = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    rows = [(r.page_id, r.url, r.html) for r in p.collect()]
    rows += [(9000 + i, "http://x/ y", rows[i % 3][2]) for i in range(7)] + [(9100, None, None), (9101, "u", ""), (None, "n", "alone"), (9102, "u", "\r\n\r\n" * 3), (9103, "ü\r\nX: y", "é")]
    rows += [rows[-1], rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    where = f"file://{tmp_path}/a"
    m = warc.write(df, where, roll=roll)
    assert m["records"] == len(rows)
    assert records(warc.read(spark, where)) == expected_records([(i, h) for i, _, h in rows])
    again = warc.write(df.repartition(7), f"file://{tmp_path}/b", roll=roll)
    assert again == m  # the same bytes, whatever the order of the input
    assert not [f for f in tmp_path.rglob("*.tmp")]


def test_warc_rolls_within_shards(spark, tmp_path):
    """The registered ratio of shard to file, a thousandth in size; ids are null, or one id has many payloads."""
    rng = np.random.default_rng(0)
    text = lambda n: "".join(rng.choice(list("abcdefgh <>/"), n))
    rows = [(None if i < 300 else 7 if i < 600 else i, f"u{i}", text(int(rng.integers(3000, 9000)))) for i in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("x")).withColumn("kind", F.lit(1))
    m = warc.write(df, f"file://{tmp_path}/a", roll=warc.ROLL >> 10, shard=warc.SHARD >> 10)
    sizes: dict = defaultdict(list)
    for f in m["files"]:
        sizes[f["shard"]].append(f["records"])
    assert len(sizes) >= warc.SHARDS - 1 and max(map(sum, sizes.values())) <= 2 * 900 / len(sizes)
    assert max(map(len, sizes.values())) > 1
    assert records(warc.read(spark, f"file://{tmp_path}/a")) == expected_records([(i, h) for i, _, h in rows])
    ids = [(f["first_id"] or -1, f["last_id"] or -1) for f in m["files"]]
    assert ids == sorted(ids)


def test_revisits_name_their_response(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(1, "u", "same"), (2, "v", "same"), (3, "w", "other")], "page_id long, url string, html string")
    warc.write(df, f"file://{tmp_path}/a")
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "a").glob("*.warc.gz")))
    heads = [dict(x.split(": ", 1) for x in part.split("\r\n\r\n")[0].split("\r\n")) for part in raw.decode().split("WARC/1.1\r\n")[1:]]
    by = {h["X-Page-ID"]: h for h in heads if "X-Page-ID" in h}
    assert by["1"]["WARC-Type"] == "revisit" and by["1"]["WARC-Refers-To"] == by["2"]["WARC-Record-ID"]
    assert {h["WARC-Type"] for h in heads} == {"warcinfo", "response", "revisit"}


def test_warc_notices_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    warc.write(df, f"file://{tmp_path}/a")
    f = next((tmp_path / "a").glob("*.warc.gz"))
    f.write_bytes(f.read_bytes()[:-9])
    with pytest.raises(Exception, match="manifest"):
        warc.read(spark, f"file://{tmp_path}/a").collect()


def test_warc_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write(df, f"file://{tmp_path}/a")["files"] == []
    assert warc.read(spark, f"file://{tmp_path}/a").collect() == []
