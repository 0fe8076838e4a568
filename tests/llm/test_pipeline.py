"""The pipeline stage by stage: each against plain Python on its own input."""

import pytest

import corpus_pipeline
from flowmill.llm.common import materialize
from test_exact import brute_bytes, brute_links
from test_models import check_mix, encoder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, f in corpus_pipeline.STAGES:
        docs = materialize(f(spark, docs, SF), name)
        out.append((name, docs))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in stages[1:]] == ["language_id", "near_dedup", "suffix_dedup", "mixing", "bpe"]
    for _, df in stages[:-1]:
        assert df.dtypes == stages[0][1].dtypes


def test_language_stage_keeps_texts(stages):
    before, after = dict(rows(stages[0][1])), dict(rows(stages[1][1]))
    assert after.items() <= before.items()
    assert {d for d, t in before.items() if t and any(c.isalpha() for c in t)} == set(after)


def test_one_of_each_group_stays(stages):
    links = brute_links(rows(stages[1][1]), 5)
    assert {d for d, (_, c) in links.items() if c == d} == {d for d, _ in rows(stages[2][1])}


def test_repeats_go(stages):
    before = rows(stages[2][1])
    want = brute_bytes(before, 100)
    after = {r.doc_id: r for r in stages[3][1].collect()}
    for d, t in before:
        n, removed, _, _ = want[d]
        if d not in after:
            assert removed and removed >= n - 8
        elif not removed:
            assert after[d].text == t
        else:
            assert n - removed <= len(after[d].text.encode()) <= n - removed + 6 * want[d][2]
            assert after[d].n_chars == len(after[d].text)


def test_sources_follow_targets(stages):
    from flowmill.llm import mixing

    docs = [(r.doc_id, r.source, r.text) for r in stages[3][1].collect()]
    plan = mixing.plan(stages[3][1]).collect()
    check_mix(docs, plan)
    copies = {r.doc_id: r.copies for r in plan}
    got: dict = {}
    for d, _ in rows(stages[4][1]):
        got[d] = got.get(d, 0) + 1
    assert got == {d: c for d, c in copies.items() if c}


def test_ids(stages):
    import hashlib

    texts = dict(rows(stages[4][1]))
    enc = encoder()
    for r in stages[5][1].collect():
        assert r.n_tokens == len(enc.encode_ordinary(texts[r.doc_id]))
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_is_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_odd_documents(spark):
    text = "some words that are here only once, and then a few more of them to fill a line " * 2
    docs = [(1, text + "a", "en", "s", 5), (2, text + "b", "en", None, None), (3, None, None, None, None), (4, "", "en", "s", 0), (None, "short one here", "en", "s", 1), (5, "five words stand in here", None, "t", 2), (5, "five words stand in here", None, "t", 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").select("*", df_extra("key"), df_extra("seg"), df_extra("h"))
    for frame in (df, df.limit(0)):
        for _, f in corpus_pipeline.STAGES:
            frame = materialize(f(spark, frame, SF), "odd")
            frame.collect()


def df_extra(name):
    from pyspark.sql import functions as F

    return F.lit(1).alias(name)
