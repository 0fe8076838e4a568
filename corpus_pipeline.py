"""From raw documents to token ids: five stages, each written and read by the next.

1. language_id: documents that language ID rejects go.
2. near_dedup: of each group of near duplicates (five-word shingles, similarity 0.8 or
   more) the document with the smallest id stays.
3. suffix_dedup: passages of 100 bytes or more that also start earlier are removed, in whole
   characters; n_chars follows the text, and a document of which nothing is left goes.
4. mixing: rows are left out or repeated so that sources take up their target weights.
5. bpe: token counts and digests of each remaining row.

All but the last return the columns of documents. A stage's input is its predecessor's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.llm import bpe, langid, mixing, neardup, suffixes
from flowmill.llm.common import materialize
from flowmill.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.kept_rows(docs, neardup.Spec(k=5))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    r = suffixes.remove(docs, keep_text=True)
    left = r.where((F.col("n_removed") == 0) | (F.length("kept") > 0))
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))}
    return left.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def _shipped(stage):
    """The stage, with the package sent to the executors first."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _shipped(f)) for name, f in (("language_id", language_id), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mix), ("bpe", encode))]
#: SQL has no language model, signature banding or tokenizer; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
