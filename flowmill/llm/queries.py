"""The queries of this subpackage: name to (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from flowmill.llm import bpe, langid, mixing, neardup, neighbours, phrases, suffixes, toxicity, warc, webp


def queries() -> dict:
    return {
        "op1_webp": webp.op1,
        "op2_langid": langid.op2,
        "op3_phrases": phrases.op3,
        "op4_neighbours": neighbours.op4,
        "op5_mixing": mixing.op5,
        "op6_toxicity": toxicity.op6,
        "op7_warc": warc.op7,
        "op8_suffix_dedup": suffixes.op8,
        "op9_minhash": neardup.op9,
        "op10_bpe": bpe.op10,
        "langid_pages": langid.pages,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_phrases": phrases.OP3_SQL, "op4_neighbours": neighbours.OP4_SQL, "op5_mixing": mixing.OP5_SQL, "op7_warc": warc.OP7_SQL, "op8_suffix_dedup": suffixes.OP8_SQL, "op9_minhash": neardup.OP9_SQL}
