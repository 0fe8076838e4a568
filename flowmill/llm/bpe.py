"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A long text is cut before encoding, only where no match of the split pattern can cross:
between a character that is not white space and white space after it. Every alternative
of the pattern puts white space first or matches nothing else, so no match holds such a
pair, and the look-ahead after a white-space run sees the same characters as before.
The pieces' ids, one after another, are then the ids of the whole text.

Defined cases: a null text is the empty text, which has no ids; decoding gives bytes, so
ids that end inside a character still decode exactly; rows are encoded one by one, so null,
repeated ids and repeated rows keep their own; an empty table gives no rows; other columns may
have any names, and do not come out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import text_of

#: Characters of a piece, about: what one call of the tokenizer holds at once.
PIECE = 1 << 16
_CUT = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE):
    """Consecutive parts of text, each of about `size` characters, cut only at safe places.

    A stretch without any white space stays one piece: it is a handful of matches, which
    the tokenizer merges with a heap.
    """
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def encode(enc, text: str, size: int = PIECE) -> list[int]:
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for p in pieces(text, size):
        ids += enc.encode_ordinary(p)
    return ids


def bpe(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded if asked)."""
    kind = docs.schema[id_col].dataType
    src = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))

    def run(it):
        enc = encoding(rank_file, pattern)
        names = [str(i) for i in range(enc.n_vocab)]
        for b in it:
            out: dict = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for t in b.column(1):
                ids = encode(enc, t.as_py())
                raw = enc.decode_bytes(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
                if keep_ids:
                    out["ids"].append(ids)
                    out["decoded"].append(raw)
            cols = [b.column(0), pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
            names_out = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols += [pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["decoded"], pa.binary())]
                names_out += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names_out)

    schema = f"`{id_col}` {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep_ids
    return src.mapInArrow(run, schema)


def op10(spark, sf_dir: str, rank_file: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe(docs, rank_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
