"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.tables import spread

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's pattern of pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(ranks: str):
    """The tokenizer of a rank file; once per Python worker."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=table, special_tokens={})


def _count(ranks: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = encoding(SparkFiles.get(ranks)).encode_ordinary
    for b in batches:
        n = [0 if t is None else len(encode(t)) for t in b.column(0).to_pylist()]
        names = ["n_tokens", *b.schema.names[1:]]
        yield pa.record_batch([pa.array(n, pa.int32()), *b.columns[1:]], names=names)


def token_counts(df: DataFrame, text: str, keep: list[Column], ranks: str = RANKS) -> DataFrame:
    """``keep`` and n_tokens of whole texts (null and empty: 0); the text itself goes no further. The file at ``ranks`` is sent to the executors."""
    df.sparkSession.sparkContext.addFile(ranks)
    d = spread(df.select(F.col(text).alias("_text"), *keep))
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[1:])
    return d.mapInArrow(partial(_count, os.path.basename(ranks)), f"n_tokens int, {rest}")
