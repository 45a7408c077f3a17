"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.session import ship

#: Rank file of a byte-level tokenizer for many languages; every executor must see this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the rank files' tokenizer cuts a text before it merges bytes (fixed value).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with ``tokens``: how many tokens the whole text has; 0 for NULL and empty texts."""
    ship(df.sparkSession)

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = tokenizer(vocabulary).encode_ordinary
        for batch in batches:
            yield pa.array([len(encode(t)) if t else 0 for t in batch.to_pylist()], pa.int64())

    return df.withColumn("tokens", count.asNondeterministic()(F.col(text)))
