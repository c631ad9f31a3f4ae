"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of a byte-level BPE vocabulary; every executor must have the file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's tokenizer divides texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(vocabulary: str, pattern: str = PATTERN):  # noqa: ANN201
    """The tokenizer of a vocabulary file, once per process."""
    import tiktoken  # noqa: PLC0415

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, vocabulary: str = VOCABULARY) -> int:
    """Tokens of a whole text; lone surrogates are read as replacement characters."""
    coder = encoding(vocabulary)
    return len(coder.encode_ordinary(text.encode("utf-8", "replace").decode("utf-8") if not text.isascii() else text))


def token_counts(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns and ``tokens``, 0 for null and empty texts. Every text is read whole."""
    columns = [documents.schema[c] for c in keep]
    schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in columns) + ", tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = [count_tokens(t, vocabulary) if isinstance(t, str) and t else 0 for t in batch.pop("text")]
            yield batch.assign(tokens=tokens)

    return documents.select(*keep, F.col("text")).mapInPandas(run, schema)
