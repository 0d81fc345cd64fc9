"""Sizes of texts in tokens of a public tokenizer. The vocabulary file's path is a parameter; it is never copied or trained."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how this vocabulary splits a text into pieces before merging.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict = {}


def _counter(vocabulary: str):
    """A function from texts to numbers of tokens, for a file of ranks (.tiktoken) or of a tokenizer (.json). Strings of special tokens count as ordinary text."""
    if vocabulary.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        t.encode_special_tokens = True
        return lambda texts: [len(e) for i in range(0, len(texts), 64) for e in t.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encode = tiktoken.Encoding(vocabulary, pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda texts: [len(encode(t)) for t in texts]


def count_tokens(texts: list[str], vocabulary: str = VOCABULARY) -> list[int]:
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = _counter(vocabulary)
    return _LOADED[vocabulary](texts)


def token_sizes(df: DataFrame, key: str = "doc_id", text: str = "text", extra: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, the extra columns, tokens (bigint): whole texts; null and empty texts have 0 tokens."""
    extra = extra or []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(tokens=count_tokens(pdf["_text"].tolist(), vocabulary))
            yield pdf.drop(columns="_text")

    src = df.select(key, *extra, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in src.drop("_text").dtypes)
    return src.mapInPandas(run, f"{kinds}, tokens bigint")
