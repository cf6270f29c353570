"""Token counts by a public byte-level tokenizer, read from a vocabulary file."""

from __future__ import annotations

import base64
import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder with the vocabulary files; a parameter of every operator.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that splits text before the merges of these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict = {}


def encoding(path: str):
    """The tokenizer of a vocabulary file, loaded once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def lengths(path: str) -> np.ndarray:
    """Bytes of each token of a vocabulary file, by its number."""
    if (path, "lengths") not in _loaded:
        enc = encoding(path)
        _loaded[path, "lengths"] = np.array([len(enc.decode_single_token_bytes(c)) for c in range(enc.n_vocab)], dtype=np.int64)
    return _loaded[path, "lengths"]


def n_tokens(text: Column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of the whole text; 0 for null and empty."""
    path = f"{folder}/{vocabulary}"

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(path)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int32")

    return count(text)


def sized(df: DataFrame, key: str, text: str, *more: Column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, *more), one row per row of ``df``."""
    return df.select(F.col(f"`{key}`").alias("id"), n_tokens(F.col(f"`{text}`"), folder, vocabulary).alias("n_tokens"), *more)
