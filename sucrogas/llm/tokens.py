"""Token counts and token offsets by public byte-level tokenizers."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Folder of the vocabulary files (a parameter of every operator) and the file taken.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY):
    """The tokenizer of a rank file, loaded once per Python worker."""
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Bytes of each token id."""
    e = encoding(folder, vocabulary)
    out = np.zeros(e.max_token_value + 1, dtype=np.int64)
    for b, i in e._mergeable_ranks.items():
        out[i] = len(b)
    return out




def encode(text: str, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> list[int]:
    """Tokens of a text.  A lone surrogate, which has no UTF-8 form, is read as "?"."""
    e = encoding(folder, vocabulary)
    try:
        return e.encode_ordinary(text)
    except UnicodeEncodeError:
        return e.encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))


def with_token_counts(df: DataFrame, text: str, column: str = "tokens", folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the number of tokens of the whole text; 0 for NULL and empty texts.  No shuffle."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(encode(t, folder, vocabulary)) if isinstance(t, str) and t else 0 for t in texts], dtype="int64")

    return df.withColumn(column, count(F.col(text)))
