"""Sizes of texts in tokens of a public byte-level tokenizer, read from a file whose path is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern by which that vocabulary's texts are split before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(documents: DataFrame, *, ident: str, text: str, keep: list[str] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """ident, the columns to keep and n_tokens of every row with an ident; null and empty texts have 0 tokens. Whole texts are encoded."""
    kinds = dict(documents.dtypes)

    def run(batches):
        enc = encoding(vocabulary)
        for b in batches:
            sizes = [len(enc.encode_to_numpy(t or "", disallowed_special=())) for t in b["_text"]]  # there are no special tokens
            yield b.drop(columns="_text").assign(n_tokens=sizes)

    work = documents.where(F.col(ident).isNotNull()).select(ident, *keep, F.col(text).alias("_text"))
    return work.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in (ident, *keep)) + ", n_tokens long")
