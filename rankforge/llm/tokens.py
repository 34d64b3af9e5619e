"""Token counts of documents by a byte-level BPE vocabulary, the one that the token codes use."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from rankforge.llm.shared import release

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # a default; every operator takes the path as a parameter
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str = "text", vocabulary: str = VOCABULARY) -> Column:
    """0 for a null text; the whole text is counted, whatever its length. Only the text column goes to Python."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        bpe = tokenizer(vocabulary)
        found = pa.array([len(bpe.encode_ordinary(t.as_py() or "")) for t in texts], pa.int64())
        release()
        return found

    return count(F.col(text))
