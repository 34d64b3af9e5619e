"""Token ids in directly addressable codes: random access to any token without decoding a block.

An id is cut into chunks of CHUNK bits, lowest first. Level l holds the l-th chunks of all ids that have one, a bitmap that
marks which of them continue, and a rank directory (ones before every 512 bits). The chunk of token i at level 0 is at i; if its bit
is set, the next chunk is at rank(i) of level 1, and so on.

Layout of a code, little endian: b"DAC1", u64 tokens, u8 levels, then for each level u64 chunks, the chunks as bytes, the bitmap in
64-bit words padded to the next full word, and the directory as u64.

Cases: null and empty texts give a code of no tokens (a null text with n_tokens 0 too). Texts are encoded whole; strings that look like special
tokens are ordinary text. Repeated rows give equal rows. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.shared import lean, pick
from rankforge.llm.tokens import VOCABULARY, tokenizer

CHUNK, BLOCK = 8, 512
MAGIC = b"DAC1"


def encode(ids: np.ndarray) -> bytes:
    """The code of non-negative ids."""
    rest = np.asarray(ids).astype(np.uint64)
    levels, out = 0, []
    while len(rest):
        chunk, rest = (rest & np.uint64(255)).astype(np.uint8), rest >> np.uint64(CHUNK)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(more) // 64) * 8, dtype=np.uint8)
        words[: len(bits)] = bits
        ones = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64))[:-1]]).astype("<u8")
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes(), words.tobytes(), ones.tobytes()]
        rest = rest[more]
        levels += 1
    return b"".join([MAGIC, struct.pack("<QB", len(ids), levels), *out])


class Codes:
    """A view of a code; nothing is decoded until it is asked for."""

    def __init__(self, code: bytes):
        if code[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        self.code = code
        self.tokens, levels = struct.unpack_from("<QB", code, 4)
        self.levels, at = [], 13
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", code, at)
            bitmap = at + 8 + n
            directory = bitmap + -(-n // 64) * 8
            self.levels.append((n, at + 8, bitmap, directory))
            at = directory + -(-n // BLOCK) * 8

    def __len__(self) -> int:
        return self.tokens

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for _, chunks, bitmap, directory in self.levels:
            value |= self.code[chunks + i] << shift
            if not self.code[bitmap + (i >> 3)] >> (i & 7) & 1:
                break
            block = i // BLOCK
            (before,) = struct.unpack_from("<Q", self.code, directory + 8 * block)
            start = block * BLOCK
            part = int.from_bytes(self.code[bitmap + start // 8 : bitmap + i // 8 + 1], "little")
            i = before + (part & ((1 << (i - start)) - 1)).bit_count()
            shift += CHUNK
        return value

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out = np.zeros(self.tokens, dtype=np.int64)
        at = np.arange(self.tokens)
        for level, (n, chunks, bitmap, directory) in enumerate(self.levels):
            out[at] |= np.frombuffer(self.code, np.uint8, n, chunks).astype(np.int64) << (CHUNK * level)
            more = np.unpackbits(np.frombuffer(self.code, np.uint8, directory - bitmap, bitmap), bitorder="little")[:n].astype(bool)
            at = at[more]
        return out


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = tokenizer(path)
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            counts, codes = [], []
            for text in part.column("text"):
                ids = np.array(bpe.encode_ordinary(text.as_py() or ""), dtype=np.uint32)
                counts.append(len(ids))
                codes.append(encode(ids))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(codes, pa.binary())], names=["doc_id", "n_tokens", "codes"])


def tokenized(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, codes) of every document; `vocabulary` is a tiktoken file that every executor can read."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return pick(docs, doc_id="doc_id", text="text").mapInArrow(lean(lambda it: _encode(it, vocabulary)), f"doc_id {kind}, n_tokens bigint, codes binary")


def token_at(codes: Column, position: Column) -> Column:
    """The token at a position from 0 on; null outside the code or for a null."""
    @F.pandas_udf("bigint")
    def at(code: pd.Series, i: pd.Series) -> pd.Series:
        out = []
        for c, k in zip(code, i):
            view = None if c is None or pd.isna(k) else Codes(bytes(c))
            out.append(view[int(k)] if view is not None and 0 <= k < len(view) else None)
        return pd.Series(out, dtype="Int64")

    return at(codes, position)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(spark.read.parquet(f"{sf_dir}/documents.parquet"))
