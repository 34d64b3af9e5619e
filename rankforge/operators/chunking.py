"""Chunkers: a table of documents becomes a table of chunks.

Input columns document_id, text and whatever else is to be carried; output adds chunk_id, position and token_count.
The fixed and semantic chunkers are expressions over the text: splits are transforms level by level, merges and overlaps are folds over
segments and their numbers of tokens. The recursive chunker does the same in Arrow; it and the similarity of neighbouring sentences
leave the JVM, a whole batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from rankforge.config import Config
from rankforge.functions import arrow
from rankforge.functions import text as T

PARAGRAPHS = ("\n\n", "\n", ". ", " ")
STRINGS, SEGMENTS = "array<string>", "array<struct<s:string,n:int>>"
TEXT, COUNT = "text", "token_count"  # of a chunk, where a chunker counts its tokens
MARK = rf"[^{T.WORD_CHAR}{T.WS[1:-1]}]"  # a token that is no word
TOKENS = 1 << 18  # whose neighbours are compared at a time


def window_texts(tokens: Column, size: int, overlap: int) -> Column:
    """Windows of `size` tokens at every step of size - overlap; a short later window is joined to the one before, and ends the list.

    `tokens` must be a column or a lambda's variable, not an expression: lambdas evaluate what they mention for every element.
    """
    step, n = max(1, size - overlap), F.size(tokens)
    least = max(15, size // 3) if size >= 30 else 0
    full = F.ceil(n / step).cast("int")
    short = F.greatest(F.lit(1), F.ceil((n - least + 1) / step).cast("int"))  # the first window but the very first that is too short
    kept = F.least(full, short)

    def text_of(i: Column) -> Column:
        own = F.slice(tokens, i * step + 1, size)
        return F.array_join(F.when((i == kept - 1) & (kept < full), F.concat(own, F.slice(tokens, kept * step + 1, size))).otherwise(own), " ")

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), kept - 1), text_of)).otherwise(F.array().cast(STRINGS))


def counted(texts: Column) -> Column:
    """Segments: texts with their numbers of tokens, which are counted once and then added."""
    return F.transform(texts, lambda s: F.struct(s.alias("s"), T.number_of_tokens(s).alias("n")))


def split(segment: Column, size: int, separators: tuple[str, ...] = PARAGRAPHS) -> Column:
    """Segments of a segment: at each separator in turn whatever is too long is split, if that gives several parts; what then still is becomes windows of tokens."""
    segments = F.array(segment)
    for separator in separators:
        end = (lambda p: F.when(F.endswith(p, F.lit(".")), p).otherwise(F.concat(p, F.lit(".")))) if separator == ". " else (lambda p: p)

        def parts(x: Column, pattern: str = separator.replace(".", r"\."), end: Callable = end) -> Column:
            found = F.filter(F.transform(F.split(x["s"], pattern), T.strip), lambda p: p != "")
            return T.let(found, lambda p: F.when(F.size(p) > 1, counted(F.transform(p, end))).otherwise(F.array(x)))

        segments = F.flatten(F.transform(segments, lambda x: F.when(x["n"] > size, parts(x)).otherwise(F.array(x))))
    windows = lambda x: counted(T.let(T.tokens(x["s"]), lambda t: window_texts(t, size, 0)))
    return F.flatten(F.transform(segments, lambda x: F.when(x["n"] > size, windows(x)).otherwise(F.array(F.struct(T.strip(x["s"]).alias("s"), x["n"].alias("n"))))))


def merge(segments: Column, size: int) -> Column:
    """Neighbouring segments joined by a blank line while they fit; their token counts add up."""
    start = F.struct(F.array().cast(SEGMENTS).alias("out"), F.lit("").alias("s"), F.lit(0).alias("n"))
    held = lambda a: F.struct(a["s"].alias("s"), a["n"].alias("n"))

    def step(a: Column, x: Column) -> Column:
        fits = a["n"] + x["n"] <= size
        joined = F.when(a["s"] == "", x["s"]).otherwise(F.concat(a["s"], F.lit("\n\n"), x["s"]))
        return F.struct(
            F.when(fits | (a["s"] == ""), a["out"]).otherwise(F.array_append(a["out"], held(a))).alias("out"),
            F.when(fits, T.strip(joined)).otherwise(x["s"]).alias("s"),
            (F.when(fits, a["n"]).otherwise(0) + x["n"]).alias("n"),
        )

    return F.aggregate(segments, start, step, lambda a: F.when(a["s"] == "", a["out"]).otherwise(F.array_append(a["out"], held(a))))


def with_overlap(segments: Column, overlap: int) -> Column:
    """Every segment but the first behind the last `overlap` tokens of the one before it, which has its own overlap already."""
    if overlap <= 0:
        return segments

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        longer = F.struct(F.concat(T.tail_tokens(last["s"], overlap), F.lit("\n\n"), x["s"]).alias("s"), (F.least(last["n"], F.lit(overlap)) + x["n"]).alias("n"))
        return F.array_append(a, F.when(F.size(a) == 0, x).otherwise(longer))

    return F.aggregate(segments, F.array().cast(SEGMENTS), step)


def finished(segments: Column, size: int) -> Column:
    """The tidied texts of the segments without those of too few tokens."""
    return F.transform(F.filter(segments, lambda x: x["n"] >= max(1, min(15, size // 2))), lambda x: T.remove_empty_lines(x["s"]))


def recursive_texts(text: Column, size: int, overlap: int) -> Column:
    whole = F.struct(text.alias("s"), T.number_of_tokens(text).alias("n"))
    return finished(with_overlap(merge(split(whole, size), size), overlap), size)


SPACE, LETTER, SIGN = 0, 1, 2
_kinds = np.full(0x110000, -1, np.int8)  # of characters that were met, as RE2 has them


def _kind(characters: np.ndarray) -> np.ndarray:
    """Whether characters, as numbers, are white space, belong to words or are tokens by themselves."""
    new = np.unique(characters[_kinds[characters] < 0])
    if len(new):
        text = pa.array([chr(c) for c in new.tolist()])
        word, sign = (pc.match_substring_regex(text, pattern=p).to_numpy(zero_copy_only=False) for p in (f"[{T.WORD_CHAR}]", MARK))
        _kinds[new] = np.where(word, LETTER, np.where(sign, SIGN, SPACE))
    return _kinds[characters]


def _counts(texts: pa.Array) -> np.ndarray:
    """The numbers of tokens of texts without nulls, from the kinds of their bytes: a token begins at a sign, and at a letter behind anything else."""
    if not len(texts):
        return np.zeros(0, np.int64)
    offsets, data = (np.frombuffer(b, kind) if b else np.zeros(0, kind) for b, kind in zip(texts.buffers()[1:], (np.int32, np.uint8)))
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = data[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    ascii = np.concatenate([_kind(np.arange(128)), np.full(128, SPACE, np.int8)])
    kind = ascii[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first, more = data[lead].astype(np.int64), np.concatenate([data, np.zeros(3, np.uint8)])
        size = np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))
        code = first & (0x7F >> size)
        for i in (1, 2, 3):
            code = np.where(i < size, code << 6 | more[lead + i] & 0x3F, code)
        own = _kind(code)
        kind[lead] = own
        for i in (1, 2, 3):  # a letter goes on to its last byte
            kind[lead[(i < size) & (own == LETTER)] + i] = LETTER
    begins = kind == LETTER
    begins[1:] &= kind[:-1] != LETTER
    at = offsets[:-1][offsets[:-1] < len(kind)]
    begins[at] = kind[at] == LETTER
    begins |= kind == SIGN
    upto = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def _token_lists(texts: pa.Array) -> list[list[str]]:
    """The tokens of texts, which have no white space inside them."""
    return [x.split() for x in pc.replace_substring_regex(texts, MARK, r" \0 ").to_pylist()]  # the characters of WS are those of split


def _windows(tokens: list[str], size: int) -> list[str]:
    """As window_texts without overlap."""
    least = max(15, size // 3) if size >= 30 else 0
    full = -(-len(tokens) // size)
    kept = min(full, max(1, -(-(len(tokens) - least + 1) // size)))
    return [" ".join(tokens[i * size : (i + 1 if i < kept - 1 or kept == full else kept + 1) * size]) for i in range(kept)]


def _replaced(row: np.ndarray, segments: pa.Array, n: np.ndarray, gone: np.ndarray, at: np.ndarray, new: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, segments, n) with new ones in order instead of those that are gone; `at` has the place of the one that each new one comes from."""
    stay = np.flatnonzero(~gone)
    order = np.argsort(np.concatenate([stay, at]), kind="stable")
    segments = pa.concat_arrays([segments.take(pa.array(stay)), new.cast(segments.type)]).take(pa.array(order))
    return np.concatenate([row[stay], row[at]])[order], segments, np.concatenate([n[stay], _counts(new)])[order]


def _segments(texts: pa.Array, size: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """split() of whole texts: of each segment the text's place, the segment and its number of tokens."""
    row, segments, n = np.arange(len(texts)), texts, _counts(texts)
    for separator in PARAGRAPHS:
        long = np.flatnonzero(n > size)
        cut = pc.split_pattern(segments.take(pa.array(long)), separator)
        at, parts = np.repeat(long, arrow.lengths(cut)), pc.utf8_trim(cut.flatten(), characters=T.WS_CHARS)
        held = pc.not_equal(parts, "").to_numpy(zero_copy_only=False)
        several = np.bincount(at[held], minlength=len(n)) > 1
        held &= several[at]
        at, parts = at[held], parts.filter(pa.array(held))
        if separator == ". ":
            parts = pc.if_else(pc.ends_with(parts, "."), parts, pc.binary_join_element_wise(parts, ".", ""))
        row, segments, n = _replaced(row, segments, n, several, at, parts)
    if len(long := np.flatnonzero(n > size)):
        windows = [_windows(t, size) for t in _token_lists(segments.take(pa.array(long)))]
        row, segments, n = _replaced(row, segments, n, n > size, np.repeat(long, [len(w) for w in windows]), pa.array([x for w in windows for x in w], pa.string()))
    return row, pc.utf8_trim(segments, characters=T.WS_CHARS), n


def _tails(texts: pa.Array, overlap: int) -> list[list[str]]:
    """The last `overlap` tokens of texts, or all if there are fewer; only texts of very long tokens are cut into tokens as a whole."""
    ends = pc.utf8_slice_codeunits(texts, -10 * overlap, None)
    found = _token_lists(ends)
    whole = np.flatnonzero(np.array([len(t) <= overlap for t in found], bool) & pc.not_equal(ends, texts).to_numpy(zero_copy_only=False))
    for i, t in zip(whole, _token_lists(texts.take(pa.array(whole)))):
        found[i] = t
    return [t[-overlap:] for t in found]


def _recursive(texts: pa.Array, size: int, overlap: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """finished(with_overlap(merge(split()))) of whole texts: of each chunk the text's place, the chunk and its number of tokens."""
    row, segments, n = _segments(texts, size)
    some = n > 0
    row, segments, n = row[some], segments.filter(pa.array(some)), n[some]
    starts, held, at = [], 0, -1
    for i, (r, x) in enumerate(zip(row.tolist(), n.tolist())):
        if r != at or held + x > size:
            starts.append(i)
            held, at = 0, r
        held += x
    starts = np.array(starts, dtype=np.int64)
    row, n = row[starts], np.add.reduceat(n, starts) if len(starts) else n
    chunks = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(segments)).astype(np.int32)), segments), "\n\n")
    follows = np.append(False, row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
    if overlap > 0 and follows.any():
        before, tail, said = np.flatnonzero(follows) - 1, [], []
        for i, t in zip(before.tolist(), _tails(chunks.take(pa.array(before)), overlap)):
            tail = (tail + t)[-overlap:] if follows[i] else t
            said.append(" ".join(tail))
            n[i + 1] += len(tail)
        longer = pc.binary_join_element_wise(pa.array(said, pa.string()), chunks.filter(pa.array(follows)), "\n\n")
        chunks = pc.replace_with_mask(chunks, pa.array(follows), longer)
    some = n >= max(1, min(15, size // 2))
    chunks = pc.utf8_trim(pc.replace_substring_regex(chunks.filter(pa.array(some)), r"\n{3,}", "\n\n"), characters=T.WS_CHARS)
    return row[some], chunks, n[some]


def recursive_chunks(text: Column, size: int, overlap: int) -> Column:
    """recursive_texts with numbers of tokens, by RE2 in Arrow level by level, some 4 MB of texts at a time. Null texts have no chunks."""

    @F.arrow_udf(f"array<struct<{TEXT}:string,{COUNT}:int>>")
    def recursive(texts: pa.Array) -> pa.Array:
        counts, chunks, tokens = [np.zeros(0, np.int64)], [pa.array([], pa.string())], [np.zeros(0, np.int64)]
        texts = pc.fill_null(texts, "").cast(pa.string())
        for a, b in arrow.pieces(arrow.byte_lengths(texts), arrow.BYTES):
            row, chunk, n = _recursive(texts.slice(a, b - a), size, overlap)
            counts.append(np.bincount(row, minlength=b - a))
            chunks.append(chunk.cast(pa.string()))
            tokens.append(n)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
        out = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.concat_arrays(chunks), pa.array(np.concatenate(tokens).astype(np.int32))], names=[TEXT, COUNT]))
        del chunks
        arrow.release()
        return out

    return recursive(F.make_valid_utf8(text))


def _cosines(bags: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of neighbouring pairs of each text, and the cosines of all."""
    sentences = bags.flatten()
    texts, sizes = arrow.lengths(bags), arrow.lengths(sentences)
    known = pc.dictionary_encode(sentences.flatten())
    width = len(known.dictionary) + 1
    key, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + known.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    norm = np.sqrt(np.bincount(key // width, weights=n.astype(np.float64) ** 2, minlength=len(sizes)))
    # a word's count meets its count in the next sentence, one row of keys further
    at = np.searchsorted(key, key + width)
    at[at == len(key)] = 0
    same = key[at] == key + width
    dot = np.bincount(key[same] // width, weights=(n * n[at])[same].astype(np.float64), minlength=len(sizes))
    scale = norm[:-1] * norm[1:]
    near = np.where(scale > 0, dot[:-1] / np.where(scale > 0, scale, 1), 0.0) if len(sizes) > 1 else np.zeros(0)
    first = np.cumsum(texts) - texts
    pairs = np.maximum(texts - 1, 0)
    return pairs, near[np.repeat(first - (np.cumsum(pairs) - pairs), pairs) + np.arange(pairs.sum())]


@F.arrow_udf(ArrayType(DoubleType()))
def neighbour_cosines(bags: pa.Array) -> pa.Array:
    """Cosines of the word counts of neighbouring sentences, from their words; for many texts of a batch at once."""
    sentences, sizes = arrow.lengths(bags), arrow.lengths(bags.flatten())
    words = np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(sentences)])])
    parts = [_cosines(bags.slice(a, b - a)) for a, b in arrow.pieces(words + sentences, TOKENS)]
    pairs, near = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in (0, 1))
    arrow.release()
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pairs)]).astype(np.int32)), pa.array(near, pa.float64()))


def similarities(sentences: Column) -> Column:
    """Cosines of the word counts of neighbouring sentences, of a text's sentences."""
    bag = lambda s: F.transform(F.filter(T.tokens(s), lambda t: t.rlike(r"^[\pL\pN]+$")), F.lower)
    return neighbour_cosines(F.transform(F.coalesce(sentences, F.array().cast(STRINGS)), bag))


def encoded_cosines(model_name: str) -> Callable[[Column], Column]:
    """Cosines of neighbouring sentences by a sentence-transformers model, loaded once a worker. Needs that library and the weights."""

    @F.pandas_udf("array<double>")
    def cosines(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(model_name)
        for texts in batches:
            vectors = [model.encode(list(s), normalize_embeddings=True) if s is not None and len(s) else np.zeros((0, 1)) for s in texts]
            yield pd.Series([(v[:-1] * v[1:]).sum(axis=1).astype(float) for v in vectors])

    return cosines


def has_encoder(name: str | None) -> bool:
    """Whether sentences are compared by a model: one is named and its library is installed. Weights that are missing are an error of the run."""
    if not name:
        return False
    try:
        import sentence_transformers  # noqa: F401
    except ImportError:
        return False
    return True


def semantic_texts(text: Column, sentences: Column, near: Column, size: int, overlap: int, threshold: float, least: int) -> Column:
    """Breaks before a sentence that would make the chunk too long, or that differs from the one before once the chunk has `least` sentences.

    `sentences` and `near`, their neighbours' similarities, are columns.
    """
    each = F.transform(sentences, lambda s, i: F.struct(s.alias("s"), T.number_of_tokens(s).alias("n"), F.when(i > 0, F.element_at(near, F.when(i > 0, i).otherwise(1))).alias("near")))
    start = F.struct(F.array().cast(SEGMENTS).alias("out"), F.lit("").alias("s"), F.lit(0).alias("count"), F.lit(0).alias("n"))
    held = lambda a: F.struct(a["s"].alias("s"), a["n"].alias("n"))

    def step(a: Column, x: Column) -> Column:
        breaks = (a["count"] > 0) & ((a["n"] + x["n"] > size) | ((a["count"] >= least) & (x["near"] < threshold)))
        return F.struct(
            F.when(breaks, F.array_append(a["out"], held(a))).otherwise(a["out"]).alias("out"),
            F.when(breaks | (a["count"] == 0), x["s"]).otherwise(F.concat(a["s"], F.lit(" "), x["s"])).alias("s"),
            (F.when(breaks, 0).otherwise(a["count"]) + 1).alias("count"),
            (F.when(breaks, 0).otherwise(a["n"]) + x["n"]).alias("n"),
        )

    groups = F.aggregate(each, start, step, lambda a: F.array_append(a["out"], held(a)))
    cut = F.flatten(F.transform(groups, lambda g: F.when(g["n"] <= size, F.array(g)).otherwise(merge(split(g, size, (". ", " ")), size))))
    return F.when(F.size(sentences) > 1, finished(cut, size)).when(F.size(sentences) == 1, recursive_texts(text, size, overlap)).otherwise(F.array().cast(STRINGS))


PREPARE: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}
CHUNKERS: dict[str, Callable[[dict], Column]] = {}


def register_chunker(name: str, texts: Callable[[dict], Column], prepare: Callable[[DataFrame, dict], DataFrame] | None = None) -> None:
    """A chunking strategy: `texts` gives the array of chunk texts, or of structs of them and their token counts, from the settings; `prepare` may add columns named __... to the documents before."""
    CHUNKERS[name] = texts
    if prepare:
        PREPARE[name] = prepare


def _sentences(documents: DataFrame, c: dict) -> DataFrame:
    documents = documents.withColumn("__sentences", T.sentences("text"))
    if has_encoder(c["semantic_encoder_model"]):
        return documents.withColumn("__near", encoded_cosines(c["semantic_encoder_model"])(F.col("__sentences")))
    return documents.withColumn("__near", similarities(F.col("__sentences")))


register_chunker("fixed", lambda c: window_texts(F.col("__tokens"), c["chunk_size"], c["overlap"]), lambda d, c: d.withColumn("__tokens", T.tokens("text")))
register_chunker("recursive", lambda c: recursive_chunks(F.col("text"), c["chunk_size"], c["overlap"]))
register_chunker(
    "semantic", lambda c: semantic_texts(F.col("text"), F.col("__sentences"), F.col("__near"), c["chunk_size"], c["overlap"], c["semantic_similarity_threshold"], c["semantic_min_sentences"]), _sentences
)


def chunk_documents(documents: DataFrame, config: Config) -> DataFrame:
    """One row a chunk; positions count from 0 within the document. Null and empty texts have no chunks."""
    settings, strategy = config["chunking"], config["chunking.strategy"]
    carried = [c for c in documents.columns if c not in ("text", "token_count", "position", "chunk_id")]
    if strategy in PREPARE:
        documents = PREPARE[strategy](documents, settings)
    cut = documents.select(*carried, F.posexplode(CHUNKERS[strategy](settings)).alias("position", "text"))
    counted = isinstance(cut.schema["text"].dataType, StructType)
    text, count = (F.col(f"text.{TEXT}"), F.col(f"text.{COUNT}")) if counted else (T.strip("text"), T.token_count("text"))
    return cut.select(
        F.concat_ws(":", F.col("document_id").cast("string"), F.col("position").cast("string")).alias("chunk_id"), *carried, "position", text.alias("text"), count.alias("token_count")
    )


def corpus_statistics(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_count, chunk_count and average_chunk_tokens (to 2 digits) in one row."""
    held = chunks.agg(F.count("*").alias("chunk_count"), F.coalesce(F.bround(F.avg("token_count"), 2), F.lit(0.0)).alias("average_chunk_tokens"))
    return documents.agg(F.count("*").alias("document_count")).crossJoin(held)


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Chunks and least, mean and most tokens of each document."""
    n = F.col("token_count")
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.min(n).alias("min_tokens"), F.bround(F.avg(n), 2).alias("average_tokens"), F.max(n).alias("max_tokens"))
