"""Language ID: nearest of several clustered centroids per language, by cosine, with distance-based rejection.

A document is the sublinear TF-IDF vector of its hashed byte 2- and 3-grams (lower case, everything but words as one
space), scaled to length one. Document frequencies are counted over all documents. Each language's centroids come from spherical k-means over a
seeded sample of at most `sample` of its labelled documents (the bound of the fit; everything else covers all rows).
A document takes the language of the nearest centroid. It is rejected if its cosine distance is beyond what its
evidence allows: SLACK times the QUANTILE of the distances at which training texts with about as many n-grams lie
from centroids of their language that they had no part in, at least LEAST_RADIUS (fewer n-grams lie further away; windows of the training texts stand for short ones).

Cases: null, empty and word-free texts are rejected with a null language. A null label is not used in fitting. With no
labelled document at all everything is rejected. Ties go to the first language in order. Texts are read whole,
whatever their length. Repeated rows get equal answers. An empty table gives an empty result. Other columns are passed by accepted()
unchanged and not read by identify(). A label column that is missing from an empty fit is an error of the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankforge.llm.shared import lean, pick, seeded
from rankforge.llm.textbytes import WORD, lowered, utf8

DIMENSIONS, CLUSTERS, SAMPLE, SEED = 4096, 4, 500, 17
QUANTILE, SLACK, LEAST_RADIUS = 0.99, 1.15, 0.55
WINDOW = 1024
SIZES = np.array([0, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 1 << 62])  # n-grams, by which radii differ
BATCH_ROWS, BATCH_BYTES = 256, 1 << 20


def collapsed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with every run of other bytes than words as one space, their rows, and the word bytes of each row."""
    word = WORD[data]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = word[1:] | word[:-1] | (row[1:] != row[:-1])
    return np.where(word, data, 32)[keep].astype(np.uint8), row[keep], np.bincount(row[word], minlength=len(offsets) - 1)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, DIMENSIONS) counts, and the number of n-grams and of word bytes of each row."""
    n = len(offsets) - 1
    b, row, letters = collapsed(data, offsets)
    b = b.astype(np.uint32)
    flat = np.zeros(n * DIMENSIONS)
    for size in (2, 3):
        if len(b) >= size:
            code = np.full(len(b) - size + 1, size, dtype=np.uint32)
            for k in range(size):
                code = (code << np.uint32(8)) | b[k : len(b) - size + 1 + k]
            ok = row[: len(code)] == row[size - 1 :]
            bucket = (code[ok] * np.uint32(0x9E3779B1)) >> np.uint32(20)
            flat += np.bincount(row[: len(code)][ok] * DIMENSIONS + bucket, minlength=n * DIMENSIONS)
    counts = flat.reshape(n, DIMENSIONS)
    return counts, counts.sum(axis=1).astype(np.int64), letters


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.zeros_like(counts)
    some = counts > 0
    v[some] = 1.0 + np.log(counts[some])
    v *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.where(norm > 0, norm, 1)[:, None]


def _summed(data: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What grams() gives for one long text, from pieces that begin with the last two bytes kept of the piece before."""
    ends = lambda x: np.array([0, len(x)])
    total, tail = grams(data[:0], ends(data[:0])), data[:0]
    for at in range(0, len(data), most):
        piece = np.concatenate([tail, data[at : at + most]])
        total = tuple(x + y - z for x, y, z in zip(total, grams(piece, ends(piece)), grams(tail, ends(tail))))
        tail = collapsed(piece, ends(piece))[0][-2:]
    return total


def blocks(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First and last row, counts, n-grams and word bytes of blocks that fit in memory; a long text is cut and summed."""
    data, offsets = utf8(lowered(text))
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, min(a + BATCH_ROWS, int(np.searchsorted(offsets, offsets[a] + BATCH_BYTES, side="right")) - 1))
        b = min(b, n)
        if b == a + 1 and offsets[b] - offsets[a] > 4 * BATCH_BYTES:
            yield a, b, *_summed(data[offsets[a] : offsets[b]], 4 * BATCH_BYTES)
        else:
            yield a, b, *grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
    for batch in batches:
        for _, _, counts, _, letters in blocks(batch.column("text")):
            df += (counts > 0)[letters > 0].sum(axis=0)
            n += int((letters > 0).sum())
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.append(n, df))], names=["bucket", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """ln((1 + N) / (1 + df)) + 1 of each of the DIMENSIONS buckets, over all documents with a word."""
    rows = pick(docs, text="text").mapInArrow(lean(_frequencies), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(DIMENSIONS + 1)
    for r in rows:
        counts[r.bucket + 1] = r.n
    return np.log((1 + counts[0]) / (1 + counts[1:])) + 1


def k_means(v: np.ndarray, k: int, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and the cluster of each row: farthest-first start, then spherical k-means."""
    chosen = [0]
    nearest = v @ v[0]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, v @ v[chosen[-1]])
    c, own = v[chosen], None
    for _ in range(rounds):
        now = np.argmax(v @ c.T, axis=1)
        if own is not None and (now == own).all():
            break
        own = now
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c, np.argmax(v @ c.T, axis=1)


def windows(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """grams() of one window of `size` bytes from each text that is long enough, at a place that its length decides."""
    data, offsets = utf8(lowered(text))
    long = np.flatnonzero(np.diff(offsets) > size)
    start = offsets[long] + (np.diff(offsets)[long] * 2654435761) % (np.diff(offsets)[long] - size)
    pieces = [data[a : a + size] for a in start]
    return grams(np.concatenate(pieces) if pieces else data[:0], np.arange(len(pieces) + 1) * size)


def fit(docs: DataFrame, label: str = "lang", sample: int = SAMPLE, clusters: int = CLUSTERS, seed: int = SEED) -> dict:
    """The model: idf, centroids, their languages, and their radii by number of n-grams."""
    idf = inverse_frequencies(docs)
    labelled = pick(docs, text="text", lang=F.col(f"`{label}`").cast("string")).where("lang is not null and length(text) > 0")
    share = {r.lang: min(1.0, (1.5 * sample + 50) / r["count"]) for r in labelled.groupBy("lang").count().collect()}
    if not share:
        return {"idf": idf, "centroids": np.zeros((0, DIMENSIONS)), "languages": [], "radii": np.zeros((0, len(SIZES) - 1))}
    u = F.pmod(seeded(seed, "text"), F.lit(1 << 30)) / float(1 << 30)
    limit = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    drawn = labelled.withColumn("h", seeded(seed, "text")).where(u < limit).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("n") <= sample)

    def train(group: pa.Table) -> pa.Table:
        group = group.sort_by("n")
        held = [(counts[letters > 0], size[letters > 0]) for _, _, counts, size, letters in blocks(group.column("text").combine_chunks())]
        counts, size = np.concatenate([c for c, _ in held]), np.concatenate([s for _, s in held])
        lang = group.column("lang")[0].as_py()
        out = {"lang": [], "centroid": [], "radii": []}
        if len(counts):
            v = vectors(counts, idf)
            c, own = k_means(v, clusters)
            text, radii = group.column("text").combine_chunks(), []
            half = np.arange(len(v)) % 2
            # distances are taken across halves, as a text lies nearer to centroids that it helped to make
            across = [(half != h, k_means(v[half == h], clusters)[0]) for h in (0, 1)] if len(v) > 1 else [(half >= 0, c)]
            distance = np.zeros(len(v))
            for mine, near in across:
                distance[mine] = 1 - (v[mine] @ near.T).max(axis=1)
            for top in SIZES[1:]:
                seen = distance[size > top // 2]
                if top <= WINDOW:  # windows of the training texts stand for texts as short as this
                    short, n, _ = windows(text, int(top) // 2)
                    seen = 1 - (vectors(short, idf) @ c.T).max(axis=1)[n > 0] if len(short) else seen
                radii.append(float(np.quantile(seen, QUANTILE)) if len(seen) else (radii[-1] if radii else 1.0))
            radii = np.maximum(np.maximum.accumulate(radii[::-1])[::-1], LEAST_RADIUS)  # less evidence never has the smaller radius
            for j in range(len(c)):
                out["lang"].append(lang)
                out["centroid"].append(c[j])
                out["radii"].append(radii)
        return pa.table({"lang": pa.array(out["lang"], pa.string()), "centroid": pa.array(out["centroid"], pa.list_(pa.float64())), "radii": pa.array(out["radii"], pa.list_(pa.float64()))})

    rows = drawn.groupBy("lang").applyInArrow(train, "lang string, centroid array<double>, radii array<double>").collect()
    rows.sort(key=lambda r: (r.lang, r.centroid))
    return {"idf": idf, "centroids": np.array([r.centroid for r in rows]).reshape(-1, DIMENSIONS), "languages": [r.lang for r in rows], "radii": np.array([r.radii for r in rows]).reshape(-1, len(SIZES) - 1)}


def decide(text: pa.Array, model: dict, slack: float = SLACK) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Language, cosine distance, allowed distance and whether it is accepted, of each text."""
    n = len(text)
    lang, distance, limit, good = [None] * n, np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, dtype=bool)
    if not model["languages"]:
        return lang, distance, limit, good
    for a, b, counts, size, letters in blocks(text):
        near = vectors(counts, model["idf"]) @ model["centroids"].T
        best = np.argmax(near, axis=1)
        some = letters > 0
        at = np.arange(a, b)[some]
        distance[at] = 1 - near[np.arange(b - a), best][some]
        limit[at] = np.minimum(slack * model["radii"][best, np.searchsorted(SIZES, size, side="left") - 1], 0.999)[some]
        for i, j in zip(at, best[some]):
            lang[i] = model["languages"][j]
    good = distance <= limit
    return lang, distance, limit, good


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, language, distance, max_distance, accepted) of every document; the language only if accepted."""
    model = model or fit(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, distance, limit, good = decide(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x if g else None for x, g in zip(lang, good)], pa.string()), pa.array(distance, from_pandas=True), pa.array(limit, from_pandas=True), pa.array(good)],
                names=["doc_id", "language", "distance", "max_distance", "accepted"],
            )

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(lean(work), f"doc_id {kind}, language string, distance double, max_distance double, accepted boolean")


def accepted(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """The rows of docs, all columns, whose language is known; the others go."""
    model = model or fit(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(decide(batch.column(batch.schema.names.index("text")), model)[3]))

    return docs.mapInArrow(lean(work), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
