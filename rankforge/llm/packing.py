"""Best-fit packing of documents into sequences of `capacity` tokens after Martello-Toth dominance reduction.

A document longer than the capacity gives full pieces and one shorter piece. Packing only needs to know how many
pieces there are of each size, at most `capacity` numbers whatever the corpus, so the instance is reduced and packed by counts on the driver:

Reduction (Martello and Toth): from the largest size j down, with r = capacity - j left, a set {j, ...} is fixed for good if it
dominates every other feasible set with j: alone if nothing fits; {j, r}; {j, k} with the largest k that fits if no two more
pieces fit, or if no feasible pair exceeds k; {j, k, b} if no three more fit and b is at least the smaller part of every pair. Passes repeat
until none changes the instance.

Best fit of the remainder, sizes decreasing: each piece goes to the fullest open bin that takes it.

Every piece then gets its number among the pieces of its size, counted in parallel by (size, bucket) with offsets, and the plan's runs turn numbers
into bins. There are as many buckets as keep one at about BUCKET_ROWS pieces, so that no task handles all pieces of one size.

Tokens are those of the BPE vocabulary; piece p of a document is its tokens from token_start = p * capacity on.

Cases: documents without tokens (null, empty) are listed with size 0 and no bin. Repeated rows are packed separately; pieces of
equal size are interchangeable. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankforge.llm.shared import lean, pick, written
from rankforge.llm.tokens import VOCABULARY, token_count

CAPACITY, BUCKET_ROWS = 2048, 1 << 18


class Pieces:
    """How many pieces of each size are left, with order queries over the sizes."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.sizes = sorted(self.n)

    def take(self, size: int, count: int) -> None:
        self.n[size] -= count
        if not self.n[size]:
            del self.n[size]
            del self.sizes[bisect_left(self.sizes, size)]

    def largest(self, most: int, used: Counter) -> int | None:
        """The largest size of at most `most` with a piece that `used` leaves."""
        i = bisect_right(self.sizes, most) - 1
        while i >= 0 and self.n[self.sizes[i]] <= used[self.sizes[i]]:
            i -= 1
        return self.sizes[i] if i >= 0 else None

    def smallest(self, k: int, used: Counter) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(k - len(out), self.n[s] - used[s])
            if len(out) == k:
                break
        return out

    def best_pair(self, room: int, used: Counter) -> tuple[int, int]:
        """The largest sum of two pieces within room, and the largest smaller part of any such pair; 0 without one."""
        best, small, i, j = 0, 0, 0, bisect_right(self.sizes, room) - 1
        left = lambda s: self.n[s] - used[s]
        while i <= j:
            a, b = self.sizes[i], self.sizes[j]
            if left(a) <= 0:
                i += 1
            elif left(b) <= 0 or a + b > room:
                j -= 1
            elif i == j:
                if left(a) >= 2:
                    best, small = max(best, 2 * a), max(small, a)
                break
            else:
                best, small = max(best, a + b), max(small, a)
                i += 1
        return best, small


def dominating(left: Pieces, j: int, capacity: int) -> tuple[int, ...] | None:
    """A feasible set with j that dominates all others, if the criteria find one."""
    room, used = capacity - j, Counter([j])
    k = left.largest(room, used)
    if k is None:
        return (j,)
    few = left.smallest(3, used)
    if k == room or len(few) < 2 or few[0] + few[1] > room:
        return (j, k)
    if len(few) < 3 or sum(few) > room:
        best, small = left.best_pair(room, used)
        if best <= k:
            return (j, k)
        b = left.largest(room - k, used + Counter([k]))
        if b is not None and b >= small:
            return (j, k, b)
    return None


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], Pieces]:
    """The sets fixed for good, each with its number of bins, and what is left."""
    left, fixed, changed = Pieces(counts), [], True
    while changed:
        changed = False
        for j in left.sizes[::-1]:
            while left.n.get(j):
                found = dominating(left, j, capacity)
                if found is None:
                    break
                need = Counter(found)
                times = min(left.n[s] // c for s, c in need.items())
                for s, c in need.items():
                    left.take(s, c * times)
                fixed.append((found, times))
                changed = True
    return fixed, left


def best_fit(left: Pieces, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit decreasing by counts: patterns ((size, pieces), ...) and their numbers of bins."""
    bins: dict[int, list] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple, n: int) -> None:
        if n:
            if room not in bins:
                insort(rooms, room)
            bins.setdefault(room, []).append((pattern, n))

    for s in left.sizes[::-1]:
        n = left.n[s]
        while n:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                each = capacity // s
                put(capacity - each * s, ((s, each),), n // each)
                if n % each:
                    put(capacity - n % each * s, ((s, n % each),), 1)
                break
            room = rooms[at]
            pattern, g = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[at]
            each = room // s
            full = min(g, n // each)
            put(room - each * s, (*pattern, (s, each)), full)
            n -= full * each
            if full < g:
                if n:
                    put(room - n * s, (*pattern, (s, n)), 1)
                put(room, pattern, g - full - (n > 0))
                n = 0
    return [(pattern, n) for groups in bins.values() for pattern, n in groups]


def plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """By size, runs of (first number, first bin, pieces in each bin, first token) in order of the first number."""
    fixed, left = reduce(counts, capacity)
    patterns = [(tuple(sorted(Counter(f).items(), reverse=True)), n) for f, n in fixed] + best_fit(left, capacity)
    seen, runs, bins = Counter(), {}, 0
    for pattern, n in patterns:
        start = 0
        for size, each in pattern:
            runs.setdefault(size, []).append((seen[size], bins, each, start))
            seen[size] += n * each
            start += size * each
        bins += n
    return {s: np.array(r, dtype=np.int64) for s, r in runs.items()}


def _assign(batches: Iterator[pa.RecordBatch], runs: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, number = batch.column("n_tokens").to_numpy(), batch.column("number").to_numpy()
        bins, start = np.full(len(size), -1, dtype=np.int64), np.zeros(len(size), dtype=np.int64)
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order])) + 1
        for at in np.split(order, cuts):
            if len(at) and size[at[0]] > 0:
                run = runs[int(size[at[0]])]
                mine = run[np.searchsorted(run[:, 0], number[at], side="right") - 1]
                bins[at] = mine[:, 1] + (number[at] - mine[:, 0]) // mine[:, 2]
                start[at] = mine[:, 3] + (number[at] - mine[:, 0]) % mine[:, 2] * size[at]
        none = size == 0
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("doc_id", "piece", "token_start", "n_tokens")], pa.array(bins, mask=none), pa.array(start, mask=none)],
            names=["doc_id", "piece", "token_start", "n_tokens", "bin_id", "bin_start"],
        )


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, bin_id, bin_start): every piece, its tokens in the document, its bin and its first token's place there."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = written(pick(docs, doc_id="doc_id", text="text").select("doc_id", token_count("text", vocabulary).alias("n"), F.monotonically_increasing_id().alias("row")), "lengths")
    last = F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("bigint")
    pieces = slim.select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    start = F.col("piece") * capacity
    pieces = pieces.withColumns({"token_start": start, "n_tokens": F.least(F.lit(capacity), F.col("n") - start).cast("bigint")})
    counts = {r.n_tokens: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}  # at most capacity + 1 rows
    buckets = max(1, -(-sum(counts.values()) // bucket_rows))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)))
    held = pieces.groupBy("n_tokens", "bucket").agg(F.count("*").alias("held"))
    before = held.withColumn("before", F.sum("held").over(Window.partitionBy("n_tokens").orderBy("bucket")) - F.col("held")).drop("held")
    place = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("row", "piece"))
    numbered = pieces.withColumn("place", place).join(before, ["n_tokens", "bucket"]).select("doc_id", "piece", "token_start", "n_tokens", (F.col("before") + F.col("place") - 1).alias("number"))
    runs = plan({s: n for s, n in counts.items() if s > 0}, capacity)
    return numbered.mapInArrow(lean(lambda it: _assign(it, runs)), f"doc_id {kind}, piece bigint, token_start bigint, n_tokens bigint, bin_id bigint, bin_start bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
