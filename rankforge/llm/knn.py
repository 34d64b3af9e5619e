"""Exact top-k search: a Voronoi kNN join of a table of queries with a table of vectors.

(1) Seeded pivots divide the space into cells; every vector and every query goes to its nearest pivot. (2) Each cell is summarised by its
count, its radius and the least k + 1 distances of its vectors to its pivot. (3) These bound the distance at which any query of cell i finds
its k-th neighbour: theta(i), the (k + 1)-th least of radius(i) + |p(i) p(j)| + d(s, p(j)) over all summaries. (4) Neighbouring cells are put in
groups of bounded size, of queries and of vectors. A vector is sent to the groups of queries with a cell i for which
d(s, p(i)) <= radius(i) + theta(i) and the hyperplane between the pivots is within theta(i) of s. A query is sent to the groups of vectors with a
cell j for which d(q, p(j)) - radius(j) <= theta of its cell. All others are too far. (5) Each pair of groups is one task's work: a
matrix product finds the candidates, differences of the vectors give their distances; the k best of each pair are merged by query.

Euclidean distance; neighbours by distance, then vec_id (null last), then row. A query's own row is never its neighbour, but rows that repeat it
are.

Cases: null vectors, vectors with a null or not finite component and vectors of another dimension than the most common one (the lesser of
ties) neither ask nor answer. With k or fewer vectors each query gets all the others. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankforge.llm.shared import lean, seeded, written

K, PIVOTS, GROUP_ROWS, QUERY_ROWS, EVERY, SEED = 10, 4096, 1 << 15, 1 << 14, 50, 71


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def group_cells(pivots: np.ndarray, weights: np.ndarray, most: int) -> list[np.ndarray]:
    """Cells in groups of neighbours with at most `most` rows (or of one cell), by halving along the widest axis."""
    todo, done = [np.arange(len(pivots))], []
    while todo:
        cells = todo.pop()
        if len(cells) == 1 or weights[cells].sum() <= most:
            done.append(cells)
            continue
        axis = np.argmax(pivots[cells].var(axis=0))
        cells = cells[np.argsort(pivots[cells, axis], kind="stable")]
        held = np.cumsum(weights[cells])
        cut = min(max(1, int(np.searchsorted(held, held[-1] / 2))), len(cells) - 1)
        todo += [cells[:cut], cells[cut:]]
    return done


class Groups:
    """Groups of cells; one that is a single overfull cell is divided into chunks by row number."""

    def __init__(self, pivots: np.ndarray, weights: np.ndarray, most: int):
        self.cells = group_cells(pivots, weights, most)
        self.chunks = np.array([max(1, -(-int(weights[c].sum()) // most)) for c in self.cells])
        self.first = np.cumsum(self.chunks) - self.chunks
        self.of = np.zeros(len(pivots), dtype=np.int64)
        for g, cells in enumerate(self.cells):
            self.of[cells] = g

    def home(self, cell: np.ndarray, row: np.ndarray) -> np.ndarray:
        g = self.of[cell]
        return self.first[g] + row % self.chunks[g]

    def sent(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and chunks from a matrix that says which cells each row may meet."""
        at, to = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for g, cells in enumerate(self.cells):
            mine = np.flatnonzero(near[:, cells].any(axis=1))
            for c in range(self.chunks[g]):
                at.append(mine)
                to.append(np.full(len(mine), self.first[g] + c))
        return np.concatenate(at), np.concatenate(to)


def nearest(queries: np.ndarray, q_row: np.ndarray, data: np.ndarray, row: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, data numbers, distances and ranks of the k nearest, ties by order; a row of its own number is left out."""
    norm, asked = (data * data).sum(axis=1), (queries * queries).sum(axis=1)
    slack = 1e-10 * (1 + max(norm.max(initial=0), asked.max(initial=0)))  # what the product may be off by
    step, found = max(1, (1 << 22) // max(1, len(data))), []
    for a in range(0, len(queries), step):
        q = queries[a : a + step]
        d = asked[a : a + step, None] + norm[None, :] - 2 * (q @ data.T)
        d[row[None, :] == q_row[a : a + step, None]] = np.inf
        kth = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(q), np.inf)
        i, j = np.nonzero((d <= kth[:, None] + slack) & np.isfinite(d))
        exact = np.sqrt(((data[j] - q[i]) ** 2).sum(axis=1))
        best = np.lexsort((order[j], exact, i))
        i, j, exact = i[best], j[best], exact[best]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        found.append((i[keep] + a, j[keep], exact[keep], rank[keep] + 1))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 4


def knn_join(
    vectors: DataFrame, asks: Column | None = None, k: int = K, pivots: int = PIVOTS, group_rows: int = GROUP_ROWS, query_rows: int = QUERY_ROWS, seed: int = SEED, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """(vec_id, neighbor_id, rank, distance): the k nearest other rows of every row for which `asks` holds, or of all rows.

    There are 2 sqrt(n) pivots, at most `pivots`: more would only cost time, as none is left out of an answer.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_column].dataType.simpleString()
    out = f"vec_id {kind}, neighbor_id {kind}, rank int, distance double"
    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").alias("v"), (F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))).alias("asks"))
    good = rows.where("v is not null and size(v) > 0").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sizes = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out)
    dim, total = sizes[0].dim, sizes[0]["count"]
    good = written(good.where(F.size("v") == dim).withColumn("row", F.monotonically_increasing_id()), "vectors")
    drawn = good.orderBy(seeded(seed, "row"), "row").limit(min(pivots, max(1, math.isqrt(total) * 2))).select("v").collect()
    p = np.unique(np.array([r.v for r in drawn], dtype=np.float64), axis=0)
    vector = good.schema["v"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            d = distances(matrix(batch.column("v"), dim), p)
            cell = np.argmin(d, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], names=[*batch.schema.names, "cell", "d"])

    columns = f"id {kind}, v {vector}, asks boolean, row bigint"
    celled = written(good.select("id", "v", "asks", "row").mapInArrow(lean(assign), f"{columns}, cell int, d double"), "cells")

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each cell the least k + 1 distances in this task, so that a cell's rows never meet in one place."""
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            cell, d = batch.column("cell").to_numpy(), batch.column("d").to_numpy()
            order = np.lexsort((d, cell))
            for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                c = int(cell[own[0]])
                held[c] = np.sort(np.concatenate([held.get(c, d[:0]), d[own[: k + 1]]]))[: k + 1]
        pairs = [(c, x) for c, xs in held.items() for x in xs]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in pairs], pa.int32()), pa.array([x for _, x in pairs], pa.float64())], names=["cell", "d"])

    near = celled.select("cell", "d").mapInArrow(lean(least), "cell int, d double").withColumn("i", F.row_number().over(Window.partitionBy("cell").orderBy("d"))).where(F.col("i") <= k + 1)
    summary = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius"), F.count_if("asks").alias("asked"), F.max(F.when(F.col("asks"), F.col("d"))).alias("reach"))
    weight, asked = np.zeros(len(p), dtype=np.int64), np.zeros(len(p), dtype=np.int64)
    radius, reach = np.full(len(p), -np.inf), np.full(len(p), -np.inf)
    for r in summary.collect():  # one row a pivot
        weight[r.cell], radius[r.cell], asked[r.cell], reach[r.cell] = r.n, r.radius, r.asked, -np.inf if r.reach is None else r.reach
    bounds: dict[int, list[float]] = {}
    for r in near.select("cell", "d").collect():  # k + 1 rows a pivot
        bounds.setdefault(r.cell, []).append(r.d)
    apart = distances(p, p)
    theta = np.full(len(p), np.inf)
    for i in np.flatnonzero(asked):
        far = np.concatenate([apart[i, j] + np.array(b) for j, b in bounds.items()]) + reach[i]
        if len(far) > k:
            theta[i] = np.partition(far, k)[k]
    theta = theta * (1 + 1e-9) + 1e-9
    finite = np.where(asked > 0, reach, 0.0)
    asking, data = Groups(p, asked, query_rows), Groups(p, weight, group_rows)
    parts = int(data.chunks.sum())

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.full(len(p), -np.inf)
        wide[asked > 0] = (finite + theta)[asked > 0] * (1 + 1e-9) + 1e-9
        for batch in slices(batches, 2048):
            d = distances(matrix(batch.column("v"), dim), p)
            cell, row, own = (batch.column(c).to_numpy() for c in ("cell", "row", "d"))
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d**2 - own[:, None] ** 2) / (2 * apart[cell])
            meets = (d <= wide) & ((apart[cell] == 0) | ~(plane > theta * (1 + 1e-9) + 1e-9)) & (asked > 0)
            at, to = asking.sent(meets)  # a vector meets groups of queries
            of_vectors = to * parts + data.home(cell, row)[at]
            q = np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False))
            reached = (d[q] - radius <= theta[cell[q], None]) & (weight > 0)
            q_at, q_to = data.sent(reached)  # a query meets groups of vectors
            of_queries = asking.home(cell[q], row[q])[q_at] * parts + q_to
            taken = batch.select(["id", "v", "row"]).take(pa.array(np.concatenate([at, q[q_at]])))
            asks = np.arange(len(at) + len(q_at)) >= len(at)
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate([of_vectors, of_queries]), pa.int64()), pa.array(asks)], names=["id", "v", "row", "part", "asks"])

    def solve(table: pa.Table) -> pa.Table:
        asks = table.filter(table.column("asks")).combine_chunks()
        data = table.filter(pa.compute.invert(table.column("asks"))).combine_chunks()
        held = [matrix(t.column("v").combine_chunks(), dim) if len(t) else np.zeros((0, dim)) for t in (asks, data)]
        by_id = pa.compute.sort_indices(data, sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_end").to_numpy()
        order = np.empty(len(data), dtype=np.int64)
        order[by_id] = np.arange(len(data))
        i, j, far, _ = nearest(held[0], asks.column("row").to_numpy(), held[1], data.column("row").to_numpy(), order, k) if len(asks) and len(data) else (np.zeros(0, dtype=np.int64),) * 4
        i, j = pa.array(i), pa.array(j)
        return pa.table({"query": asks.column("row").take(i), "vec_id": asks.column("id").take(i), "neighbor_id": data.column("id").take(j), "row": data.column("row").take(j), "distance": pa.array(far, pa.float64())})

    sent = celled.mapInArrow(lean(replicate), f"id {kind}, v {vector}, row bigint, part bigint, asks boolean")
    found = sent.groupBy("part").applyInArrow(solve, f"query bigint, vec_id {kind}, neighbor_id {kind}, row bigint, distance double")
    best = Window.partitionBy("query").orderBy("distance", F.col("neighbor_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("vec_id", "neighbor_id", "rank", "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by EVERY ask all vectors."""
    return knn_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0).withColumn("distance", F.round("distance", 6))


ORACLE_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.r, a.vec_id, b.vec_id AS neighbor_id, list_distance(a.e, b.e) AS d, b.r AS br FROM v a, v b WHERE a.vec_id % {EVERY} = 0 AND a.r <> b.r),
q AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, neighbor_id, br) AS n FROM p)
SELECT vec_id, neighbor_id, n::INTEGER AS rank, round(d, 6) AS distance FROM q WHERE n <= {K}"""
