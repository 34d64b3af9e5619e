"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length and source. A source's budget is its weight's share of the total budget.
All of the budget but a window of two of the longest documents is drawn in proportion: a systematic sample with a seeded start over the documents
by length, so that every band of lengths gives the same share. A bounded-knapsack program over the documents still available, in seeded order, then
fits the remaining tokens, from below. As long as the fit is not exact, the window grows fourfold, until it is the whole budget, which makes the fit
optimal, or both WINDOW and 16 of the longest documents. Lengths are divided by their greatest common divisor first. The counts by length are met by the documents
of that source and length with the least seeded hashes; rows that repeat each other have equal hashes, and any of them may be taken. Tokens are those of the BPE vocabulary.

Without weights, sources weigh in proportion to tokens ** ALPHA; without a budget it is the largest one that needs no
source more than once, but at least the share LEAST of the tokens of all weighted sources, so that a tiny source does not set the total. A source with
fewer tokens than its share of a budget is taken whole, and what it lacks is shared among the others by weight.

Cases: a null source is a source of its own; sources missing from given weights get none, and weights of sources without documents are left out of the shares. Null and empty texts have no
tokens and are never chosen. Repeated rows count and are chosen as separate documents. An empty table gives an empty
result. Other columns are passed by mixed() unchanged and not read by mix().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankforge.llm.shared import narrow, pick, row_key, seeded, written
from rankforge.llm.tokens import VOCABULARY, token_count

ALPHA, SEED, WINDOW, LEAST = 0.5, 29, 1 << 22, 0.5


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """How many of each length to take so that the sum is the largest reachable one of at most `budget`.

    reached[r] is set by layers: the j-th layer of a length extends only sums first reached by its (j-1)-th, so a sum
    is traced back through at most `counts` copies. Lengths come in seeded order, so that none is preferred for its size.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    first = np.full(budget + 1, -1, dtype=np.int32)
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    for i in np.random.default_rng(seed).permutation(len(lengths)):
        n, at = int(lengths[i]), np.flatnonzero(reached)
        for _ in range(int(counts[i])):
            at = at[at <= budget - n] + n
            at = at[~reached[at]]
            if not len(at):
                break
            reached[at], first[at] = True, i
        if reached[budget]:
            break
    r = int(np.flatnonzero(reached)[-1])
    while r:
        take[first[r]] += 1
        r -= int(lengths[first[r]])
    return take


def drawn(counts: np.ndarray, share: float, seed: int) -> np.ndarray:
    """A systematic sample with a seeded start over the documents in the order given, as counts: any run of n of them gives n * share, to within one."""
    ends = np.floor(np.concatenate([[0], np.cumsum(counts)]) * share + np.random.default_rng(seed).random())
    return np.minimum(np.diff(ends).astype(np.int64), counts)


def _fill(lengths: np.ndarray, counts: np.ndarray, budget: int, shared: int, seed: int) -> np.ndarray:
    take = drawn(counts, shared / int((lengths * counts).sum()), seed)
    rest = budget - int((lengths * take).sum())
    usable = (take < counts) & (lengths <= rest)
    if rest > 0 and usable.any():
        take[usable] += knapsack(lengths[usable], (counts - take)[usable], rest, seed)
    return take


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """How many documents of each ascending length to take for a budget of tokens."""
    if budget >= int((lengths * counts).sum()):
        return counts.copy()
    unit = int(np.gcd.reduce(lengths))  # sums of lengths are multiples of it
    lengths, budget = lengths // unit, budget // unit
    longest, best, most = int(lengths[-1]), None, -1
    # the sample is off its tokens by no more than the longest document, so that it stays within the budget
    window = 2 * longest
    while most < budget:
        take = _fill(lengths, counts, budget, max(0, budget - window), seed)
        if (tokens := int((lengths * take).sum())) > most:
            best, most = take, tokens
        if window >= min(budget, max(WINDOW, 16 * longest)):
            break
        window *= 4
    return best


def plan(lengths: DataFrame, weights: dict | None = None, budget: int | None = None, alpha: float = ALPHA, seed: int = SEED, least: float = LEAST) -> DataFrame:
    """(source, n_tokens, take) from lengths(source, n_tokens, n), one row for each source and length."""
    totals = lengths.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("tokens"))
    if weights is None:
        totals = totals.withColumn("weight", F.pow(F.col("tokens").cast("double"), F.lit(alpha)))
    else:
        given = lengths.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        totals = totals.join(given, totals.source.eqNullSafe(given.name), "left").drop("name").fillna(0.0, ["weight"])
    ratio = F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight"))
    whole = totals.agg(F.sum("weight").alias("all"), F.min(ratio).alias("scarcest"), F.sum(F.when(F.col("weight") > 0, F.col("tokens"))).alias("corpus"))
    most = F.lit(int(budget)).cast("double") if budget is not None else F.greatest(F.col("scarcest") * F.col("all"), least * F.col("corpus"))
    # by tokens a weight, the sources before one are short if it is; the first that can pay its share sets the level for itself and all after it
    up = Window.orderBy("ratio", "source")
    before = F.coalesce(F.sum("tokens").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    paid = totals.withColumn("ratio", ratio).where("ratio is not null").crossJoin(whole).withColumn("level", (most - before) / after)
    level = paid.where("level < ratio").agg(F.min_by("level", "ratio").alias("level"))  # null if all sources are taken whole
    share = F.when(F.col("level").isNull(), F.col("tokens")).otherwise(F.least("tokens", F.floor(F.col("level") * F.col("weight") + 1e-6)))
    totals = totals.crossJoin(level).select(F.col("source").alias("name"), F.when(F.col("weight") > 0, share).otherwise(0).cast("bigint").alias("budget"))

    def solve(group: pa.Table) -> pa.Table:
        group = group.sort_by("n_tokens")
        take = fill(group.column("n_tokens").to_numpy(), group.column("n").to_numpy(), group.column("budget")[0].as_py(), seed)
        return pa.table({"source": group.column("source"), "n_tokens": group.column("n_tokens"), "take": pa.array(take)})

    joined = lengths.join(totals, lengths.source.eqNullSafe(totals.name)).drop("name")
    return joined.groupBy("source").applyInArrow(solve, "source string, n_tokens bigint, take bigint").where("take > 0")


def _class() -> Column:
    """The source as a string that is never null, so that it can be a join key."""
    return F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))


def _first(table: DataFrame, order: str) -> DataFrame:
    """Of each class the row, in the given order, that holds its `rest`-th document; `c` counts a row's documents, `rest` becomes the number still to find."""
    upto = F.sum("c").over(Window.partitionBy("class", "n_tokens").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = table.withColumn("upto", upto).where("upto >= rest and upto - c < rest")
    return found.withColumn("rest", F.col("rest") - (F.col("upto") - F.col("c"))).drop("upto")


def bounds(slim: DataFrame, take: DataFrame) -> DataFrame:
    """(class, n_tokens, h, last): of slim(class, n_tokens, h, row) those are chosen whose (h, row) is at most (h, last), `take` of each class.

    The bound is found by digits of the hash, then among rows of equal hash by the partition that wrote them, so that no task ever ranks a whole class.
    """
    key = ["class", "n_tokens"]
    held = written(slim.groupBy(*key, "h").agg(F.count("*").alias("c")).withColumn("digit", F.shiftright("h", 48)), "hashes")
    digits = held.groupBy(*key, "digit").agg(F.sum("c").alias("c")).join(narrow(take), key)
    digit = _first(digits, "digit").select(*key, "digit", "rest")
    exact = written(_first(held.join(digit, [*key, "digit"]), "h").select(*key, "h", "c", "rest"), "bounds")
    tied = exact.where("rest < c")
    whole = exact.where("rest = c").select(*key, "h", F.lit(2**63 - 1).alias("last"))
    if tied.isEmpty():
        return whole
    rows = slim.withColumn("part", F.shiftright("row", 33)).join(narrow(tied.select(*key, "h", "rest")), [*key, "h"])
    part = _first(rows.groupBy(*key, "h", "part").agg(F.count("*").alias("c"), F.first("rest").alias("rest")), "part").select(*key, "h", "part", "rest")
    last = rows.drop("rest").withColumn("c", F.lit(1)).join(part, [*key, "h", "part"])
    return whole.union(_first(last, "row").select(*key, "h", F.col("row").alias("last")))


def _chosen(slim: DataFrame, weights: dict | None, budget: int | None, alpha: float, seed: int, least: float) -> DataFrame:
    """The chosen rows of a written table with source, class, n_tokens, h and row, all columns."""
    lengths = slim.where("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count("*").alias("n"))
    take = written(plan(lengths, weights, budget, alpha, seed, least).select(_class().alias("class"), "n_tokens", F.col("take").alias("rest")), "take")
    found = written(bounds(slim.select("class", "n_tokens", "h", "row").where("n_tokens > 0"), take).withColumnsRenamed({"h": "most"}), "chosen")
    return slim.join(narrow(found), ["class", "n_tokens"]).where("h < most or h = most and row <= last")


def _keyed(seed: int, vocabulary: str) -> list[Column]:
    """What _chosen() needs of a row with doc_id, source and text."""
    return [F.col("source"), _class().alias("class"), token_count("text", vocabulary).alias("n_tokens"), seeded(seed, "k1", "k2").alias("h"), F.monotonically_increasing_id().alias("row")]


def mix(docs: DataFrame, weights: dict | None = None, budget: int | None = None, alpha: float = ALPHA, seed: int = SEED, least: float = LEAST, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of the chosen documents."""
    rows = pick(docs, doc_id="doc_id", source=F.col("source").cast("string"), text="text").select("*", *row_key())
    slim = written(rows.select("doc_id", *_keyed(seed, vocabulary)), "lengths")
    return _chosen(slim, weights, budget, alpha, seed, least).select("doc_id", "source", "n_tokens")


def mixed(docs: DataFrame, weights: dict | None = None, budget: int | None = None, alpha: float = ALPHA, seed: int = SEED, least: float = LEAST, vocabulary: str = VOCABULARY) -> DataFrame:
    """The chosen rows of docs, all columns. Rows are stored with their numbers of tokens and met by the bounds of their class, so that no text is shuffled."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = docs.select(whole, F.col("doc_id"), F.col("source").cast("string").alias("source"), F.col("text")).select("*", *row_key())
    slim = written(rows.select("whole", *_keyed(seed, vocabulary)), "mixed")
    return _chosen(slim, weights, budget, alpha, seed, least).select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
