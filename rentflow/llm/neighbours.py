"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree halves its rows level by level along random directions: a node splits at the median of its sample rows, and a
level of a tree shares its direction, so that a row is placed in all trees by one matrix product. Trees are as deep as the
table asks for (about LEAF_ROWS rows a leaf); below the levels that the bounded sample can tell apart, nodes split at the
median of their level. A query walks all trees at once through one priority queue, ordered by the squared margins summed
along the path, until it has seen enough leaves; their rows are candidates and are ranked by exact distance. Each vector
is shuffled once, into a block; the queries and their leaves pass by the blocks.
Equal vectors are one entry with their smallest ids, so a vector that thousands of rows share is one candidate.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions

#: Trees, rows that the split points are taken from at most, and rows of a leaf, about.
TREES = 48
SAMPLE_ROWS = 20_000
LEAF_ROWS = 24
#: A query's leaves hold about EFFORT * n ** POWER rows over all trees, with n rows in all; one rule for every size.
EFFORT = 110.0
POWER = 0.45
#: Entries of a block, the unit in which vectors are measured.
BLOCK_ROWS = 8192


class Forest:
    """Directions (dimensions x trees x levels) and split points; a node is the path of its bits from the root."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 7) -> None:
        n, d = sample.shape
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, max(0, round(math.log2(max(1, rows) / leaf_rows)))
        told = min(self.depth, max(0, int(math.log2(max(1, n) / 8))))  # levels with a split point for each node
        turns = [np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(-(-trees * self.depth // d))]
        self.way = np.concatenate([np.zeros((d, 0)), *turns], 1)[:, : trees * self.depth]
        self.cut: list[list[np.ndarray]] = []
        for t in range(trees):
            along = sample @ self.way[:, t * self.depth : (t + 1) * self.depth]
            node, cuts = np.zeros(n, np.int64), []
            for level in range(self.depth):
                x = along[:, level]
                middle = float(np.median(x)) if n else 0.0
                cut = np.full(1 << level if level < told else 1, middle)
                if level < told:
                    order = np.lexsort((x, node))
                    begin, end = (np.searchsorted(node[order], np.arange(1 << level), side) for side in ("left", "right"))
                    has = end > begin
                    cut[has] = x[order][((begin + end) // 2)[has]]
                    node = node * 2 + (x >= cut[node])
                cuts.append(cut)
            self.cut.append(cuts)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, as a number over all trees."""
        along = x @ self.way
        out = np.empty((len(x), self.trees), np.int64)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                cut = self.cut[t][level]
                node = node * 2 + (along[:, t * self.depth + level] >= (cut[node] if len(cut) > 1 else cut[0]))
            out[:, t] = node * self.trees + t
        return out

    def visit(self, q: np.ndarray, many: int) -> list[int]:
        """The first ``many`` leaves in the order of the shared queue."""
        along = (q @ self.way).tolist()
        depth, trees, cuts = self.depth, self.trees, self.cut
        heap, found = [(0.0, t, 0, 0) for t in range(trees)], []
        while heap and len(found) < many:
            bound, t, level, node = heapq.heappop(heap)
            while level < depth:
                cut = cuts[t][level]
                margin = along[t * depth + level] - float(cut[node] if len(cut) > 1 else cut[0])
                near = margin >= 0
                level += 1
                heapq.heappush(heap, (bound + margin * margin, t, level, node * 2 + (not near)))
                node = node * 2 + near
            found.append(node * trees + t)
        return found


def effort(rows: int, depth: int) -> int:
    """Leaves that a query visits, over all trees."""
    return max(1, math.ceil(EFFORT * rows**POWER / (rows / 2**depth))) if rows else 0


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _ranked(forest, k: int):
    """Candidates of each query in a block, measured: (query_id, id, score) of the k best of the block.

    Rows come sorted by block; a block's entries (kind 0) precede its queries (kind 1, with the leaves that they visit),
    which pass by batch by batch. Only entries in a visited leaf are measured."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, table = None, [], None
        for batch in batches:
            mark = np.stack([batch.column("block").to_numpy(), batch.column("kind").to_numpy()], 1)
            cut = np.flatnonzero(np.concatenate([[True], (mark[1:] != mark[:-1]).any(1)])) if len(mark) else []
            found: list[tuple[int, int, float]] = []
            for a, b in zip(cut, [*cut[1:], len(mark)], strict=True):
                rows = batch.slice(a, b - a)
                if mark[a, 0] != block:
                    block, parts, table = mark[a, 0], [], None
                if mark[a, 1] == 0:
                    parts.append((_vectors(rows.column("v")), rows.column("numbers").to_pylist()))
                    continue
                if not parts:
                    continue
                if table is None:
                    x = np.concatenate([p[0] for p in parts])
                    leaves = forest.value.leaves(x)
                    order = np.argsort(leaves, axis=None, kind="stable")
                    table = leaves.ravel()[order], order // leaves.shape[1], x, [i for p in parts for i in p[1]]
                leaf, row, x, ids = table
                for query, q, wanted in zip(rows.column("query").to_pylist(), _vectors(rows.column("v")), rows.column("numbers"), strict=True):
                    wanted = wanted.values.to_numpy()
                    begin, end = np.searchsorted(leaf, wanted), np.searchsorted(leaf, wanted, "right")
                    many = end - begin
                    ends = np.cumsum(many)
                    if not len(ends) or not ends[-1]:
                        continue
                    at = np.unique(row[np.repeat(begin - (ends - many), many) + np.arange(ends[-1])])
                    d = np.sqrt(((x[at] - q) ** 2).sum(1))
                    n = min(k + 1, len(d)) - 1
                    near = np.flatnonzero(d <= np.partition(d, n)[n])
                    got = sorted((float(d[i]), j) for i in near for j in ids[at[i]] if j != query)[:k]
                    found += [(query, j, s) for s, j in got]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], ["query_id", "id", "score"])

    return run


def search(df: DataFrame, id_col: str, vector_col: str, queries: DataFrame, k: int, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The ``k`` nearest rows of ``df`` found for each row of ``queries`` (same columns): (query_id, rank, ``id_col``, score).

    Score is the Euclidean distance in double precision; ties go to the smaller id, and a row is not its own neighbour.
    Split points come from at most ``sample_rows`` rows (smallest vector hashes); all rows are indexed. Rows whose id or
    vector is null, and vectors that are empty, zero, of another length than most (no distance is defined), or that hold
    null or non-finite components take no part. Rows that repeat an id and its vector count once; an id with several
    vectors is a candidate with each. Empty tables give no rows. Other columns, whatever their names, are not read.
    """
    spark = df.sparkSession

    def good(rows: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return rows.where((F.size("v") > 0) & F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))

    rows = good(df)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    rows = rows.where(F.size("v") == sizes[0]["n"])
    # Entries: distinct vectors (0.0 and -0.0 alike) with their k + 1 smallest ids, which is all a query can need of them.
    entries = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    firsts = entries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))).groupBy("v", "part").agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"))
    entries = firsts.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    entries = materialise(entries.select("v", "ids", F.col("ids")[0].alias("key")), "entries")
    n = entries.count()
    sample = entries.orderBy(F.xxhash64("v"), "key").limit(sample_rows).select("v").toArrow()
    forest = spark.sparkContext.broadcast(Forest(_vectors(sample["v"]), n))  # bounded by the sample
    many = effort(n, forest.value.depth)
    blocks = max(1, -(-n // BLOCK_ROWS))
    tasks = partitions(spark)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = [np.sort(forest.value.visit(q, many)) for q in _vectors(batch.column("v"))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(leaves, pa.list_(pa.int64()))], ["query", "v", "numbers"])

    asking = good(queries).where(F.size("v") == sizes[0]["n"]).dropDuplicates(["id", "v"])
    visits = materialise(asking.repartition(tasks, "id").mapInArrow(asked, "query long, v array<double>, numbers array<long>"), "visits")
    # The queries are a stated set; each block of entries sees them one after another, and measures what their leaves hold.
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    rows = entries.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query"), "v", F.col("ids").alias("numbers"))
    both = rows.unionByName(visits.select("block", F.lit(1).alias("kind"), "query", "v", "numbers"))
    near = both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_ranked(forest, k), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
