"""Near-duplicate join on five-word shingles: MinHash LSH forest, exact verification.

Texts with equal shingle sets are one set. Each set has a label of DEPTH MinHash values in each of TREES prefix tries. The
labels of all sets are sorted; sets whose label shares the least prefix in use with a neighbour in that order are the
branching part of the tries, all that any prefix length in use can match. Matching begins with long prefixes. The pairs
that share a prefix are verified exactly, and the verified links tell how many more a pair of their similarity leaves
unmatched at this length; while that is more than the target recall allows, prefixes are shortened by one value. At the
least prefix even a pair right at the threshold meets the target, so that shortening always ends with the target met.

Candidates are put in order of (smallest id met along shared nodes, set size, id) and cut into blocks. Two blocks are compared if
members of them share a trie node and their sizes allow the threshold; a task hands on counts, a spanning forest of what
it verified and the expected misses, never the pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NEAR, SHINGLE_WORDS, discard, materialise, partitions, slices
from .components import components

TREES = 48
#: Values of a label, and the prefix length that matching begins with.
DEPTH = 12
FIRST_DEPTH = 8
#: MinHash functions; each tree's label takes DEPTH of them.
FUNCTIONS = 192
#: Share of the links that must be expected to have met in some tree.
TARGET_RECALL = 0.9999
#: Sets of a block, and shingles that end one early.
BLOCK = 128
BLOCK_SHINGLES = 500_000
#: Times that the smallest id met in a trie is handed on along the nodes, so that sets of one group stand together.
SPREAD = 3
#: Bytes that a task's memory of word hashes may take.
HASH_BYTES = 24 << 20
#: Rows up to which a counted side is broadcast.
BROADCAST_ROWS = 500_000

TOKEN = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def missed(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray | float:
    """Chance that two sets of that similarity share no prefix of that length in any tree."""
    return (1 - np.asarray(similarity, float) ** depth) ** trees


def least_depth(threshold: float, trees: int = TREES) -> int:
    """The longest prefix, up to FIRST_DEPTH, at which a pair of that similarity goes unmatched as seldom as the target
    recall allows. Raises ValueError for thresholds at which no prefix does (below about 0.17)."""
    for depth in range(FIRST_DEPTH, 0, -1):
        if missed(threshold, depth, trees) <= 1 - TARGET_RECALL:
            return depth
    raise ValueError(f"a similarity of {threshold} is too low for {trees} trees")


class _Hashes(dict):
    """Hashes of words met; emptied when the words held, with about 150 bytes each beside their letters, fill HASH_BYTES."""

    held = 0

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        self.held += 150 + 4 * len(word)
        if self.held > HASH_BYTES:
            self.clear()
            self.held = 150 + 4 * len(word)
        self[word] = h
        return h


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; a shorter text with words is one shingle."""
    words = TOKEN.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    k = min(SHINGLE_WORDS, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = (out + h[i : len(h) - k + 1 + i]) * _MIX
        out ^= out >> np.uint64(32)
    return np.unique(_finish(out + np.uint64(k)))


class Forest:
    """The MinHash functions and the trees' choices among them."""

    def __init__(self) -> None:
        rng = np.random.default_rng(20240501)
        self.a = (rng.integers(0, 2**31, FUNCTIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, FUNCTIONS, dtype=np.uint32)[:, None]
        self.pick = np.stack([rng.permutation(FUNCTIONS)[:DEPTH] for _ in range(TREES)])

    def labels(self, s: np.ndarray) -> list[bytes]:
        """The set's label in each tree: the tree's number, then one byte of each MinHash value."""
        x = (s ^ (s >> np.uint64(32))).astype(np.uint32)[None, :]
        low = np.full(FUNCTIONS, 0xFFFFFFFF, np.uint32)
        for i in range(0, x.shape[1], 2048):
            low = np.minimum(low, (self.a * x[:, i : i + 2048] + self.b).min(axis=1))
        byte = ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
        label = np.concatenate([np.arange(TREES, dtype=np.uint8)[:, None], byte[self.pick]], 1).tobytes()
        return [label[i : i + DEPTH + 1] for i in range(0, len(label), DEPTH + 1)]


def _branching(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's sorted (label, id): rows whose label shares its first ``least`` bytes with a neighbour, and the first and
    last prefix of the task, whose neighbours may lie in another."""
    before, held, first = None, None, None  # prefix and last row of the run so far; the task's first prefix
    for batch in batches:
        label, ids = batch.column("label").to_pylist(), batch.column("id").to_pylist()
        out: list[tuple[bytes, int]] = []
        for x, i in zip(label, ids, strict=True):
            prefix = x[:least]
            if first is None:
                first = prefix
            if prefix == before:
                if held is not None:
                    out.append(held)
                    held = None
                out.append((x, i))
            elif prefix == first:
                out.append((x, i))
                before = prefix
            else:
                before, held = prefix, (x, i)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64())], ["label", "id"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.binary()), pa.array([held[1]], pa.int64())], ["label", "id"])


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sorted sets with the weight of those before them in the task; BLOCK sets or BLOCK_SHINGLES fill a block."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        ends = before + np.cumsum(batch.column("size").to_numpy() + BLOCK_SHINGLES // BLOCK)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("size"), pa.array(np.full(len(ends), part, np.int64)), pa.array(ends)], ["id", "size", "part", "end"])
        before = int(ends[-1]) if len(ends) else before


def _compare(pdf: pd.DataFrame, threshold: float, depth: int) -> pd.DataFrame:
    """Verified links of one task: for each set the number of documents behind its partners, forest edges, and how many
    links of its kind go unmatched for those matched."""
    ids, many, block = pdf["id"].to_numpy(), pdf["many"].to_numpy(), pdf["block"].to_numpy()
    own, n = bool(pdf["i"].iat[0] == pdf["j"].iat[0]), len(pdf)
    size = np.array([len(s) for s in pdf["s"]])
    if n < 2:
        return pd.DataFrame({"id": ids[:0], "links": many[:0], "to": ids[:0], "found": many[:0], "unmet": np.zeros(0)})
    _, place = np.unique(np.concatenate(pdf["s"].to_list()), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    shared = np.flatnonzero(np.bincount(place) > 1)  # shingles of one set only can't be common
    at = np.full(place.max() + 1, -1)
    at[shared] = np.arange(len(shared))
    column, keep = at[place], at[place] >= 0
    row, column = row[keep], column[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)
    for begin in range(0, len(shared), 8192):
        a, b = np.searchsorted(column, [begin, begin + 8192])
        part = np.zeros((n, min(8192, len(shared) - begin)), np.float32)
        part[row[a:b], column[a:b] - begin] = 1
        both += part @ part.T
    common = both.astype(np.int64)
    # Exact in integers: common / union >= threshold, which has two decimals.
    near = common * 100 >= round(threshold * 100) * (size[:, None] + size[None, :] - common)
    near &= ~np.eye(n, dtype=bool) if own else block[:, None] != block[None, :]
    a, b = np.nonzero(near)
    chance = missed(common[a, b] / np.maximum(1, size[a] + size[b] - common[a, b]), depth)
    unmet = np.bincount(a, chance / (1 - np.minimum(chance, 1 - 1e-9)), n)
    first = np.where(near.any(1), near.argmax(1), -1)
    least = np.array([min(ids[i], ids[near[i]].min()) if first[i] >= 0 else ids[i] for i in range(n)])
    # A forest of the task's links: union by repeatedly taking the smallest id of the neighbourhood.
    while True:
        lower = np.array([least[near[i]].min() if first[i] >= 0 else least[i] for i in range(n)])
        lower = np.minimum(lower, least)
        if (lower == least).all():
            break
        least = lower
    found = first >= 0
    return pd.DataFrame({"id": ids[found], "links": (near @ many)[found], "to": least[found], "found": near.sum(1)[found], "unmet": unmet[found]})


def _comparing(threshold: float, depth: int):
    return lambda pdf: _compare(pdf, threshold, depth)


def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = NEAR) -> DataFrame:
    """Each document's (``id_col``, class_id, n_links): the smallest id linked to it by a chain of links, and how many
    other documents have a Jaccard similarity of at least ``threshold`` (two decimals) with it, its copies included.

    Words are runs of letters and digits, lower-cased. A text of one to four words is one shingle. Null, empty and wordless
    texts link to nothing: their class is their own id. Null ids give a row of null class and no links. A row that repeats
    an id and shingle set counts once. An empty table gives no rows. Other columns are ignored. A threshold that
    the tries can't serve at the target recall raises ValueError (``least_depth``).
    """
    spark = df.sparkSession
    forest, floor = Forest(), least_depth(threshold)
    tasks = partitions(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in slices(batches):
            keys, labels, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, hashes)
                keys.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                labels.append(forest.labels(s) if len(s) else [])
                sizes.append(len(s))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(labels, pa.list_(pa.binary()))], ["id", "set", "size", "labels"])

    told = materialise(rows.mapInArrow(labelled, "id long, set binary, size long, labels array<binary>"), "labels")
    doc = told.select("id", "set").distinct()
    sets = doc.where(F.col("id").isNotNull() & F.col("set").isNotNull()).groupBy("set").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("many"))
    sets = materialise(sets, "sets")

    # The tries' branching part: labels of the sets' smallest documents, in order.
    own = told.join(sets.select("set", "rep"), "set").where(F.col("id") == F.col("rep")).dropDuplicates(["id"])
    label = own.select("id", F.explode("labels").alias("label"))
    tries = label.repartitionByRange(tasks, "label", "id").sortWithinPartitions("label").mapInArrow(partial(_branching, floor + 1), "label binary, id long")
    tries = materialise(tries, "tries")
    member = sets.select(F.col("rep").alias("id"), "many", "set")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in slices(batches):
            got = [shingles(t, hashes) for t in batch.column("text").to_pylist()]
            keys = pa.array([xxhash.xxh128_digest(s.tobytes()) for s in got], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), keys, pa.array([s.view(np.int64) for s in got], pa.list_(pa.int64()))], ["id", "set", "s"])

    for depth in range(FIRST_DEPTH, floor - 1, -1):
        # Nodes at this prefix length that hold several sets, and the order and blocks of those sets.
        node = tries.select("id", F.substring("label", 1, depth + 1).alias("node")).distinct()
        shared = node.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        node = materialise(node.join(shared, "node").select("node", "id", "least"), "shared")
        near = node.select("id", F.col("least").alias("near"))
        for _ in range(SPREAD):
            least = node.select("id", "node").join(near.groupBy("id").agg(F.min("near").alias("near")), "id").groupBy("node").agg(F.min("near").alias("near"))
            near = node.select("id", "node").join(least, "node").select("id", "near")
        few = materialise(near.groupBy("id").agg(F.min("near").alias("near")), "order")
        small = few.count() <= BROADCAST_ROWS
        size = own.select("id", "size").join(F.broadcast(few) if small else few, "id").repartitionByRange(tasks, "near", "size", "id").sortWithinPartitions("near", "size", "id")
        block = materialise(size.select("id", "size").mapInArrow(_weighed, "id long, size long, part long, end long"), "weights")
        ends = {r["part"]: r["end"] for r in block.groupBy("part").agg(F.max("end").alias("end")).collect()}  # a row a task
        starts = [(part, sum(ends[p] for p in ends if p < part)) for part in ends]
        weights = block
        block = block.join(F.broadcast(spark.createDataFrame(starts, "part long, start long")), "part").select("id", "size", F.floor((F.col("start") + F.col("end") - 1) / BLOCK_SHINGLES).alias("block"))
        block = materialise(block, "blocks")

        # Pairs of blocks that share a node and whose sizes allow the threshold.
        span = block.groupBy("block").agg(F.struct("block", F.min("size").alias("low"), F.max("size").alias("high")).alias("span"))
        meet = node.select("node", "id").join(F.broadcast(block) if small else block, "id").select("node", "block").distinct().join(span, "block")
        lists = meet.groupBy("node").agg(F.array_sort(F.collect_set("span")).alias("spans")).select("spans").distinct()
        first = lists.select("spans", F.explode("spans").alias("x"))
        fits = F.filter("spans", lambda y: (y["block"] >= F.col("x.block")) & (y["high"] * 100 >= F.col("x.low") * round(threshold * 100)) & (F.col("x.high") * 100 >= y["low"] * round(threshold * 100)))
        pair = first.select(F.col("x.block").alias("i"), F.explode(F.transform(fits, lambda y: y["block"])).alias("j")).distinct()
        pair = materialise(pair, "pairs")

        ids = block.select("id")
        text = rows.join(F.broadcast(ids) if small else ids, "id", "left_semi").mapInArrow(cut, "id long, set binary, s array<long>")
        text = text.join(member, ["id", "set"]).dropDuplicates(["id", "set"]).join(block.select("id", "block"), "id")
        task = pair.select("i", "j", F.col("i").alias("block")).unionByName(pair.where(F.col("i") != F.col("j")).select("i", "j", F.col("j").alias("block")))
        dealt = text.join(task, "block").select("i", "j", "id", "many", "block", "s")
        compared = dealt.groupBy("i", "j").applyInPandas(_comparing(threshold, depth), "id long, links long, to long, found long, unmet double")
        compared = materialise(compared, "links")
        discard(node, few, weights, block, pair)
        sums = compared.agg(F.sum("found").alias("found"), F.sum("unmet").alias("unmet")).first()
        if not sums["found"] or sums["unmet"] <= (1 - TARGET_RECALL) * sums["found"]:
            break

    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(compared.select(F.col("id").alias("a"), F.col("to").alias("b")))

    whole = sets.join(links, sets["rep"] == links["id"], "left").drop("id").join(classes, F.col("rep") == classes["id"], "left")
    whole = whole.select("set", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    whole = materialise(whole, "classes")
    discard(tries, sets, compared)
    out = doc.join(whole, "set", "left")
    mine = F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id"))
    return out.select(F.col("id").alias(id_col), mine.alias("class_id"), F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).alias("n_links"))
