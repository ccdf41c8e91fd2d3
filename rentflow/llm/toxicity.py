"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Every word of the examples is a term. A term's weight is (1 + ln tf) x IDF, with IDF over all documents, times a gain of 1
or more that grows with how clearly the labelled classes differ in it; no term is left out. A word that no example has can't
meet one, but counts in its text's norm, as a word of a single text. Examples are indexed by term;
postings are cut into blocks of like examples with their largest weight. A search ranks the blocks by the upper bound that
these weights give, looks into the best ones first and then into those whose bound can still improve the list, so that
the neighbours are exact. Their votes count by squared cosine against a prior; an isotonic fit on leave-one-out votes of
the examples turns them into probabilities. The neighbours themselves are the evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDS, materialise, slices

#: Labelled rows of a class that the examples are taken from, at most.
CLASS_ROWS = 1200
NEIGHBOURS = 15
BLOCK = 128
#: Blocks that a search looks into before it knows a list to improve.
FIRST_BLOCKS = 2
#: Largest gain of a term. Half of it is reached at a log-likelihood ratio (two classes, example groups) of SURE.
GAIN = 60.0
SURE = 24.0
#: Weight of the prior against votes of weight cosine squared.
PRIOR_WEIGHT = 0.05
#: Hash functions that group near copies of an example.
SKETCH = 4

TOKEN = re.compile(r"[^\W_]+")


def terms(text: str | None) -> Counter:
    """Lower-cased words with their counts."""
    return Counter(TOKEN.findall(text.lower())) if text else Counter()


def sketch(text: str | None) -> list[int]:
    """MinHash values of the five-word shingles; near copies agree in most of them."""
    w = TOKEN.findall(text.lower()) if text else []
    said = [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [""]
    h = np.array([xxhash.xxh64_intdigest(s) for s in said], np.uint64)
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)[:SKETCH]
    with np.errstate(over="ignore"):
        return (h[None, :] * odd[:, None]).min(axis=1).view(np.int64).tolist()


class Index:
    """Block-max inverted index of unit vectors: postings by term, cut at the blocks, with each block's largest weight.

    A weight is (1 + ln count) x factor of the term / norm of the example; postings hold the count alone, in few bytes, as
    the index travels to every task."""

    def __init__(self, factor: np.ndarray, ids: np.ndarray, labels: np.ndarray, ends: np.ndarray, term: np.ndarray, count: np.ndarray, rare: float = 0.0) -> None:
        """Examples as flat arrays: example i has the terms and counts from ends[i] to ends[i + 1]; those without are left out.
        ``rare`` is the factor of a word that no example has."""
        self.factor, self.rare, many = factor, rare, np.diff(ends)
        row = np.repeat(np.arange(len(ids)), many)
        weight = (1 + np.log(count)) * factor[term]
        norm = np.sqrt(np.bincount(row, weight * weight, len(ids)))
        # Examples whose heaviest term is the same become neighbours, which makes the blocks' largest weights tight.
        lead = np.full(len(ids), -1)
        heavy = np.lexsort((-term, weight))
        lead[row[heavy]] = term[heavy]
        order = np.lexsort((ids, lead))
        order = order[many[order] > 0]
        self.ids, self.labels, self.norm = ids[order], labels[order].astype(np.int64), norm[order]
        self.blocks = max(1, -(-len(order) // BLOCK))
        at = np.full(len(ids), -1)
        at[order] = np.arange(len(order))
        place = at[row]
        order = np.lexsort((place, term))
        key = term[order] * self.blocks + place[order] // BLOCK
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.place = place[order].astype(np.min_scalar_type(max(1, len(self.ids))))
        self.count = count[order].astype(np.min_scalar_type(int(count.max(initial=1))))
        # One entry for each block of a term's list: its block, its postings' begin, its largest weight (rounded up).
        self.block = (key[begin] % self.blocks).astype(np.min_scalar_type(self.blocks))
        self.begin = np.append(begin, len(key)).astype(np.int32)
        most = np.maximum.reduceat((weight / norm[row])[order], begin) if len(key) else np.zeros(0)
        self.most = np.nextafter(most.astype(np.float32), np.float32(2))
        self.lists = np.searchsorted(key[begin] // self.blocks, np.arange(len(factor) + 1)).astype(np.int32)

    def vector(self, term: np.ndarray, count: np.ndarray, strange: float = 0.0) -> np.ndarray:
        """A text's weights over the norm of all its words; ``strange`` is the sum of (1 + ln count) ** 2 of those no example has."""
        w = (1 + np.log(count.astype(np.float64))) * self.factor[term]
        return w / (math.sqrt(float(w @ w) + strange * self.rare * self.rare) or 1.0)

    def _entries(self, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block entries of these terms, each with the query's weight of the term."""
        start = self.lists[term]
        many = self.lists[term + 1] - start
        ends = np.cumsum(many)
        return np.repeat(start - (ends - many), many) + np.arange(ends[-1]), np.repeat(weight, many)

    def _cosines(self, entry: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of all examples behind these block entries."""
        if not len(entry):
            return np.zeros(0, np.int64), np.zeros(0)
        start = self.begin[entry]
        many = self.begin[entry + 1] - start
        ends = np.cumsum(many)
        at = np.repeat(start - (ends - many), many) + np.arange(ends[-1])
        cosine = (np.bincount(self.place[at], np.repeat(weight, many) * (1 + np.log(self.count[at].astype(np.float64))), len(self.ids)) / self.norm).round(12)
        hit = np.flatnonzero(cosine > 0)
        return hit, cosine[hit]

    def _best(self, place: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(place) > k:
            near = cosine >= np.partition(cosine, len(place) - k)[len(place) - k]
            place, cosine = place[near], cosine[near]
        order = np.lexsort((self.ids[place], -cosine))[:k]
        return place[order], cosine[order]

    def examples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ends, terms, counts): the postings turned back into the examples' vectors."""
        term = np.repeat(np.arange(len(self.factor)), np.diff(self.begin[self.lists]))
        order = np.lexsort((term, self.place))
        return np.searchsorted(self.place[order], np.arange(len(self.ids) + 1)), term[order], self.count[order]

    def search(self, term: np.ndarray, count: np.ndarray, k: int, leave: int | None = None, strange: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples, ties to the smaller id; ``leave`` is a place to pass over."""
        if not len(term) or not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0)
        unit = self.vector(term, count, strange)
        entry, weight = self._entries(term, unit)
        block = self.block[entry]
        bound = np.bincount(block, weight * self.most[entry], self.blocks) * (1 + 1e-9)
        weight = self._entries(term, unit * self.factor[term])[1]
        rank = np.empty(self.blocks, np.int64)
        rank[np.argsort(-bound, kind="stable")] = np.arange(self.blocks)
        rank = rank[block]
        best = self._cosines(entry[rank < FIRST_BLOCKS], weight[rank < FIRST_BLOCKS])
        for begin, end in ((FIRST_BLOCKS, 3 * FIRST_BLOCKS), (3 * FIRST_BLOCKS, self.blocks)):
            if leave is not None:
                best = tuple(a[best[0] != leave] for a in best)
            best = self._best(*best, k)
            least = best[1][-1] if len(best[1]) == k else 0.0
            rest = (rank >= begin) & (rank < end) & (bound[block] >= least)
            more = self._cosines(entry[rest], weight[rest])
            best = np.concatenate([best[0], more[0]]), np.concatenate([best[1], more[1]])
        if leave is not None:
            best = tuple(a[best[0] != leave] for a in best)
        return self._best(*best, k)


class Model:
    """Index, class weights and shares; all bounded by the sample of examples."""

    def __init__(self, factor: np.ndarray, ids: np.ndarray, labels: np.ndarray, ends: np.ndarray, term: np.ndarray, count: np.ndarray, class_weight: tuple[float, float], rare: float = 0.0) -> None:
        self.class_weight = np.array(class_weight)
        self.index = Index(factor, ids, labels, ends, term, count, rare)
        full = np.diff(ends) > 0
        mass = [self.class_weight[c] * (labels == c).sum() for c in (0, 1)]
        self.prior = float((mass[1] + 0.5) / (sum(mass) + 1)) if len(labels) else 0.0
        mass = [self.class_weight[c] * ((labels == c) & ~full).sum() for c in (0, 1)]
        self.plain = float((mass[1] + self.prior) / (sum(mass) + 1))  # of texts that share no term with an example

    def vote(self, place: np.ndarray, cosine: np.ndarray) -> float:
        labels = self.index.labels[place]
        weight = cosine * cosine * self.class_weight[labels]
        return float((weight @ labels + PRIOR_WEIGHT * self.prior) / (weight.sum() + PRIOR_WEIGHT))

    def score(self, term: np.ndarray, count: np.ndarray, strange: float, knots: np.ndarray, levels: np.ndarray) -> tuple[float, list[tuple[int, float]]]:
        """Probability, and the evidence: the nearest examples' (id, cosine). Knots and levels are the calibration."""
        place, cosine = self.index.search(term, count, NEIGHBOURS, strange=strange)
        if not len(place):
            return self.plain, []
        p = float(np.interp(self.vote(place, cosine), knots, levels))
        return p, [(int(self.index.ids[i]), float(c)) for i, c in zip(place[:3], cosine[:3], strict=True)]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: means of y that don't fall with x, shrunk by half a count, at the mean x of each pool."""
    pools: list[list[float]] = []  # sums of y, weight, x
    for a, b, w in sorted(zip(x.tolist(), y.tolist(), weight.tolist(), strict=True)):
        pools.append([b * w, w, a * w])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, t = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + t]
    return np.array([t / n for _, n, t in pools]), np.array([(s + 0.5) / (n + 1) for s, n, _ in pools])


def gains(clean: np.ndarray, toxic: np.ndarray, n0: float, n1: float) -> np.ndarray:
    """1 to 1 + GAIN by the log-likelihood ratio of a term's rates in the two classes, if one is at least twice the other."""
    df, n = clean + toxic, n0 + n1
    g2 = np.zeros(len(df))
    with np.errstate(divide="ignore", invalid="ignore"):
        for seen, of in ((toxic, n1), (clean, n0)):
            g2 += np.where(seen > 0, seen * np.log(seen * n / (df * of)), 0.0)
            g2 += np.where(seen < of, (of - seen) * np.log((of - seen) * n / (np.maximum(n - df, 1e-9) * of)), 0.0)
    lift = (toxic + 0.5) / (n1 + 0.5) / ((clean + 0.5) / (n0 + 0.5))
    level = (np.maximum(2 * g2, 0.0) / SURE) ** 6
    return 1 + GAIN * np.where(np.maximum(lift, 1 / lift) >= 2, level / (1 + level), 0.0)


def fit(docs: DataFrame, labels: DataFrame, label_col: str, class_rows: int) -> tuple[Broadcast, tuple[np.ndarray, np.ndarray], DataFrame]:
    """The model from at most ``class_rows`` labelled rows (id, text) of a class, sent to the tasks, its calibration, and
    every row's features (id, terms, counts). IDF counts all ``docs``."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["id"]
    # An id labelled twice is toxic if one of its labels says so; equal texts are one example.
    marks = materialise(labels.groupBy("id").agg(F.when(F.max(label_col) > 0, 1).otherwise(0).alias("label")), "labels")
    of = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    draw = F.xxhash64(F.lit("toxicity"), "id")
    taken = [marks.where(F.col("label") == c).orderBy(draw, "id").limit(class_rows) for c in (0, 1)]
    taken = materialise(taken[0].unionByName(taken[1]), "marks")  # 2 x class_rows rows at most
    some = docs.join(F.broadcast(taken), "id").groupBy(F.xxhash64("text").alias("h"), "text").agg(F.min("id").alias("id"), F.max("label").alias("label"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            found = [terms(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([sketch(t) for t in texts], pa.list_(pa.int64())), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["id", "label", "sketch", "words", "counts"])

    shape = f"id {kind}, label int, sketch array<long>, words array<string>, counts array<int>"
    rows = some.select("id", "label", "text").mapInArrow(counted, shape).toArrow().sort_by("id").combine_chunks()  # bounded by the sample
    class_weight = tuple(of.get(c, 0) / max(1, min(class_rows, of.get(c, 0))) for c in (0, 1))
    ids, label, n = rows["id"].to_numpy(), rows["label"].to_numpy(), len(rows)
    words = pa.concat_arrays([c.flatten() for c in rows["words"].chunks] or [pa.array([], pa.string())]).dictionary_encode()
    vocabulary, term = words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)
    count = np.concatenate([np.zeros(0), *(c.flatten().to_numpy() for c in rows["counts"].chunks)]).astype(np.int64)
    ends = np.cumsum([0, *pc.list_value_length(rows["words"]).to_pylist()])

    # Groups of near copies count as about one example, so that they don't multiply a term's evidence.
    said = np.array(rows["sketch"].to_pylist(), np.int64).reshape(n, SKETCH)
    share = np.zeros(n)
    for i in range(SKETCH):
        _, group = np.unique(np.stack([label.astype(np.int64), said[:, i]], 1), axis=0, return_inverse=True)
        share += 1 / np.bincount(group.ravel(), minlength=1)[group.ravel()] / SKETCH
    each = np.repeat(share, np.diff(ends))
    toxic = np.repeat(label, np.diff(ends)) == 1
    seen = [np.bincount(term[mine], each[mine], len(vocabulary)) for mine in (~toxic, toxic)]
    gain = gains(*seen, *(max(float(share[label == c].sum()), 1e-9) for c in (0, 1)))

    told = spark.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = told.value
        for batch in slices(batches):
            flat_t, flat_n, sizes, strange = [], [], [0], []
            for text in batch.column("text").to_pylist():
                found = terms(text)
                known = place.keys() & found.keys()
                flat_t += [place[w] for w in known]
                flat_n += [found[w] for w in known]
                sizes.append(len(flat_t))
                strange.append(math.fsum((1 + math.log(c)) ** 2 for w, c in found.items() if w not in place))
            at = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(at, pa.array(flat_t, pa.int32())), pa.ListArray.from_arrays(at, pa.array(flat_n, pa.int32())), pa.array(strange, pa.float64())], ["id", "terms", "counts", "strange"])

    features = materialise(docs.mapInArrow(featured, f"id {kind}, terms array<int>, counts array<int>, strange double"), "features")
    size = len(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a term of this task, and one with the number of its texts under the term after the last."""
        df = np.zeros(size + 1, np.int64)
        for batch in batches:
            df[:size] += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
            df[size] += batch.num_rows
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(df[has])], ["term", "df"])

    df = np.zeros(size + 1, np.int64)
    counts = features.select("terms").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row a term
    df[counts["term"].to_numpy()] = counts["df"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    # A word that no example has weighs as one of a single text, without gain.
    model = Model(idf * gain, ids, label, ends, term, count, class_weight, float(np.log((1 + df[-1]) / 2) + 1))

    shared = spark.sparkContext.broadcast(model)  # bounded by the sample
    told.destroy()

    # Leave-one-out votes of the examples, for the calibration.
    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        ends, term, count = m.index.examples()
        for batch in batches:
            places = batch.column("id").to_pylist()
            near = [m.index.search(term[ends[i] : ends[i + 1]], count[ends[i] : ends[i + 1]], NEIGHBOURS, leave=i) for i in places]
            yield pa.RecordBatch.from_arrays([pa.array(m.index.labels[places]), pa.array([m.vote(*x) for x in near], pa.float64())], ["label", "vote"])

    votes = spark.range(len(model.index.ids)).mapInArrow(left_out, "label long, vote double").toArrow()  # bounded by the sample
    known = votes["label"].to_numpy()
    return shared, isotonic(votes["vote"].to_numpy(), known, model.class_weight[known]), features


def score(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_col: str, class_rows: int = CLASS_ROWS) -> DataFrame:
    """Every row's (``id_col``, held_out, score, predicted, evidence).

    Labels are read from rows of folds 1 to 4 only, at most ``class_rows`` of each class (those of the smallest id hashes,
    weighted up to the class), equal texts once; an id labelled twice is toxic if one of its labels says so. ``evidence``
    has the ids and cosines of the three nearest examples. Null, empty and wordless texts, and texts that share no word
    with an example, have no evidence and score as the examples without a word do, shrunk to the toxic share; with no
    labels at all every score is 0. A null id is not held out. Repeated rows score alike; an empty table gives no rows.
    Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % FOLDS != 0))
    model, line, features = fit(rows, marks.select(F.col(id_col).alias("id"), label_col), label_col, class_rows)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[float, list]] = {}  # answers of texts met before in this task
        for batch in slices(batches):
            got = []
            ends = batch.column("terms").offsets.to_numpy()
            term, count = batch.column("terms").values.to_numpy(), batch.column("counts").values.to_numpy()
            for a, b, strange in zip(ends, ends[1:], batch.column("strange").to_pylist(), strict=False):
                order = np.argsort(term[a:b])
                t, n = term[a:b][order], count[a:b][order]
                key = xxhash.xxh3_128_intdigest(t.tobytes() + n.tobytes() + str(strange).encode())
                if key not in seen:
                    if len(seen) > 5_000:
                        seen.clear()
                    seen[key] = model.value.score(t, n, strange, *line)
                got.append(seen[key])
            evidence = pa.array([[{"id": i, "cosine": c} for i, c in near] for _, near in got], pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([p for p, _ in got], pa.float64()), evidence], ["id", "score", "evidence"])

    out = features.mapInArrow(scored, f"id {kind}, score double, evidence array<struct<id: long, cosine: double>>")
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % FOLDS == 0, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
