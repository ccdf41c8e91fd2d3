"""Quality classifier by co-training: a text view and a metadata view teach each other.

The text view hashes words and word shapes; the metadata view has language, source and counts of characters, lines, marks
and repeats. Both are logistic regressions, fitted on a bounded sample of labelled rows. Features of all documents are
computed once. In each round both views score all other documents, each names the HANDED rows of either class that it is
surest of in the whole table, the other view learns from them, and both are fitted anew. Near copies (texts that have one of
four MinHash values of their five-word shingles in common) count as one row there, and those of a labelled row not at all,
so that no group of copies fills a round. Each view's score is calibrated on
labelled rows that it didn't learn from (Platt), and the calibrated log odds are averaged with weights that the same rows
give. The fitted views then score all documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLDS, SHINGLE_WORDS, materialise, slices

#: Labelled rows that the views are fitted on, at most.
LABELLED_ROWS = 6000
#: Hashed features of the text view and of the metadata view's names.
TEXT_FEATURES = 1 << 14
NAME_FEATURES = 64
ROUNDS = 4
#: Different texts a class that a view hands to the other in a round, the surest of all, and how sure it must be.
HANDED = 200
SURE = 0.9

WORD = re.compile(r"\w+|[^\w\s]+")
NUMBERS = 12


@lru_cache(300_000)
def _known(s: str) -> int:
    return zlib.crc32(s.encode())


def _crc(s: str) -> int:
    """crc32, remembered for words of up to 40 characters, so that the memory is bounded in bytes."""
    return _known(s) if len(s) <= 40 else zlib.crc32(s.encode())


def _hash(s: str, size: int) -> int:
    return _crc(s) % size


#: Odd factors of a shingle's words in its hash; the first COPY_KEYS also mix it for that many MinHash values.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
COPY_KEYS = 4


def copy_keys(words: list[str]) -> list[int]:
    """MinHash values of the runs of five words (of all words, if fewer); near copies nearly always have one in common."""
    if not words:
        return [0] * COPY_KEYS
    codes = np.array([_crc(w) for w in words], np.uint64)
    k = min(SHINGLE_WORDS, len(codes))
    h = np.zeros(len(codes) - k + 1, np.uint64)
    for i in range(k):
        h += codes[i : i + len(h)] * FACTORS[i]
    h ^= h >> np.uint64(29)
    mixed = (h * f for f in FACTORS[:COPY_KEYS])
    return [int((m ^ (m >> np.uint64(32))).min() >> np.uint64(1)) for m in mixed]


def text_counts(text: str | None) -> tuple[list[int], list[int], list[float], list[int]]:
    """Hashed words and mark runs with their counts, the shares of the commonest, of repeats and of marks, and the keys
    of near copies."""
    words = WORD.findall(text.lower()) if text else []
    found = Counter(words)
    said: dict[int, int] = {}
    for w, n in found.items():
        i = _hash(w if w[0].isalnum() else "mark " + w[:3], TEXT_FEATURES - 8)
        said[i] = said.get(i, 0) + n
    total = sum(found.values())
    marks = sum(n for w, n in found.items() if not w[0].isalnum())
    return list(said), list(said.values()), [max(found.values()) / total, 1 - len(found) / total, marks / total] if total else [0.0] * 3, copy_keys(words)


def meta_view(text: str | None, lang: str | None, source: str | None) -> list[float]:
    """Counts of the page: lengths, lines, repeated lines, shares of letters, ASCII capitals, digits, spaces and marks."""
    t = text or ""
    n = max(1, len(t))
    lines = t.split("\n")
    c = np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256) / n
    upper, digits, spaces = c[65:91].sum(), c[48:58].sum(), c[32]
    marks = c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()
    return [np.log1p(len(t)) / 10, np.log1p(len(lines)) / 5, len(set(lines)) / len(lines), 1 - digits - spaces - marks, upper, digits, spaces, marks, c[124] * 10, c[33] * 10, float(not t), 1.0]


class Rows:
    """Both views of a batch as flat arrays; text row i has the entries with ``row`` i."""

    def __init__(self, ends: np.ndarray, at: np.ndarray, n: np.ndarray, numbers: np.ndarray, names: np.ndarray) -> None:
        self.many = len(ends) - 1
        row = np.repeat(np.arange(self.many), np.diff(ends))
        w = 1 + np.log(np.maximum(1, n.astype(np.float64)))
        w /= np.sqrt(np.bincount(row, w * w, self.many))[row]
        shares = numbers[:, NUMBERS:]
        self.text = [np.concatenate([row, np.repeat(np.arange(self.many), 3)]), np.concatenate([at.astype(np.int64), np.tile(TEXT_FEATURES - 8 + np.arange(3), self.many)]), np.concatenate([w, shares.ravel()])]
        every = np.concatenate([np.tile(np.arange(NUMBERS), (self.many, 1)), NUMBERS + names], 1)
        value = np.concatenate([numbers[:, :NUMBERS], np.full(names.shape, 0.3)], 1)
        self.meta = [np.repeat(np.arange(self.many), every.shape[1]), every.ravel(), value.ravel()]

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Rows:
        at = batch.column("at")
        ends = at.offsets.to_numpy()
        numbers, names = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("numbers", "names"))
        return cls(ends - ends[0], at.flatten().to_numpy(), batch.column("n").flatten().to_numpy(), numbers, names)


class Logistic:
    """L2-regularised logistic regression by gradient steps with per-weight scaling, on CSR rows."""

    def __init__(self, size: int) -> None:
        self.w, self.b, self.size = np.zeros(size), 0.0, size

    def fit(self, row: np.ndarray, at: np.ndarray, value: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150) -> Logistic:
        self.w[:], self.b = 0, 0.0
        scale = np.full(self.size, 1e-8)
        scale_b = 1e-8
        weight = weight / max(1e-9, weight.sum())
        for _ in range(steps):
            z = np.bincount(row, self.w[at] * value, len(y)) + self.b
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
            slope = np.bincount(at, error[row] * value, self.size) + 1e-5 * self.w
            scale += slope * slope
            self.w -= 0.5 * slope / np.sqrt(scale)
            scale_b += error.sum() ** 2
            self.b -= 0.5 * error.sum() / np.sqrt(scale_b)
        return self

    def odds(self, row: np.ndarray, at: np.ndarray, value: np.ndarray, many: int) -> np.ndarray:
        return np.bincount(row, self.w[at] * value, many) + self.b


def _p(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Views:
    """The two views with their calibrations."""

    def __init__(self, rate: float) -> None:
        self.views = [Logistic(TEXT_FEATURES), Logistic(NUMBERS + NAME_FEATURES)]
        self.platt, self.weight, self.rate, self.one = [(1.0, 0.0), (1.0, 0.0)], [0.5, 0.5], rate, False

    def odds(self, rows: Rows) -> list[np.ndarray]:
        return [view.odds(*data, rows.many) for view, data in zip(self.views, (rows.text, rows.meta), strict=True)]

    def fit(self, view: int, rows: Rows, y: np.ndarray, weight: np.ndarray) -> None:
        """Classes count alike, whatever their shares."""
        share = np.clip(y.mean(), 0.02, 0.98)
        self.views[view].fit(*(rows.text, rows.meta)[view], y, np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) * weight)

    def calibrate(self, rows: Rows, y: np.ndarray) -> None:
        if len(set(y)) < 2:
            return
        loss = []
        for k, odds in enumerate(self.odds(rows)):
            self.platt[k] = a, b = _platt(odds, y)
            p = _p(a * odds + b)
            loss.append(-np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)))
        inverse = 1 / (np.array(loss) + 1e-6)
        self.weight = (inverse / inverse.sum()).tolist()

    def score(self, rows: Rows) -> np.ndarray:
        if self.one:
            return np.full(rows.many, self.rate)
        return _p(sum(w * (a * odds + b) for w, (a, b), odds in zip(self.weight, self.platt, self.odds(rows), strict=True)))


def _platt(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * odds + b, -30, 30)))
        step = 0.5
        a -= step * (float(np.mean((p - y) * odds)) / (float(np.mean(odds**2)) + 1e-9) * 4)
        b -= step * float(np.mean(p - y)) * 4
    return max(a, 1e-3), b


FEATURES = "copy array<long>, at array<int>, n array<int>, numbers array<double>, names array<int>"


def _keys(copy: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Keys of near copies, a row each."""
    copy = copy.combine_chunks() if isinstance(copy, pa.ChunkedArray) else copy
    return copy.flatten().to_numpy(zero_copy_only=False).reshape(-1, COPY_KEYS)


def _first_of_copies(rows: pa.Table) -> pa.Table:
    """The HANDED surest rows, one of each set of near copies: the surest, of smallest id."""
    rows = rows.sort_by([("p", "descending"), ("id", "ascending")])
    keys, left = _keys(rows["copy"]), np.arange(len(rows))
    for k in range(COPY_KEYS):
        left = left[np.sort(np.unique(keys[left, k], return_index=True)[1])]
    return rows.take(pa.array(left[:HANDED]))


def _surest(features: DataFrame, views: Views, known: set[int], handed: list[set[int]]) -> pa.Table:
    """The HANDED different texts of each class that each view is surest of, in the whole table but for copies of the
    labelled rows and of those handed before: (view, y, p, id, features). A task keeps no more of them than that. Rows are
    ranked without their features, which are read again for the chosen ones."""
    model = features.sparkSession.sparkContext.broadcast((views, known, handed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, known, handed = model.value
        best: dict[tuple[int, int], pa.Table] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            copies = _keys(batch.column("copy")).tolist()
            for view, odds in enumerate(views.odds(Rows.of(batch))):
                p = _p(odds)
                free = np.fromiter((known.isdisjoint(c) and handed[view].isdisjoint(c) for c in copies), bool, len(copies)) & batch.column("id").is_valid().to_numpy(zero_copy_only=False)
                for y in (0, 1):
                    sure = np.where(free, p if y else 1 - p, 0.0)
                    top = np.flatnonzero(sure >= SURE)
                    rows = pa.table({"p": sure[top], "id": batch.column("id").take(pa.array(top)), "copy": batch.column("copy").take(pa.array(top))})
                    best[view, y] = _first_of_copies(pa.concat_tables([best[view, y], rows]) if (view, y) in best else rows)
        for (view, y), rows in best.items():
            rows = rows.append_column("view", pa.array([view] * len(rows), pa.int32())).append_column("y", pa.array([y] * len(rows), pa.int32()))
            yield from rows.select(["view", "y", "p", "id", "copy"]).combine_chunks().to_batches()

    named = features.mapInArrow(run, f"view int, y int, p double, id {dict(features.dtypes)['id']}, copy array<long>")
    for k in range(COPY_KEYS):  # tasks may name copies of one text
        surest = Window.partitionBy("view", "y", F.col("copy")[k]).orderBy(F.desc("p"), "id")
        named = named.withColumn("nth", F.row_number().over(surest)).where("nth = 1").drop("nth")
    place = F.row_number().over(Window.partitionBy("view", "y").orderBy(F.desc("p"), "id"))
    chosen = named.withColumn("place", place).where(F.col("place") <= HANDED).drop("place")  # 4 x HANDED rows
    return features.join(F.broadcast(chosen), ["id", "copy"]).dropDuplicates(["view", "y", "id"]).toArrow()


def train(features: DataFrame, labelled: pa.Table) -> Views:
    """Co-training from labelled rows (label, split, id, features) with all rows of ``features``."""
    label = labelled["label"].to_numpy().astype(float)
    tuned = labelled["split"].to_numpy() % 4 == 0  # set aside for the calibration
    views = Views(float((label.sum() + 0.5) / (len(label) + 1)))
    views.one = len(set(label[~tuned])) < 2
    if views.one:
        return views
    columns = ["at", "n", "numbers", "names"]
    base = labelled.filter(pa.array(~tuned)).select(columns)
    taught = [(base, label[~tuned], np.ones((~tuned).sum()))] * 2
    known, handed = set(_keys(labelled["copy"]).ravel().tolist()), [set(), set()]
    for turn in range(ROUNDS):
        for view, (rows, y, weight) in enumerate(taught):
            views.fit(view, Rows.of(rows.combine_chunks().to_batches()[0]), y, weight)
        if turn == ROUNDS - 1:
            break
        found = _surest(features, views, known, handed).sort_by([("view", "ascending"), ("y", "ascending"), ("p", "descending"), ("id", "ascending")])
        for view in (0, 1):
            mine = found.filter(pc.equal(found["view"], view))
            handed[view] |= set(_keys(mine["copy"]).ravel().tolist())
            rows, y, weight = taught[1 - view]  # the other view learns from them
            taught[1 - view] = pa.concat_tables([rows, mine.select(columns)]), np.append(y, mine["y"].to_numpy()), np.append(weight, np.full(len(mine), 0.5))
    if tuned.any():
        views.calibrate(Rows.of(labelled.filter(pa.array(tuned)).combine_chunks().to_batches()[0]), label[tuned])
    return views


def score(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, labels: DataFrame, label_col: str, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """Every row's (``id_col``, held_out, score, predicted): the probability of good quality.

    Labels are read from rows of folds 1 to 4 only, at most ``labelled_rows`` of them (smallest id hashes); every other row
    is unlabelled and may be named in a round. Null and empty texts are scored by their metadata and an empty text vector;
    null language or source is a name of its own. With labels of one class, or none, every score is the smoothed share. An
    id labelled twice is good if one of its labels says so. Repeated rows score alike; an empty table gives no rows. Other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    kind = dict(rows.dtypes)["id"]
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % FOLDS != 0))
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")).orderBy(F.xxhash64(F.lit("quality"), "id"), "id").limit(labelled_rows)
    marks = materialise(marks, "marks")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t = batch.to_pydict()
            got = [text_counts(x) for x in t["text"]]
            ends = pa.array(np.cumsum([0, *(len(g[0]) for g in got)]), pa.int32())
            flat = [pa.array([x for g in got for x in g[k]], pa.int32()) for k in (0, 1)]
            numbers = [[*meta_view(text, lang, source), *g[2]] for text, lang, source, g in zip(t["text"], t["lang"], t["source"], got, strict=True)]
            names = [[_hash(f"lang {lang}", NAME_FEATURES), _hash(f"source {source}", NAME_FEATURES)] for lang, source in zip(t["lang"], t["source"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([g[3] for g in got], pa.list_(pa.int64())), pa.ListArray.from_arrays(ends, flat[0]), pa.ListArray.from_arrays(ends, flat[1]), pa.array(numbers, pa.list_(pa.float64())), pa.array(names, pa.list_(pa.int32()))], ["id", "copy", "at", "n", "numbers", "names"])

    features = materialise(rows.mapInArrow(seen, f"id {kind}, {FEATURES}"), "features")
    chosen = features.join(F.broadcast(marks), "id").withColumn("split", F.pmod(F.xxhash64(F.lit("split"), "id"), F.lit(1 << 30)))  # labelled_rows rows at most
    labelled = chosen.dropDuplicates(["id"]).toArrow().sort_by("id")
    views = docs.sparkSession.sparkContext.broadcast(train(features, labelled))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = views.value.score(Rows.of(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p, pa.float64())], ["id", "score"])

    out = features.mapInArrow(scored, f"id {kind}, score double")
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % FOLDS == 0, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
