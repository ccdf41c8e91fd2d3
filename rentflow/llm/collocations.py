"""Phrase collocations from sorted count streams: one stream in prefix order, one in suffix order, each read once in lockstep.

1. Tasks count the words and the phrases of two words of their texts, then, in a second pass, those of three words whose
   halves both occur often enough: a filter of fixed size over the frequent pairs passes every one of them and few others.
2. Only frequent counts go on. They are dealt by sampled splitters and sorted by their words from the first on (prefix
   order) and from the last on (suffix order). In the first a phrase comes right after its own beginnings, in the second
   after its own ends, so one reading of each stream gives a phrase's left and right counts, and to a pair the largest
   count of a phrase that extends it. A row whose extensions lie in several tasks is sent to each of them.
3. The streams' findings are put together by phrase, and the best of every language are ranked.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, partitions, slices

#: Words that a task counts at a time, and bytes of a text that it splits at a time.
TOKENS, BLOCK = 3_000_000, 4 << 20
#: Bits of the filter over frequent pairs (8 MiB). With more pairs it passes more phrases to be counted, and loses none.
FILTER_BITS = 1 << 26
#: Rows sampled for each range of a sorted stream, and parts in which a language is ranked.
SAMPLE, SALTS = 50, 64

STOP = b"."
FOLD = bytes(46 if c in b".,;:!?\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text and a STOP where a piece ends, in blocks; no word is cut."""
    text = text.translate(FOLD)
    begin = 0
    while begin < len(text):
        end = begin + BLOCK
        while end < len(text) and text[end] not in b" \t.":
            end += 1
        yield text[begin:end].replace(STOP, b" . ").split()
        begin = end


class Texts:
    """Word numbers of the texts of one language; 0 stands between pieces and texts."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[STOP]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        for words in tokens(text):
            self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
            self.size += len(words)
        self.parts.append(np.zeros(1, np.int32))

    def ids(self) -> np.ndarray:
        return np.concatenate(self.parts).astype(np.int64)

    def words(self) -> pa.Array:
        return pa.array(list(self.number), pa.binary())


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, xxhash.xxh32_intdigest(lang)) for w in words), np.uint64, len(words))


def _places(first: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    """Two places in the filter for pairs of word hashes."""
    h = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + (first >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return [(h >> np.uint64(k)) & np.uint64(FILTER_BITS - 1) for k in (3, 35)]


def _batch(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"lang": pa.repeat(pa.scalar(lang), len(phrases)), "phrase": phrases.cast(pa.binary()), "a": pa.array(counts, pa.int64())})


def _short(lang: str, texts: Texts) -> Iterator[pa.RecordBatch]:
    """Counts of words, of pairs, and (as the empty phrase) of all words."""
    ids, words = texts.ids(), texts.words()
    single = np.bincount(ids, minlength=len(words))[1:]
    yield _batch(lang, words[1:], single)
    yield _batch(lang, pa.array([b""], pa.binary()), np.array([single.sum()]))
    if len(ids) > 1:
        whole = (ids[:-1] > 0) & (ids[1:] > 0)
        keys, counts = np.unique((ids[:-1] * len(words) + ids[1:])[whole], return_counts=True)
        yield _batch(lang, pc.binary_join_element_wise(words.take(pa.array(keys // len(words))), words.take(pa.array(keys % len(words))), b" "), counts)


def _long(bits: np.ndarray) -> Callable[[str, Texts], Iterator[pa.RecordBatch]]:
    """Counts of the phrases of three words whose two pairs pass the filter."""

    def count(lang: str, texts: Texts) -> Iterator[pa.RecordBatch]:
        ids, words = texts.ids(), texts.words()
        if len(ids) < 3:
            return
        h = _hashes(lang, list(texts.number))[ids]
        often = (ids[:-1] > 0) & (ids[1:] > 0)
        for place in _places(h[:-1], h[1:]):
            often &= (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        at = np.flatnonzero(often[:-1] & often[1:])
        pairs, pair = np.unique(ids[at] * len(words) + ids[at + 1], return_inverse=True)
        keys, counts = np.unique(pair * len(words) + ids[at + 2], return_counts=True)
        pair, third = pairs[keys // len(words)], keys % len(words)
        yield _batch(lang, pc.binary_join_element_wise(words.take(pa.array(pair // len(words))), words.take(pa.array(pair % len(words))), words.take(pa.array(third)), b" "), counts)

    return count


def _counts(docs: DataFrame, kind: Callable[[], Callable[[str, Texts], Iterator[pa.RecordBatch]]], least: int) -> DataFrame:
    """(lang, phrase, a) of phrases that occur ``least`` times or more, and of the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, held, n = kind(), defaultdict(Texts), 0
        for batch in slices(batches):
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                before = held[lang].size
                held[lang].add(text.as_py())
                n += held[lang].size - before
                if n >= TOKENS:
                    while held:
                        yield from count(*held.popitem())
                    n = 0
        while held:
            yield from count(*held.popitem())

    rows = docs.mapInArrow(run, "lang string, phrase binary, a long")
    # Tasks have summed what they hold, so the rows are dealt first and summed once.
    sums = rows.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    return materialise(sums.where((F.col("a") >= least) | (F.length("phrase") == 0)), "counts")


def _filter(spark: SparkSession, short: DataFrame) -> np.ndarray:
    """The filter over the frequent pairs; FILTER_BITS bits whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 50_000):
            pairs = defaultdict(list)
            for lang, phrase in zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist(), strict=True):
                if b" " in phrase:
                    pairs[lang].append(phrase.split(b" "))
            for lang, found in pairs.items():
                places = np.concatenate(_places(*(_hashes(lang, [p[i] for p in found]) for i in (0, 1))))
                yield pa.record_batch({"word": pa.array((places >> np.uint64(6)).astype(np.int64)), "bit": pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64))})

    found = short.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def _dealt(counts: DataFrame, backwards: bool) -> DataFrame:
    """(part, lang, words, a, own), sorted: ranges by sampled splitters, and in each range also the beginnings of its rows.
    A row is its own in one range only. Words are reversed for suffix order."""
    spark = counts.sparkSession
    split = F.split(F.col("phrase").cast("string"), " ")
    keyed = counts.select("lang", (F.reverse(split) if backwards else split).alias("words"), "a")
    parts = partitions(spark)
    total = counts.count()
    # A bounded sample: about SAMPLE rows a range, whatever the input.
    taken = keyed.where(F.pmod(F.xxhash64("lang", "words"), F.lit(max(1, total))) < SAMPLE * parts).orderBy("lang", "words").collect()
    ordered = [(r["lang"].encode(), [w.encode() for w in r["words"]]) for r in taken]
    splitters = [ordered[len(ordered) * i // parts] for i in range(1, parts)] if len(ordered) >= parts else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 20_000):
            row, part, own = [], [], []
            for i, (lang, words) in enumerate(zip(batch["lang"].to_pylist(), batch["words"].to_pylist(), strict=True)):
                lang, words = lang.encode(), [w.encode() for w in words]
                first = bisect_right(splitters, (lang, words))
                # No word has the byte 0xFF, so this comes after all that begins with these words.
                for p in range(first, max(first, bisect_left(splitters, (lang, [*words, b"\xff"]))) + 1):
                    row.append(i)
                    part.append(p)
                    own.append(p == first)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(batch[c].take(pa.array(row, pa.int64())) for c in ("lang", "words", "a")), pa.array(own, pa.bool_())], ["part", "lang", "words", "a", "own"])

    return keyed.mapInArrow(run, "part int, lang string, words array<string>, a long, own boolean").repartition(parts, "part").sortWithinPartitions("part", "lang", "words")


FOUND = "lang string, phrase string, a long, l1 long, l2 long, r1 long, r2 long, longest long"


def _lockstep(counts: DataFrame, backwards: bool) -> DataFrame:
    """One reading of a sorted stream: to each phrase of two or three words the counts of its beginnings (backwards: ends),
    to each pair the largest count of a phrase of three words that goes on from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at = one = two = None

        def told(lang: str, words: list[str], a: int | None, single: int | None, pair: int | None, longest: int) -> tuple:
            if backwards:  # r of the cut after one word is the longer end
                return (lang, " ".join(reversed(words)), a, None, None, *((pair, single) if pair else (single, None)), longest)
            return (lang, " ".join(words), a, single, pair, None, None, longest)

        def close(pair: list | None) -> None:
            if pair:
                lang, words, a, own, single, longest = pair
                out.append(told(lang, words, a if own else None, single if own else None, None, longest))

        for batch in slices(batches, 20_000):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part, lang, words, a, own = row
                if part != at:
                    close(two)
                    at, one, two = part, None, None
                if len(words) == 1:
                    one = a
                elif len(words) == 2:
                    close(two)
                    two = [lang, words, a, own, one, 0]
                else:
                    two[5] = max(two[5], a)
                    out.append(told(lang, words, a, one, two[2], 0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(zip(*out))], [c.split()[0] for c in FOUND.split(", ")])
                out.clear()
        close(two)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(zip(*out))], [c.split()[0] for c in FOUND.split(", ")])

    return _dealt(counts, backwards).mapInArrow(run, FOUND)


def _score(left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)) in 38 decimal digits: exact for counts below 10 ** 16."""
    wide = lambda c: f"cast({c} AS decimal(19,0))"
    return F.expr(f"({wide('a')} * {wide('a')} * 1000000BD) div ({wide(left)} * {wide(right)})")


def collocations(docs: DataFrame, text: str, lang: str, least: int = 10, absorbed: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of each language.

    Texts lose the letter case of A-Z and are cut at ``. , ; : ! ?`` and line ends into pieces, those at blanks and tabs into
    words; phrases lie inside pieces. Candidates have two or three words and occur ``least`` times or more (a). A cut after k
    words gives l and r, the counts of both parts, and floor(1000000 a a / (l r)); the cut of the lowest score counts, the
    first of equal ones. A candidate goes if a candidate of three words that holds it occurs ``absorbed`` percent as often
    or more. n is the number of words of the language. Ties in score go to the larger a, then the smaller phrase in bytes.

    A null text is empty, a null language ``und``. Repeated rows count each time; other columns are not read. A table
    without a candidate gives no row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    short = _counts(rows, lambda: _short, least)
    bits = spark.sparkContext.broadcast(_filter(spark, short.where(F.length("phrase") > 0)))
    long = _counts(rows, lambda: _long(bits.value), least)
    often = short.unionByName(long).where((F.length("phrase") > 0) & (F.col("a") >= least))
    both = _lockstep(often, False).unionByName(_lockstep(often, True))
    found = both.groupBy("lang", "phrase").agg(*[F.max(c).alias(c) for c in ("a", "l1", "l2", "r1", "r2", "longest")])
    found = found.where((F.col("l2").isNotNull()) | (100 * F.col("longest") < absorbed * F.col("a")))
    found = found.withColumns({"s1": _score("l1", "r1"), "s2": _score("l2", "r2")})
    first = F.coalesce(F.col("s1") <= F.col("s2"), F.lit(True))
    picked = lambda i, j: F.when(first, F.col(i)).otherwise(F.col(j))
    found = found.select("lang", "phrase", "a", picked("l1", "l2").alias("l"), picked("r1", "r2").alias("r"), picked("s1", "s2").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may hold most phrases: ranked in parts, then the parts' best together.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    best = materialise(best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top), "ranked")
    n = materialise(short.where(F.length("phrase") == 0).select("lang", F.col("a").alias("n")), "sizes")
    discard(short, long)
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
