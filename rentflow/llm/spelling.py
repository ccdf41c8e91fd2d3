"""Spelling variants: the vocabulary acceptor composed with a one-edit transducer and with the acceptor again.

Accepted pairs of the composition are the near words. Before its edit the composed machine reads the same letters on both
sides, after it too, so a pair shares what lies before and behind the edit. The composition is enumerated by initial state: a
state stands for the shorter word's length, the stretch in which the edit lies, the letters read before that stretch and those
that must follow it. Every word is dealt to the states of the first and of the second half, as the shorter word of a pair and
as the longer one; states that too many words reach are split in halves again. Each task builds the minimised acceptors of its
states' stretches and walks them in lockstep.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, slices

#: Words of one initial state from which its stretch is split, and letters of a stretch from which it is split too. A stretch
#: of one letter isn't split: with an alphabet of 90 letters no more than 8,190 words can reach it.
STATE_WORDS, STRETCH = 20_000, 256
#: Split states up to which they are broadcast; more are joined.
BROADCAST_STATES = 100_000
#: Remembered answers of a walk; they are forgotten beyond that.
MEMORY = 500_000

STATE = ["size", "begin", "end", "before", "behind"]


def typed_words(docs: DataFrame, doc_id: str, text: str, least_letters: int, every: int = 31) -> DataFrame:
    """(word, n): runs of letters with the simulated slips of the contract, counted."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(low, F.lit(f"[a-zÀ-ÿ]{{{least_letters},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(h % every == 0, slipped).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _state(size: Column, begin: Column, end: Column) -> list[Column]:
    """The columns of an initial state for ``word`` and a stretch [begin, end) of a pair whose shorter word has ``size`` letters."""
    behind = F.greatest(size - end, F.lit(0))
    return [size.alias("size"), begin.alias("begin"), end.alias("end"), F.substring(F.col("word"), F.lit(1), begin).alias("before"), F.when(behind > 0, F.right("word", behind)).otherwise("").alias("behind")]


def _states(vocabulary: DataFrame, least_letters: int) -> DataFrame:
    """(size, begin, end, before, behind, word, n): every word at its initial states, no state with more than STATE_WORDS."""
    letters = F.length("word")
    sized = vocabulary.select("word", "n", F.explode(F.array(letters, letters - 1)).alias("size")).where(F.col("size") >= least_letters)
    half = (F.col("size") / 2).cast("int")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("begin"), half.alias("end")), F.struct(half.alias("begin"), (F.col("size") + 1).alias("end"))))
    rows = sized.select("word", "n", "size", ends.alias("s")).select("word", "n", *_state(F.col("size"), F.col("s.begin"), F.col("s.end")))
    done = None
    while True:
        rows = materialise(rows, "states")
        wide = (F.col("end") - F.col("begin")) > 1
        large = materialise(rows.groupBy(*STATE).agg(F.count(F.lit(1)).alias("words")).where(wide & ((F.col("words") > STATE_WORDS) | (F.col("end") - F.col("begin") > STRETCH))).select(*STATE), "large")
        n = large.count()
        if not n:
            return rows if done is None else done.unionByName(rows)
        few = F.broadcast(large) if n <= BROADCAST_STATES else large
        kept = rows.join(few, STATE, "left_anti")
        done = kept if done is None else done.unionByName(kept)
        middle = ((F.col("begin") + F.col("end")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("begin"), middle.alias("end")), F.struct(middle.alias("begin"), F.col("end"))))
        rows = rows.join(few, STATE, "left_semi").select("word", "n", "size", halves.alias("s")).select("word", "n", *_state(F.col("size"), F.col("s.begin"), F.col("s.end")))


class Acceptors:
    """Minimised acceptors that share their states: a state is known by its arcs and by whether it accepts."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.met: dict[tuple[int, int], bool] = {}

    def state(self, arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())
        if (found := self.known.get(key)) is None:
            found = self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return found

    def build(self, words: list[str]) -> int:
        """The first state of the acceptor of sorted distinct words: open states lie on the last word's path, and what a new
        word leaves is made final."""
        path: list[list] = [[{}, False, ""]]  # arcs, accepts, letter that leads here
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                arcs, final, letter = path.pop()
                path[-1][0][letter] = self.state(arcs, final)

        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            close(same)
            path += [[{}, False, c] for c in word[same:]]
            path[-1][1] = True
            last = word
        close(0)
        return self.state(path[0][0], path[0][1])

    def meet(self, p: int, q: int) -> bool:
        """Whether some rest is accepted from both states."""
        if p == q:
            return True
        key = (p, q) if p < q else (q, p)
        if (known := self.met.get(key)) is None:
            a, b = self.arcs[p], self.arcs[q]
            if len(a) > len(b):
                a, b = b, a
            known = self.final[p] and self.final[q] or any(c in b and self.meet(r, b[c]) for c, r in a.items())
            if len(self.met) >= MEMORY:
                self.met.clear()
            self.met[key] = known
        return known

    def rests(self, p: int, q: int) -> Iterator[str]:
        """All rests that both states accept."""
        if self.final[p] and self.final[q]:
            yield ""
        b = self.arcs[q]
        for c, r in self.arcs[p].items():
            if c in b and self.meet(r, b[c]):
                for rest in self.rests(r, b[c]):
                    yield c + rest

    def replaced(self, p: int) -> Iterator[tuple[str, str]]:
        """Pairs of the acceptor, an edge that writes another letter than it reads, and the acceptor; each pair once."""
        left = [(p, "")]
        while left:
            p, read = left.pop()
            arcs = list(self.arcs[p].items())
            for i, (c, r) in enumerate(arcs):
                for d, s in arcs[i + 1 :]:
                    if self.meet(r, s):
                        for rest in self.rests(r, s):
                            yield read + c + rest, read + d + rest
                left.append((r, read + c))

    def inserted(self, p: int, q: int, at_end: bool) -> Iterator[tuple[str, str]]:
        """Pairs (shorter, longer) of the two acceptors with an edge that writes a letter and reads none. Both read the same as
        long as they can, so each pair comes once; ``at_end`` allows the edge behind the last letter."""
        left = [(p, q, "")]
        while left:
            p, q, read = left.pop()
            a = self.arcs[p]
            for d, s in self.arcs[q].items():
                if at_end and self.final[p] and self.final[s]:
                    yield read, read + d
                below = self.arcs[s]
                for c, r in a.items():
                    if c != d and c in below and self.meet(r, below[c]):
                        for rest in self.rests(r, below[c]):
                            yield read + c + rest, read + d + c + rest
                if d in a:
                    left.append((a[d], s, read + d))


def _pairs(size: int, begin: int, end: int, words: list[str], counts: list[int]) -> Iterator[tuple[str, int, str, int]]:
    """Near words of one initial state whose edit lies in its stretch: (word, n, near word, its n)."""
    behind = max(size - end, 0)
    stretch: tuple[dict, dict] = ({}, {})
    for word, n in zip(words, counts, strict=True):
        stretch[len(word) - size][word[begin : len(word) - behind]] = (word, n)
    short, long = stretch
    if not short or len(words) < 2:
        return
    machine = Acceptors()
    first = machine.build(sorted(short))
    for u, v in machine.replaced(first):
        yield (*short[u], *short[v])
    if long:
        for u, v in machine.inserted(first, machine.build(sorted(long)), end > size):
            yield (*short[u], *long[v])


def near_words(vocabulary: DataFrame, least_letters: int) -> DataFrame:
    """(word, near, near_n), both ways, of all words one edit apart."""
    states = _states(vocabulary, least_letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * STRETCH))
        out: list[tuple[str, str, int]] = []
        at: tuple | None = None
        words: list[str] = []
        counts: list[int] = []

        def table() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int64())], ["word", "near", "near_n"])
            out.clear()
            return made

        def settle() -> Iterator[pa.RecordBatch]:
            if at:
                for u, m, v, n in _pairs(*at[:3], words, counts):
                    out.extend(((u, v, n), (v, u, m)))
                    if len(out) >= 10_000:
                        yield table()

        for batch in slices(batches, 10_000):
            for *state, word, n in zip(*(batch[c].to_pylist() for c in (*STATE, "word", "n")), strict=True):
                if at != tuple(state):
                    yield from settle()
                    at, words, counts = tuple(state), [], []
                words.append(word)
                counts.append(n)
        yield from settle()
        if out:
            yield table()

    dealt = states.repartition(*STATE).sortWithinPartitions(*STATE)
    return dealt.mapInArrow(run, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): links are followed in steps that double. A form is at least ten times as frequent as its
    word, so no chain is longer than 19 links and five rounds are enough."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = materialise(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        ended = stepped.where("moved").isEmpty()
        discard(at)
        at = stepped.select("word", "root")
        if ended:
            return at


def variants(docs: DataFrame, doc_id: str, text: str, least_letters: int = 7, least: int = 2, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``least_letters`` letters or more that occurs ``least`` times.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; where 31 divides the crc32 of ``<doc_id>:<run>`` the run
    lacks its letter at that crc32 modulo its length. Words are near if one letter inserted, deleted or replaced makes one of
    the other; n_near counts them. A word's form is its most frequent near word (ties: the first in code-point order) if that
    is ``times`` as frequent or more, else null; its root is where the forms lead.

    A null text has no words, a null id is written as nothing, repeated rows count each time, other columns are not read. A
    word of many letters costs its length times a 256th of it.
    """
    vocabulary = materialise(typed_words(docs, doc_id, text, least_letters).where(F.col("n") >= least), "vocabulary")
    near = near_words(vocabulary, least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    told = vocabulary.join(near, "word", "left")
    enough = -F.col("best.n") >= times * F.col("n")
    told = materialise(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")), "forms")
    roots = _roots(told.where(F.col("form").isNotNull()))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
