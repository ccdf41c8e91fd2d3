"""Removal of repeated passages: a distributed merge sort of suffixes that never compares known prefixes twice.

A byte goes if it lies in a WINDOW-byte string that also starts earlier. Sorting the suffixes of every byte would move the
corpus many times over, so only suffixes at anchors are sorted. Of the GRAM-byte strings inside a window, the one with the
smallest hash is the window's anchor; it depends on the window's bytes alone, so equal windows have equal anchors at equal
offsets. An anchor owns a run of windows, and the bytes they span are its context.

1. Contexts are counted by the hash of their gram. A gram that occurs once can't lie in a repeated window. Of contexts
   equal in whole, all but the first go. Equal contexts are reduced to the first in each batch before they are shuffled.
2. First contexts that share their gram with different ones are sorted by the suffix at the anchor: each task sorts its
   own, front-codes the run (length of the common prefix with the suffix before, and the rest) and deals it out by gram;
   the receiving task merges its runs in a loser tree that carries common-prefix lengths and compares bytes only beyond
   them. Along the merged order these lengths split the suffixes, for each offset d of a window, into classes of equal
   WINDOW - d bytes; together with the hash of the d bytes before the anchor a class is one window, and its first stays.
3. The ranges found go back to the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, slices

WINDOW = 100
#: Grams a window holds: GRAMS of length GRAM.
GRAMS = 64
GRAM = WINDOW - GRAMS + 1
#: Windows that are looked at together; longer texts are taken in pieces (whole windows, each in one piece).
PIECE = 1 << 19
#: Documents whose contexts are reduced together before they are shuffled.
BATCH_DOCS = 2000

_RNG = np.random.default_rng(20240502)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POSITION = np.uint64((1 << 20) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = _powers(_BASE, PIECE + WINDOW + 1)
_DOWN = _powers(pow(_BASE, -1, 2**64), PIECE + WINDOW + 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def contexts(b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram hash, context hash, first window's start, anchor's offset from it, windows) of each context of a text."""
    parts = []
    for begin in range(0, max(0, len(b) - WINDOW + 1), PIECE):
        x = b[begin : begin + PIECE + WINDOW - 1]
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTE[x] * _UP[: len(x)], out=sums[1:])
        grams = _mix((sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(x) - GRAM + 1])
        low = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        step = 1
        while step < GRAMS:  # a sliding minimum by doubling; ties go to the left
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        last = np.concatenate([first[1:], [len(low)]]) - 1
        anchor = (low[first] & _POSITION).astype(np.int64)
        offset, many = anchor - first, last - first + 1
        whole = _mix((sums[last + WINDOW] - sums[first]) * _DOWN[first] + (offset * 64 + many).astype(np.uint64) * np.uint64(_BASE))
        parts.append((grams[anchor], whole, first + begin, offset, many))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _runs(order: tuple[np.ndarray, ...]) -> np.ndarray:
    """True where one of the sorted columns changes."""
    new = np.ones(len(order[0]), bool)
    new[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in order])
    return new


def _table(schema: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in columns], schema)


#: Contexts on their way to the tasks that count them: gram hash, context hash, document, and start, offset, windows in
#: one number. Ranges that a batch already removes travel along: size -1, the range in place of the context hash.
CONTEXT = ["gram", "whole", "doc", "size"]
FOUND = ["doc", "kind", "a", "b"]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, BATCH_DOCS):
        got, docs = [], []
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("body").to_pylist(), strict=True):
            c = contexts(np.frombuffer(text.encode(), np.uint8))
            if len(c[0]):
                got.append(c)
                docs.append(np.full(len(c[0]), doc, np.int64))
        if not got:
            continue
        gram, whole, start, offset, many = (np.concatenate(p) for p in zip(*got, strict=True))
        doc = np.concatenate(docs)
        order = np.lexsort((start, doc, whole, gram))
        gram, whole, doc, start, offset, many = (a[order] for a in (gram, whole, doc, start, offset, many))
        new = _runs((gram, whole))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (doc != doc[head]) | (start != start[head])
        yield _table(CONTEXT, gram[~later].view(np.int64), whole[~later].view(np.int64), doc[~later], start[~later] << 16 | offset[~later] << 8 | many[~later])
        if later.any():
            d, s, e = _joined(doc[later], start[later], start[later] + many[later] - 1 + WINDOW)
            yield _table(CONTEXT, _mix(d.astype(np.uint64)).view(np.int64), s << 32 | e, d, np.full(len(d), -1))


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges sorted, and those of a document that touch or overlap joined."""
    order = np.lexsort((end, start, doc))
    doc, start, end = doc[order], start[order], end[order]
    shift = (np.cumsum(_runs((doc,))) - 1) * (int(end.max()) + 1)  # documents apart on one line
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]])
    return doc[new], start[new], np.maximum.reduceat(end, np.flatnonzero(new))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task's grams: removed ranges (kind 0: start, end) and first contexts to be sorted (kind 1: start, size)."""
    parts = [[batch.column(n).to_numpy(zero_copy_only=False) for n in CONTEXT] for batch in batches]
    if not parts:
        return
    gram, whole, doc, size = (np.concatenate(p) for p in zip(*parts, strict=True))
    known = size == -1
    if known.any():
        yield _table(FOUND, doc[known], np.zeros(known.sum()), whole[known] >> 32, whole[known] & 0xFFFFFFFF)
    order = np.argsort(gram[~known], kind="stable")
    order = np.flatnonzero(~known)[order]
    g = gram[order]
    new = _runs((g,))
    group = np.cumsum(new) - 1
    order = order[np.bincount(group, minlength=1)[group] > 1] if len(g) else order
    if not len(order):
        return
    gram, whole, doc, size = gram[order], whole[order], doc[order], size[order]
    order = np.lexsort((size, doc, whole, gram))  # the start leads the size
    gram, whole, doc, size = gram[order], whole[order], doc[order], size[order]
    new = _runs((gram, whole))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    start, many = size >> 16, size & 255
    later = (doc != doc[head]) | (start != start[head])
    yield _table(FOUND, doc[later], np.zeros(later.sum()), start[later], start[later] + many[later] - 1 + WINDOW)
    group = np.cumsum(_runs((gram,))) - 1
    open_ = new & (np.bincount(group, new)[group] > 1)
    yield _table(FOUND, doc[open_], np.ones(open_.sum()), start[open_], size[open_])


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted strings: common-prefix length with the one before, and the rest."""
    shared, rest, before = [], [], b""
    for s in strings:
        n, most = 0, min(len(s), len(before))
        if s[:most] == before[:most]:
            n = most
        else:
            while s[n] == before[n]:
                n += 1
        shared.append(n)
        rest.append(s[n:])
        before = s
    return shared, rest


def merge(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """Merges front-coded runs: (common-prefix length with the string before in the whole order, run, place in the run).

    A loser tree. Each string comes with its common-prefix length with the last one put out; of two strings the one that
    shares more is smaller, and only if they share equally much are bytes compared, from there on.
    """
    n = 1
    while n < max(1, len(runs)):
        n *= 2
    place = [0] * n
    string: list[bytes | None] = [runs[i][1][0] if i < len(runs) and runs[i][1] else None for i in range(n)]
    shared = [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's length becomes the one that it shares with the winner."""
        x, y = string[a], string[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        k, most = shared[a], min(len(x), len(y))
        while k < most and x[k] == y[k]:
            k += 1
        if k == most:
            first = len(x) <= len(y)
        else:
            first = x[k] < y[k]
        a, b = (a, b) if first else (b, a)
        shared[b] = k
        return a, b

    loser, win = [0] * n, [0] * n + list(range(n))
    for i in range(n - 1, 0, -1):
        win[i], loser[i] = play(win[2 * i], win[2 * i + 1])
    w = win[1] if n > 1 else 0
    while string[w] is not None:
        yield shared[w], w, place[w]
        place[w] += 1
        lengths, rest = runs[w]
        if place[w] < len(rest):
            k = lengths[place[w]]
            string[w], shared[w] = string[w][:k] + rest[place[w]], k
        else:
            string[w] = None
        i = (w + n) // 2
        while i:
            w, loser[i] = play(w, loser[i])
            i //= 2


def _sorted_runs(parts: int):
    """Front-coded runs of a batch's open contexts, one for each receiving task: suffixes, bytes before the anchor, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_DOCS):
            rows = []
            for doc, text, many in zip(batch.column("doc").to_pylist(), batch.column("body").to_pylist(), batch.column("open").to_pylist(), strict=True):
                b = text.encode()
                for size in many:
                    start, offset, n = size >> 16, size >> 8 & 255, size & 255
                    anchor = start + offset
                    rows.append((xxhash.xxh64_intdigest(b[anchor : anchor + GRAM]) % parts, b[anchor : start + n - 1 + WINDOW], b[start:anchor][::-1], doc, size))
            rows.sort(key=lambda r: r[:2])
            cut = [i for i in range(len(rows)) if not i or rows[i][0] != rows[i - 1][0]] + [len(rows)]
            out = []
            for a, z in zip(cut, cut[1:], strict=False):
                shared, rest = front_code([r[1] for r in rows[a:z]])
                out.append((rows[a][0], shared, rest, [r[2] for r in rows[a:z]], [r[3] for r in rows[a:z]], [r[4] for r in rows[a:z]]))
            kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["to", "shared", "rest", "before", "doc", "size"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds[i]) for i in range(6)], names)

    return run


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges a task's runs and finds the windows that aren't the first of their class: ranges (document, start, end)."""
    runs, before, docs, sizes = [], [], [], []
    for batch in batches:
        for shared, rest, left, doc, size in zip(*(batch.column(n).to_pylist() for n in ("shared", "rest", "before", "doc", "size")), strict=True):
            runs.append((shared, rest))
            before.append(left)
            docs.append(doc)
            sizes.append(size)
    if not runs:
        return
    order = list(merge(runs))
    shared = np.array([k for k, _, _ in order])
    doc = np.array([docs[r][i] for _, r, i in order])
    size = np.array([sizes[r][i] for _, r, i in order])
    offset, many, anchor = size >> 8 & 255, size & 255, (size >> 16) + (size >> 8 & 255)
    left = np.zeros((len(order), GRAMS), np.uint8)
    for row, (_, r, i) in enumerate(order):
        x = before[r][i]
        left[row, : len(x)] = np.frombuffer(x, np.uint8)
    hashed = np.zeros(len(order), np.uint64)  # of the d bytes before the anchor
    gone_doc, gone_start = [], []
    for d in range(GRAMS):
        if d:
            hashed = _mix(hashed * np.uint64(_BASE) + _BYTE[left[:, d - 1]])
        group = np.cumsum(shared < WINDOW - d)
        has = np.flatnonzero((d <= offset) & (d > offset - many))
        if len(has) < 2:
            continue
        has = has[np.lexsort((anchor[has], doc[has], hashed[has], group[has]))]
        new = _runs((group[has], hashed[has]))
        head = has[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = has[(doc[has] != doc[head]) | (anchor[has] != anchor[head])]
        gone_doc.append(doc[later])
        gone_start.append(anchor[later] - d)
    if gone_doc and len(d := np.concatenate(gone_doc)):
        s = np.concatenate(gone_start)
        yield _table(["doc", "a", "b"], *_joined(d, s, s + WINDOW))


def _cut(text: str | None, ranges: list | None) -> tuple[bytes, int, int, int]:
    """(kept bytes, bytes, removed bytes, removed runs)."""
    b = (text or "").encode()
    if not ranges:
        return b, len(b), 0, 0
    edge = np.zeros(len(b) + 1, np.int64)
    a = np.array([(r["a"], r["b"]) for r in ranges])
    np.add.at(edge, a[:, 0], 1)
    np.add.at(edge, a[:, 1], -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
    return np.frombuffer(b, np.uint8)[~gone].tobytes(), len(b), int(gone.sum()), runs


def repeats(df: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """(doc, body, c0 ..., ranges): every row, with the ranges (a, b) of bytes to be removed, which may overlap, or null;
    c0 and so on are the columns named in ``keep``.

    Null and short texts have none. A null id has no place in the order: its row removes nothing and loses nothing. Rows
    that repeat an id and text are one document and each stay. (An id should name one text: rows of one id with several
    texts all lose the ranges found in any.) An empty table gives no rows.
    """
    spark = df.sparkSession
    parts = partitions(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("body"), *[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(keep or [])])  # a new name, so that Catalyst keeps one shape for both uses
    named = docs.where(F.col("doc").isNotNull() & F.col("body").isNotNull())
    packed = named.select("doc", "body").mapInArrow(_packed, ", ".join(f"{n} long" for n in CONTEXT))
    found = packed.repartition(parts, "gram").mapInArrow(_counted, ", ".join(f"{n} long" for n in FOUND))
    found = materialise(found, "contexts")

    # Both joins read the same rows, so that Spark shuffles the texts by id once and reuses the exchange.
    open_ = found.where(F.col("kind") == 1).groupBy("doc").agg(F.collect_list("b").alias("open"))  # as many as the text has
    runs = named.join(open_, "doc").mapInArrow(_sorted_runs(parts), "to long, shared array<int>, rest array<binary>, before array<binary>, doc array<long>, size array<long>")
    ranges = runs.repartition(parts, "to").mapInArrow(_classes, "doc long, a long, b long")
    ranges = ranges.unionByName(found.where(F.col("kind") == 0).select("doc", "a", "b"))
    ranges = ranges.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    rest = docs.where(F.col("doc").isNull() | F.col("body").isNull()).withColumn("ranges", F.lit(None).cast("array<struct<a: long, b: long>>"))
    return named.join(ranges, "doc", "left").unionByName(rest)


def digest(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row's (``id_col``, n_bytes, n_removed, n_spans, kept_sha256) after the removal of repeated passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [_cut(t, r) for t, r in zip(batch.column("body").to_pylist(), batch.column("ranges").to_pylist(), strict=True)]
            columns = [pa.array([g[i] for g in got], pa.int64()) for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *columns, pa.array([hashlib.sha256(g[0]).hexdigest() for g in got], pa.string())], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = repeats(df, id_col, text_col).mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("doc", id_col)


def strip(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with repeated passages removed from the texts; a character that loses a byte goes, null stays null."""
    others = [n for n in df.columns if n not in (id_col, text_col)]
    kinds = dict(df.dtypes)
    plain = [f"c{i}" for i in range(len(others))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if t is None else _cut(t, r)[0].decode("utf-8", "ignore") for t, r in zip(batch.column("body").to_pylist(), batch.column("ranges").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string()), *(batch.column(n) for n in plain)], ["doc", "body", *plain])

    schema = ", ".join(["doc long", "body string", *(f"{n} {kinds[o]}" for n, o in zip(plain, others, strict=True))])
    return repeats(df, id_col, text_col, others).mapInArrow(run, schema).toDF(id_col, text_col, *others).select(*df.columns)
