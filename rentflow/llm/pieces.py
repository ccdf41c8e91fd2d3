"""SentencePiece encoding and decoding with a BPE piece model, words encoded together in a trie.

Texts are cut into marked words (spaces, which the model writes as U+2581, and what follows them). No piece crosses such a
cut, so words encode alone. A batch's distinct words are sorted, which lays them out as a trie in depth-first order; the
forward table of a word is kept where the next word shares its prefix, so every trie node is computed once.

The model's scores are merge ranks, not log-probabilities, so the best path is not a largest sum. A sequence of pieces is
the BPE encoding of its string exactly if each two neighbours encode, as a string of their own, to themselves. The forward
entry of a prefix is therefore the last piece of the prefix's encoding: the one piece that ends there and agrees with the
entry of the prefix before it. Ids equal those of the public library, except that U+2581 in a text is kept apart from a
space by writing its bytes.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words and pairs that a Python worker remembers between batches, at most.
WORDS_KEPT = 80_000
PAIRS_KEPT = 200_000
#: Text that is encoded at once.
BATCH_CHARS = 2_000_000


def load(model_file: str) -> tuple[list[str], list[float], list[int]]:
    """Pieces (marks as spaces, control pieces empty), scores, and the ids of the 256 byte pieces of a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
    pieces = ["" if special[i] else model.id_to_piece(i).replace(MARK, " ") for i in range(n)]
    raw = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
    return pieces, [model.get_score(i) for i in range(n)], [raw[i] for i in range(256)]


class Encoder:
    """Encodes sorted words; remembers frequent words and checked pairs up to fixed counts."""

    def __init__(self, pieces: list[str], scores: list[float], raw: list[int]) -> None:
        self.ids = {p: i for i, p in enumerate(pieces) if p}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.raw = raw
        self.code = "H" if len(pieces) <= 1 << 16 else "I"  # bytes of an id in memory
        lengths: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                lengths.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}  # of pieces, by their last three characters
        self.cut = re.compile(" *[^ \n]+| +|\n" if not any("\n" in p for p in self.ids) else " *[^ ]+| +")
        self.merges: dict[str, tuple | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.bytes_of = [p.encode() for p in pieces]
        for value, i in enumerate(raw):
            self.bytes_of[i] = bytes([value])
        size = np.array([len(b) for b in self.bytes_of])
        self.size, self.start = size, np.cumsum(size) - size
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def _merges(self, piece: str) -> tuple | None:
        """The merges that make the piece, in order: (score, first symbol after it, last symbol after it); None if it
        isn't made."""
        if piece not in self.merges:
            score, symbols, steps = self.score, list(piece), []
            while len(symbols) > 1:
                at = [(score[a + b], -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in score]
                if not at:
                    break
                best, i = max(at)
                symbols[-i : 2 - i] = [symbols[-i] + symbols[1 - i]]
                steps.append((best, symbols[0], symbols[-1]))
            self.merges[piece] = tuple(steps) if len(symbols) == 1 else None
        return self.merges[piece]

    def _agree(self, left: str, right: str) -> bool:
        """Whether the two pieces, as one string, encode to themselves: no merge across them comes first."""
        a, b = self._merges(left), self._merges(right)
        if a is None or b is None:
            return False
        score, i, j, end, begin = self.score, 0, 0, left[0] if len(left) == 1 else left[-1], right[0]
        while True:
            across = score.get(end + begin, -np.inf)
            of_a = a[i][0] if i < len(a) else -np.inf
            of_b = b[j][0] if j < len(b) else -np.inf
            if across > of_a and across >= of_b:
                return False
            if of_a == of_b == -np.inf:
                return True
            if of_a >= of_b:
                end, i = a[i][2], i + 1
            else:
                begin, j = b[j][1], j + 1

    def _encode_sorted(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word's ids (in bytes), by depth-first traversal: ``last[i]`` is the length of the last piece of the
        encoding of the word's first i characters."""
        ids, lengths, pairs, agree, none = self.ids, self.lengths, self.pairs, self._agree, ()
        before, last, piece = "", [0], [""]
        for word in words:
            keep, most = 0, min(len(before), len(word))
            if before[:most] == word[:most]:
                keep = most
            else:
                while before[keep] == word[keep]:
                    keep += 1
            del last[keep + 1 :], piece[keep + 1 :]
            for i in range(keep + 1, len(word) + 1):
                found = word[i - 1]
                for n in (*lengths.get(word[i - 3 : i], none), 2) if i > 2 else (2,) if i > 1 else none:
                    if n > i or (t := word[i - n : i]) not in ids:
                        continue
                    u = piece[i - n]
                    if (ok := pairs.get((u, t))) is None:
                        ok = pairs[u, t] = agree(u, t) if u in ids else self._merges(t) is not None
                    if ok:
                        found = t
                        break
                last.append(len(found))
                piece.append(found)
            out, i = [], len(word)
            while i:
                t = piece[i]
                if t in ids:
                    out.append(ids[t])
                else:
                    out.extend(self.raw[x] for x in reversed(t.encode()))
                i -= last[i]
            out.reverse()
            before = word
            yield word, array(self.code, out).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of each text, in bytes; a text is preceded by one space, as the model asks. Empty: none; null: null."""
        cut = [self.cut.findall(" " + t) if t else [] for t in texts]
        known = self.words
        counts = Counter(chain.from_iterable(cut))
        new = sorted(counts.keys() - known.keys())
        if len(self.pairs) > PAIRS_KEPT:
            self.pairs.clear()
        often = set(sorted((w for w in new if counts[w] > 1), key=counts.__getitem__, reverse=True)[: WORDS_KEPT - len(known)])
        known.update(self._encode_sorted(new))
        out = [None if t is None else b"".join([known[w] for w in c]) for t, c in zip(texts, cut, strict=True)]
        for w in new:
            if w not in often:
                del known[w]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids, with the leading space that encoding adds."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[ids] - (ends - size), size) + np.arange(total)
        return self.flat[at].tobytes()


_ENCODERS: dict[int, Encoder] = {}


def _encoder(model: tuple) -> Encoder:
    """One encoder for a Python worker and model, so that what it remembers outlives a task."""
    key = hash((len(model[0]), tuple(model[0][-50:]), sum(model[1])))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*model)
    return _ENCODERS[key]


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts exceed BATCH_CHARS (one long text stays whole)."""
    for batch in batches:
        size = np.array([0 if t is None else len(t) for t in batch.column(column).to_pylist()])
        begin = 0
        while begin < len(size):
            n = max(1, int(np.searchsorted(np.cumsum(size[begin:]), BATCH_CHARS, "right")))
            yield batch.slice(begin, n)
            begin += n


def encode(df: DataFrame, text_col: str, model_file: str, ids_col: str = "piece_ids", check_col: str | None = None) -> DataFrame:
    """``df`` with a column of piece ids (array<int>) in place of the texts, each encoded whole.

    With ``check_col``, a boolean column of that name says whether decoding the ids gave the text back. A null text has null
    ids (and a true check), an empty one none. Repeated rows encode alike, an empty table gives no rows. Characters without
    a piece are written as their UTF-8 bytes, so that every text can be decoded. Other columns are kept; one that already
    has a new column's name is replaced.
    """
    model = df.sparkSession.sparkContext.broadcast(load(model_file))  # as large as the model file
    names = [n for n in df.columns if n not in (text_col, ids_col, check_col)]
    plain, kinds = [f"c{i}" for i in range(len(names))], dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value)
        for batch in _slices(batches, "body"):
            texts = batch.column("body").to_pylist()
            found = encoder.encode(texts)
            kind = np.dtype(encoder.code)
            ends = np.concatenate([[0], np.cumsum([len(x) // kind.itemsize if x else 0 for x in found])]).astype(np.int32)
            flat = np.frombuffer(b"".join(x for x in found if x), kind).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([x is None for x in found]))
            same = [not t or encoder.decode(flat[a:b])[1:] == t.encode() for t, a, b in zip(texts, ends, ends[1:], strict=False)] if check_col else []
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in plain), ids, *([pa.array(same, pa.bool_())] if check_col else [])], [*plain, "ids", *(["same"] if check_col else [])])

    inner = df.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, plain, strict=True)], F.col(f"`{text_col}`").alias("body"))
    schema = ", ".join([*(f"{c} {kinds[n]}" for n, c in zip(names, plain, strict=True)), "ids array<int>", *(["same boolean"] if check_col else [])])
    return inner.mapInArrow(run, schema).toDF(*names, ids_col, *([check_col] if check_col else []))


def decode(df: DataFrame, ids_col: str, model_file: str, text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of each sequence of ids; null ids give null. Bytes that are not UTF-8 are replaced."""
    model = df.sparkSession.sparkContext.broadcast(load(model_file))
    kept = df.drop(text_col)
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value)
        for batch in batches:
            column = batch.column("__ids")
            flat = column.values.to_numpy(zero_copy_only=False)
            ends = column.offsets.to_numpy()
            texts = [encoder.decode(flat[a:b])[1:].decode("utf-8", "replace") if ok else None for a, b, ok in zip(ends, ends[1:], column.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(texts, pa.string())], [*(f"c{i}" for i in range(len(names))), "text"])

    inner = kept.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)], F.col(f"`{ids_col}`").cast("array<int>").alias("__ids"))
    schema = ", ".join(f"c{i} {kind}" for i, (_, kind) in enumerate(kept.dtypes)) + ", text string"
    return inner.mapInArrow(run, schema).toDF(*names, text_col)
