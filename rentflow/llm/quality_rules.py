"""Quality rules whose cutoffs carry a guarantee: labelled holdouts and exact binomial bounds choose them.

A rule rejects a text whose measure lies above its cutoff. Per stratum, LEVELS candidate policies (one cutoff a rule) are made
from the selecting labelled rows: level by level the rules may reject more of the good ones. The holdouts then test the
policies in this fixed order: with n good holdouts of which k are rejected, a policy passes if a binomial of n draws at the
allowed rate falls to k or lower with no more than the allowed risk, divided by the strata (Bonferroni). The first policy that
fails ends a stratum's sequence, so its order costs no further correction. All policies that pass reject at most the allowed
share of good texts, together with probability 1 - RISK in all strata; the one that parted good from bad best among the
selecting rows is used, the mildest of equal ones. A stratum without a passing policy rejects nothing beyond the base.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLDS, discard, fold, materialise, slices

#: Allowed share of good texts that a stratum's rules reject, and the risk that any stratum's share is larger.
RATE, RISK = 0.02, 0.05
#: Folds that select; the others are the holdouts.
SELECTING = (1, 2)
#: Shares of good selecting rows that one rule may reject, in thousandths, mildest first.
LEVELS = (0, 1, 2, 4, 8, 16)
WINDOW = 3
#: Bytes of a text that are split into words at a time.
BLOCK = 4 << 20

MEASURES = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_lines": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_capitals": "long",
}
#: Each rule's measure, in thousandths (hundredths for the mean word).
RULES = {
    "symbols": "n_symbols * 1000 div n_words",
    "repeated_lines": "n_dup_lines * 1000 div n_lines",
    "repeated_words": "n_repeat_words * 1000 div n_words",
    "capitals": "n_capitals * 1000 div word_chars",
    "long_words": "word_chars * 100 div n_words",
}


def _numbers(text: bytes) -> np.ndarray:
    """A number for each word, equal for equal words; the words of a long text are never all held at once."""
    known: dict[bytes, int] = {}
    parts, begin = [], 0
    while begin < len(text):
        end = begin + BLOCK
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        words = text[begin:end].split()
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        begin = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _repeated(ids: np.ndarray) -> int:
    """Words that lie in windows of WINDOW words found twice or more."""
    if len(ids) <= WINDOW:
        return 0
    key = ids[: len(ids) - WINDOW + 1]
    for i in range(1, WINDOW):  # numbers stay below the square of the word count
        step = ids[i : len(ids) - WINDOW + 1 + i]
        _, key = np.unique(key * (ids.max() + 1) + step, return_inverse=True)
    twice = np.bincount(key)[key] > 1
    covered = np.zeros(len(ids), bool)
    for i in range(WINDOW):
        covered[i : i + len(twice)] |= twice
    return int(covered.sum())


def measured(text: bytes | None) -> tuple[int, ...]:
    """The MEASURES of one text; of null as of an empty one."""
    text = text or b""
    ids = _numbers(text)
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\v\f\r")]
    blanks = sum(text.count(bytes([c])) for c in b" \t\n\v\f\r")
    follow = np.frombuffer(text, np.uint8)
    letters = len(text) - int(((follow & 0xC0) == 0x80).sum())
    capitals = int(((follow >= 65) & (follow <= 90)).sum())
    return len(ids), letters - blanks, sum(text.count(bytes([c])) for c in b"#*$%&|<>"), len(lines), len(lines) - len(set(lines)), _repeated(ids), capitals


def measures(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """``columns``, the MEASURES of ``text`` and the text's md5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [measured(t.as_py()) for t in batch["__text"]]
            made = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in (*columns, "__digest")), *made], [*columns, "digest", *MEASURES])

    text_col = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*columns, F.md5(text_col.cast("binary")).alias("__digest"), text_col.cast("binary").alias("__text"))
    kinds = dict(docs.select(*columns).dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "digest string", *(f"{m} {k}" for m, k in MEASURES.items())]))


def lower_tail(k: int, n: int, p: float) -> float:
    """P(binomial(n, p) <= k), summed term by term."""
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def _tail(k: str, n: str, p: float) -> Column:
    """``lower_tail`` of two columns. A tail from the mean on is above any risk; it isn't summed."""

    def tails(ks: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([1.0 if a >= b * p else lower_tail(int(a), int(b), p) for a, b in zip(ks, ns, strict=True)], dtype="float64")

    return F.pandas_udf(tails, "double")(k, n)


def _above(row: str, cut: str) -> Column:
    """Whether any rule of ``row`` lies above the cutoff struct ``cut``; a null cutoff rejects nothing."""
    over = F.lit(False)
    for rule in RULES:
        over = over | F.coalesce(F.col(f"{row}.{rule}") > F.col(f"{cut}.{rule}"), F.lit(False))
    return over


def thresholds(rows: DataFrame, rate: float = RATE, risk: float = RISK) -> DataFrame:
    """(stratum, the RULES' cutoffs, level, n_holdout, n_rejected, tail, certified) of each stratum with a labelled good row.

    ``rows`` has stratum, good (boolean), selecting (boolean) and the RULES; equal texts are one row already.
    """
    long = rows.where("selecting").select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES])).alias("m"))
    counts = long.groupBy("stratum", F.col("m.rule").alias("rule"), F.col("m.value").alias("value")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # Distinct values of a rule are few thousand: shares in thousandths.
    of_rule = Window.partitionBy("stratum", "rule")
    up = of_rule.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    told = counts.select("stratum", "rule", "value", F.coalesce(F.sum("good").over(up), F.lit(0)).alias("good_above"), F.coalesce(F.sum("bad").over(up), F.lit(0)).alias("bad_above"), F.sum("good").over(of_rule).alias("all_good"), F.sum("bad").over(of_rule).alias("all_bad"))
    told = told.withColumn("level", F.explode(F.array(*map(F.lit, range(len(LEVELS))))))
    allowed = F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level") + 1)
    cuts = told.where((F.col("all_good") > 0) & (1000 * F.col("good_above") <= allowed * F.col("all_good"))).groupBy("stratum", "level", "rule").agg(F.min_by(F.struct("value", "good_above", "bad_above", "all_good", "all_bad"), "value").alias("c"))
    # A rule that rejects no larger share of the bad than of the good stays unused at this level.
    cuts = cuts.withColumn("cutoff", F.when(F.col("c.bad_above") * F.col("c.all_good") > F.col("c.good_above") * F.col("c.all_bad"), F.col("c.value")))
    policy = cuts.groupBy("stratum", "level").agg(F.struct(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in RULES]).alias("cut"))
    policies = policy.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("level", "cut"))).alias("policies"))  # one a level
    each = rows.join(policies, "stratum").select("stratum", "good", "selecting", F.struct(*RULES).alias("row"), F.explode("policies").alias("p"))
    each = each.select("stratum", "good", "selecting", F.col("p.level").alias("level"), F.col("p.cut").alias("cut"), "row")
    hit = each.withColumn("hit", _above("row", "cut"))
    of = lambda good, selecting: (F.col("good") == good) & (F.col("selecting") == selecting)
    sums = hit.groupBy("stratum", "level", "cut").agg(
        F.count_if(of(True, False)).alias("n_holdout"), F.count_if(of(True, False) & F.col("hit")).alias("n_rejected"),
        F.count_if(of(True, True)).alias("s_good"), F.count_if(of(True, True) & F.col("hit")).alias("x_good"), F.count_if(of(False, True)).alias("s_bad"), F.count_if(of(False, True) & F.col("hit")).alias("x_bad"),
    )
    strata = sums.agg(F.count_distinct("stratum").alias("strata"))  # one row
    tested = sums.join(F.broadcast(strata)).withColumn("tail", _tail("n_rejected", "n_holdout", rate))
    tested = tested.withColumn("passed", F.col("tail") <= F.lit(risk) / F.col("strata"))
    so_far = Window.partitionBy("stratum").orderBy("level")
    tested = tested.withColumn("certified", F.min("passed").over(so_far))
    gain = F.when(F.col("certified"), F.when(F.col("s_bad") > 0, F.col("x_bad") / F.when(F.col("s_bad") > 0, F.col("s_bad"))).otherwise(0.0) - F.col("x_good") / F.when(F.col("s_good") > 0, F.col("s_good")))
    best = tested.groupBy("stratum").agg(F.max_by(F.struct("cut", "level", "n_holdout", "n_rejected", "tail", "certified"), F.struct(F.coalesce(F.round(gain, 9), F.lit(-2.0)), -F.col("level"))).alias("b"))
    return best.select("stratum", "b.*")


def judge(docs: DataFrame, doc_id: str, text: str, stratum: str, labels: DataFrame, label: str, rate: float = RATE, risk: float = RISK) -> DataFrame:
    """(doc_id, MEASURES, base_failed, kept, rejected_by, stratum_certified) of every row of ``docs``.

    Words are runs without blanks, tabs and line ends; the base fails with fewer than 50 words or with more than half of them in
    repeated windows of three. Beyond it a text goes if a certified rule of its stratum rejects it; ``rejected_by`` names them.

    A null text has no words, hence fails; a null stratum is ``und``; a null id has no label. Labels null or without their text
    say nothing; an id labelled twice counts as bad if any label is 0. Equal texts are one labelled row (with the smallest id),
    so copies don't feign evidence. Without labels only the base rejects. Other columns are not read.
    """
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("und")).alias("stratum"), F.col(text).alias("text"))
    words, repeats = F.col("n_words"), F.col("n_repeat_words")
    failed = (words < 50) | (100 * repeats > 50 * words)
    told = measures(ids, ["doc_id", "stratum"], "text").withColumn("base_failed", failed)
    some = lambda e: F.when(~F.col("base_failed"), F.expr(e))  # noqa: E731 - what passes the base has words and lines
    told = materialise(told.withColumns({r: some(e) for r, e in RULES.items()}), "measures")
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).alias("mark"))
    known = told.where(~F.col("base_failed")).join(marks, "doc_id")
    known = known.groupBy("stratum", "digest").agg(F.min_by(F.struct("mark", "doc_id", *RULES), "doc_id").alias("r")).select("stratum", "r.*")
    known = known.select("stratum", (F.col("mark") == 1).alias("good"), fold("doc_id").isin(*SELECTING).alias("selecting"), *RULES)
    known = materialise(known, "known")
    cuts = materialise(thresholds(known, rate, risk).where("certified"), "cutoffs")
    few = F.broadcast(cuts) if cuts.count() <= 100_000 else cuts
    both = told.withColumn("row", F.struct(*RULES)).join(few.select("stratum", "cut", "certified"), "stratum", "left")
    by = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"row.{r}") > F.col(f"cut.{r}"), F.lit(r)) for r in RULES])), ",")
    discard(known)
    return both.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & (by == "")).alias("kept"), by.alias("rejected_by"), F.coalesce("certified", F.lit(False)).alias("stratum_certified"))
