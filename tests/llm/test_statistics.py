"""Collocations, spelling variants and quality rules against brute force, on planted cases and on awkward rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import compare
import pytest

from rentflow.llm import collocations as streams
from rentflow.llm import quality_rules, queries, spelling

SCHEMA = "doc_id long, text string, lang string, phrase string, word string, n long, a long"


def documents(spark, rows):
    """Rows (doc_id, text, lang) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)


def prose(seed, n, words=60):
    rng = random.Random(seed)
    known = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    said = lambda: "".join(rng.choice(known).title() + rng.choice([" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n"]) for _ in range(rng.randint(0, words)))
    return [(i, said(), rng.choice(["en", "de", None])) for i in range(n)]


AWKWARD = [(None, None, None), (None, "", "en"), (7, "  \t ", "en"), (7, "...\n;", "en"), (8, "the hot line of words. the hot line of words", "en"), (8, "the hot line of words. the hot line of words", "en"),
           (9, "a " * 40_000, "de"), (10, "Ärger-frei \x01b c d " * 12, None), (11, "Straßenbahnen" * 30, "de")]


@pytest.mark.parametrize("name", ["op11_collocations", "op12_spelling_variants", "op13_quality_rules"])
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_gives_its_sql(spark, sf_dir, name, size):
    where = sf_dir.replace("sf0.001", size)
    names, got = compare.spark_rows(queries.queries()[name](spark, where))
    wanted_names, wanted = compare.oracle(queries.oracle_sql()[name], where)
    assert names == wanted_names and got == wanted and got


# Collocations -------------------------------------------------------------------------------------------------------


def plain_collocations(rows, least, top):
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", low):
            words = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            if any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in often.items() if len(p) == 2):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), lang, f[p[:k]], f[p[k:]], n))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, lang, l, r, n) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_are_those_of_plain_counting(spark, seed, monkeypatch):
    monkeypatch.setattr(streams, "TOKENS", 500)  # many partial counts
    monkeypatch.setattr(streams, "BLOCK", 40)
    rows = prose(seed, 150) + AWKWARD
    assert rows_of(streams.collocations(documents(spark, rows).repartition(5), "text", "lang", least=3, top=40)) == plain_collocations(rows, 3, 40)


def test_rows_whose_extensions_lie_in_several_ranges(spark):
    rows = [(i, f"hot w{i % 37} z{i % 5}. hot w{i % 37}", "en") for i in range(800)]
    docs = documents(spark, rows)
    dealt = streams._dealt(spark.createDataFrame([("en", b"hot", 9)] + [("en", f"hot w{i}".encode(), 9) for i in range(2000)], "lang string, phrase binary, a long"), False)
    parts = {r["part"] for r in dealt.where("size(words) = 1").collect()}
    assert len(parts) > 4 and dealt.where("own").count() == 2001
    assert rows_of(streams.collocations(docs, "text", "lang", least=10, top=500)) == plain_collocations(rows, 10, 500)


def test_scores_beyond_64_bits(spark):
    wide = spark.createDataFrame([(10**15, 10**15 + 7, 10**15 + 9), (3_000_000_000, 3_000_000_001, 3_000_000_007)], "a long, l long, r long")
    got = [r.s for r in wide.select(streams._score("l", "r").alias("s")).collect()]
    assert got == [10**6 * 10**30 // ((10**15 + 7) * (10**15 + 9)), 10**6 * 9 * 10**18 // (3_000_000_001 * 3_000_000_007)]


def test_no_text_no_phrase(spark):
    assert streams.collocations(documents(spark, []), "text", "lang").count() == 0
    assert streams.collocations(documents(spark, AWKWARD[:4]), "text", "lang").count() == 0


# Spelling variants --------------------------------------------------------------------------------------------------


def edits_apart(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    u, v = sorted((u, v), key=len)
    i = next((i for i in range(len(u)) if u[i] != v[i]), len(u))
    return u[i + (len(u) == len(v)) :] == v[i + 1 :]


def plain_variants(rows, least_letters=7, least=2, times=10):
    n = Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_letters and c >= least}
    near = {w: [v for v in n if edits_apart(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= times * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n), key=lambda r: r[0])


def close_words(seed, n):
    """Texts of words that differ in few letters, with steep counts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÀ") for _ in range(rng.randint(7, 9))) for _ in range(150)]
    return [(i, " ".join(w.title() for w in words for _ in range(min(200, int(rng.paretovariate(0.6)))) if rng.random() < 0.1), "en") for i in range(n)]


@pytest.mark.parametrize("most", [20_000, 6])
def test_variants_are_those_of_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(spelling, "STATE_WORDS", most)  # few words a state: stretches are split to single letters
    rows = close_words(most, 60) + AWKWARD + [(i, "receive " * 30 + "recieves recieves receives receives " + "receivesx " * (i % 2), "en") for i in range(9)]
    got = sorted((tuple(r) for r in spelling.variants(documents(spark, rows), "doc_id", "text").collect()), key=lambda r: r[0])
    assert got == plain_variants(rows) and any(r[1] for r in got)


def test_roots_follow_every_link(spark):
    rows = [(i, "commoner " * 300 + "commonerr " * 3, "en") for i in range(40)] + [(90, "commonerrr commonerrr", "en")]
    got = {r.word: (r.form, r.root) for r in spelling.variants(documents(spark, rows), "doc_id", "text").collect()}
    assert got["commonerrr"] == ("commonerr", "commoner") and got["commoner"] == (None, "commoner")


def test_acceptors_are_minimal():
    machine = spelling.Acceptors()
    first = machine.build(sorted(a + b for a in "abcd" for b in ["en", "es"]))
    assert len(machine.arcs) == 4 and len(set(map(id, machine.arcs[first].values()))) >= 1
    assert sorted(machine.rests(first, first)) == sorted(a + b for a in "abcd" for b in ["en", "es"])
    assert sorted(machine.replaced(first)) == sorted({tuple(sorted((u, v))) for u in machine.rests(first, first) for v in machine.rests(first, first) if edits_apart(u, v)})


def test_very_long_words_and_no_words(spark):
    long = "ab" * 600
    rows = [(1, f"{long} {long} {long}", "en"), (2, f"{long[:-1]} {long[:-1]}", "en"), (3, "short one", "en")]
    got = {r.word: r.n_near for r in spelling.variants(documents(spark, rows), "doc_id", "text").collect()}
    assert got == {w: len([v for v in got if edits_apart(w, v)]) for w in got} and len(got) >= 2
    assert spelling.variants(documents(spark, []), "doc_id", "text").count() == 0
    assert spelling.variants(documents(spark, AWKWARD[:4]), "doc_id", "text").count() == 0


# Quality rules ------------------------------------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    words = re.findall("[^ \t-\r]+", text)
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, c in Counter(windows).items() if c > 1}
    spots = {i + j for i, w in enumerate(windows) if w in twice for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(spots), len(re.findall("[A-Z]", text))


def test_measures_are_those_of_plain_counting(monkeypatch):
    monkeypatch.setattr(quality_rules, "BLOCK", 16)
    for text in [t for _, t, _ in prose(5, 60) + AWKWARD] + ["a\n a\na\n\na", "x y z x y z", "a b c a b", "ÄB #|<>  \x1c é\x0bq"]:
        assert quality_rules.measured(None if text is None else text.encode()) == plain_measures(text)


def test_exact_binomial_tails():
    for n, k, p in [(5, 2, 0.3), (85, 0, 0.05), (400, 3, 0.02), (1, 0, 0.5)]:
        assert math.isclose(quality_rules.lower_tail(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)


def labelled(rng, n, share_of_noisy_good):
    """Texts of which bad ones hold symbols; some good ones do too."""
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        noisy = bad or rng.random() < share_of_noisy_good
        docs.append((i, " ".join(f"{rng.choice('bcdfg')}{rng.randrange(10**6)}{'#%' if noisy else ''}" for _ in range(60)), "en" if i % 3 else "de"))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_certified_rules_reject_bad_texts(spark):
    docs, labels = labelled(random.Random(1), 3000, 0.0)
    got = quality_rules.judge(documents(spark, docs), "doc_id", "text", "lang", spark.createDataFrame(labels, "doc_id long, quality int"), "quality").collect()
    truth = dict(labels)
    assert all(r.stratum_certified and not r.base_failed for r in got)
    assert not any(r.kept for r in got if truth[r.doc_id] == 0)
    assert sum(not r.kept for r in got if truth[r.doc_id]) <= 0.02 * 2250


def test_no_rule_without_evidence(spark):
    """Too few holdouts, or good texts that a cutoff would reject too often: only the base rejects."""
    for n, share in ((200, 0.0), (3000, 0.2)):
        docs, labels = labelled(random.Random(2), n, share)
        got = quality_rules.judge(documents(spark, docs), "doc_id", "text", "lang", spark.createDataFrame(labels, "doc_id long, quality int"), "quality")
        good = {i for i, q in labels if q == 1}
        lost = [r.doc_id for r in got.collect() if not r.kept and r.doc_id in good]
        assert len(lost) <= 0.02 * len(good)


def test_copies_are_no_evidence(spark):
    docs, labels = labelled(random.Random(3), 60, 0.0)
    docs, labels = [(i, docs[i % 60][1], docs[i % 60][2]) for i in range(3000)], [(i, labels[i % 60][1]) for i in range(3000)]
    got = quality_rules.judge(documents(spark, docs), "doc_id", "text", "lang", spark.createDataFrame(labels, "doc_id long, quality int"), "quality")
    assert got.where("not kept").count() == 0


def test_awkward_rows_get_base_verdicts(spark):
    labels = spark.createDataFrame([(None, 1), (7, None), (8, 1), (8, 0)], "doc_id long, quality int")
    docs = documents(spark, AWKWARD)
    got = quality_rules.judge(docs, "doc_id", "text", "lang", labels, "quality").collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[:8]) for r in got), key=key) == sorted(((i, *plain_measures(t)) for i, t, _ in AWKWARD), key=key)
    assert all(r.kept == (not r.base_failed) for r in got) and not any(r.stratum_certified for r in got)
    assert quality_rules.judge(documents(spark, []), "doc_id", "text", "lang", labels, "quality").count() == 0
    assert quality_rules.judge(docs, "doc_id", "text", "lang", labels.limit(0), "quality").count() == len(AWKWARD)
