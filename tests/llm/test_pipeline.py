"""Each stage of the pipeline against a plain version of its decision on the same input."""

import corpus_pipeline as p
import pytest

from rentflow.llm import queries
from rentflow.llm.common import materialise, read


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs, out = read(spark, sf_dir, "documents"), []
    for name, stage in p.STAGES:
        after = materialise(stage(spark, docs, sf_dir), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_all_but_the_last_keep_the_columns(steps):
    for name, (before, after) in steps.items():
        if name != p.STAGES[-1][0]:
            assert after.columns == before.columns and [t for _, t in after.dtypes] == [t for _, t in before.dtypes]


def test_run_is_the_stages(spark, sf_dir, steps):
    last = steps[p.STAGES[-1][0]][1]
    order = lambda df: sorted((r.doc_id, tuple(r.piece_ids or ())) for r in df.collect())
    assert order(p.run(spark, sf_dir)) == order(last)


def test_one_document_of_each_class_stays(spark, steps):
    before, after = steps["ngram_jaccard_join"]
    before.createOrReplaceTempView("before")
    texts = {r.doc_id: r.text for r in before.collect()}
    shingles = {}
    for i, t in texts.items():
        import re

        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        shingles[i] = {" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    ids, root = sorted(texts), {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = shingles[a], shingles[b]
            if x and y and 10 * len(x & y) >= 8 * len(x | y):
                root[max(top(a), top(b))] = min(top(a), top(b))
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == [i for i in ids if top(i) == i]


def test_repeats_go_and_every_document_stays(steps):
    from test_brute_force import repeats

    before, after = steps["suffix_array_dedup"]
    kept = {r.doc_id: r.text for r in after.collect()}
    had = {r.doc_id: r.text for r in before.collect()}
    assert set(kept) == set(had)
    for i, (_, removed, _, _) in repeats(had).items():
        if not removed:
            assert kept[i] == had[i]
        else:
            assert len(kept[i].encode()) <= len(had[i].encode())


def test_contaminated_documents_go(spark, sf_dir, steps):
    before, after = steps["decontamination"]
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    hits = queries.contained(before, "doc_id", "text", read(spark, sf_dir, "benchmark"), "item_id", "text")
    assert gone == {r.doc_id for r in hits.collect()}
