"""Recall of the nearest neighbours where the sample is far above the given tables, against brute force."""

import numpy as np

from rentflow.llm import neighbours
from rentflow.llm.common import read


def test_effort_grows_slower_than_the_table():
    share = [neighbours.effort(n, round(np.log2(n / neighbours.LEAF_ROWS))) * n / 2 ** round(np.log2(n / neighbours.LEAF_ROWS)) / n for n in (500, 2000, 10_000, 50_000, 150_000, 10**9)]
    assert share == sorted(share, reverse=True) and share[-1] < 0.01


def test_recall_above_the_sample(spark, sf_dir):
    rows = read(spark, sf_dir.replace("0.001", "0.1"), "embeddings").select("vec_id", "embedding").orderBy("vec_id").collect()
    given = np.array([r.embedding for r in rows if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)])
    # The given components, each dealt anew over the rows: no clusters, so the neighbours are hard to find.
    rng = np.random.default_rng(11)
    x = np.stack([rng.choice(given[:, j], 10_000) for j in range(given.shape[1])], axis=1)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, "vec_id", "embedding", df.where("vec_id % 250 = 0"), k=10, sample_rows=5000).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 250):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got.get(q, set()) & set(np.argsort(d)[:10].tolist()))
    print("recall", hits / 400)
    assert hits >= 0.9 * 400
