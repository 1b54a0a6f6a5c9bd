"""Vectors against brute force."""

import numpy as np

from tallywake.llm import embedding


def brute(rows):
    n = len(rows)
    link = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            a, b = embedding.unit_of(rows[i][1]), embedding.unit_of(rows[j][1])
            if i != j and a is not None and b is not None and len(a) == len(b) and rows[i][2] is not None and rows[i][2] == rows[j][2]:
                link[i][j] = a @ b >= embedding.COSINE
    comp = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    low = {}
    for i in range(n):
        low[comp[i]] = min(low.get(comp[i], 1 << 60), rows[i][0])
    return sorted((r[0], sum(link[i]), low[comp[i]], r[0] == low[comp[i]]) for i, r in enumerate(rows))


def test_links_and_components(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(6):
        base = rng.normal(size=32)
        for _ in range(12):
            rows.append((len(rows), (base + rng.normal(size=32) * 0.22).tolist(), g % 2))
    rows += [(100, None, 0), (101, [0.0] * 32, 0), (102, [float("nan")] * 32, 0), (103, [1.0, None], 0), (104, rows[0][1], None), (105, rows[0][1], 0), (106, rows[0][1], 0), (107, [], 0), (108, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(i, v, l, "x") for i, v, l in rows], "vec_id long, embedding array<double>, label int, cid string")
    for run in (embedding.RUN, 4):  # one block, and many
        got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding.near_vectors(df, run=run).collect())
        assert got == brute(rows)
    assert embedding.near_vectors(df.limit(0)).count() == 0


def test_recall():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1)[:, None]
    x, y = embedding.buckets(embedding.codes(a)), embedding.buckets(embedding.codes(b))
    assert (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean() >= 0.99
