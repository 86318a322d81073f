"""Subspace pigeonhole join against all pairs."""

import numpy as np
import pytest

from tessera.llm import vector_join as V


def brute(rows, cosine):
    ok = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, _, _ in rows}
    root = {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, x, l) in enumerate(ok):
        for j, y, m in ok[k + 1 :]:
            if l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(((i, links[i], find(i), i == find(i)) for i, _, _ in rows), key=str)


@pytest.mark.parametrize(("dims", "cosine", "rows_of_cell"), [(64, 0.93, 2048), (20, 0.9, 8), (3, 0.99, 5)])
def test_against_all_pairs(spark, monkeypatch, dims, cosine, rows_of_cell):
    monkeypatch.setattr(V, "CELL_ROWS", rows_of_cell)
    rnd = np.random.default_rng(dims)
    centres = rnd.standard_normal((12, dims))
    rows = []
    for i in range(260):
        x = centres[i % 12] + rnd.standard_normal(dims) * rnd.choice([0.05, 0.2, 0.4])
        rows.append((i * 3, [float(np.float32(v)) for v in x * rnd.choice([1, 7.5])], int(rnd.integers(0, 3)) if i % 40 else None))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(20)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * dims, 1), (2003, [None] + [1.0] * (dims - 1), 1), (2004, [float("nan")] * dims, 1), (2005, [float("inf")] * dims, 1), (2006, [1.0] * (dims + 1), 1), (2007, [2.0] * (dims + 1), 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = sorted((tuple(r) for r in V.near_vectors(df, cosine).collect()), key=str)
    assert got == brute(rows, cosine)


def test_odd_tables(spark):
    assert V.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), 0.9).count() == 0
    rows = [(None, [1.0, 2.0], 1), (1, [1e300, 1e300], 1), (2, [1e-300, 1e-300], 1), (3, [1.0, 1.0], 1)]
    got = sorted((tuple(r) for r in V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.9).collect()), key=str)
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (None, 0, None, True)]
