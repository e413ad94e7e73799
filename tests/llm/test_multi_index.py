import math

import numpy as np
import pytest

from factloom.llm import multi_index


def slow(rows):
    ok = [v is not None and lab is not None and i is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    scaled = [np.array(v) / np.abs(v).max() if k else None for (_, v, _), k in zip(rows, ok)]
    u = [v / np.linalg.norm(v) if k else None for v, k in zip(scaled, ok)]
    links, low = [0] * len(rows), {i: i for i, _, _ in rows if i is not None}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.93:
                links[a], links[b] = links[a] + 1, links[b] + 1
                x, y = sorted((top(rows[a][0]), top(rows[b][0])))
                low[y] = x
    return sorted((str(i), n, i if i is None else top(i)) for (i, _, _), n in zip(rows, links))


def rows():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24))
    out = []
    for i in range(500):
        b = base[rng.integers(40)] if i % 3 else rng.normal(size=24)
        out.append((i, (b + rng.normal(size=24) * rng.choice([0.02, 0.2])).tolist(), int(rng.integers(3))))
    hot = rng.normal(size=24)
    out += [(600 + i, (hot + rng.normal(size=24) * 0.05).tolist(), 1) for i in range(200)]
    nan, inf = float("nan"), float("inf")
    return out + [(900, None, 1), (901, [0.0] * 24, 1), (902, [nan] * 24, 1), (903, [inf] + [1.0] * 23, 1), (904, [None] * 24, 1), (905, hot.tolist(), None), (None, hot.tolist(), 1), (906, [1e200, 1e200], 1), (907, [1.0, 1.0], 1), (600, hot.tolist(), 1), (908, [], 1)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, row int")
    got = multi_index.near_duplicates(df, **kw).collect()
    assert all(r.kept == (r.component_id == r.vec_id) for r in got if r.vec_id is not None)
    return sorted((str(r.vec_id), r.n_links, r.component_id) for r in got)


def test_same_as_brute_force(spark):
    want = slow(rows())
    assert run(spark, rows()) == want
    assert run(spark, rows(), tile=32) == want


@pytest.mark.parametrize("vectors", [40_000, 400_000, 4_000_000])
def test_recall_at_the_threshold(vectors):
    """Pairs at exactly the least cosine: the visited cells hold at least 99 % of them, whatever the codebook's size."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = multi_index.Index(x, vectors, 0.93, 0.999)
    a = x[:1500]
    d = rng.normal(size=a.shape)
    d -= (d * a).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + (1 - 0.93**2) ** 0.5 * d / np.linalg.norm(d, axis=1, keepdims=True)
    found = [p[0] in q or q[0] in p for p, q in zip(index.cells(a), index.cells(b))]
    assert np.mean(found) >= 0.99


def test_empty(spark):
    assert run(spark, []) == []


def test_codebook_grows_with_the_vectors():
    assert multi_index.codewords(10) == multi_index.FEWEST
    for n in (10**6, 10**7, 10**8, 10**9):
        assert 0.9 * multi_index.OCCUPANCY < n / multi_index.codewords(n) ** 2 < 1.1 * multi_index.OCCUPANCY
