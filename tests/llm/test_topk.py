import math
import random

from factloom.llm import topk


def slow(rows, every, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in good:
        if i % every == 0:
            asked[i] = max(v, asked.get(i, v))
    out = []
    for q, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def rows(scale=1.0):
    rng = random.Random(11)
    base = [[rng.gauss(0, scale) for _ in range(20)] for _ in range(6)]
    out = [(i, [x * rng.choice([0.2, 1, 3]) + rng.gauss(0, 0.3 * scale) for x in rng.choice(base)]) for i in range(400)]
    out += [(500, None), (None, base[0]), (510, [None] * 20), (520, [float("nan")] * 20), (530, [float("inf")] * 20), (540, [0.0] * 20), (550, base[1]), (551, base[1]), (551, base[1]), (560, base[1]), (560, base[1])]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, place int")
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, **kw).collect())


def test_same_as_brute_force(spark):
    assert run(spark, rows(), every=10) == slow(rows(), 10, 5)
    assert run(spark, rows(), every=10, tile=16, block=7) == slow(rows(), 10, 5)


def test_products_beyond_doubles(spark):
    big = [(i, [x * 2.0**18 for x in v or []]) for i, v in rows()[:60]]
    assert run(spark, big, every=10) == slow(big, 10, 5)


def test_few_or_none(spark):
    assert run(spark, rows()[:3], every=1) == slow(rows()[:3], 1, 5)
    assert run(spark, []) == []


def test_copies_of_blocks_are_not_broadcast(spark):
    """Only lists of places and one tile may be; a block's copies, one a tile, are shuffled."""
    df = spark.createDataFrame(rows(), "vec_id long, embedding array<double>")
    out = topk.top_k(df, every=10, tile=16, block=7)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [place" in plan and "BroadcastHashJoin [place" not in plan
