import random
import re

from factloom.llm import mixing


def slow_targets(sizes):
    """sizes by source in order, null last; reshared by weight until none is above."""
    total, weights = 1.5 * sum(sizes), [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    capped = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(2 * sizes[i] for i in capped)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > 2 * sizes[i]}
        if not over:
            return [2 * sizes[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 40), rng.choice(["b", "a", "é", "Z", None, "hot", "hot", "hot"])) for i in range(900)]
    rows += [(1000, None, "a"), (1001, "", "none"), (1002, " x\x0by\tz z ", "b"), (None, "q q", "a"), (1003, "r", "a"), (1003, "r", "a")]
    rows += [(2000 + i, "same " * 9, "hot") for i in range(700)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), size(t)) for d, t, _ in rows)
    sources = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sums = [sum(size(t) for _, t, s in rows if s == x) for x in sources]
    want = dict(zip(sources, zip(sums, slow_targets(sums))))
    source = {d: s for d, _, s in rows}
    taken = dict.fromkeys(sources, 0)
    for r in got:
        s = source[r.doc_id] if r.doc_id is not None else "a"
        assert r.source_size == want[s][0] and abs(r.target - want[s][1]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in sources:
        assert abs(taken[s] - want[s][1]) <= 1
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    rows_out = mixing.repeat_rows(spark, df, "")
    assert rows_out.columns == df.columns
    assert sorted(str(r.doc_id) for r in rows_out.collect()) == sorted(str(r.doc_id) for r in got for _ in range(r.taken // max(1, r.size)))


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_fit_is_exact():
    rng = random.Random(4)
    for _ in range(60):
        lengths = rng.sample(range(2, 30), rng.randint(1, 5))
        counts = [rng.randint(0, 3) for _ in lengths]
        budget = rng.randint(0, 90)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        out = mixing.fit(lengths, counts, budget)
        assert all(a <= b for a, b in zip(out, counts))
        assert abs(sum(a * b for a, b in zip(out, lengths)) - budget) == min(abs(s - budget) for s in sums)


def test_repeated_rows_and_both_joins(spark, tmp_path, monkeypatch):
    rows = [(None, "a b c", "x", 1)] * 50 + [(7, "d e f", "x", 1)] * 50 + [(8, "d e f", "x", 1), (9, None, "x", 1), (10, "", None, 1)] + [(100 + i, "g h", None, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_h int").repartition(3)
    df.write.parquet(f"{tmp_path}/d")
    seen = []
    for docs, limit in ((df, 1 << 20), (spark.read.parquet(f"{tmp_path}/d"), 1 << 20), (spark.read.parquet(f"{tmp_path}/d"), -1)):
        monkeypatch.setattr(mixing, "BROADCAST_BYTES", limit)
        got = mixing.repeat_rows(spark, docs, "")
        assert got.columns == df.columns
        seen.append(sorted(map(str, got.collect())))
    assert seen[0] == seen[1] == seen[2]
    # sources x and null weigh 5 and 2; x is given 150 % * 383 words * 5 / 7 = 410, null its most of 2 * 80
    taken = {s: sum(len(r.text.split()) for r in got.collect() if r.source == s) for s in ("x", None)}
    assert abs(taken["x"] - (1.5 * 383 - 160)) <= 3 and taken[None] == 160
