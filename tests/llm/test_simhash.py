import random
import re

import numpy as np
import xxhash

from factloom.llm import simhash


def slow_print(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def slow_components(rows, radius=4):
    prints = [slow_print(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                group[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(d, low.get(top(i), d))
    return sorted((str(d), f"{p:016x}", low.get(top(i))) for i, ((d, _), p) in enumerate(zip(rows, prints)))


def texts():
    base = [f"w{i * 7 % 50} A{i} É{i % 3} x\x0by" for i in range(60)]
    rows = [(i, " ".join(base[i % 20 : i % 20 + 1 + i % 12])) for i in range(80)]
    rows += [(i + 80, " ".join(base) + " tail" * (i % 3)) for i in range(40)]
    return rows + [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (203, "one"), (None, "one"), (204, "a b c"), (205, "word " * 5000)]


def test_same_as_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"f0": simhash.F.lit(1), "node": simhash.F.lit("x")})
    for tile in (4096, 3):
        got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, tile=tile).collect())
        assert got == slow_components(rows)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tiles_are_skipped():
    """Tile pairs are skipped by population count, and nothing is lost by it."""
    rng = np.random.default_rng(2)
    share = rng.random(1500)[:, None]
    prints = np.packbits(rng.random((1500, 64)) < share, axis=1).view(np.uint64)
    prints = np.concatenate([prints, prints[:200] ^ (np.uint64(1) << rng.integers(0, 64, (200, 1)).astype(np.uint64))])
    ones = np.sort(np.bitwise_count(prints[:, 0]).astype(np.int64))
    taken = list(simhash.tile_pairs(ones, ones, 4, 64))
    every = -(-len(ones) // 64)
    assert len(taken) < every * every / 3
    i, j = simhash.tiles_within(prints, prints, 4)
    diff = np.bitwise_count(prints[:, None, 0] ^ prints[None, :, 0])
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(diff <= 4))))


def test_stage_with_repeated_ids(spark):
    """Of two texts with one id the same one stays whatever the order of rows; of repeated rows one stays."""
    other = [f"z{i}" for i in range(50)]
    rows = [(1, "a b c d e f g", "x"), (1, " ".join(other), "y"), (2, " ".join(other), "z"), (3, "same row here", "q"), (3, "same row here", "q"), (None, "n", "m"), (None, "n", "m")]
    seen = []
    for part in (1, 3, 5):
        for order in (rows, rows[::-1]):
            df = spark.createDataFrame(order, "doc_id long, text string, near_row string").repartition(part)
            seen.append(sorted(map(str, simhash.keep_first(spark, df, "").collect())))
    assert all(s == seen[0] for s in seen)
    assert sum("doc_id=1," in r for r in seen[0]) == 1 and sum("doc_id=3" in r for r in seen[0]) == 1 and sum("None" in r for r in seen[0]) == 2
    assert any("z49" in r for r in seen[0])


def test_stage_keeps_one_of_each_group(spark):
    words = [f"v{i * i % 997}" for i in range(400)]
    near = words[:200] + ["changed"] + words[201:]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (9, " ".join(words)), (9, " ".join(words)), (4, " ".join(reversed(words))), (None, "x"), (7, None), (8, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, f0 int")
    got = simhash.keep_first(spark, df, "")
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["3", "4", "7", "None"]


def slow_kept(rows):
    """doc_ids that stay, by all pairs of shingle sets."""
    sets = []
    for _, t in rows:
        words = t.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = {d: d for d, _ in rows}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((top(rows[i][0]), top(rows[j][0])))
                group[b] = a
    return sorted(d for d in group if group[d] == d)


def test_stage_same_as_all_pairs_by_jaccard(spark):
    rng = random.Random(5)
    rows = []
    for family in range(40):
        base = [f"f{family}w{rng.randrange(10**6)}" for _ in range(rng.choice([4, 8, 9, 12, 60, 200, 400]))]
        rows.append(" ".join(base))
        for _ in range(8):  # a replaced word changes five shingles: similarities from 0.4 to 1, most close to 0.8
            copy = list(base)
            for _ in range(rng.choice([0, 1, len(base) // 60, len(base) // 45, len(base) // 40, len(base) // 25])):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**9)}"
            rows.append(" ".join(copy[: len(copy) - rng.choice([0, 0, 1, len(copy) // 6])]))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for other in ({}, {"tile": 64, "block": 8}):
        assert sorted(r.doc_id for r in simhash.keep_first(spark, df, "", **other).collect()) == slow_kept(rows)


def test_alike_same_as_sets():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(40)]
    every = base + [np.unique(np.append(x[: len(x) - 1], 99).astype(np.uint64)) for x in base] + [np.zeros(0, np.uint64)] * 2
    i, j = simhash.alike(every, every)
    want = [(a, b) for a, x in enumerate(every) for b, y in enumerate(every) if 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y))]
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(want)


def test_many_texts_nearly_alike(spark):
    """A large group of texts just below and just above the least similarity: no pairs are written for it."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(500):
        copy = list(base)
        for _ in range(2 if i < 400 else 1):
            copy[rng.randrange(5, 55)] = f"c{i}x{rng.random()}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_first(spark, df, "").collect()) == slow_kept(rows)
