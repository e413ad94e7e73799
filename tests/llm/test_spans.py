import itertools
import random
import re

import numpy as np

from factloom.llm import exchange, spans


def mark(word):
    """The hash by which words of long sentences are compared."""
    full = 2**64 - 1
    h = len(word)
    for k in range(8):
        h = (h * 0x9E3779B97F4A7C15 & full) ^ (word[k] if k < len(word) else 0)
    h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & full
    return h ^ h >> 32


def pieces_of(raw, longest=14):
    """Places of words, in a list for each sentence or part of one."""
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    sents = []
    for i, (a, e) in enumerate(words):
        if not i or raw[words[i - 1][1] - 1 : words[i - 1][1]] in b".!?" or b"\n" in raw[words[i - 1][1] : a]:
            sents.append([])
        sents[-1].append((a, e))
    out = []
    for s in sents:
        cut = {0}
        if len(s) > longest:
            h = [mark(raw[a:e]) for a, e in s]
            near = longest // 2
            for i in range(len(s) - near + 1):
                cut.add(max(range(i, i + near), key=lambda k: (-h[k], k)))
        edges = [*sorted(cut), len(s)]
        out += [s[a:b] for a, b in zip(edges, edges[1:])]
    return out


def slow(rows):
    found, parts = {}, []
    for r, (d, t) in enumerate(rows):
        raw = (t or "").encode()
        pieces = pieces_of(raw)
        parts.append((raw, pieces))
        for i in range(len(pieces)):
            j = i + 2
            while j <= len(pieces) and sum(map(len, pieces[i:j])) < 20:
                j += 1
            if j <= len(pieces):
                found.setdefault(raw[pieces[i][0][0] : pieces[j - 1][-1][1]], []).append((float("inf") if d is None else d, pieces[i][0][0], r, i, j))
    gone = set()
    for occ in found.values():
        for _, _, r, i, j in sorted(occ)[1:]:
            gone |= {(r, k) for k in range(i, j)}
    out = []
    for r, ((d, _), (raw, pieces)) in enumerate(zip(rows, parts)):
        at = [0, *[p[0][0] for p in pieces[1:]], len(raw)]
        kept = b"".join(raw[at[k] : at[k + 1]] for k in range(max(1, len(pieces))) if (r, k) not in gone)
        out.append((str(d), len(pieces), sum((r, k) in gone for k in range(len(pieces))), kept.decode()))
    return sorted(out)


def test_same_as_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aéb") for _ in range(rng.randint(2, 6)))
    sentence = lambda: " ".join(word() for _ in range(rng.choice([2, 7, 20, 40]))) + rng.choice([". ", "!\n", "\n ", "?  "])
    passages = ["".join(sentence() for _ in range(6)) for _ in range(8)]
    rows = [(i, "".join(rng.choice(passages) + sentence() for _ in range(rng.randint(0, 4)))) for i in range(60)]
    rows += [(90, None), (91, ""), (92, " \n "), (None, passages[0]), (93, passages[1] * 3), (93, passages[1] * 3), (94, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("data", spans.F.lit(1)).coalesce(1)
    got = sorted((str(r.doc_id), r.n_sentences, r.n_removed, r.text) for r in spans.remove_passages(df).collect())
    assert got == slow(rows)


def test_many_small_batches(spark, monkeypatch):
    """Texts in many batches: the same result, and texts are not shuffled for the answers."""
    rng = random.Random(7)
    shared = " ".join(f"shared{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 90))) + (". " + shared if i % 3 else "") + " end" * (i % 4)) for i in range(60)] + [(100, "long " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(exchange, "BATCH_BYTES", 2000)
    out = spans.remove_passages(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((str(r.doc_id), r.n_sentences, r.n_removed, r.text) for r in out.collect()) == slow(rows)
    assert not exchange.bucket_of(np.array([5, 2**40 + 3]), 7).tolist() == [0, 0]
    numbers = np.fromiter(itertools.islice(exchange.numbers(9, 7), 50), np.int64)
    real = [r.b for r in spark.createDataFrame([(int(n),) for n in numbers], "n long").selectExpr("pmod(hash(n), 7) as b").collect()]
    assert real == [9 % 7] * 50


def test_passages_in_mid_sentence(spark):
    """Passages of 51 to 80 words, planted in the middle of longer sentences of other documents, lose most of their words."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    def run(n):
        return " ".join(word() + rng.choice(["", "", "", "", "", "", "", ".", ","]) for _ in range(n))

    passages = [run(rng.randint(51, 80)) for _ in range(60)]
    rows = [(i, f"{run(rng.randint(5, 40))} {p} {run(rng.randint(5, 40))}") for i, p in enumerate(passages)]
    rows += [(100 + i, f"{run(rng.randint(3, 40))} {p} {run(rng.randint(3, 40))}") for i, p in enumerate(passages)]
    rows += [(200 + i, run(120)) for i in range(60)]
    got = {r.doc_id: r.text for r in spans.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = []
    for d, t in rows:
        if 100 <= d < 200:
            p = passages[d - 100].split()
            lost.append(1 - sum(w in set(got[d].split()) for w in p) / len(p))
        else:
            assert got[d] == t
    assert min(lost) > 0.25 and sum(lost) / len(lost) > 0.7


def test_empty(spark):
    assert spans.remove_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
