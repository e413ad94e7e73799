import math
import random
import zlib

import numpy as np
import xxhash

from factloom.llm import quality

LABELS = "doc_id long, quality int"
DOCS = "doc_id long, text string, score int"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = sum(y)
    return (rank[np.array(y) == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op7_quality_scores(spark, d).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert auc([q for _, q in labels], np.array([got[i].score for i, _ in labels])) > 0.9


def test_odd_rows(spark):
    rng = random.Random(1)
    text = lambda good: " ".join(rng.choice(["fine", "words", "here"] if good else ["BAD!!", "###", "$$$"]) for _ in range(20))
    docs = [(i, text(i % 3), 7) for i in range(120)] + [(500, None, 7), (501, "", 7), (None, "fine words", 7), (5, "fine", 7), (502, "x " * 30000, 7)]
    labels = [(i, int(i % 3 > 0)) for i in range(120)] + [(5, 0), (900, 1), (None, 1), (3, None)]
    got = quality.score_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 120]) > 0.95


def test_no_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in quality.score_documents(spark.createDataFrame([(1, "a", 1)], DOCS), none).collect()] == [0.5]
    assert quality.score_documents(spark.createDataFrame([], DOCS), none).collect() == []


def test_vectors_and_network_by_plain_loops():
    """Context sums, pooling and the forward pass against loops over words, rows and units."""
    rng = random.Random(6)
    words = ["Fine", "words,", "HERE", "a1", "##", "é", "fine", "xxxx"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))).encode() for _ in range(12)] + [b"", None]

    def rows_of(text):
        out = []
        for w in (text or b"").split():
            kinds = ["0" if 48 <= b < 58 else "A" if 65 <= b < 91 else "a" if 97 <= b < 123 or b >= 128 else chr(b) for b in w]
            shape = "".join(c for i, c in enumerate(kinds) if not i or kinds[i - 1] != c)
            out.append((xxhash.xxh32_intdigest(w.lower()) % quality.NAMES, xxhash.xxh32_intdigest(shape.encode("latin-1")) % quality.SHAPES))
        return out

    names, shapes = quality.index_vectors()
    sums = np.zeros((quality.NAMES + quality.SHAPES, quality.WIDE))
    for t in texts:
        at = rows_of(t)
        for i, (n, s) in enumerate(at):
            for j in range(max(0, i - quality.NEAR), min(len(at), i + quality.NEAR + 1)):
                if i != j:
                    near = names[at[j][0]].astype(float) + shapes[at[j][1]]
                    sums[n] += near
                    sums[quality.NAMES + s] += near
    got = quality.context_sums(texts, names, shapes)
    assert np.allclose(got, sums, atol=1e-3)
    v = quality.Vectors(got)
    pools = []
    for t in texts:
        at = rows_of(t)
        one = sum((v.names[n].astype(float) for n, _ in at), np.zeros(quality.WIDE)) / max(1, len(at))
        two = sum((v.shapes[s].astype(float) for _, s in at), np.zeros(quality.WIDE)) / max(1, len(at))
        pools.append(np.concatenate([one, two]))
        assert np.allclose(v.pool(t, quality.Rows()), pools[-1], atol=1e-4)
    x = np.array(pools)
    net = quality.Network(x, np.array([i % 2 for i in range(len(x))], float))
    for row, score in zip(x, net.scores(x)):
        z = [(a - m) / s for a, m, s in zip(row, net.mean, net.scale)]
        hidden = [math.tanh(sum(a * net.p[0][k, j] for k, a in enumerate(z)) + net.p[1][j]) for j in range(quality.HIDDEN)]
        logit = (sum(h * w for h, w in zip(hidden, net.p[2])) + net.p[3][0]) / net.temperature
        assert abs(1 / (1 + math.exp(-max(-40, min(40, logit)))) - score) < 1e-9
