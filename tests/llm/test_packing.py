import random
import zlib

import numpy as np

from factloom.llm import packing


def slow_cost(places, penalty, window):
    best = [0.0] + [float("inf")] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            n = int(places[j] - places[i])
            if n <= window:
                best[j] = min(best[j], best[i] + (0 if n & n - 1 == 0 else window - n) + penalty[j])
    return best[-1]


def test_cuts_are_best():
    rng = random.Random(1)
    for _ in range(80):
        places = np.unique(np.cumsum([0] + [rng.randint(1, 9) for _ in range(rng.randint(1, 40))]))
        penalty = np.array([rng.choice([0.0, 1.0, 5.0]) for _ in places])
        at = packing.cuts(places, penalty, 16)
        n = np.diff(places[at])
        assert at[0] == 0 and at[-1] == len(places) - 1 and (n <= 16).all()
        cost = sum((0 if k & k - 1 == 0 else 16 - k) for k in n.tolist()) + sum(penalty[at[1:]])
        assert abs(cost - slow_cost(places, penalty, 16)) < 1e-9


def texts():
    rng = random.Random(6)
    words = ["the", "thnd.", "l'éau", "it's", "12345", "###", "a\nb", "naïve!", "日本", "x" * 60, "<|endoftext|>", " ", "don't\n", ""]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 50, 700, 3000]))) for _ in range(60)] + ["", " ", "  a   b ", "\n\n x", "junk" * 20000]


def test_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*enumerate(texts()), (500, None), (None, "no id."), (501, "twice. "), (501, "twice. ")]
    want = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in rows}
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").repartition(2)
    got = packing.pack(df).collect()
    docs, sequences = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        assert ids == want[r.doc_id][r.start : r.start + r.length]
        docs.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, ids in want.items():
        seen = sorted(k for s, n in docs[d] for k in range(s, s + n))
        assert seen == sorted(list(range(len(ids))) * (2 if d == 501 else 1))
    padding = total = 0
    for parts in sequences.values():
        parts.sort()
        n = sum(k for _, k in parts)
        assert [o for o, _ in parts] == np.cumsum([0] + [k for _, k in parts])[:-1].tolist() and n <= 1024
        padding += 0 if n & n - 1 == 0 else 1024 - n
        total += n
    assert padding < 0.02 * total


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_added_tokens_as_the_json_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t, own, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Tokens(), random.Random(3)
    end = "<|endoftext|>"
    bits = [end, end * 2, f"in{end}side", f" {end} ", f"{end}\n", "<|endof", "text|>", "a b", " ", ".", "\n", "é", "<|", "|>"]
    texts = [end, end * 3, f"a{end}b", f"a {end} b", f"<|end{end}oftext|>"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for x in texts:
        assert own(x).tolist() == t.encode(x, add_special_tokens=False).ids
    assert own(end).tolist() == [50256]
