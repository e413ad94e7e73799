import zlib

import corpus_pipeline
import numpy as np
from factloom.llm import mixing, quality
from factloom.llm.common import Scratch


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before, scratch, seen = docs, Scratch(spark), [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.cut(stage(spark, docs, d))
        if name != "packing":
            assert out.schema.names == before.schema.names
            assert out.select("doc_id").exceptAll(docs.select("doc_id").distinct()).count() == 0 or name == "mixture"
        docs = out
        seen.append(docs.count())
    assert seen[1] > 0.7 * seen[0] and 0 < seen[2] <= seen[1] and seen[3] == seen[2]
    words = out.selectExpr("sum(length)").first()[0]
    assert words > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "secrets", "mixture", "packing"]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0
        docs = docs if "text" in docs.columns else docs


def masked(text, spans):
    """text with each run of overlapping spans replaced by the mark, by a plain walk."""
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_run_same_as_plain_stages(spark, tmp_path):
    """run() against plain programs: all pairs by shingles, patterns and entropy by hand, the JSON tokenizer."""
    import public_tokenizers
    import test_secrets
    import test_simhash
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.001"
    key = "wJalrXUtnFEMI7K8MDENG9bPxR"
    docs = spark.read.parquet(f"{d}/documents.parquet").where("n_chars < 4000").limit(90)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows += [(5000 + i, (t or "") + extra, lang, source, 0) for i, (_, t, lang, source, _) in enumerate(rows[:30]) for extra in [("", f" token={key} and more", f" {key}/x9 end")[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{d}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    text = {r[0]: r[1] or "" for r in rows}
    good = {r.doc_id for r in quality.score_documents(df, labels).collect() if r.predicted == 1}
    kept = test_simhash.slow_kept([(i, text[i]) for i in sorted(good)])
    shown = {}
    for i in kept:
        spans = test_secrets.slow(text[i])[2]
        shown[i] = masked(text[i], [tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s])
    left = spark.createDataFrame([(i, shown[i], next(r[3] for r in rows if r[0] == i)) for i in kept], "doc_id long, text string, source string")
    copies = {r.doc_id: r.taken // max(1, r.size) for r in mixing.mix(left).collect()}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    seen = {}
    for r in got:
        ids = [*t.encode(shown[r.doc_id], add_special_tokens=False).ids, 0]
        part = np.array(ids[r.start : r.start + r.length], "<u4")
        assert r.doc_tokens == len(ids) and zlib.crc32(part.tobytes()) == r.ids_crc32
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert {i: n // len([*t.encode(shown[i], add_special_tokens=False).ids, 0]) for i, n in seen.items()} == {i: n for i, n in copies.items() if n}
    assert len(good) < len(rows) and len(kept) < len(good) and any("[SECRET]" in x for x in shown.values())
