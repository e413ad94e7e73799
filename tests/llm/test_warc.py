import hashlib

import pytest

from factloom.llm import warc
from factloom.llm.common import Scratch


def rows():
    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 30000
    out = [(5, "http://a/x", "<html>" * 30), (2, "http://b", "<html>" * 30), (9, None, "<html>" * 30), (None, "u", "<html>" * 30), (7, "u v\r\nw", "short"), (8, "", "short")]
    out += [(10, "z", None), (11, "z", ""), (12, "big", big), (3, "big", big), (13, "big", big[:-1]), (20, "twice", "same" * 40), (20, "twice", "same" * 40), (None, "n", "lone" * 40), (None, "n", "lone" * 40)]
    return out


def want(rows):
    low = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and p is not None:
            low[b] = min(p, low.get(b, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        first = low.get(b)
        again = first is not None and (p is None or p > first)
        out.append((str(p), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x") for r in rows()], "page_id long, url string, html string, payload string").repartition(3)
    table = warc.write_archives(df, Scratch(spark))
    got = warc.read_archives(table).collect()
    assert sorted(((str(r.page_id), *r[1:5]) for r in got), key=str) == want(rows())
    assert table.selectExpr("max(octet_length(data))").first()[0] <= warc.CHUNK + 4
    assert table.where("chunk > 5").count() > 0
    warc.export(table, str(tmp_path))
    found = []
    for f in tmp_path.iterdir():
        reader, raw = warc.Reader(), f.read_bytes()
        for at in range(0, len(raw), 777):
            found += list(reader.feed(raw[at : at + 777]))
    assert sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=str) == want(rows())


def test_damage_shows():
    parts = list(warc.chunks(1, "u", hashlib.sha256(b"x" * 200000).hexdigest(), memoryview(b"x" * 200000), None))
    stored = [(0, 0, k, *p) for k, p in enumerate(parts)]
    assert len(list(warc.parse(stored))) == 1
    with pytest.raises(ValueError):
        list(warc.parse(stored[:2] + stored[3:]))
    with pytest.raises(ValueError):
        list(warc.parse([(*r[:4], r[4].replace(b"x", b"y", 1), r[5]) for r in stored]))


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
