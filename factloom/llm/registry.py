"""The queries of this package and the SQL of those that SQL can express."""

import corpus_pipeline

from .mixing import op9_source_mixing
from .multi_index import op2_multi_index_dedup
from .packing import op5_window_packing
from .quality import op7_quality_scores
from .secrets import op8_secret_scans
from .simhash import op3_simhash_dedup
from .spans import op10_sentence_spans
from .suffix import op4_suffix_dedup
from .topk import op6_exact_top_k
from .warc import op1_warc_records

QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_records, op2_multi_index_dedup, op3_simhash_dedup, op4_suffix_dedup, op5_window_packing,
        op6_exact_top_k, op7_quality_scores, op8_secret_scans, op9_source_mixing, op10_sentence_spans,
    )
} | {"pipeline": corpus_pipeline.run}

#: What DuckDB can compute: the rest is tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op1_warc_records": """
        with p as (select page_id, coalesce(html, '') as body from pages),
        d as (select page_id, strlen(body) as n, sha256(body) as digest from p),
        f as (select digest, min(page_id) as first_id from d where n >= 100 group by digest)
        select d.page_id, d.n as payload_bytes, d.digest as payload_digest,
               case when d.page_id > f.first_id then 'revisit' else 'response' end as record_type,
               case when d.page_id > f.first_id then f.first_id end as refers_to
        from d left join f using (digest)""",
    "op4_suffix_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
        w as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, n - 49)) as i from d)),
        m as (select s, min(doc_id) as low from w group by s),
        o as (select w.doc_id, i, case when i - lag(i) over (partition by w.doc_id order by i) <= 50 then 0 else 1 end as new from w join m on m.s = w.s where w.doc_id > m.low),
        r as (select doc_id, i, sum(new) over (partition by doc_id order by i) as k from o),
        spans as (select doc_id, min(i) as a, max(i) + 50 as b from r group by doc_id, k),
        pieces as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as x, a as y from spans
                   union all select doc_id, coalesce(max(b), 0), max(n) from d left join spans using (doc_id) group by doc_id),
        kept as (select doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' order by x) as k from pieces join d using (doc_id) group by doc_id),
        t as (select doc_id, count(*) as n_spans, sum(b - a)::bigint as n_removed from spans group by doc_id)
        select d.doc_id, d.n as n_bytes, coalesce(t.n_removed, 0) as n_removed, coalesce(t.n_spans, 0) as n_spans, sha256(unhex(kept.k)) as kept_sha256
        from d join kept using (doc_id) left join t using (doc_id)""",
    "op6_exact_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as e
                   from embeddings where embedding is not null),
        s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
              from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5""",
    "op2_multi_index_dedup": """
        with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where label is not null and embedding is not null),
        l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(a, b) as (select a, b from l union select r.a, l.b from reach r join l on r.b = l.a),
        low as (select a, min(b) as m from reach group by a),
        n as (select a, count(*) as n from l group by a)
        select e.vec_id, coalesce(n.n, 0) as n_links, least(e.vec_id, coalesce(low.m, e.vec_id)) as component_id,
               e.vec_id = least(e.vec_id, coalesce(low.m, e.vec_id)) as kept
        from embeddings e left join n on n.a = e.vec_id left join low on low.a = e.vec_id""",
}
