"""Search, ranking, metrics, routes, SQL texts and redaction applied to the tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from ..sources.tables import table
from .edges import EDGES, build_edges

QUERIES, ORACLE_SQL = {}, {}
WANTED = ["the", "eron", "heat", "thwh"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(r"""with e as (select doc_id, unnest(l) as t, unnest(range(len(l))) as i from (select doc_id, regexp_split_to_array(text, '[^A-Za-z0-9_]+') as l from documents)),
f as (select doc_id, t, min(i) as i from e where length(t) >= 2 and t not in ('AND','OR','NOT') group by 1, 2), g as (select doc_id, string_agg(t, ' ' order by i) as terms from f group by 1)
select doc_id, case when text is not null then coalesce(terms, '') end as terms from documents left join g using (doc_id)""")
def tokenize_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.array_join(T.terms(F.col("text")), " ").alias("terms"))


BM25 = r"""w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '') as l from documents),
c as (select doc_id, len(l) as n, unnest(['the','eron','heat','thwh']) as t, l from w), f as (select doc_id, n, t, len(list_filter(l, lambda x: x = t)) as tf from c),
g as (select t, count(*) as docs, count(*) filter (where tf > 0) as df, avg(n) as a from f group by t),
b as (select doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / a)) order by list_position(['the','eron','heat','thwh'], f.t)), 6) as score from f join g on g.t = f.t group by doc_id having sum(tf) > 0)"""


@query("with " + BM25 + " select doc_id, score, row_number() over (order by score desc, doc_id) as rank from b qualify rank <= 25")
def bm25_topk(spark, sf_dir):
    return S.top(S.bm25(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", WANTED), "doc_id", 25)


LINES = """l as (select doc_id, string_split(text, chr(10)) as ls from documents), e as (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from l),
h as (select doc_id, i as line, case when contains(ls[i], 'That ') then 92 else 88 end as score, array_to_string(list_slice(ls, greatest(i - 2, 1), i + 2), chr(10)) as context, row_number() over (partition by doc_id order by i) as r from e where contains(lower(ls[i]), 'that '))"""


@query("with " + LINES + " select doc_id, line, score, md5(context) as context from h where r <= 5")
def line_hits(spark, sf_dir):
    h = S.line_hits(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", "That ")
    return h.withColumn("context", F.md5("context")).withColumn("line", F.col("line").cast("long"))


@query("""with l as (select doc_id, string_split(text, chr(10)) as ls from documents), e as (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from l),
t as (select doc_id, i as line, contains(lower(ls[i]), 'eron')::int + contains(lower(ls[i]), 'heat')::int as n, case when contains(ls[i], 'That the') then 1 when contains(lower(ls[i]), 'that the') then 2 when contains(lower(ls[i]), 'eron') or contains(lower(ls[i]), 'heat') then 3 else 4 end as tier from e)
select doc_id, line, tier from t qualify row_number() over (partition by doc_id order by tier, case when tier = 3 then -n else 0 end, line) = 1""")
def best_line(spark, sf_dir):
    b = S.best_line(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", "That the", ["eron", "heat"])
    return b.withColumn("line", F.col("line").cast("long"))


@query("with " + BM25 + ", " + LINES + """, m as (select doc_id, max(s) as score from (select doc_id, 30 + case when score > 1 then 20 else 0 end as s from b union all select doc_id, score from h where r <= 5) group by doc_id)
select doc_id, score, row_number() over (order by score desc, doc_id) as rank from m join documents using (doc_id) where lang <> 'de' qualify rank <= 30""")
def hybrid_search(spark, sf_dir):
    """Ranked chunks merged with line hits, the higher score of each kept; excluded categories dropped."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang").where("lang <> 'de'")
    every = table(spark, sf_dir, "documents", "doc_id", "text")
    chunks = S.bm25(every, "doc_id", "text", WANTED).select("doc_id", (30 + F.when(F.col("score") > 1, 20).otherwise(0)).alias("score"))
    lines = S.line_hits(d, "doc_id", "text", "That ").select("doc_id", "score")
    merged = chunks.unionAll(lines).groupBy("doc_id").agg(F.max("score").alias("score")).join(d.select("doc_id"), "doc_id", "left_semi")
    return S.top(merged, "doc_id", 30)


@query("""with s as (select doc_id, substring(array_to_string(list_slice(string_split(text, chr(10)), 1, 35), chr(10)), 1, 800) as s from documents) select doc_id, length(s) as chars, greatest(1, length(s) // 4)::bigint as tokens, md5(s) as digest from s""")
def bounded_snippet(spark, sf_dir):
    s = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.snippet(F.col("text")).alias("s"))
    return s.select("doc_id", F.length("s").cast("long").alias("chars"), T.estimated_tokens(F.col("s")).alias("tokens"), F.md5("s").alias("digest"))


CANDIDATES = """x as (select d.doc_id, source, lang, 400 + 200 * quality - 150 * toxic + case when lang = 'en' then 80 else 0 end - case when n_chars > 5000 then 100 else 0 end as base from documents d join labels using (doc_id))"""


def _candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    base = 400 + 200 * F.col("quality") - 150 * F.col("toxic") + F.when(F.col("lang") == "en", 80).otherwise(0) - F.when(F.col("n_chars") > 5000, 100).otherwise(0)
    return d.select("doc_id", "source", "lang", "n_chars", base.cast("long").alias("base"))


@query("with " + CANDIDATES + """, y as (select *, row_number() over (partition by source order by base desc, doc_id) as a, row_number() over (partition by lang order by base desc, doc_id) as b from x)
select doc_id, base::bigint as base, greatest(base - case when a > 1 then 200 else 0 end - case when b > 1 then 100 else 0 end, 0)::bigint as final from y""")
def rank_candidates(spark, sf_dir):
    """Additive scores in thousandths, less penalties for sources and languages already seen."""
    return S.penalized(_candidates(spark, sf_dir), "doc_id", "base", {"source": 200, "lang": 100}).select("doc_id", "base", "final")


@query("with " + CANDIDATES + """ select doc_id, greatest(10, (40 * base + 20 * case when lang = 'en' then 1000 else 700 end + 15 * 850) // 100 * 13 // 10 - case when base < 400 then 250 else 0 end)::bigint as utility from x""")
def item_utility(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    raw = F.floor((40 * F.col("base") + 20 * F.when(F.col("lang") == "en", 1000).otherwise(700) + 15 * 850) / 100)
    return c.select("doc_id", F.greatest(F.lit(10), F.floor(raw * 13 / 10) - F.when(F.col("base") < 400, 250).otherwise(0)).cast("long").alias("utility"))


@query("with recursive " + CANDIDATES.replace("x as (select d.doc_id, source, lang,", "x as (select d.doc_id, source, lang, greatest(1, n_chars // 4) as tokens,") + """,
items as (select *, row_number() over (partition by source order by base desc, doc_id) as i, count(*) over (partition by source) as n from x),
walk(source, step, used, seen, taken, doc_id, accepted, reason) as (
  select distinct source, 0, 0::bigint, []::varchar[], []::bigint[], null::bigint, null::boolean, null::varchar from items union all
  select source, step + 1, used + case when reason in ('COVERAGE','UTILITY') then tokens else 0 end, case when reason in ('COVERAGE','UTILITY') then list_append(seen, lang) else seen end,
    case when reason in ('COVERAGE','UTILITY') then list_append(taken, doc_id) else taken end, doc_id, reason in ('COVERAGE','UTILITY'), reason
  from (select w.source, w.step, w.used, w.seen, w.taken, x.doc_id, x.lang, x.tokens, case when w.step < x.n and list_contains(w.seen, x.lang) or w.step >= x.n and list_contains(w.taken, x.doc_id) then null
      when x.base < 350 then 'LOW_SCORE' when w.used + x.tokens > 4000 then 'TOKEN_LIMIT' when w.step < x.n then 'COVERAGE' else 'UTILITY' end as reason
    from walk w join items x on x.source is not distinct from w.source and x.i = w.step % x.n + 1 where w.step < 2 * x.n))
select source, doc_id, arg_max(accepted, step) as accepted, arg_max(reason, step) as reason from walk where reason is not null group by source, doc_id""")
def budget_select(spark, sf_dir):
    c = _candidates(spark, sf_dir).withColumn("tokens", F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).cast("long"))
    return S.budget_select(c, "source", "doc_id", "tokens", "base", "lang", 4000, 350)


@query("with " + EDGES + """, p(intent, relationship) as (values ('DEBUG','PLACED'),('DEBUG','CONTAINS'),('REFACTOR','CONTAINS'),('REFACTOR','SUPPLIED_BY'),('UNDERSTAND','LOCATED_IN'),('UNDERSTAND','PART_OF'))
select intent, relationship, count(*) as n from edges join p using (relationship) group by 1, 2""")
def policy_filter(spark, sf_dir):
    """The relationships that each intent may use."""
    policy = [("DEBUG", "PLACED"), ("DEBUG", "CONTAINS"), ("REFACTOR", "CONTAINS"), ("REFACTOR", "SUPPLIED_BY"), ("UNDERSTAND", "LOCATED_IN"), ("UNDERSTAND", "PART_OF")]
    n = build_edges(spark, sf_dir).groupBy("relationship").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(spark.createDataFrame(policy, "intent string, relationship string")), "relationship").select("intent", "relationship", "n")


@query("with " + BM25 + """, r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from b qualify rank <= 25), e as (select distinct doc_id from labels where quality = 1), h as (select rank, (doc_id in (select doc_id from e))::int as hit from r)
select round(sum(hit) / count(*), 6) as precision, round(sum(hit) / (select count(*) from e), 6) as recall, round(coalesce(1.0 / min(case when hit = 1 then rank end), 0), 6)::double as mrr,
round(coalesce(sum(case when hit = 1 and rank <= 10 then 1 / log2(rank + 1) end), 0) / (select sum(1 / log2(i + 1)) from range(1, 11) t(i)), 6) as ndcg10 from h""")
def retrieval_metrics(spark, sf_dir):
    ranked = bm25_topk(spark, sf_dir).select("doc_id", "rank")
    return S.metrics(ranked, table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


def _sorted_values(spark, sf_dir, newest: int | None):
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events", "event_type", "value", "ts", "event_id")
    if newest:
        n = F.row_number().over(W.partitionBy("event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
        e = e.withColumn("n", n).where(F.col("n") <= newest)
    return e


@query("""with x as (select event_type, value from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) <= 100), s as (select event_type, list_sort(list(value)) as v from x group by 1)
select event_type, len(v) as n, v[greatest(0, least(round_even(len(v) * 0.5 - 0.5, 0), len(v) - 1))::int + 1] as p50, v[greatest(0, least(round_even(len(v) * 0.95 - 0.5, 0), len(v) - 1))::int + 1] as p95, v[greatest(0, least(round_even(len(v) * 0.99 - 0.5, 0), len(v) - 1))::int + 1] as p99 from s""")
def percentiles_rank(spark, sf_dir):
    """Of the newest hundred samples, by rounded rank."""
    s = _sorted_values(spark, sf_dir, 100).groupBy("event_type").agg(F.array_sort(F.collect_list("value")).alias("v"))
    return s.select("event_type", F.size("v").cast("long").alias("n"), *(T.percentile_index(F.col("v"), p).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)))


@query("""with s as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events)
select event_type, max(n) as n, max(case when i = round_even((n - 1) * 0.5, 0) then value end) as p50, max(case when i = round_even((n - 1) * 0.95, 0) then value end) as p95, max(case when i = round_even((n - 1) * 0.99, 0) then value end) as p99 from s group by 1""")
def percentiles_linear_idx(spark, sf_dir):
    """Of all samples, by rounded linear index. Values are counted first, so no group gathers its rows."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events", "event_type", "value").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    w = W.partitionBy("event_type")
    e = e.withColumn("upto", F.sum("c").over(w.orderBy("value"))).withColumn("n", F.sum("c").over(w))
    at = lambda p: F.rint((F.col("n") - 1) * F.lit(p))
    pick = lambda p: F.max(F.when((at(p) < F.col("upto")) & (at(p) >= F.col("upto") - F.col("c")), F.col("value")))
    return e.groupBy("event_type").agg(F.max("n").alias("n"), *(pick(p).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)))


@query("select event_id, user_id from events where ('0x' || substr(sha256(event_id || ':' || user_id), 1, 8))::bigint / 4294967295.0 <= 0.1")
def hash_sample(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "user_id")
    return e.where(T.hash_sample(F.concat_ws(":", F.col("event_id").cast("string"), F.col("user_id").cast("string")), 0.1))


ROUTES = r"""u as (select page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/'), lambda s: s <> '') as p from pages),
v as (select page_id, list_transform(p, lambda s: case when regexp_full_match(s, '[0-9]+') then '{*}' else lower(s) end) as s from u)"""


@query("with " + ROUTES + " select page_id, '/' || array_to_string(s, '/') as route, len(s) as segments from v")
def normalize_routes(spark, sf_dir):
    p = table(spark, sf_dir, "pages", "page_id", "url").select("page_id", T.route_segments(F.col("url")).alias("s"))
    return p.select("page_id", T.join_route(F.col("s")).alias("route"), F.size("s").cast("long").alias("segments"))


TEMPLATES = [("GET", "/en/:id"), ("GET", "/api/v1/fr/{page}"), ("POST", "/de/<int:id>"), ("GET", "/es/[slug]/edit"), ("GET", "/de/index.html")]


def _matched(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url").select("page_id", T.route_segments(F.col("url")).alias("c"))
    few = spark.createDataFrame(TEMPLATES, "method string, template string").withColumn("b", T.route_segments(F.col("template")))
    return pages, pages.join(F.broadcast(few), T.routes_match(F.col("c"), F.col("b")).isNotNull()).withColumn("kind", T.routes_match(F.col("c"), F.col("b")))


MATCHED = ROUTES + """, t(method, template, b, stripped) as (values ('GET', '/en/:id', ['en','{*}'], ['en','{*}']), ('GET', '/api/v1/fr/{page}', ['api','v1','fr','{*}'], ['fr','{*}']), ('POST', '/de/<int:id>', ['de','{*}'], ['de','{*}']), ('GET', '/es/[slug]/edit', ['es','{*}','edit'], ['es','{*}','edit']), ('GET', '/de/index.html', ['de','index.html'], ['de','index.html'])),
m as (select page_id, s, method, template, case when s = b then 'EXACT' when s = stripped then 'PROXY_PREFIX' when len(s) = len(b) and len(list_filter(list_zip(s, b), lambda z: z[1] <> z[2] and z[1] <> '{*}' and z[2] <> '{*}')) = 0 then 'TOPOLOGICAL_PARAM_MATCH' end as kind from v, t)"""


@query("with " + MATCHED + " select page_id, template, kind from m where kind is not null")
def match_routes(spark, sf_dir):
    return _matched(spark, sf_dir)[1].select("page_id", "template", "kind")


@query("with " + MATCHED + """, g as (select page_id, bool_or(method = 'GET') as get from m where kind is not null group by 1)
select v.page_id, '/' || array_to_string(s, '/') as route, case when g.page_id is null then 'ORPHANED_CLIENT_ROUTE' else 'HTTP_METHOD_MISMATCH' end as issue from v left join g on g.page_id = v.page_id where g.page_id is null or not g.get""")
def orphan_routes(spark, sf_dir):
    """Client calls (GET) that no route takes, or only routes of another method."""
    pages, hits = _matched(spark, sf_dir)
    g = hits.groupBy("page_id").agg(F.max(F.col("method") == "GET").alias("get"))
    x = pages.join(g, "page_id", "left").where("get is null or not get")
    return x.select("page_id", T.join_route(F.col("c")).alias("route"), F.when(F.col("get").isNull(), "ORPHANED_CLIENT_ROUTE").otherwise("HTTP_METHOD_MISMATCH").alias("issue"))


DECLARED = [("c_custkey", "long"), ("c_name", "string"), ("c_acctbal", "string"), ("c_phone", "string"), ("c_nationkey", "int")]


@query("""with d(name, kind) as (values ('c_custkey','BIGINT'),('c_name','VARCHAR'),('c_acctbal','VARCHAR'),('c_phone','VARCHAR'),('c_nationkey','INTEGER')), o as (select column_name as name, data_type as kind from information_schema.columns where table_name = 'customer')
select coalesce(d.name, o.name) as "column", case when o.name is null then 'MISSING_COLUMN' when d.name is null then 'UNUSED_COLUMN' else 'TYPE_MISMATCH' end as issue from d full join o on d.name = o.name where d.kind is distinct from o.kind""")
def schema_drift(spark, sf_dir):
    d = spark.createDataFrame(DECLARED, "column string, declared string")
    names = {"bigint": "long"}
    o = spark.createDataFrame([(c, names.get(k, k)) for c, k in table(spark, sf_dir, "customer").dtypes], "column string, observed string")
    x = d.join(o, "column", "full").where(~F.col("declared").eqNullSafe(F.col("observed")))
    return x.select("column", F.when(F.col("observed").isNull(), "MISSING_COLUMN").when(F.col("declared").isNull(), "UNUSED_COLUMN").otherwise("TYPE_MISMATCH").alias("issue"))


def _redacted(text: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    for pattern, mark, _ in T.PASSES:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(re.sub(r'[$]([0-9])', lambda m: chr(92) + m[1], mark))}, 'g')"
    return text


#: Documents, every other one with a secret of some format before its text.
MARKED = """(select doc_id, case doc_id % 16 when 0 then 'AKIA'||upper(substring(md5(''||doc_id), 1, 16))||' ' when 1 then 'Authorization: Bearer '||md5(''||doc_id)||' ' when 2 then 'ghp_'||md5(''||doc_id)||' ' when 3 then 'db_password = "'||md5(''||doc_id)||'" '
when 4 then 'API_KEY=os.getenv(1) ' when 5 then '-----BEGIN RSA PRIVATE KEY-----'||md5(''||doc_id)||'-----END RSA PRIVATE KEY----- ' when 6 then 'eyJ'||md5(''||doc_id)||'.'||md5('a')||'.'||md5('b')||' ' when 7 then 'postgres://u:'||md5(''||doc_id)||'@h/d ' else '' end || text as text from documents)"""


@query("with r as (select doc_id, text, " + _redacted("text") + " as x from " + MARKED + ") select doc_id, md5(x) as digest, x <> text as changed from r")
def redact_text(spark, sf_dir):
    """All documents, half of them with a secret of one of eight formats put before the text."""
    d = spark.sql(f"select * from {MARKED.replace('documents', '{documents}')}", documents=table(spark, sf_dir, "documents", "doc_id", "text")).withColumn("x", T.redact(F.col("text")))
    return d.select("doc_id", F.md5("x").alias("digest"), (F.col("x") != F.col("text")).alias("changed"))


@query("""select event_id, case when (props->>'$.k')::int > 50 then '[REDACTED]' else props->>'$.k' end as k from events""")
def payload_redact(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "props").withColumn("m", F.from_json("props", "map<string,string>"))
    clean = F.transform_values("m", lambda k, v: F.when(v.try_cast("int") > 50, "[REDACTED]").otherwise(v))
    return e.select("event_id", F.try_element_at(clean, F.lit("k")).alias("k"))
