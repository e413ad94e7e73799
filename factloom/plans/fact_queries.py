"""Aggregation, integrity, telemetry and snapshot operators applied to the tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import facts as O
from ..sources.tables import table
from .edges import build_edges, node

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""with d as (select user_id, cast(ts as date) as day, array_to_string(list_sort(list_distinct(list(event_type))), ',') as types from events group by 1, 2)
select types, count(*) as user_days, count(distinct user_id) as users from d group by types""")
def reverse_maps(spark, sf_dir):
    """Which event types occur together on a user's day."""
    e = table(spark, sf_dir, "events", "user_id", "ts", "event_type")
    days = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))
    return days.groupBy("types").agg(F.count("*").alias("user_days"), F.countDistinct("user_id").alias("users"))


@query("""select n_nationkey as nation, (select count(distinct c_custkey) from customer where c_nationkey = n_nationkey) as customers, (select count(distinct s_suppkey) from supplier where s_nationkey = n_nationkey) as suppliers,
(select count(distinct o_orderkey) from orders join customer on c_custkey = o_custkey where c_nationkey = n_nationkey) as orders from nation""")
def queue_counts(spark, sf_dir):
    """Distinct counts per side before the joins, so sides never multiply each other."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    a = c.groupBy(F.col("c_nationkey").alias("nation")).agg(F.countDistinct("c_custkey").alias("customers"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.countDistinct("s_suppkey").alias("suppliers"))
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation")).agg(F.countDistinct("o_orderkey").alias("orders"))
    zero = F.lit(0).cast("long")
    return n.join(a, "nation", "left").join(b, "nation", "left").join(o, "nation", "left").select("nation", *(F.coalesce(x, zero).alias(x) for x in ("customers", "suppliers", "orders")))


@query("select l_orderkey as order_id, l_partkey as part_id, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def having_duplicates(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"))
    return x.agg(F.count("*").alias("n")).where("n > 1")


@query("""select 'line_without_order' as "check", count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'line_without_part', count(*) from lineitem where l_partkey not in (select p_partkey from part)
union all select 'line_without_supplier', count(*) from lineitem where l_suppkey not in (select s_suppkey from supplier) union all select 'order_without_customer', count(*) from orders where o_custkey not in (select c_custkey from customer)
union all select 'label_without_document', count(*) from labels where doc_id not in (select doc_id from documents) union all select 'duplicate_order_key', count(*) from (select o_orderkey from orders group by 1 having count(*) > 1)
union all select 'duplicate_line', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)""")
def integrity_checks(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return O.union([
        O.orphans(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey", "line_without_order"), O.orphans(t("lineitem"), "l_partkey", t("part"), "p_partkey", "line_without_part"),
        O.orphans(t("lineitem"), "l_suppkey", t("supplier"), "s_suppkey", "line_without_supplier"), O.orphans(t("orders"), "o_custkey", t("customer"), "c_custkey", "order_without_customer"),
        O.orphans(t("labels"), "doc_id", t("documents"), "doc_id", "label_without_document"), O.duplicates(t("orders"), ["o_orderkey"], "duplicate_order_key"), O.duplicates(t("lineitem"), ["l_orderkey", "l_linenumber"], "duplicate_line"),
    ])


@query("""select 'language' as section, lang as name, count(*) as n, sum(n_chars)::bigint as size from documents group by lang union all select 'source', source, count(*), sum(n_chars)::bigint from documents group by source
union all select 'length', case when n_chars < 1000 then 'short' when n_chars < 5000 then 'medium' else 'long' end, count(*), sum(n_chars)::bigint from documents group by 2""")
def arch_overview(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "lang", "source", "n_chars")
    size = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long")
    each = lambda name, col: d.groupBy(col.alias("name")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("size")).select(F.lit(name).alias("section"), "name", "n", "size")
    return O.union([each("language", F.col("lang")), each("source", F.col("source")), each("length", size)])


@query("""select page_id, url, row_number() over (order by url, page_id) as position, (select count(*) from pages) as total, (select count(*) from pages) > 60 as has_more from pages qualify position > 40 and position <= 60""")
def paginate_routes(spark, sf_dir):
    return O.page(table(spark, sf_dir, "pages", "page_id", "url"), ["url", "page_id"], 40, 20)


@query("""select user_id as source, event_type as target, count(*) as observations, sum(cast(value as decimal(18,2)))::double as total, max(value) as largest, min(ts) as first_seen, max(ts) as last_seen from events group by 1, 2""")
def runtime_edges(spark, sf_dir):
    """Two batches, aggregated apart and merged."""
    e = table(spark, sf_dir, "events")
    make = lambda x: O.runtime_edges(x, "user_id", "event_type", "value", "ts")
    return O.merge_runtime_edges(make(e.where("event_id % 2 = 0")), make(e.where("event_id % 2 = 1")))


@query("select event_id, user_id, event_type from events order by ts desc, event_id desc limit 1000")
def retention(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    return O.retain(e, [F.col("ts").desc(), F.col("event_id").desc()], 1000).select("event_id", "user_id", "event_type")


@query("""with c as (select conv_id, turn, case when role = 'assistant' then '' else role end as role from conversations)
select c.conv_id, c.turn, coalesce(nullif(c.role, ''), nullif(p.role, '')) as role from c left join c p on p.conv_id = c.conv_id and p.turn = c.turn - 1""")
def parent_inherit(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") - 1).alias("parent"), F.when(F.col("role") == "assistant", "").otherwise(F.col("role")).alias("role"))
    return O.inherit(c, "conv_id", "turn", "parent", ["role"]).select("conv_id", "turn", "role")


@query("""with recursive w(conv_id, turn, root, depth) as (select conv_id, turn, turn, 0 from conversations c where not exists (select 1 from conversations p where p.conv_id = c.conv_id and p.turn = c.turn - 1)
union all select w.conv_id, c.turn, w.root, w.depth + 1 from w join conversations c on c.conv_id = w.conv_id and c.turn = w.turn + 1),
d as (select conv_id as trace, count(distinct root) as roots, max(depth) as deepest from w group by 1),
g as (select conv_id as trace, count(*) as spans, array_to_string(list_sort(list(distinct coalesce(nullif(role, 'system'), 'unknown_service'))), ',') as services, count(distinct role) as _, count(*) filter (where role = 'assistant') as db_queries, bool_or(length(text) % 7 = 0) as has_errors, max(length(text) / 10.0)::double as duration_ms from conversations group by 1)
select trace, roots, spans, deepest, services, db_queries, has_errors, duration_ms, printf('Trace %s: %d spans across %d service(s), %d DB queries, total duration %.1fms.', (trace::varchar)[1:8], spans, len(string_split(services, ',')), db_queries, duration_ms) as summary from g join d using (trace)""")
def trace_forest(spark, sf_dir):
    """Conversations as traces: turns as spans, roles as services, answers as database operations."""
    c = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (F.col("turn") - 1).alias("parent"), F.when(F.col("role") != "system", F.col("role")).otherwise("").alias("service"), F.when(F.col("role") == "assistant", "SELECT").otherwise("").alias("operation"),
        F.when(F.length("text") % 7 == 0, 500).otherwise(200).alias("status"), (F.length("text") / F.lit(10.0)).alias("duration"))
    return O.trace_forest(c, "conv_id", "turn", "parent", "service", "operation", "status", "duration").withColumn("services", F.array_join("services", ","))


@query("""with e as (select distinct l_partkey as part, l_suppkey as supplier from lineitem where l_linenumber % 2 = 1), o as (select distinct l_partkey as part, l_suppkey as supplier from lineitem where l_linenumber % 2 = 0),
s as (select part, min(supplier) as spare from (select * from o except select * from e) group by part), c as (select distinct part from (select * from o intersect select * from e))
select coalesce(e.part, o.part) as part, coalesce(e.supplier, o.supplier) as supplier, case when e.part is null then 'RUNTIME_ONLY' when o.part is not null then 'CONFIRMED' when s.spare is not null and c.part is null then 'CONFLICT' else 'NOT_OBSERVED' end as status,
case when e.part is not null and o.part is null and c.part is null then s.spare end as other
from e full join o on e.part = o.part and e.supplier = o.supplier left join s on s.part = coalesce(e.part, o.part) left join c on c.part = coalesce(e.part, o.part)""")
def reconcile(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), "l_linenumber")
    return O.reconcile(x.where("l_linenumber % 2 = 1"), x.where("l_linenumber % 2 = 0"), "part", "supplier")


@query("""with c as (select * from events where event_type = 'click'), p as (select * from events where event_type = 'purchase')
select p.event_id as consumer, c.event_id as producer, date_diff('millisecond', c.ts, p.ts) as latency_ms from p asof join c on p.user_id = c.user_id and p.ts >= c.ts""")
def producer_consumer(spark, sf_dir):
    """Each purchase with the user's last click before it, and the time between."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", F.struct("ts", "event_id").alias("click"))
    found = O.last_before(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "click").where("click is not null")
    ms = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 1000)
    return found.select(F.col("event_id").alias("consumer"), F.col("click.event_id").alias("producer"), (ms(F.col("ts")) - ms(F.col("click.ts"))).alias("latency_ms"))


@query("""select event_type, count(*) filter (where event_id % 3 <> 0) as known, count(*) filter (where event_id % 2 = 0 and event_id % 3 = 0) as ingested, count(*) filter (where event_id % 2 = 0 and event_id % 3 <> 0) as deduplicated from events group by 1""")
def idempotent_ingest(spark, sf_dir):
    """A second batch against the ledger of the first."""
    e = table(spark, sf_dir, "events", "event_id", "event_type")
    ledger, batch = e.where("event_id % 3 <> 0"), e.where("event_id % 2 = 0")
    new = batch.join(ledger.select("event_id"), "event_id", "left_anti").select("event_type", F.lit("ingested").alias("k"))
    again = batch.join(ledger.select("event_id"), "event_id", "left_semi").select("event_type", F.lit("deduplicated").alias("k"))
    every = ledger.select("event_type", F.lit("known").alias("k")).unionAll(new).unionAll(again)
    return every.groupBy("event_type").agg(*(F.count(F.when(F.col("k") == k, 1)).alias(k) for k in ("known", "ingested", "deduplicated")))


SNAPSHOTS = """b as (select o_orderkey as k, o_orderpriority as p, o_totalprice::decimal(18,2) as d from orders where o_orderkey % 10 <> 1), h as (select o_orderkey as k, o_orderpriority as p, (o_totalprice::decimal(18,2) + case when o_orderkey % 7 = 0 then 1 else 0 end)::decimal(18,2) as d from orders where o_orderkey % 10 <> 2)"""


def _snapshots(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    base = o.where("o_orderkey % 10 <> 1").select(F.col("o_orderkey").alias("k"), price.cast("decimal(20,2)").alias("d"))
    head = o.where("o_orderkey % 10 <> 2").select(F.col("o_orderkey").alias("k"), (price + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).cast("decimal(20,2)").alias("d"))
    return base, head


@query("with " + SNAPSHOTS + """ select coalesce(b.k, h.k) as k, case when b.k is null then 'ADDED' when h.k is null then 'REMOVED' else 'MODIFIED' end as status from b full join h on b.k = h.k where b.k is null or h.k is null or b.d <> h.d""")
def snapshot_diff(spark, sf_dir):
    return O.compare(*_snapshots(spark, sf_dir), "k", "d")


@query("with " + SNAPSHOTS + """, r as (select k from b where k not in (select k from h))
select r.k, 'REMOVED_BUT_REFERENCED' as conflict, count(*) as n, min(l_linenumber) as first_line from r join lineitem on l_orderkey = r.k where l_returnflag = 'R' group by r.k""")
def semantic_conflicts(spark, sf_dir):
    """Removed on one side, still referenced on the other."""
    base, head = _snapshots(spark, sf_dir)
    gone = O.compare(base, head, "k", "d").where("status = 'REMOVED'").select("k")
    used = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linenumber").where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "k")
    return used.join(gone, "k", "left_semi").groupBy("k").agg(F.lit("REMOVED_BUT_REFERENCED").alias("conflict"), F.count("*").alias("n"), F.min("l_linenumber").alias("first_line"))


@query("""with x as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as prior from events)
select user_id, count(*) filter (where prior is null) as introduced, count(*) filter (where prior <> event_type) as modified, count(*) filter (where prior = event_type) as unchanged from x group by 1""")
def symbol_history(spark, sf_dir):
    prior = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    x = table(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type").withColumn("prior", prior)
    count = lambda c: F.count(F.when(c, 1))
    return x.groupBy("user_id").agg(count(F.col("prior").isNull()).alias("introduced"), count(F.col("prior") != F.col("event_type")).alias("modified"), count(F.col("prior") == F.col("event_type")).alias("unchanged"))


@query("""with x as (select c_nationkey as package, count(*) as files, count(*) filter (where c_custkey % 9 = 0 and c_nationkey % 3 <> 0 or c_nationkey % 5 = 4) as changed from customer group by 1)
select 'n:'||package as package, files, changed, case when changed = 0 then 'FRESH' when changed = files then 'STALE' else 'PARTIALLY_STALE' end as state from x""")
def freshness(spark, sf_dir):
    """Indexed against present content hashes of files, by package."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_name")
    changed = ((F.col("c_custkey") % 9 == 0) & (F.col("c_nationkey") % 3 != 0)) | (F.col("c_nationkey") % 5 == 4)
    index = c.select("c_custkey", node("n", "c_nationkey").alias("package"), F.sha2("c_name", 256).alias("d"))
    disk = c.select("c_custkey", F.sha2(F.concat("c_name", F.when(changed, "!").otherwise("")), 256).alias("e"))
    x = index.join(disk, "c_custkey").groupBy("package").agg(F.count("*").alias("files"), F.count(F.when(F.col("d") != F.col("e"), 1)).alias("changed"))
    return x.withColumn("state", F.when(F.col("changed") == 0, "FRESH").when(F.col("changed") == F.col("files"), "STALE").otherwise("PARTIALLY_STALE"))


@query("""with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) > interval 30 minute then 1 else 0 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as n from x)
select user_id, min(ts) as started, max(ts) as ended, count(*) as events from s group by user_id, n""")
def debounce_sessions(spark, sf_dir):
    return O.sessions(table(spark, sf_dir, "events", "user_id", "ts"), "user_id", "ts", "30 minutes")


@query("""select case when o_custkey % 4 = 0 and o_custkey % 8 <> 0 then 2 else 1 end as generation, o_orderstatus as status, count(*) as n, sum(o_orderkey)::bigint as keys from orders group by 1, 2""")
def incremental_replace(spark, sf_dir):
    """Facts of dirty customers are replaced; those that failed to parse keep the last good ones."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    dirty, failed = o.where("o_custkey % 4 = 0"), o.where("o_custkey % 8 = 0")
    now = O.replace_paths(o.withColumn("generation", F.lit(1)), dirty.withColumn("generation", F.lit(2)), dirty, "o_custkey", failed)
    return now.groupBy("generation", F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("""select distinct 'p:'||l_partkey as dependent from lineitem where l_suppkey % 20 = 0 and l_partkey % 50 <> 0""")
def invalidate_dependents(spark, sf_dir):
    """One hop from what changed, minus what changed itself."""
    e = build_edges(spark, sf_dir, "SUPPLIED_BY")
    changed = table(spark, sf_dir, "supplier").where("s_suppkey % 20 = 0").select(node("s", "s_suppkey").alias("target"))
    edited = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(node("p", "p_partkey").alias("dependent"))
    return e.join(changed, "target", "left_semi").select(F.col("source").alias("dependent")).distinct().join(edited, "dependent", "left_anti")


@query("""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), s as (select q.vec_id as query_id, c.vec_id, list_cosine_similarity(q.e, c.e) as cosine from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, vec_id, row_number() over (partition by query_id order by cosine desc, vec_id) as rank, cosine from s qualify rank <= 3""")
def vector_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return O.top_similar(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q")), 3)


@query("""with x as (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as links, regexp_extract_all(html, '<script[^>]*>', 0) as scripts from pages)
select page_id, len(links) as links, len(list_distinct(links)) as distinct_links, coalesce(links[1], '') as first_link, len(scripts) as scripts from x""")
def html_assets(spark, sf_dir):
    p = table(spark, sf_dir, "pages", "page_id", "html")
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return p.select("page_id", F.size(links).cast("long").alias("links"), F.size(F.array_distinct(links)).cast("long").alias("distinct_links"), F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("first_link"), F.size(F.regexp_extract_all("html", F.lit("<script[^>]*>"), F.lit(0))).cast("long").alias("scripts"))


@query("""with o as (select o_custkey as k, o_orderkey as line from orders)
select e.event_id, e.user_id, max(o.line) as binding, case when max(o.line) is null then 'UNKNOWN' else 'RESOLVED' end as state from events e left join o on o.k = e.user_id and o.line <= e.event_id group by 1, 2""")
def asof_binding(spark, sf_dir):
    """The last binding at or before each use in its scope."""
    uses = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_id").alias("line"))
    bindings = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("line"), F.col("o_orderkey").alias("binding"))
    found = O.last_before(uses, bindings, "user_id", "line", "binding")
    return found.select("event_id", "user_id", "binding", F.when(F.col("binding").isNull(), "UNKNOWN").otherwise("RESOLVED").alias("state"))
