"""Graph operators applied to the relational tables, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import lookup as L
from ..sources.tables import settle, table
from .edges import EDGES, build_edges, node

QUERIES, ORACLE_SQL = {}, {}
KINDS = ("c", "o", "p", "s", "n", "r")
LABELS = {"HIGH": 3, "MEDIUM": 2, "LOW": 1, "UNKNOWN": 0}


def number(name):
    """A node as one long: its kind in the high byte, its key below."""
    column = F.col(name) if isinstance(name, str) else name
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.substring(column, 1, 1)) - 1
    return F.shiftleft(kind.cast("long"), 56).bitwiseOR(F.substring(column, 3, 20).cast("long"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""
with d as (select c.c_custkey as k, o.o_orderkey as o from customer c left join orders o on o.o_custkey = c.c_custkey and o.o_orderstatus = 'P'),
t as (select d.k, count(distinct d.o) as direct, count(distinct l.l_partkey) as transitive from d left join lineitem l on l.l_orderkey = d.o group by d.k)
select 'c:'||k as seed, direct, transitive, least(100.0, 3.5*direct + 1.5*transitive)::double as score,
  case when least(100.0, 3.5*direct + 1.5*transitive) >= 75 then 'CRITICAL' when 3.5*direct + 1.5*transitive >= 50 then 'HIGH' when 3.5*direct + 1.5*transitive >= 25 then 'MEDIUM' else 'LOW' end as risk from t""")
def blast_radius(spark, sf_dir):
    """What an open order of a customer touches: direct and second-hop counts, score and risk."""
    seeds = table(spark, sf_dir, "customer").select(node("c", "c_custkey").alias("source"))
    first = build_edges(spark, sf_dir, "PLACED").where("confidence = 'LOW'").select("source", F.col("target").alias("mid"))
    second = build_edges(spark, sf_dir, "CONTAINS").select(F.col("source").alias("mid"), "target")
    return L.blast_radius(seeds, first, second)


@query("with " + EDGES + """
select 'node' as section, split_part(n, ':', 1) as name, count(distinct n) as n from (select source as n from edges union all select target from edges) group by 2
union all select 'relationship', relationship, count(*) from edges group by 2 union all select 'confidence', confidence, count(*) from edges group by 2""")
def graph_summary(spark, sf_dir):
    """Nodes by kind, edges by relationship and by confidence: one pass for the edges, one for their ends."""
    e = build_edges(spark, sf_dir)
    ends = e.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    nodes = ends.groupBy(F.split("node", ":")[0].alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("section"), "name", "n")
    both = settle(e.groupBy("relationship", "confidence").agg(F.count("*").alias("n")))
    count = lambda c: both.groupBy(F.col(c).alias("name")).agg(F.sum("n").alias("n")).select(F.lit(c).alias("section"), "name", "n")
    return nodes.unionAll(count("relationship")).unionAll(count("confidence"))


@query("select p_brand as source, 'p:'||p_partkey as target, case when p_size > 25 then 'CONTAINS' else 'DEFINES' end as relationship from part")
def definition_edges(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), node("p", "p_partkey").alias("target"), F.when(F.col("p_size") > 25, "CONTAINS").otherwise("DEFINES").alias("relationship"))


@query("with " + EDGES + """, c as (select relationship, case when confidence = 'LOW' then 'POSSIBLE' when relationship in ('PART_OF','LOCATED_IN') then 'FRAMEWORK_DERIVED' when confidence = 'MEDIUM' then 'DATAFLOW_VERIFIED' else 'AST_VERIFIED' end as evidence_class from edges),
a(relationship, evidence_class) as (values ('PLACED','AST_VERIFIED'),('PLACED','DATAFLOW_VERIFIED'),('CONTAINS','AST_VERIFIED'),('SUPPLIED_BY','AST_VERIFIED'),('LOCATED_IN','FRAMEWORK_DERIVED'),('PART_OF','FRAMEWORK_DERIVED'))
select c.relationship, c.evidence_class, (count(a.relationship) > 0) as allowed, count(*) as n from c left join a using (relationship, evidence_class) group by 1, 2""")
def edge_label_guard(spark, sf_dir):
    """Evidence class of each edge, and whether the contract allows it."""
    e = L.evidence_class(build_edges(spark, sf_dir), framework=("PART_OF", "LOCATED_IN"))
    allowed = [("PLACED", "AST_VERIFIED"), ("PLACED", "DATAFLOW_VERIFIED"), ("CONTAINS", "AST_VERIFIED"), ("SUPPLIED_BY", "AST_VERIFIED"), ("LOCATED_IN", "FRAMEWORK_DERIVED"), ("PART_OF", "FRAMEWORK_DERIVED")]
    return L.guard(e, spark.createDataFrame(allowed, "relationship string, evidence_class string"))


WANTED = "(values ('small ring'), ('ring'), ('o'), ('absent part'), ('Customer#000000007'), ('CUSTOMER#000000008'))"
NAMES = "names as (select 'p:'||p_partkey as id, p_name as name from part union all select 'c:'||c_custkey, c_name from customer)"


def _names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(node("p", "p_partkey").alias("id"), F.col("p_name").alias("name")).unionAll(table(spark, sf_dir, "customer").select(node("c", "c_custkey"), "c_name"))


def _wanted(spark):
    return spark.createDataFrame([(x,) for x in ("small ring", "ring", "o", "absent part", "Customer#000000007", "CUSTOMER#000000008")], "term string")


@query("with " + NAMES + ", w(term) as " + WANTED + """, m as (select term, id, case when name = term then 1 when ends_with(name, ' '||term) then 2 when contains(lower(name), lower(term)) then 3 end as tier from names, w),
b as (select term, min(tier) as tier from m group by term)
select b.term, b.tier, count(m.id) as n, min(m.id) as first_id from b left join m on m.term = b.term and m.tier = b.tier group by 1, 2""")
def symbol_tiered_lookup(spark, sf_dir):
    """Exact name, else suffix after a separator, else substring: the first tier that matches."""
    return L.tiered(_names(spark, sf_dir), _wanted(spark))


@query("with " + NAMES + """, s as (select id, name, case when lower(name) = 'ring' then 100 when lower(name) like 'ri%' then 85 when lower(name) like '%ring%' then 70 else 60 end as score from names where lower(name) like '%ri%')
select id, name, score, row_number() over (order by score desc, id) as position from s qualify position <= 20""")
def symbol_search_scored(spark, sf_dir):
    return L.scored_search(_names(spark, sf_dir), "ri", "ring", 20)


@query("with " + NAMES + ", w(term) as " + WANTED + """
select term, count(id) as n, case count(id) when 0 then 'NOT_FOUND' when 1 then 'RESOLVED' else 'AMBIGUOUS' end as status, case when count(id) = 1 then min(id) end as resolved from w left join names on name = term group by term""")
def resolve_ambiguity(spark, sf_dir):
    """More than one match is never guessed."""
    return L.resolve(_names(spark, sf_dir), _wanted(spark))


@query("with " + EDGES + """, r as (select source, target, line, confidence, 1 as branch, 'CALLS' as kind from edges where confidence = 'HIGH' and relationship in ('PLACED','CONTAINS')),
f as (select source, target, line, confidence, 2 as branch, case when confidence = 'LOW' then 'POSSIBLE_CALLS' else 'CALLS' end as kind from edges e where relationship in ('PLACED','CONTAINS') and not exists (select 1 from r where r.source = e.source and r.target = e.target and r.line = e.line))
select * from r union all select * from f""")
def callers_two_source(spark, sf_dir):
    e = build_edges(spark, sf_dir, "PLACED", "CONTAINS")
    return G.callers(e, e)


@query("""with s as (select l_orderkey as k, min(l_linenumber) as lo, max(l_linenumber) as hi from lineitem group by 1),
o as (select o_orderkey as k, o_custkey from orders)
select o.k as order_id, o_custkey as owner, l.l_partkey as callee, l.l_linenumber as line from o join s on s.k = o.k join lineitem l on l.l_orderkey = o.k and l.l_linenumber between s.lo and least(s.hi, s.lo + 2)""")
def callees_range_fallback(spark, sf_dir):
    """Lines inside a span of a few lines from an order's first."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")
    spans = lines.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    found = lines.join(spans, "l_orderkey").where("l_linenumber between lo and least(hi, lo + 2)")
    return found.join(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("order_id"), F.col("o_custkey").alias("owner"), F.col("l_partkey").alias("callee"), F.col("l_linenumber").alias("line"))


SEEDS = "(values ('s:0'), ('s:1'), ('s:2')) t(x)"


@query("with recursive " + EDGES + """, walk(seed, node, depth) as (select x, x, 0 from """ + SEEDS + """
union select w.seed, e.source, w.depth + 1 from walk w join edges e on e.target = w.node and e.relationship in ('SUPPLIED_BY','CONTAINS','PLACED') where w.depth < 3)
select seed, node, min(depth) as depth from walk group by 1, 2""")
def bfs_reverse_depth(spark, sf_dir):
    """Everything that depends on a supplier within three hops, at its smallest depth."""
    e = build_edges(spark, sf_dir, "SUPPLIED_BY", "CONTAINS", "PLACED")
    return G.bfs(e, spark.createDataFrame([(f"s:{i}", f"s:{i}") for i in range(3)], "seed string, node string"), 3, reverse=True)


@query("with recursive " + EDGES + """, walk(seed, node, depth) as (select 'c:'||c_custkey, 'c:'||c_custkey, 0 from customer
union select w.seed, e.target, w.depth + 1 from walk w join edges e on e.source = w.node where w.depth < 5)
select seed, split_part(node, ':', 1) as kind, count(distinct node) as n, min(depth) as nearest from walk group by 1, 2""")
def dependency_closure(spark, sf_dir):
    """Closure of every customer by kind of node; nodes are numbers while they are walked."""
    e = build_edges(spark, sf_dir).select(number("source").alias("source"), number("target").alias("target"))
    seeds = table(spark, sf_dir, "customer").select(number(node("c", "c_custkey")).alias("seed")).withColumn("node", F.col("seed"))
    kind = F.get(F.array(*map(F.lit, KINDS)), F.shiftright("node", 56).cast("int"))
    found = G.bfs(e, seeds, 5).groupBy("seed", kind.alias("kind")).agg(F.count("*").alias("n"), F.min("depth").alias("nearest"))
    return found.withColumn("seed", F.concat(F.lit("c:"), F.col("seed").bitwiseAND((1 << 56) - 1)))


@query("with recursive " + EDGES + """, walk(seed, node, depth, path) as (select 'c:'||c_custkey, 'c:'||c_custkey, 0, ['c:'||c_custkey] from customer
union all select w.seed, e.target, w.depth + 1, list_append(w.path, e.target) from walk w join edges e on e.source = w.node and e.relationship in ('PLACED','CONTAINS','SUPPLIED_BY','LOCATED_IN','PART_OF') where w.depth < 3)
select seed, node, depth, array_to_string(path, '>') as path from walk where node like 's:%' or node like 'r:%' qualify row_number() over (partition by seed, node order by depth, path) = 1""")
def shortest_path(spark, sf_dir):
    """Shortest path from customers to suppliers and regions; the smallest in text order among equals."""
    seeds = table(spark, sf_dir, "customer").select(node("c", "c_custkey").alias("seed"), node("c", "c_custkey").alias("node"))
    found = G.shortest_paths(build_edges(spark, sf_dir), seeds, 3).where("node like 's:%' or node like 'r:%'")
    return found.withColumn("path", F.array_join("path", ">"))


@query("""with a as (select c_nationkey as k, 'DIRECT' as category, 2 as rank, 'c:'||c_custkey as source from customer
union all select s_nationkey, 'FRAMEWORK', 3, 's:'||s_suppkey from supplier
union all select s_nationkey, 'SEMANTIC', 5, 'p:'||l_partkey from lineitem join supplier on s_suppkey = l_suppkey
union all select c_nationkey, 'TRANSITIVE', 7, 'o:'||o_orderkey from orders join customer on c_custkey = o_custkey),
d as (select k, source, min(rank) as rank, arg_min(category, rank) as category from a group by 1, 2)
select 'n:'||k as target, category, rank, count(*) as n, min(source) as first_source from d group by k, category, rank""")
def impact_buckets(spark, sf_dir):
    """What a nation's change reaches, in ranked buckets; a source counts in its best bucket."""
    supplier = table(spark, sf_dir, "supplier")
    customer = table(spark, sf_dir, "customer")
    parts = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey").distinct().join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    branch = lambda df, key, name, rank, source: df.select(node("n", key).alias("target"), F.lit(name).alias("category"), F.lit(rank).alias("rank"), source.alias("source"))
    return L.impact(
        [branch(customer, "c_nationkey", "DIRECT", 2, node("c", "c_custkey")), branch(supplier, "s_nationkey", "FRAMEWORK", 3, node("s", "s_suppkey")), branch(parts, "s_nationkey", "SEMANTIC", 5, node("p", "l_partkey")), branch(orders, "c_nationkey", "TRANSITIVE", 7, node("o", "o_orderkey"))]
    ).groupBy("target", "category", "rank").agg(F.count("*").alias("n"), F.min("source").alias("first_source"))


@query("""with a as (select l_partkey as k, 'A' as strategy, 1 as ordinal, l_orderkey as test from lineitem where l_returnflag = 'R' and l_quantity > 45
union all select l_partkey, 'B', 2, l_orderkey from lineitem where l_discount >= 0.1 and l_quantity > 40),
f as (select k, test, min(ordinal) as ordinal, arg_min(strategy, ordinal) as strategy from a group by 1, 2),
g as (select l_partkey as k, 'G' as strategy, min(l_orderkey) as test from lineitem where l_partkey not in (select k from f) group by 1),
u as (select k, strategy, test from f union all select k, strategy, test from g)
select 'p:'||p_partkey as target, coalesce(strategy, 'NONE') as strategy, case when test is not null then 'o:'||test else 'NO_EVIDENCE' end as test from part left join u on k = p_partkey""")
def related_with_fallback(spark, sf_dir):
    """Evidence strategies in order; the weakest only where no other found anything; a sentinel if none did."""
    lines = table(spark, sf_dir, "lineitem", "l_partkey", "l_orderkey", "l_returnflag", "l_quantity", "l_discount")
    make = lambda cond, name: lines.where(cond).select(node("p", "l_partkey").alias("target"), node("o", "l_orderkey").alias("test"), F.lit(name).alias("strategy")).distinct()
    weak = lines.groupBy("l_partkey").agg(F.min("l_orderkey").alias("l_orderkey")).select(node("p", "l_partkey").alias("target"), node("o", "l_orderkey").alias("test"), F.lit("G").alias("strategy"))
    targets = table(spark, sf_dir, "part").select(node("p", "p_partkey").alias("target"))
    return L.related(targets, [make("l_returnflag = 'R' and l_quantity > 45", "A"), make("l_discount >= 0.1 and l_quantity > 40", "B")], weak)


@query("""with x as (select distinct l_orderkey as o, l_partkey as p, p_type as t from lineitem join part on p_partkey = l_partkey)
select a.p as part_id, b.p as other_id, count(*) as n from x a join x b on a.o = b.o and a.t = b.t and a.p < b.p group by 1, 2 having count(*) > 1""")
def parallel_impls(spark, sf_dir):
    """Parts of one type that occur together in more than one order."""
    x = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").distinct().join(table(spark, sf_dir, "part", "p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return L.together(x, ["l_orderkey", "p_type"], "l_partkey").where("n > 1").select(F.col("a").alias("part_id"), F.col("b").alias("other_id"), "n")


@query("with recursive " + EDGES + """, walk(node, depth) as (select 's:0', 0 union select e.source, w.depth + 1 from walk w join edges e on e.target = w.node and e.relationship in ('SUPPLIED_BY','CONTAINS') where w.depth < 2),
n as (select distinct node from walk)
select source, target, relationship from edges where relationship in ('SUPPLIED_BY','CONTAINS') and source in (select node from n) and target in (select node from n)""")
def focused_subgraph(spark, sf_dir):
    e = build_edges(spark, sf_dir, "SUPPLIED_BY", "CONTAINS")
    near = G.bfs(e, spark.createDataFrame([("s:0", "s:0")], "seed string, node string"), 2, reverse=True)
    return G.induced(e, near).select("source", "target", "relationship")


@query("""select 'n:'||c_nationkey as target, 'c:'||c_custkey as dependent, 'IMPORTS' as kind from customer
union select 'n:'||s_nationkey, 's:'||s_suppkey, 'CALLS' from supplier union select 'n:'||n_nationkey, 'r:'||n_regionkey, 'INHERITS' from nation""")
def dependents_union(spark, sf_dir):
    branch = lambda t, n, k, kind, key: table(spark, sf_dir, t).select(node("n", n).alias("target"), node(k, key).alias("dependent"), F.lit(kind).alias("kind"))
    return branch("customer", "c_nationkey", "c", "IMPORTS", "c_custkey").unionAll(branch("supplier", "s_nationkey", "s", "CALLS", "s_suppkey")).unionAll(branch("nation", "n_nationkey", "r", "INHERITS", "n_regionkey")).distinct()


@query("""with recursive t as (select event_type as target, lag(event_type) over (partition by user_id order by ts, event_id) as source, user_id from events),
s as (select source, target from t where source is not null and source <> target group by 1, 2 having count(*) > 1),
w(path, node, n) as (select [source], target, 1 from s union all select list_append(path, node), s.target, n + 1 from w join s on s.source = w.node where node > path[1] and not list_contains(path, node) and n < 4)
select array_to_string(path, '>') as cycle, n as length from w where node = path[1] and n > 1""")
def cycle_detect(spark, sf_dir):
    """Cycles in the graph of event transitions."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = e.select(before.alias("source"), F.col("event_type").alias("target")).where("source <> target").groupBy("source", "target").count().where("count > 1")
    return G.cycles(steps, 4).select(F.array_join("path", ">").alias("cycle"), "length")


@query("""with recursive e as (select 'n:'||n_nationkey as a, 'r:'||n_regionkey as b from nation), u as (select a, b from e union all select b, a from e),
nodes as (select distinct a as node from u union select 'n:none'), w(node, d) as (select 'n:0', 0 union select u.b, d + 1 from w join u on u.a = w.node where d < 2)
select 'n:0' as seed, nodes.node, coalesce(min(d), 99) as distance from nodes left join w on w.node = nodes.node group by nodes.node""")
def package_distance(spark, sf_dir):
    e = build_edges(spark, sf_dir, "PART_OF")
    nodes = e.select(F.col("source").alias("node")).unionAll(e.select("target")).unionAll(spark.createDataFrame([("n:none",)], "node string"))
    return G.distances(e, nodes, spark.createDataFrame([("n:0", "n:0")], "seed string, node string"), 2)


@query("""with o(owner, prefix) as (values ('root', ''), ('web', 'http://'), ('secure', 'https://'), ('mobile', 'https://m.'), ('blog', 'https://blog.'), ('web-mobile', 'http://m.'))
select page_id, arg_max(owner, length(prefix)) as owner, max(length(prefix)) as matched from pages join o on starts_with(url, prefix) group by page_id""")
def longest_prefix_owner(spark, sf_dir):
    owners = [("root", ""), ("web", "http://"), ("secure", "https://"), ("mobile", "https://m."), ("blog", "https://blog."), ("web-mobile", "http://m.")]
    return L.longest_prefix(table(spark, sf_dir, "pages", "page_id", "url"), "page_id", "url", spark.createDataFrame(owners, "owner string, prefix string"))


@query("""with m as (select 'c:'||c_custkey as leaf, '/'||lower(r_name)||'/'||lower(n_name)||'/'||lower(c_mktsegment) as full_path, 'r'||r_regionkey||'>n'||n_nationkey as route
from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey)
select leaf, full_path || case when row_number() over (partition by full_path order by leaf) > 1 then '#m'||(row_number() over (partition by full_path order by leaf) - 1) else '' end as endpoint, route from m""")
def compose_paths(spark, sf_dir):
    """Mount prefixes joined from the root down; colliding endpoints get a suffix."""
    region = table(spark, sf_dir, "region").select(F.lit(None).cast("string").alias("parent"), F.concat(F.lit("r"), "r_regionkey").alias("child"), F.concat(F.lit("/"), F.lower("r_name")).alias("prefix"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("/"), F.lower("n_name")).alias("prefix"))
    leaves = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("owner"), node("c", "c_custkey").alias("leaf"), F.concat(F.lit("/"), F.lower("c_mktsegment")).alias("path"))
    found = G.compose_prefixes(region.unionAll(nation), leaves, 2)
    n = F.row_number().over(W.partitionBy("full").orderBy("leaf")) - 1
    return found.select("leaf", F.concat("full", F.when(n > 0, F.concat(F.lit("#m"), n.cast("string"))).otherwise("")).alias("endpoint"), "route")


@query("""with x as (select l_suppkey as t, l_shipdate, l_returnflag, l_linestatus, l_orderkey, l_partkey, case l_returnflag when 'R' then 'WRITE' when 'A' then 'UPDATE' else 'READ' end as op from lineitem)
select 's:'||t as target, array_to_string(list_sort(list_distinct(list(op))), ',') as operations, case when bool_or(l_linestatus = 'O') then 'POSSIBLE' else 'AST_VERIFIED' end as evidence_class,
 min('o:'||l_orderkey||'>p:'||l_partkey||'>s:'||t) as chain, count(distinct l_orderkey) as orders, count(*) as accesses from x group by t""")
def lineage_aggregate(spark, sf_dir):
    """Accesses to each supplier through order and part: operations, worst evidence, smallest chain; by order first, then by supplier."""
    x = table(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag", "l_linestatus", "l_orderkey", "l_partkey")
    some = lambda c: F.max(c)
    kinds = {"WRITE": F.col("l_returnflag") == "R", "UPDATE": F.col("l_returnflag") == "A", "READ": ~F.coalesce(F.col("l_returnflag").isin("R", "A"), F.lit(False))}
    by_order = x.groupBy("l_suppkey", "l_orderkey").agg(
        *(some(c).alias(k) for k, c in kinds.items()), some(F.col("l_linestatus") == "O").alias("open"), F.min(F.col("l_partkey").cast("string")).alias("part"), F.count("*").alias("accesses"))
    chain = F.concat(F.lit("o:"), "l_orderkey", F.lit(">p:"), "part", F.lit(">s:"), "l_suppkey")
    found = by_order.groupBy("l_suppkey").agg(
        *(some(k).alias(k) for k in kinds), some("open").alias("open"), F.min(chain).alias("chain"), F.count("*").alias("orders"), F.sum("accesses").alias("accesses"))
    operations = F.array_sort(F.filter(F.array(*(F.when(F.col(k), k) for k in kinds)), lambda k: k.isNotNull()))
    return found.select(
        node("s", "l_suppkey").alias("target"), F.array_join(operations, ",").alias("operations"), F.when(F.col("open"), "POSSIBLE").otherwise("AST_VERIFIED").alias("evidence_class"), "chain", "orders", "accesses")


@query("with recursive " + EDGES + """, walk(seed, node, depth, chain) as (select 's:0', 's:0', 0, ['s:0'] union all select w.seed, e.source, w.depth + 1, list_append(w.chain, e.source) from walk w join edges e on e.target = w.node and e.relationship in ('SUPPLIED_BY','CONTAINS','PLACED') where w.depth < 3)
select node, depth as distance, array_to_string(chain, '<') as chain from walk where node like 'c:%' qualify row_number() over (partition by node order by depth, chain) = 1""")
def accessors_upstream(spark, sf_dir):
    """Customers that reach a supplier, with the smallest of the shortest chains."""
    e = build_edges(spark, sf_dir, "SUPPLIED_BY", "CONTAINS", "PLACED").select(F.col("target").alias("source"), F.col("source").alias("target"))
    found = G.shortest_paths(e, spark.createDataFrame([("s:0", "s:0")], "seed string, node string"), 3)
    return found.where("node like 'c:%'").select("node", F.col("depth").alias("distance"), F.array_join("path", "<").alias("chain"))


@query("""select 'p:'||l_partkey as source, 's:'||l_suppkey as target, 'SUPPLIED_BY' as relationship, case when bool_or(l_linestatus = 'F') then 'HIGH' else 'MEDIUM' end as confidence, count(*) as occurrences,
array_to_string(list_slice(list_sort(list_distinct(list(l_linenumber))), 1, 4), ',') as lines from lineitem group by l_partkey, l_suppkey""")
def edge_compress(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(node("p", "l_partkey").alias("source"), node("s", "l_suppkey").alias("target"), F.lit("SUPPLIED_BY").alias("relationship"), F.when(F.col("l_linestatus") == "F", "HIGH").otherwise("MEDIUM").alias("confidence"), F.col("l_linenumber").alias("line"))
    return G.compress(e, LABELS)
