"""Telemetry payloads, logs, names, paths, statements and notes made from rows, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import security as X
from ..functions import text as T
from ..operators import context as C
from ..operators import database as D
from ..operators import facts as O
from ..operators import interrogate as I
from ..sources import scan, telemetry
from ..sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def made(spark, sf_dir, source: str, **columns: str):
    """Columns of a table by expressions that both engines read alike."""
    return table(spark, sf_dir, source).select(*(F.expr(x).alias(c) for c, x in columns.items()))


def case(column: str, *texts: str) -> str:
    """The i-th text for column modulo their number."""
    return f"case {column} % {len(texts)} " + " ".join(f"when {i} then {x}" for i, x in enumerate(texts)) + " end"


#: a path, an identifier, a URL and a statement for each part
PATH = case(
    "p_partkey", "'app/models/order_'||p_partkey||'.py'", "'app/p'||p_partkey||'/__init__.py'", "'index.ts'", "'web/cart'||p_size||'/index.tsx'", "'a.b/c'||p_size||'.d.js'", "'init.lua'", "'../etc/passwd'||p_partkey",
    "'.env.local'||p_size", "'keys/server'||p_size||'.PEM'", "'conf/secrets.yaml'", "'src/token'||p_partkey||'.py'", "'vendor/x'||p_size||'/y.py'", "'web/app.min.js'", "'dist/out'||p_size||'.bundle.js'", "'out/p'||p_size||'.ts'", "'tests/test_'||p_partkey||'.py'",
    "'conf/app'||p_size||'.yaml'", "'src/Makefile'", "'notes'||p_partkey||'.txt'", "'skip_me'||p_size||'/a.py'",
)
NAME = case("p_partkey", "'OrderItem'||p_partkey", "'HTTPServer'||p_size||'Name'", "'userID'||p_size||'Name'", "'already_snake_'||p_partkey", "'A'||p_size", "'getURL'||p_partkey||'ForHTTPHost'")
URL = case("p_partkey", "'postgresql+psycopg://u:p@db'||p_size||'.local:6543/shop'||p_partkey||'?x=1'", "'mysql://root@h'||p_partkey||'/app'", "'redis://cache'||p_size||':6379/0'", "'sqlite:///file'||p_partkey||'.db'", "'mongodb://a.b.c'||p_size||'/d'")
SQL = case(
    "p_partkey", "'SELECT * FROM public.orders WHERE id = '||p_partkey||' -- by key'", "'insert into  items_'||p_size||' (a, b) values ('||p_partkey||', ''x''''y''), (2, ''z'')'", "'UPDATE shop.stock SET n = n - 1.5 WHERE sku IN (''a'', '''||p_partkey||''', ''c'')'",
    "'DELETE FROM carts'||p_size", "'CREATE TABLE IF NOT EXISTS audit_log'||p_size||' (id int)'", "'WITH x AS (SELECT '||p_partkey||') SELECT * FROM x'", "'VACUUM'",
)
SECRET = case("p_partkey", "'API_KEY'", "'note'||p_size", "'path'", "'words'", "'db.password'", "'tokenizer'", "'client_secret'")
VALUE = case("p_partkey", "'short'", "md5(''||p_partkey)||upper(md5('x'||p_partkey))", "'a/b/'||md5(''||p_partkey)", "'aaaaaaaaaaaaaaaaaaaaaaaaaaaa'", "''", "upper(md5(''||p_partkey))", "md5('y'||p_size)")


@query(f"select k, path, case when m = '' then 'root' else replace(m, '/', '.') end as module from (select p_partkey as k, {PATH} as path, regexp_replace(regexp_replace({PATH}, '\\.[A-Za-z0-9]+$', ''), '(^|/)(__init__|index|init)$', '') as m from part)")
def module_identity(spark, sf_dir):
    return made(spark, sf_dir, "part", k="p_partkey", path=PATH).withColumn("module", T.module_of(F.col("path")))


@query(f"select p_partkey as k, regexp_matches({PATH}, '{X.SENSITIVE_PATH}') or regexp_matches({PATH}, '{X.TRAVERSAL}') as sensitive from part")
def sensitive_paths(spark, sf_dir):
    return made(spark, sf_dir, "part", k="p_partkey", path=PATH).select("k", X.is_sensitive_path(F.col("path")).alias("sensitive"))


@query(f"select p_partkey as k, lower(regexp_replace(regexp_replace({NAME}, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) as snake from part")
def camel_to_snake(spark, sf_dir):
    return made(spark, sf_dir, "part", k="p_partkey", name=NAME).select("k", T.camel_to_snake(F.col("name")).alias("snake"))


@query(f"""with p as (select p_partkey as k, {URL} as x from part), r as (select k, regexp_extract(x, '^([a-z]+)(?:\\+[a-z0-9]+)?://(?:[^@/]*@)?([^:/?]*)(?::([0-9]+))?(?:/([^?]*))?', ['a','b','c','d']) as r from p),
q as (select k, case when r.a in ('postgresql','postgres') then 'postgres' else r.a end as provider, r.b as host, r.c as port, r.d as database from r)
select k, provider, host, coalesce(try_cast(port as int), case provider when 'postgres' then 5432 when 'mysql' then 3306 when 'redis' then 6379 when 'mongodb' then 27017 end) as port, database from q""")
def connection_metadata(spark, sf_dir):
    return made(spark, sf_dir, "part", k="p_partkey", url=URL).withColumn("c", X.connection(F.col("url"))).select("k", "c.*")


@query(f"""with v as (select p_partkey as k, {SECRET} as name, {VALUE} as value from part),
e as (select k, name, value, list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: -(length(value) - length(replace(value, c, ''))) / length(value) * log2((length(value) - length(replace(value, c, ''))) / length(value)))) as h from v)
select k, regexp_matches(name, '{X.SECRET_NAME}') or (length(value) >= 24 and not regexp_matches(value, '[/.]') and coalesce(h, 0) >= 4.2) as secret from e""")
def secret_names(spark, sf_dir):
    return made(spark, sf_dir, "part", k="p_partkey", name=SECRET, value=VALUE).select("k", X.is_secret(F.col("name"), F.col("value")).alias("secret"))


@query("select p_partkey as k, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + SQL + r", '--[^\n]*', ' ', 'g'), '''[^'']*''', '?', 'g'), '\b[0-9]+(\.[0-9]+)?\b', '?', 'g'), '\(\s*\?(\s*,\s*\?)*\s*\)', '(?)', 'g'), '\s+', ' ', 'g')) as normal from part")
def sql_normalize(spark, sf_dir):
    return made(spark, sf_dir, "part", k="p_partkey", sql=SQL).select("k", T.normalize_sql(F.col("sql")).alias("normal"))


OPERATION = case("p_partkey", "'SELECT'", "'INSERT'", "'UPDATE'", "'DELETE'", "'CREATE'", "'WITH'", "'VACUUM'")
NAMED = case("p_partkey", "'orders'", "'items_'||p_size", "'stock'", "'carts'||p_size", "'audit_log'||p_size", "'x'", "'UNKNOWN'")
RELATION = case("p_partkey", "'READS_TABLE'", "'WRITES_TABLE'", "'WRITES_TABLE'", "'WRITES_TABLE'", "'DEFINES_TABLE'", "'READS_TABLE'", "'UNKNOWN'")


@query(f"select p_partkey as k, {OPERATION} as operation, {NAMED} as table_name, {RELATION} as relationship from part")
def sql_classify(spark, sf_dir):
    q = made(spark, sf_dir, "part", k="p_partkey", sql=SQL)
    return q.select("k", T.sql_operation(F.col("sql")).alias("operation"), T.sql_table(F.col("sql")).alias("table_name"), T.sql_relationship(F.col("sql")).alias("relationship"))


@query("select p_partkey as k, " + case("p_partkey", *["'SOURCE'"] * 6, "'UNKNOWN'", "'UNKNOWN'", "'UNKNOWN'", "'CONFIG'", "'SOURCE'", "'VENDOR'", "'MINIFIED'", "'BUNDLE'", "'BUILD_ARTIFACT'", "'TEST'", "'CONFIG'", "'CONFIG'", "'UNKNOWN'", "'SOURCE'") + " as plain, "
       + case("p_partkey", *["'GENERATED'"] * 11, "'VENDOR'", "'MINIFIED'", "'BUNDLE'", "'BUILD_ARTIFACT'", *["'GENERATED'"] * 5) + " as generated, "
       + case("p_partkey", "'python'", "'python'", "'typescript'", "'typescript'", "'javascript'", "'luau'", "''", "''", "''", "''", "'python'", "'python'", "'javascript'", "'javascript'", "'typescript'", "'python'", "''", "''", "''", "'python'") + " as language, p_size % 3 = 0 as zero, p_partkey % 20 in (11, 19) as ignored from part")
def file_classes(spark, sf_dir):
    """Category with and without a mark of generated code, language, binary content and ignore patterns of paths."""
    p = made(spark, sf_dir, "part", k="p_partkey", path=PATH, s="p_size")
    content = F.when(F.col("s") % 3 == 0, F.concat(F.encode(F.lit("text"), "UTF-8"), F.unhex(F.lit("00")))).otherwise(F.encode(F.lit("text 0 00"), "UTF-8"))
    ignored = F.col("path").rlike(scan.glob_regex(["# a comment", "", "skip_me*/", "vendor"]))
    return p.select(
        "k", scan.category(F.col("path"), F.lit("x = 1\n")).alias("plain"), scan.category(F.col("path"), F.lit("# auto-generated, do not edit\n")).alias("generated"), F.coalesce(scan.language(F.col("path")), F.lit("")).alias("language"),
        scan.is_binary(content).alias("zero"), ignored.alias("ignored"))


@query("select p_partkey as k, " + case("p_partkey", "'number'", "'text'", "'flag'", "'real'", "'time'", "'document'", "'other'") + " as kind from part")
def type_groups(spark, sf_dir):
    """Types of code and of databases as kinds of value."""
    kind = case("p_partkey", case("p_size", "'BIGINT'", "'int'", "'serial'"), "'varchar('||p_size||')'", "'Boolean'", "'numeric(10, 2)'", "'timestamp with time zone'", "'jsonb'", "'Thing'||p_size")
    return made(spark, sf_dir, "part", k="p_partkey", t=kind).select("k", D.type_group(F.col("t")).alias("kind"))


SPAN = """'{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc-'||(user_id % 7)||'"}}]},"scopeSpans":[{"spans":[{"traceId":"t'||user_id||'","spanId":"s'||event_id||'","parentSpanId":"s'||(event_id - 1)||'","name":"'||event_type||'","kind":'||(event_id % 6)||',"startTimeUnixNano":"'||(event_id * 1000000)||'","endTimeUnixNano":"'||(event_id * 1000000 + 500000 * (event_id % 5))||'","attributes":[{"key":"http.method","value":{"stringValue":"GET"}},{"key":"http.request.header.authorization","value":{"stringValue":"Bearer x"}},{"key":"http.route","value":{"stringValue":"/u/'||user_id||'"}},{"key":"db.statement","value":{"stringValue":"SELECT a FROM t'||(user_id % 3)||' WHERE id = '||event_id||'"}}]}]}]}]}'"""


@query("""select 't'||user_id as trace_id, 's'||event_id as span_id, 's'||(event_id - 1) as parent_span_id, 'svc-'||(user_id % 7) as service, event_type as name, case event_id % 6 when 2 then 'SERVER' when 3 then 'CLIENT' when 4 then 'PRODUCER' when 5 then 'CONSUMER' when 1 then 'INTERNAL' else '0' end as kind,
round((event_id % 5) * 0.5, 6)::double as duration_ms, 'GET' as http_method, '/u/'||user_id as route, 'SELECT a FROM t'||(user_id % 3)||' WHERE id = ?' as sql, 3::bigint as attributes from events""")
def otlp_spans(spark, sf_dir):
    """Spans of one payload for each event, a tenth of them sent twice; headers that hold credentials are dropped."""
    e = made(spark, sf_dir, "events", event_id="event_id", value=SPAN)
    x = telemetry.otel_spans(e.select("value").unionAll(e.where("event_id % 10 = 0").select("value")))
    return x.select("trace_id", "span_id", "parent_span_id", "service", "name", "kind", F.round("duration_ms", 6).alias("duration_ms"), "http_method", "route", "sql", F.size("attributes").cast("long").alias("attributes"))


EVENT = case("event_id", """'{"trace_id":"'||user_id||'","verb":"GET","endpoint":"/a","function":"f'||user_id||'","table_name":"Shop.Orders","duration":"1.5"}'""", """'{"trace":"'||user_id||'","sql":"DELETE FROM carts WHERE id = '||event_id||'","elapsed_ms":"2"}'""", "'not json '||event_id")


@query("""select user_id::varchar as trace_id, case event_id % 3 when 0 then 'GET' else '' end as http_method, case event_id % 3 when 0 then '/a' else '' end as route, case event_id % 3 when 0 then 'f'||user_id else '' end as handler, case event_id % 3 when 0 then 'orders' else 'carts' end as "table",
case event_id % 3 when 0 then 'UNKNOWN' else 'WRITES_TABLE' end as relationship, case event_id % 3 when 0 then '' else 'DELETE FROM carts WHERE id = ?' end as sql, case event_id % 3 when 0 then 1.5 else 2.0 end::double as duration_ms from events where event_id % 3 <> 2""")
def json_events(spark, sf_dir):
    """Events of JSON lines under whatever names; a third of the lines is no JSON."""
    return telemetry.json_events(made(spark, sf_dir, "events", value=EVENT)).select("trace_id", "http_method", "route", "handler", "table", "relationship", "sql", "duration_ms")


LOG = case("event_id", "'2024-01-01 trace_id=t'||user_id||' caller=svc.f'||user_id||' duration_ms=1.25 select a from shop.items where b = '||event_id", "'caller=g INSERT INTO log_'||(user_id % 4)||' VALUES ('||event_id||', ''x'')'", "'nothing to see '||event_id")


@query("""select case event_id % 3 when 0 then 't'||user_id else '' end as trace_id, case event_id % 3 when 0 then 'svc.f'||user_id else 'g' end as caller, case event_id % 3 when 0 then 1.25 end::double as duration_ms, case event_id % 3 when 0 then 'items' else 'log_'||(user_id % 4) end as "table",
case event_id % 3 when 0 then 'READS_TABLE' else 'WRITES_TABLE' end as relationship, case event_id % 3 when 0 then 'select a from shop.items where b = ?' else 'INSERT INTO log_'||(user_id % 4)||' VALUES (?)' end as sql from events where event_id % 3 <> 2""")
def sql_logs(spark, sf_dir):
    return telemetry.sql_log(made(spark, sf_dir, "events", value=LOG)).select("trace_id", "caller", "duration_ms", "table", "relationship", "sql")


@query("""with s as (select p_partkey as k, 'shop.part_'||p_partkey||'.read' as id, 'read_'||(p_partkey % 50) as name from part), u as (select name, count(*) as n, min(id) as id from s group by 1),
o as (select event_id, case event_id % 3 when 0 then 'shop.part_'||(event_id % 100)||'.read' when 1 then 'read_'||(event_id % 60) else 'odd' end as h, 'Public.Stock_'||(event_id % 4) as t from events)
select event_id, coalesce(s.id, case when u.n = 1 then u.id end, h) as symbol_id, 'db.UNKNOWN.UNKNOWN.stock_'||(event_id % 4) as table_id from o left join s on s.id = o.h left join u on u.name = o.h""")
def runtime_names(spark, sf_dir):
    """Raw names of telemetry as ids of symbols and tables: exact, else the only short name, else as they are."""
    symbols = made(spark, sf_dir, "part", canonical_id="'shop.part_'||p_partkey||'.read'", name="'read_'||(p_partkey % 50)")
    tables = spark.createDataFrame([("Stock_0",), ("stock_1",)], "table_name string")
    o = made(spark, sf_dir, "events", event_id="event_id", handler=case("event_id", "'shop.part_'||(event_id % 100)||'.read'", "'read_'||(event_id % 60)", "'odd'"), table="'Public.Stock_'||(event_id % 4)")
    return I.resolve_runtime(o, symbols, tables).select("event_id", "symbol_id", "table_id")


@query("select event_id, user_id from events where user_id in (select user_id from events where event_type = 'signup' and event_id % 5 = 0)")
def traces_of(spark, sf_dir):
    """All observations of users in whom one handler and table occur."""
    o = made(spark, sf_dir, "events", event_id="event_id", trace_id="user_id", handler="event_type", table="'T'||(event_id % 5)", route="'/'")
    return C.trace_of(o, symbol="SIGNUP", table="t0").select("event_id", F.col("trace_id").alias("user_id"))


@query("select event_type as class, count(*) as total, count(*) filter (where event_id % 4 = 0) as hits, round(avg(value * 1000) filter (where event_id % 4 <> 0))::bigint as cold_us, round(avg(value * 1000) filter (where event_id % 4 = 0))::bigint as warm_us from events group by 1")
def session_summary(spark, sf_dir):
    return C.session_summary(made(spark, sf_dir, "events", **{"class": "event_type", "latency_ms": "value", "cached": "event_id % 4 = 0"}))


@query(r"""select 'documents' as "table", count(*) as n from documents where regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----|://[^/\s:@]+:[^/\s@]+@') or contains(text, 'AKIA') or contains(text, 'password')
union all select 'pages', count(*) from pages where regexp_matches(url || chr(31) || html, '-----BEGIN [A-Z ]*PRIVATE KEY-----|://[^/\s:@]+:[^/\s@]+@') or contains(url || chr(31) || html, 'AKIA') or contains(url || chr(31) || html, 'password')""")
def secret_audit(spark, sf_dir):
    """Rows of two tables that hold a seeded secret, a key block or credentials in a URL."""
    tables = {"documents": table(spark, sf_dir, "documents", "doc_id", "text"), "pages": table(spark, sf_dir, "pages", "page_id", "url", "html")}
    return C.audit_secrets(tables, ["AKIA", "password"])


@query("select 'p'||p_partkey as key, p_name as value from part where lower('p'||p_partkey) like '%ring%' or lower(p_name) like '%ring%' order by key limit 20")
def memory_notes(spark, sf_dir):
    return C.memory_search(made(spark, sf_dir, "part", key="'p'||p_partkey", value="p_name"), "RING")


@query("""select x as name, x in (select c_name from customer) or x in (select s_name from supplier) as found from (select unnest(['Customer#000000007', 'nobody', '']) as x)""")
def exists_anywhere(spark, sf_dir):
    rows = [(n, C.exists_anywhere(n, (table(spark, sf_dir, "customer"), "c_name"), (table(spark, sf_dir, "supplier"), "s_name"))) for n in ("Customer#000000007", "nobody", "")]
    return spark.createDataFrame(rows, "name string, found boolean")


@query("select reason, count(*) as n from (select " + case("p_partkey", *["'read'"] * 6, "'unknown_language'", "'sensitive'", "'sensitive'", "'sensitive'", "'read'", "'read'", "'read'", "'ignored_folder'", "'read'", "'read'", "'unknown_language'", "'unknown_language'", "'unknown_language'", "'ignored_pattern'") + " as reason from part) group by 1")
def skipped_files(spark, sf_dir):
    """Why files are not read, by the rules that the scan applies."""
    p = made(spark, sf_dir, "part", path="case when p_partkey % 20 = 7 then '.env.local' else " + PATH + " end").withColumn("content", F.encode(F.lit("x"), "UTF-8")).withColumn("length", F.lit(1).cast("long"))
    return scan.skip_counts(scan.judged(p, 1_000_000, ["skip_me*/"]))


MIGRATION = case("p_partkey", "'db/migrations/'||lpad(''||p_partkey, 6, '0')||'.sql'", "'prisma/migrations/m'||p_partkey||'/migration_'||p_partkey||'.sql'", "'drizzle/'||p_partkey||'.sql'", "'alembic/versions/v'||p_partkey||'.py'", "'node_modules/x/migrations/'||p_partkey||'.sql'", "'src/'||p_partkey||'.sql'")


@query(f"""with f as (select {MIGRATION} as path, p_size as modified from part), m as (select string_split(path, '/')[-1] as name, path, modified from f where path not like 'node_modules/%' and path not like 'src/%')
select substring(sha256(string_agg(name||' '||modified, chr(10) order by name, path)), 1, 16) as digest, count(*)::int as n, arg_max(name, name) as latest from m""")
def migration_state(spark, sf_dir):
    """Digest, number and last of the migrations in a tree."""
    return I.migration_state(made(spark, sf_dir, "part", path=MIGRATION, modified="p_size"))


@query("""with recursive e as (select user_id, 'f'||(event_id % 400) as path, ts, row_number() over (partition by user_id order by ts, 'f'||(event_id % 400)) as i, epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts, 'f'||(event_id % 400))) as apart from events),
w(user_id, i, batch, waiting) as (select user_id, 1::bigint, 1, [path] from e where i = 1 union all select e.user_id, e.i, case when apart > 40000 or len(waiting) >= 5 then batch + 1 else batch end, case when apart > 40000 or len(waiting) >= 5 then [path] else list_distinct(list_append(waiting, path)) end from w join e on e.user_id = w.user_id and e.i = w.i + 1)
select user_id, batch, min(ts) as started, max(ts) as ended, count(distinct path) as paths from w join e using (user_id, i) group by 1, 2""")
def change_batches(spark, sf_dir):
    """Bursts of changes of each user, closed after a pause or when five paths wait."""
    return O.change_batches(made(spark, sf_dir, "events", user_id="user_id", path="'f'||(event_id % 400)", ts="ts"), "user_id", "path", "ts", 40000, 5)
