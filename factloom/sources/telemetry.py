"""Telemetry payloads as rows of spans and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:array<struct<key:string,value:{VALUE}>>>"
RESOURCE = f"struct<resourceSpans:array<struct<resource:struct<attributes:array<struct<key:string,value:{VALUE}>>>,scopeSpans:array<struct<spans:array<{SPAN}>>>>>>"
KINDS = {"1": "INTERNAL", "2": "SERVER", "3": "CLIENT", "4": "PRODUCER", "5": "CONSUMER"}
#: Attributes that may hold credentials.
DROPPED = r"(?i)(authorization|cookie|password|secret|token|api[_-]?key)"


def _attributes(a):
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    kept = F.filter(F.coalesce(a, F.array().cast(f"array<struct<key:string,value:{VALUE}>>")), lambda x: ~x["key"].rlike(DROPPED))
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["key"].alias("key"), text(x["value"]).alias("value"))))


def otel_spans(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Spans of OTLP JSON payloads, one row for each trace:span; of repeats the first payload's counts."""
    p = payloads.select(F.monotonically_increasing_id().alias("_n"), F.from_json(column, RESOURCE).alias("r"))
    r = p.select("_n", F.explode("r.resourceSpans").alias("r"))
    s = r.select("_n", _attributes(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeSpans").alias("s")).select("_n", "resource", F.posexplode("s.spans").alias("_i", "s"))
    kind = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    a = _attributes(F.col("s.attributes"))
    rows = s.select(
        "_n", "_i", F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"), F.coalesce("s.parentSpanId", F.lit("")).alias("parent_span_id"),
        F.coalesce(F.try_element_at("resource", F.lit("service.name")), F.lit("")).alias("service"), F.col("s.name").alias("name"),
        F.coalesce(F.try_element_at(kind, F.col("s.kind")), F.regexp_replace("s.kind", "^SPAN_KIND_", ""), F.lit("INTERNAL")).alias("kind"),
        F.col("s.startTimeUnixNano").try_cast("long").alias("start_ns"), F.col("s.endTimeUnixNano").try_cast("long").alias("end_ns"), a.alias("attributes"),
    )
    get = lambda *keys: F.coalesce(*(F.try_element_at("attributes", F.lit(k)) for k in keys), F.lit(""))
    sql = T.normalize_sql(get("db.statement", "db.query.text"))
    first = F.row_number().over(W.partitionBy("trace_id", "span_id").orderBy("_n", "_i"))
    return rows.withColumn("_r", first).where("_r = 1").select(
        "trace_id", "span_id", "parent_span_id", "service", "name", "kind", "start_ns", "end_ns", ((F.col("end_ns") - F.col("start_ns")) / 1e6).alias("duration_ms"),
        get("http.method", "http.request.method").alias("http_method"), get("http.route", "http.target").alias("route"), sql.alias("sql"),
        get("messaging.destination", "messaging.destination.name").alias("destination"), "attributes",
    )


#: For each field the keys that events use for it, in order of preference.
ALIASES = {
    "trace_id": ("trace_id", "traceId", "trace"), "span_id": ("span_id", "spanId", "span"), "parent_span_id": ("parent_span_id", "parentSpanId", "parent_id"), "http_method": ("http_method", "method", "verb"),
    "route": ("route", "path", "url", "endpoint"), "handler": ("handler", "handler_name", "function"), "operation": ("operation", "op"), "table": ("table", "table_name", "collection"), "sql": ("sql", "query", "statement"), "duration_ms": ("duration_ms", "duration", "elapsed_ms"),
}


def json_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of JSON lines, whatever of the known names their fields have; bad lines are dropped."""
    m = lines.select(F.from_json(column, "map<string,string>").alias("m")).where("m is not null")
    cols = [F.coalesce(*(F.nullif(F.try_element_at("m", F.lit(k)), F.lit("")) for k in keys), F.lit("")).alias(name) for name, keys in ALIASES.items()]
    rows = m.select(*cols).withColumn("duration_ms", F.col("duration_ms").try_cast("double"))
    named = F.when(F.col("table") != "", F.lower(F.element_at(F.split("table", r"\."), -1))).otherwise(T.sql_table(F.col("sql")))
    return rows.withColumn("table", named).withColumn("relationship", F.when(F.col("sql") != "", T.sql_relationship(F.col("sql"))).otherwise("UNKNOWN")).withColumn("sql", T.normalize_sql(F.col("sql")))


def sql_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of text logs: statement with trace_id=, caller= and duration_ms= tags."""
    tag = lambda k: F.regexp_extract(column, rf"\b{k}=(\S+)", 1)
    sql = F.trim(F.regexp_extract(column, r"(?i)((?:select|insert|update|delete|create|alter|drop|with)\b.*)$", 1))
    rows = lines.select(tag("trace_id").alias("trace_id"), tag("caller").alias("caller"), tag("duration_ms").try_cast("double").alias("duration_ms"), sql.alias("sql")).where("sql <> ''")
    return rows.select("trace_id", "caller", "duration_ms", T.sql_table(F.col("sql")).alias("table"), T.sql_relationship(F.col("sql")).alias("relationship"), T.normalize_sql(F.col("sql")).alias("sql"))
