"""Identifiers, path accuracy, efficiency and gates, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as V
from ..sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("select event_id, substr(sha256('salt-1' || user_id || ':' || event_type), 1, 16) as correlation from events")
def correlation_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    return e.select("event_id", T.correlation_id(F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_type")), "salt-1").alias("correlation"))


@query("""with r as (select user_id, list_distinct(list(event_type) filter (where value > 60)) as r from events group by 1), e as (select user_id, coalesce(r, []) as r, ['click','purchase','refund'] as e from r)
select user_id, floor(1000 * len(list_intersect(r, e)) / 3)::bigint as recall, case when len(r) = 0 then 0 else floor(1000 * len(list_intersect(r, e)) / greatest(len(r), 1))::bigint end as precision,
array_to_string(list_sort(list_filter(e, lambda x: not list_contains(r, x))), ',') as missing, array_to_string(list_sort(list_filter(r, lambda x: not list_contains(e, x))), ',') as extra from e""")
def path_accuracy(spark, sf_dir):
    e = table(spark, sf_dir, "events", "user_id", "event_type", "value").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 60, F.col("event_type"))).alias("retrieved"))
    out = V.path_accuracy(e.withColumn("expected", F.array(*map(F.lit, ("click", "purchase", "refund")))))
    return out.select("user_id", "recall", "precision", "missing", "extra")


@query("select source as packet, count(distinct lang) as layers, floor(1000 * (count(*) - count(distinct n_chars)) / count(*))::bigint as redundancy, sum(n_chars)::bigint as tokens from documents group by source")
def efficiency(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "source", "lang", "n_chars").withColumnRenamed("source", "packet")
    return V.efficiency(d, "packet", "lang", "n_chars", "n_chars")


@query("""with b as (select event_type as metric, case when event_type < 'f' then 'latency' else 'recall' end as kind, count(*)::double as old from events where event_id % 2 = 0 and event_type <> 'view' group by 1),
c as (select event_type as metric, count(*)::double as new from events where event_id % 3 <> 0 and event_type <> 'error' group by 1)
select coalesce(b.metric, c.metric) as metric, kind, old, new, case when new is null then 'MISSING' when old is null then 'NEW' when kind = 'latency' and (new - old) / old > 0.25 or kind = 'recall' and (new - old) / old < -0.05 then 'REGRESSION' else 'OK' end as status from b full join c on b.metric = c.metric""")
def regression_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "event_type")
    kind = F.when(F.col("event_type") < "f", "latency").otherwise("recall")
    b = e.where("event_id % 2 = 0 and event_type <> 'view'").groupBy(F.col("event_type").alias("metric"), kind.alias("kind")).agg(F.count("*").cast("double").alias("value"))
    c = e.where("event_id % 3 <> 0 and event_type <> 'error'").groupBy(F.col("event_type").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    return V.regressions(b, c)
