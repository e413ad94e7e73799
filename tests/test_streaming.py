from pyspark.sql import functions as F

from factloom.operators import facts as O
from factloom.streaming import queries as Q

DATA = "/root/testdata/sf0.001"


def test_closed_sessions_equal_the_batch(spark, tmp_path):
    events = Q.read_events(spark, DATA)
    Q.start(Q.sessions(events), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    batch = O.sessions(spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "30 minutes")
    last = batch.agg(F.max("ended")).first()[0]
    closed = batch.where(F.col("ended") < F.lit(last) - F.expr("interval 90 minutes"))
    assert got.exceptAll(batch).count() == 0 and closed.exceptAll(got).count() == 0 and closed.count() > 100


def test_running_edges_equal_the_batch(spark, tmp_path):
    rows = {}

    def merge(df, number):
        rows.update({(r.source, r.target): r for r in df.collect()})

    Q.upsert(Q.runtime_edges(Q.read_events(spark, DATA)), merge, f"{tmp_path}/check").awaitTermination()
    batch = O.runtime_edges(spark.read.parquet(f"{DATA}/events.parquet"), "user_id", "event_type", "value", "ts")
    assert {k: (r.observations, r.total) for k, r in rows.items()} == {(r.source, r.target): (r.observations, r.total) for r in batch.collect()}


def test_linked_across_batches_and_once(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    for k in range(2):  # two files, one with repeats of the other's events
        e.where(f"event_id % 2 = {k} or event_id % 5 = 0").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    Q.start(Q.unique_spans(stream, ["event_id"], "60 days"), f"{tmp_path}/u", f"{tmp_path}/uc").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/u").count() == e.count()
    Q.start(Q.linked(Q.read_events(spark, DATA)), f"{tmp_path}/l", f"{tmp_path}/lc").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/l").select("producer", "consumer")
    want = Q.batch_linked(spark, DATA).select("producer", "consumer")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 0
