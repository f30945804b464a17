"""Sessions of a stream against those of a table, with a restart, events out of order and late ones."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tagweave.streaming import sessions as ss

BEGIN = datetime(2024, 1, 1)


@pytest.fixture
def provider(spark):
    spark.conf.set(*ss.PROVIDER)
    yield
    spark.conf.unset(ss.PROVIDER[0])


def told(df):
    return sorted((r.key, r.start, r.end, r.n, round(r.total, 6), round(r.score, 6)) for r in df.collect())


def run(spark, source, tmp_path, schema, **more):
    stream = ss.stream_sessions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "user_id", **more)
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(ss.OUT).parquet(f"{tmp_path}/out")


def test_a_stream_gives_the_sessions_of_a_table(spark, sf, tmp_path, provider):
    events = spark.read.parquet(f"{sf}/events.parquet").filter("user_id < 6")
    last = events.agg(F.max("ts")).first()[0]
    gap = 6 * 3600
    pieces = events.withColumn("piece", F.ntile(3).over(Window.orderBy("ts", "event_id")))
    for k in (1, 2):
        pieces.filter(f"piece = {k}").drop("piece").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(spark, f"{tmp_path}/in", tmp_path, events.schema, gap=gap, late="1 hour")
    pieces.filter("piece = 3").drop("piece").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    end = events.limit(1).withColumn("ts", F.lit(last + timedelta(days=30)).cast(events.schema["ts"].dataType)).withColumn("user_id", F.lit(-1).cast("long"))
    end.write.mode("append").parquet(f"{tmp_path}/in")
    got = run(spark, f"{tmp_path}/in", tmp_path, events.schema, gap=gap, late="1 hour")  # a restart: state and timers go on
    want = told(ss.sessions(events, "user_id", gap=gap))
    assert told(got.filter("key <> '-1'")) == want and len(want) > 6


def test_order_merging_and_late_events(spark, tmp_path, provider):
    at = lambda minutes: BEGIN + timedelta(minutes=minutes)
    files = [[(1, at(0), 1.0), (1, at(50), 2.0), (2, at(5), None)], [(1, at(25), 4.0), (2, at(6), 1.0)], [(3, at(500), 1.0)], [(3, at(501), 1.0)], [(1, at(20), 100.0)], [(9, at(5000), 0.0)]]
    schema = "user_id long, ts timestamp, value double"
    for k, f in enumerate(files):
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    source = f"{tmp_path}/in/*"
    got = run(spark, source, tmp_path, schema, late="2 hours")
    kept = [e for f in files for e in f if e[2] != 100.0]  # more than two hours before 500, which a batch before has brought: too late
    want = [r for r in told(ss.sessions(spark.createDataFrame(kept, schema), "user_id")) if r[0] != "9"]
    assert told(got.filter("key <> '9'")) == want
    assert [r[3] for r in want if r[0] == "1"] == [3]  # the event between them made one session of two
