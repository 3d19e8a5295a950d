from loomgraph.session import clear_steps, cut_lineage, shared_dir
from loomgraph.streaming import windows as W

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def _events(spark, path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value")
    rows.repartition(4).write.parquet(path)
    return spark.read.parquet(path), spark.readStream.schema(EVENTS).parquet(path)


def test_stream_gives_the_windows_of_the_table(spark, tmp_path):
    table, stream = _events(spark, str(tmp_path / "in"))
    for name, f in {"counts": lambda e: W.counts(e, "1 day", late="90 days"), "sessions": lambda e: W.sessions(e, "2 hours", late="90 days")}.items():
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        got = sorted(map(repr, spark.table(name).drop("total").collect()))
        assert got == sorted(map(repr, f(table).drop("total").collect())) and got


def test_log_and_upsert(spark, tmp_path):
    _, stream = _events(spark, str(tmp_path / "in"))
    W.append_log(stream, str(tmp_path / "log"), str(tmp_path / "c1"), "parquet").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1000
    seen = {}

    def merge(batch, number):
        seen.update({r["event_type"]: r["count"] for r in batch.collect()})

    W.upsert_stream(stream.groupBy("event_type").count(), merge, str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert sum(seen.values()) == 1000


def test_steps_are_written_and_cleared(spark):
    df = cut_lineage(spark.range(3).toDF("id"))
    assert df.count() == 3 and shared_dir(spark)
    assert clear_steps(spark) >= 1
