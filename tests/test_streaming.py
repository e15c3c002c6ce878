"""Streaming editions against their batch meaning."""

import datetime as dt

from lodestrata.streaming import events


def run(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def ts(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_daily_counts_drop_repeats_and_late_rows(spark, tmp_path):
    schema = "event_id string, ts timestamp, repository string, event_type string"
    first = [("1", ts(1, 5), "r", "Push"), ("1", ts(1, 6), "r", "Push"), ("2", ts(1, 7), "r", "Push"), ("3", ts(4), "r", "Push")]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = run(spark, events.daily_counts(stream), "daily")
    assert [(str(r.day), r.repository, r.events) for r in got] == [("2024-01-01", "r", 2)]


def test_record_states(spark, tmp_path):
    schema = "project long, record_id long, kind string, ts timestamp"
    rows = [(1, 1, "issue_opened", ts(1)), (1, 1, "issue_closed", ts(3)), (1, 1, "issue_triaged", ts(2)), (1, 2, "issue_triaged", ts(1)), (1, 1, "issue_opened", ts(4))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = run(spark, events.record_states(stream), "states")
    assert sorted((r.record_id, r.kind, r.state, r.valid) for r in got) == [(1, "issue_closed", "closed", True), (1, "issue_opened", "closed", False), (1, "issue_opened", "open", True), (1, "issue_triaged", "triaged", True), (2, "issue_triaged", None, False)]
