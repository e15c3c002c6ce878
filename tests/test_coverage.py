"""The coverage gate as a stream against the same over a table."""

import datetime as dt

import pytest

from lodestrata.streaming import coverage

SCHEMA = "source string, event_id string, ts timestamp, arrived timestamp"


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def rows():
    """Source a: a whole day, a day without one hour; b: a repeated id, a row in the grace, late rows; c: only late rows."""
    out = [("a", f"a{d}.{h}", at(d, h, 5), at(d, h, 6)) for d in (1, 2) for h in range(24) if (d, h) != (2, 7)]
    out += [("b", f"b{h}", at(1, h), at(1, h, 1)) for h in range(23)] + [("b", "b0", at(1, 0), at(1, 3)), ("b", "b23", at(1, 23, 30), at(2, 1, 59))]
    out += [("b", "b-late", at(1, 4), at(2, 2)), ("b", "b-later", at(1, 4), at(3, 9)), ("c", "c1", at(1, 4), at(3, 10))]
    out += [("z", "end", at(20), at(20)), ("z", "after", at(21), at(21))]
    return sorted(out, key=lambda r: r[3])


@pytest.mark.parametrize("size", [1000, 17])
def test_stream_equals_table(spark, tmp_path, size):
    data = rows()
    table = spark.createDataFrame(data, SCHEMA)
    for n in range(0, len(data), size):
        spark.createDataFrame(data[n : n + size], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n:05d}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        query = coverage.covered_days(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start()
        query.processAllAvailable()
        query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.schema(coverage.OUTPUT).parquet(f"{tmp_path}/out").where("source <> 'z'")
    want = coverage.covered_days_of(table.where("source <> 'z'"))
    assert sorted(map(tuple, got.where("kind = 'closed'").collect())) == sorted(map(tuple, want.where("kind = 'closed'").collect()))
    gates = sorted(map(tuple, coverage.gate(got).collect()), key=str)
    assert gates == sorted(map(tuple, coverage.gate(want).collect()), key=str)
    assert gates == [("a", 47, 2, 1, 0, None, "partial_coverage"), ("b", 24, 1, 0, 2, 24.0, None), ("c", 0, 0, 0, 1, None, "partial_coverage")]
