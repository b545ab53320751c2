"""Uniqueness on a stream: flags by batch, order within a batch, eviction of keys."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tamis.streaming.seen import flag_seen, keyed_state

START = datetime(2024, 1, 1)


def replay(spark, folder, batches, **options):
    """Rows (n, k, minutes) with their flags, batch by batch."""
    for rows in batches:
        spark.createDataFrame([(n, k, START + timedelta(minutes=m)) for n, k, m in rows], "n int, k string, at timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("n int, k string, at timestamp").parquet(f"{folder}/in")
        with keyed_state(spark):
            query = flag_seen(stream, ["k"], ["n"], "again", **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return {r["n"]: r["again"] for r in spark.read.parquet(f"{folder}/out").collect()}


def test_flags(spark, tmp_path):
    found = replay(spark, tmp_path, [[(3, "a", 0), (1, "a", 9), (2, "b", 0), (4, None, 0)], [(5, "a", 1), (6, "c", 0), (8, None, 0), (7, "c", 0)]])
    assert found == {1: False, 2: False, 3: True, 4: False, 5: True, 6: False, 7: True, 8: True}
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or "")


def test_keys_are_forgotten(spark, tmp_path):
    """Kept for an hour of event time: b's rows move the watermark on."""
    batches = [[(1, "a", 0), (2, "a", 5)], [(3, "a", 50), (4, "b", 55)], [(5, "b", 200)], [(6, "b", 201)], [(7, "a", 202), (8, "b", 203)], [(9, "a", 10)]]
    found = replay(spark, tmp_path, batches, time_col="at", watermark="0 seconds", keep_ms=3_600_000)
    assert found == {1: False, 2: True, 3: True, 4: False, 5: True, 6: True, 7: False, 8: True, 9: True}
    state = spark.read.format("statestore").option("stateVarName", "latest").load(str(tmp_path / "state"))
    assert sorted(r["k"] for r in state.select(F.col("key.k").alias("k")).collect()) == ["a", "b"]


def test_arguments(spark):
    with pytest.raises(ValueError, match="keep_ms"):
        flag_seen(spark.readStream.format("rate").load(), ["value"], [], time_col="timestamp")
