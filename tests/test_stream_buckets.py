"""The stream operators keep one state for a bucket of keys, whatever the number of keys, and carry every value exactly."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from signalbox.streaming import events, state
from signalbox.streaming.events import BUCKETS

T0 = datetime(2024, 1, 2, 8, 0)
KEYS = 4 * BUCKETS
BIG = 2**53 + 1  # no double


def stored(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return spark.readStream.schema(schema).parquet(str(folder / "in"))


def written(found, folder, partition):
    writer = found.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp"))
    query = writer.partitionBy(partition).trigger(availableNow=True).start()
    query.awaitTermination()
    return max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)


def test_sorted_out_keeps_a_state_for_a_bucket(spark, tmp_path):
    schema = "k long, ts timestamp, id long, v double"
    rows = [(k, T0, k, 0.0) for k in range(KEYS)] + [(None, T0, None, None), (0, T0, BIG, None), (None, T0, BIG, float("nan"))]
    held = written(events.sorted_out(stored(spark, rows, schema, tmp_path), ["k"], "ts"), tmp_path, "status")
    out = spark.read.parquet(str(tmp_path / "out"))
    assert held <= BUCKETS
    assert out.where("status = 'unique'").select("k").distinct().count() == KEYS + 1 == out.where("status = 'unique'").count()
    assert out.where("status = 'repeated'").count() == 2
    assert out.where(F.col("id") == BIG).count() == 2 and out.where("isnan(v)").count() == 1 and out.where("v is null").count() == 2


def test_event_stream_keeps_a_state_for_a_bucket(spark, tmp_path):
    schema = "k long, ts timestamp, id long, flag int, n long"
    rows = [(k, T0 + timedelta(minutes=i), 2 * k + i, 1, BIG if k % 2 else None) for k in range(KEYS) for i in range(2)]
    rows += [(None, T0, -1, 1, 1), (None, T0 + timedelta(minutes=3), -1, None, 1)]

    def run(rows):
        return written(events.event_stream(stored(spark, rows, schema, tmp_path), ["k"], "ts", "id", "flag", ["id", "n"]), tmp_path, "kind")

    held = run(rows)
    run([(None, datetime(9999, 1, 1), None, None, None), (0, T0 - timedelta(hours=1), -5, 1, None)])
    out = spark.read.parquet(str(tmp_path / "out"))
    found = {r["k"]: r for r in out.where("kind = 'event'").collect()}
    late = out.where("kind = 'late'").collect()
    assert held <= BUCKETS
    assert len(found) == KEYS + 1 and found[None]["row_count"] == 1
    assert [found[1][c] for c in ("id", "n", "row_count", "end_time")] == [2, BIG, 2, T0 + timedelta(minutes=1)]
    assert found[2]["n"] is None
    assert [[r[c] for c in ("k", "id", "n", "end_time", "row_count", "delay_duration_minutes")] for r in late] == [[0, -5, None, None, None, None]]


def test_recent_rows_keep_a_state_for_a_bucket(spark, tmp_path):
    schema = "k long, ts timestamp, id long, n long"
    seen = []

    def run(rows):
        recent = events.recent_rows(stored(spark, rows, schema, tmp_path), ["k"], "ts", "id", ["n"], 3)
        query = state.run_batches(recent, lambda batch, i: seen.append(batch.collect()), str(tmp_path / "cp"), available_now=True, mode="update")
        query.awaitTermination()
        return max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)

    held = run([(k, T0 + timedelta(minutes=i), i, BIG if i else None) for k in range(KEYS) for i in range(2)])
    run([(7, T0 + timedelta(minutes=9), 9, 9), (None, T0, 0, 5)])
    assert held <= BUCKETS
    assert len(seen[0]) == 3 * KEYS and len(seen[1]) == 6  # keys that a batch doesn't touch aren't in its update
    places = lambda rows, k: [r["n"] for r in sorted((r for r in rows if r["k"] == k), key=lambda r: r["place"])]
    assert places(seen[0], 7) == [None, None, BIG]
    assert places(seen[1], 7) == [None, BIG, 9] and places(seen[1], None) == [5, 5, 5]
