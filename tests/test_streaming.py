"""Streams against their batch twins, across micro-batches, out-of-order rows and re-run batches."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalbox.operators import events, serving
from signalbox.streaming import feeds, state
from signalbox.streaming.events import event_stream, recent_rows, sorted_out

T0 = datetime(2024, 1, 2, 8, 0)
SCHEMA = "k string, ts timestamp, id int, v double, flag int"
KEYS = ["k"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    rows = []
    for k, n in (("a", 60), ("b", 25), ("c", 1)):
        at = 0.0
        for _ in range(n):
            at += float(rng.choice([0.5, 1, 2, 30]))
            rows.append((k, T0 + timedelta(minutes=at), len(rows), float(rng.integers(0, 9)), int(rng.random() < 0.5)))
    return rows


@pytest.fixture
def stream(spark, data, tmp_path):
    """Five files in time order, with neighbouring rows swapped so that some come late."""
    folder = tmp_path / "in"
    folder.mkdir()
    rows = sorted(data, key=lambda r: r[1])
    for i in range(0, len(rows) - 3, 4):
        rows[i], rows[i + 2] = rows[i + 2], rows[i]
    size = -(-len(rows) // 5)
    for i in range(5):
        part = rows[i * size : (i + 1) * size]
        lines = [json.dumps(dict(zip(("k", "ts", "id", "v", "flag"), (r[0], r[1].isoformat(), *r[2:])))) for r in part]
        (folder / f"{i:02}.json").write_text("\n".join(lines))
        import os

        os.utime(folder / f"{i:02}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def run(stream, process, tmp_path):
    query = state.run_batches(stream, process, str(tmp_path / "cp"), available_now=True)
    query.awaitTermination()
    return len(query.recentProgress)


def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def test_latest_state(spark, stream, data, tmp_path):
    table = state.LatestState(spark, str(tmp_path / "s"), schema(spark), KEYS, "ts", "id")

    def twice(batch, n):
        table.process(batch, n)
        table.process(batch, n)  # a repeated batch changes nothing

    run(stream, twice, tmp_path)
    assert table.version == 4
    again = state.LatestState(spark, str(tmp_path / "s"), schema(spark), KEYS, "ts", "id")
    assert again.version == 4  # a restarted job finds the state
    want = serving.latest(spark.createDataFrame(data, SCHEMA), KEYS, "ts", "id")
    assert sorted(table.current().collect()) == sorted(want.collect())


def test_replace_keeps_only_newest_snapshot(spark, tmp_path):
    table = state.LatestState(spark, str(tmp_path / "s"), schema(spark), KEYS, "ts", "id", mode="replace")
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    table.process(make([("a", T0, 1, 1.0, 0), ("b", T0, 2, 1.0, 0)]), 0)
    table.process(make([("a", T0 + timedelta(1), 3, 2.0, 0), ("b", T0, 4, 9.0, 0)]), 1)
    assert [r["id"] for r in table.current().collect()] == [3]
    table.process(make([]), 2)
    assert [r["id"] for r in table.current().collect()] == [3]
    with pytest.raises(ValueError):
        state.LatestState(spark, "x", schema(spark), KEYS, "ts", mode="other")


def test_history(spark, stream, data, tmp_path):
    table = state.History(spark, str(tmp_path / "s"), schema(spark), KEYS, "ts", "id", 12)
    run(stream, table.process, tmp_path)
    got = {r["k"]: [f["id"] for f in r["features"]] for r in table.sequences(["id"]).collect()}
    for k in "abc":
        ids = [r[2] for r in sorted((r for r in data if r[0] == k), key=lambda r: (r[1], r[2]))][-12:]
        assert got[k] == [ids[0]] * (12 - len(ids)) + ids


def written(found, tmp_path, partition):
    writer = found.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "cp"))
    writer.partitionBy(partition).trigger(availableNow=True).start().awaitTermination()


EVENT = ["k", "ts", "v", "id", "delay_duration_minutes", "affected_trains_count", "end_time", "row_count"]


@pytest.mark.parametrize("timeout", [None, 20.0])
def test_events(spark, stream, data, tmp_path, timeout):
    """Rows out of order in five batches give the batch operator's events; the rest of them once the stream ends."""

    def run():
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        written(events_of(rows, ["v", "id"], "60 minutes", timeout), tmp_path, "kind")
        out = spark.read.parquet(str(tmp_path / "o"))
        return out.where("kind = 'event'").select(*EVENT), out.where("kind = 'late'").count()

    early, late = run()
    early = early.count()
    end = {"k": None, "ts": "9999-01-01T00:00:00", "id": None, "v": None, "flag": None}
    (tmp_path / "in" / "99.json").write_text(json.dumps(end))
    found, late = run()
    want = events.extract_events(
        spark.createDataFrame(data, SCHEMA), KEYS, "ts", "id", "flag", ["v", "id"], max_gap=timeout
    ).select(*EVENT)
    assert sorted(found.collect()) == sorted(want.collect())
    assert 0 < early < want.count() and late == 0


def events_of(rows, features, lateness, timeout=None):
    return event_stream(rows, KEYS, "ts", "id", "flag", features, lateness, timeout)


def landed(spark, tmp_path, deliveries, run):
    """Rows (minute, id, flag) of one key, delivered and processed one delivery after the other."""
    (tmp_path / "in").mkdir(exist_ok=True)
    for i, rows in enumerate(deliveries):
        lines = [json.dumps({"k": "a", "ts": t if isinstance(t, str) else (T0 + timedelta(minutes=t)).isoformat(), "id": n, "v": 0.0, "flag": f}) for t, n, f in rows]
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(lines))
        run(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")))


def test_late_rows_are_set_aside(spark, tmp_path):
    end = [("9999-01-01T00:00:00", -1, 0)]
    landed(spark, tmp_path, [[(0, 0, 1), (30, 1, 0)], [(10, 2, 1), (40, 3, 0)], end], lambda rows: written(events_of(rows, ["id"], "5 minutes"), tmp_path, "kind"))
    out = spark.read.parquet(str(tmp_path / "o"))
    assert [r["id"] for r in out.where("kind = 'late'").collect()] == [2]
    assert [(r["row_count"], r["delay_duration_minutes"]) for r in out.where("kind = 'event'").collect()] == [(1, 1.0)]


def test_everything_delivered_is_sorted_out(spark, tmp_path):
    deliveries = [[(0, 0, 0), (0, 1, 0), (30, 2, 0)], [(30, 3, 0), (28, 4, 0), (3, 5, 0)], [(40, 6, 0), (28, 7, 0)], [(28, 8, 0), (41, 9, 0)]]
    landed(spark, tmp_path, deliveries, lambda rows: written(sorted_out(rows, KEYS, "ts", "5 minutes"), tmp_path, "status"))
    got = {r["id"]: r["status"] for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got.pop(0) != got.pop(1)  # one of the two is the first
    assert got == {2: "unique", 3: "repeated", 4: "unique", 5: "late", 6: "unique", 7: "repeated", 8: "late", 9: "unique"}


def test_recent_rows(spark, stream, data, tmp_path):
    out = []

    def process(batch, n):
        out.append({(r["k"], r["place"]): r["id"] for r in batch.collect()})

    recent = recent_rows(stream, KEYS, "ts", "id", ["id"], 12)
    state.run_batches(recent, process, str(tmp_path / "cp"), available_now=True, mode="update").awaitTermination()
    got = {}
    for batch in out:  # a key's later update replaces the earlier
        got.update(batch)
    for k in "abc":
        ids = [r[2] for r in sorted((r for r in data if r[0] == k), key=lambda r: (r[1], r[2]))][-12:]
        assert [got[k, i] for i in range(12)] == [ids[0]] * (12 - len(ids)) + ids


def test_a_batch_of_one_key_rewrites_one_bucket(spark, tmp_path):
    table = state.LatestState(spark, str(tmp_path / "s"), schema(spark), KEYS, "ts", "id", buckets=8)
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    table.process(make([(f"k{i}", T0, i, float(i), 0) for i in range(60)]), 0)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}
    before = files()
    for n in range(1, 7):  # more often than versions are kept
        table.process(make([("k7", T0 + timedelta(minutes=n), 100 + n, -1.0, 1)]), n)
        after = files()
        changed = {p.split("bucket=")[1].split("/")[0] for p, _ in set(after.items()) ^ set(before.items())}
        assert len(changed) == 1
        before = after
    rows = {r["k"]: r["id"] for r in table.current().collect()}
    assert len(rows) == 60 and rows["k7"] == 106 and rows["k8"] == 8
    assert {r["k"]: r["id"] for r in table.table.read(4).collect()}["k7"] == 104
    table.process(make([]), 7)
    assert table.current().count() == 60


def test_documents_refused_by_a_stream_are_kept(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    segment = lambda i, speed: f"<segment><segment_id>{i}</segment_id><speed>{speed}</speed><valid>Y</valid></segment>"
    doc = lambda *s: f"<r><date>2024-01-02</date><time>08:00:00</time><segments>{''.join(s)}</segments></r>"
    run = lambda: feeds.landed_road(spark, str(land), str(tmp_path / "o"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    (land / "a.xml").write_text(doc(segment(1, 20), segment(2, "fast")))
    run()
    (land / "b.xml").write_text(doc(segment(3, 30))[:-30])
    (land / "c.xml").write_text(doc(segment(4, 40)))
    run()
    rows = spark.read.parquet(str(tmp_path / "o" / "rows"))
    refused = spark.read.parquet(str(tmp_path / "o" / "refused"))
    assert sorted(r["segment_id"] for r in rows.collect()) == [1, 4]
    assert sorted((r["source_file"][-5:], r["reason"]) for r in refused.collect()) == [("a.xml", "bad number"), ("b.xml", "unreadable document")]


def rail_doc(minute, delayed):
    board = {"UP": [{"ttnt": str(minute)}], "DOWN": []}
    return json.dumps({
        "collected_at": f"20240102_08{minute:02}00",
        "data": {"T": {s: {"isdelay": "Y" if s in delayed else "N", "data": {f"T-{s}": board}} for s in "AB"}},
    })


def test_rail_feed(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    for i, delayed in enumerate(["", "A", "AB"]):
        (land / f"{i}.json").write_text(rail_doc(i, delayed))
    (land / "3.json").write_text("{broken")
    rows = feeds.rail_rows(spark, str(land), files_per_trigger=1)
    feeds.alert_stream(rows, str(tmp_path / "alerts"), str(tmp_path / "cp1"), True).awaitTermination()
    alerts = spark.read.parquet(str(tmp_path / "alerts"))
    assert sorted((r["sta"], r["timestamp"].minute) for r in alerts.collect()) == [("A", 1), ("A", 2), ("B", 2)]

    table = state.LatestState(spark, str(tmp_path / "s"), rows.schema, ["line", "sta"], "timestamp", "source_file")
    feeds.scored_state(rows, lambda b: b, table, str(tmp_path / "cp2"), available_now=True).awaitTermination()
    assert sorted((r["sta"], r["isdelay"], r["up_ttnt_1"]) for r in table.current().collect()) == [("A", 1, 2.0), ("B", 1, 2.0)]


@pytest.mark.parametrize("spread_by", [None, "source_file"])
def test_road_feed_drops_repeated_snapshots(spark, tmp_path, spread_by):
    land = tmp_path / "land"
    land.mkdir()
    doc = (
        "<r><date>2024-01-02</date><time>08:00:00</time><segments><segment><segment_id>1</segment_id>"
        "<speed>20</speed><valid>Y</valid></segment></segments></r>"
    )
    for name in ("a.xml", "b.xml", "c.xml", "d.xml"):
        (land / name).write_text(doc)
    rows = state.drop_repeats(feeds.road_rows(spark, str(land)), ["segment_id"], "datetime", spread_by=spread_by)
    query = rows.writeStream.format("parquet").option("path", str(tmp_path / "o")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o")).collect()
    assert [(r["segment_id"], r["speed"], r["hour"], r["is_peak"]) for r in got] == [(1, 20.0, 8, 1)]
