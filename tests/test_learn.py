"""Training sets, training and scoring, and the two feeds end to end on small archives."""

import json
import math
from datetime import datetime, timedelta

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from signalbox.operators import dataset, learn, serving
from signalbox.plans import rail, road
from signalbox.sources.snapshots import FILE, read_archive, read_newest

T0 = datetime(2024, 1, 2, 6, 0)


@pytest.fixture(scope="module")
def road_archive(tmp_path_factory):
    folder = tmp_path_factory.mktemp("road")
    for i in range(40):
        at = T0 + timedelta(minutes=5 * i)
        segments = "".join(
            f"<segment><segment_id>{s}</segment_id><speed>{20 if (i // 8 + s) % 2 else 50}</speed><valid>Y</valid></segment>"
            for s in range(1, 5)
        )
        (folder / f"{i:03}.xml").write_text(
            f"<r><date>{at:%Y-%m-%d}</date><time>{at:%H:%M:%S}</time><segments>{segments}</segments></r>"
        )
    return str(folder)


@pytest.fixture(scope="module")
def rail_archive(tmp_path_factory):
    folder = tmp_path_factory.mktemp("rail")
    for i in range(40):
        at = T0 + timedelta(minutes=i)
        boards = {
            s: {"isdelay": "Y" if (i // 6 + n) % 3 == 0 else "N",
                "data": {f"T-{s}": {"UP": [{"ttnt": str(i % 7)}] if i % 5 else [], "DOWN": [{"ttnt": "4"}]}}}
            for n, s in enumerate("ABC")
        }
        doc = {"collected_at": f"{at:%Y%m%d_%H%M%S}", "data": {"T": boards}}
        (folder / f"{i:03}.json").write_text(json.dumps(doc))
    return str(folder)


def test_road_end_to_end(spark, road_archive, tmp_path):
    table = str(tmp_path / "train")
    road.prepare_training_table(spark, road_archive, table)
    rows = spark.read.parquet(table)
    assert rows.count() == 160
    one = [r["congestion_minutes"] for r in rows.where("segment_id = 1").orderBy("datetime").collect()]
    assert one[:9] == [5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0, 0.0] or one[0] == 0.0
    label = [r["label_congestion_minutes"] for r in rows.where("segment_id = 1").orderBy("datetime").collect()]
    assert label == one[6:] + [0.0] * 6
    samples = learn.road_samples(rows, FILE)
    assert samples.count() == 4 * (40 - 12) and samples.first()["features"].size == 60
    model = road.train(spark, table, seed=3, iterations=(2, 4))
    state = road.refresh(read_newest(spark, road_archive, "*.xml"), model)
    got = state.collect()
    assert {r["segment_id"] for r in got} == {1, 2, 3, 4}
    assert all(r["predicted_congestion_minutes"] >= 0 for r in got)


def test_rail_end_to_end(spark, rail_archive, tmp_path):
    risk_path, event_path = str(tmp_path / "risk"), str(tmp_path / "events")
    assert rail.prepare_training_tables(spark, rail_archive, risk_path, event_path, seed=3)
    risk, events = spark.read.parquet(risk_path), spark.read.parquet(event_path)
    assert risk.count() == 120 and risk.where("up_ttnt_1 is null").count() == 0
    assert events.groupBy("copy").count().agg(F.countDistinct("count")).first()[0] == 1
    models = rail.train(risk, events, seed=3, iterations=(2, 3))
    state = rail.refresh(read_newest(spark, rail_archive, "*.json"), *models).collect()
    assert {r["sta"] for r in state} == {"A", "B", "C"}
    for r in state:
        assert 0 <= r["delay_risk_probability"] <= 1 and r["affected_trains_count"] >= 0
        assert r["up_ttnt"] == float(39 % 7) and r["color_code"] in ("green", "yellow", "red")


def test_no_delays_means_no_event_training(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(
        json.dumps({"collected_at": "20240102_080000", "data": {"T": {"A": {"isdelay": "N", "data": {}}}}})
    )
    ok = rail.prepare_training_tables(spark, str(tmp_path / "in"), str(tmp_path / "r"), str(tmp_path / "e"), seed=1)
    assert ok is False
    assert {"delay_duration_minutes", "affected_trains_count"} <= set(spark.read.parquet(str(tmp_path / "e")).columns)


def test_live_rows_keep_unreadable_stamp(spark):
    doc = json.dumps({"collected_at": "?", "data": {"T": {"A": {"data": {"T-A": {"UP": [{"ttnt": "3"}]}}}}}})
    docs = spark.createDataFrame([(doc, "f")], f"value string, {FILE} string")
    row = rail.live_rows(docs).first()
    assert (row["up_ttnt_1"], row["down_ttnt_1"], row["hour"], row["is_peak"], row["timestamp"]) == (3.0, 0.0, 0, 0, None)


def test_augmentation_invariants(spark):
    rows = [(i, 0.5, 3.0, 1.2, 1) for i in range(300)]
    df = spark.createDataFrame(
        rows, "id int, up_ttnt_1 double, down_ttnt_1 double, delay_duration_minutes double, affected_trains_count int"
    )
    out = dataset.augment(df, ["id"], seed=11)
    assert out.count() == 6 * len(rows)
    assert sorted(map(tuple, out.where("copy = 0").drop("copy").collect())) == rows
    low = out.agg(F.min("up_ttnt_1"), F.min("delay_duration_minutes"), F.max("affected_trains_count")).first()
    assert low[0] == 0.0 and low[1] == 1.0 and low[2] == 1
    spread = out.where("copy > 0").agg(F.stddev("down_ttnt_1"), F.countDistinct("down_ttnt_1")).first()
    assert 1.2 < spread[0] < 2.2 and spread[1] > 1200
    again = dataset.augment(df.repartition(7), ["id"], seed=11)
    assert sorted(out.collect()) == sorted(again.collect())
    assert sorted(out.collect()) != sorted(dataset.augment(df, ["id"], seed=12).collect())


def test_splits(spark):
    df = spark.range(5000).withColumn("ts", F.timestamp_seconds(F.col("id")))
    stable = dataset.split_stable(df, ["id"], seed=1)
    share = stable.agg(F.avg(F.col("is_train").cast("int"))).first()[0]
    assert 0.77 < share < 0.83
    assert stable.where("is_train").exceptAll(dataset.split_stable(df.repartition(9), ["id"], seed=1).where("is_train")).isEmpty()
    by_time = dataset.split_by_time(df, "ts")
    assert by_time.where("is_train").count() == 4000
    assert by_time.where("is_train").agg(F.max("id")).first()[0] < by_time.where("not is_train").agg(F.min("id")).first()[0]
    train, valid = dataset.split_random(df, seed=1)
    assert train.count() + valid.count() == 5000


def test_loss_metrics(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.4), (1, 1.0)], "y int, p double")
    row = dataset.loss_metrics(df, "y", "p").first()
    assert row["mse"] == pytest.approx((0.04 + 0.16 + 0) / 3)
    assert row["bce"] == pytest.approx(-(math.log(0.8) + math.log(0.6) + math.log(1 - 1e-12)) / 3)


def test_split_by_time_is_exact(spark):
    times = [-5, 0, 0, 0, 7, 7, 100, 10**9, 10**9 + 1, 10**12]
    df = spark.createDataFrame([(t,) for t in times], "u bigint").withColumn("ts", F.timestamp_micros("u"))
    for train in (0.1, 0.2, 0.5, 0.6, 0.8, 0.9, 1.0):
        cut = sorted(times)[math.ceil(round(train * len(times), 6)) - 1]
        got = dataset.split_by_time(df, "ts", train)
        assert sorted(r["u"] for r in got.where("is_train").collect()) == [t for t in times if t <= cut]
    assert dataset.split_by_time(df.limit(0), "ts").collect() == []


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_best_candidate_beats_the_constant(spark, task):
    wave = lambda i: 10.0 * (i % 4 >= 2)
    rows = [(datetime(2024, 1, 1) + timedelta(minutes=i), [float(i % 4)], wave(i) if task == "regression" else float(i % 4 >= 2)) for i in range(80)]
    samples = spark.createDataFrame(rows, "at timestamp, f array<double>, label double").withColumn("features", array_to_vector("f"))
    model = learn.select_best(samples, "label", 5, task, "at", iterations=(1, 3))
    chosen = learn.selection(samples, "label", 5, task, "at", iterations=(1, 3))
    assert (chosen.n_train, chosen.n_validation) == (64, 16) and 1 <= chosen.trees <= 3
    assert chosen.loss < chosen.constant_loss == pytest.approx(25.0 if task == "regression" else math.log(2))
    newest = samples.where(F.col("at") >= rows[64][0])
    loss = learn.validation_loss(model, newest, "label", task)
    assert loss < (25.0 if task == "regression" else math.log(2)) / 2


def test_scoring_reads_no_labels_and_needs_no_window(spark, road_archive, tmp_path):
    rows = road.congestion_features(road.observations(read_archive(spark, road_archive, "*.xml")), FILE)
    samples = spark.createDataFrame([([0.5] * 60, 1.0), ([0.2] * 60, 2.0)], "f array<double>, label double")
    model = learn.train_regressor(samples.withColumn("features", array_to_vector("f")), "label", 1, kind="linear")
    scored = learn.score_road(rows, model, FILE)
    assert scored.count() == 4
    assert "Window" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_newest_row_takes_known_arrivals(spark):
    rows = [("L", "A", 1, 3.0, None), ("L", "A", 2, None, None), ("L", "B", 1, None, 4.0), ("L", "B", 2, 5.0, None)]
    df = spark.createDataFrame(rows, "line string, sta string, t int, up double, down double")
    got = serving.latest_filled(df, ["line", "sta"], "t", (), ["up", "down"]).orderBy("sta").collect()
    assert [tuple(r) for r in got] == [("L", "A", 2, 3.0, 0.0), ("L", "B", 2, 5.0, 4.0)]
