"""Queries on tables where one key holds a third of all rows, with every long history cut, against SQL."""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, normal
from signalbox.operators import split

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")

HOT = {
    "events": "SELECT * REPLACE (CASE WHEN hash(event_id) % 3 = 0 THEN 7 ELSE user_id END AS user_id)",
    "lineitem": "SELECT * REPLACE (CASE WHEN hash(l_partkey, l_quantity) % 3 = 0 THEN 5 ELSE l_orderkey END AS l_orderkey)",
    "orders": "SELECT * REPLACE (CASE WHEN hash(o_orderkey) % 3 = 0 THEN 9 ELSE o_custkey END AS o_custkey)",
}

NAMES = [
    "gap_minutes", "run_minutes", "run_minutes_leading", "lead_label", "lead_label_time", "road_training_table",
    "top_congested_segments", "forward_fill", "lookahead_max", "lookahead_max_time", "rail_risk_table",
    "change_blocks", "sequence_windows", "sequence_windows_all", "sequence_padding", "gap_interpolate",
    "delay_events", "delay_events_observed", "augment_events", "ordered_polyline", "ordered_polyline_parts",
    "first_line_of_station", "latest_state", "json_flatten", "xml_flatten", "stream_events", "stream_sequences",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    duckdb = pytest.importorskip("duckdb")
    folder, db = tmp_path_factory.mktemp("skew"), duckdb.connect()
    for t in TABLES:
        change = HOT.get(t, "SELECT *")
        db.execute(f"COPY ({change} FROM '{SF}/{t}.parquet') TO '{folder}/{t}.parquet'")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), db


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, skewed, name, monkeypatch):
    monkeypatch.setattr(split, "PIECE_ROWS", 40)
    folder, db = skewed
    df = entry.queries()[name](spark, folder)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert got == normal(result.fetchall(), columns)


def test_hot_key_is_cut(spark, skewed, monkeypatch):
    monkeypatch.setattr(split, "PIECE_ROWS", 40)
    events = spark.read.parquet(f"{skewed[0]}/events.parquet")
    plan = split.plan_split(events, ["user_id"], "ts", "event_id")
    pieces = plan.mark(events).where("user_id = 7").groupBy(split.PIECE).count().collect()
    rows = sum(r["count"] for r in pieces)
    assert rows > events.count() / 4 and len(pieces) >= 5
    assert max(r["count"] for r in pieces) < 3 * rows / len(pieces)
