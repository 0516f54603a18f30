"""Every query next to its SQL on the smallest data, and the plans that matter."""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, normal

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == normal(result.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    chain = plan(entry.queries()["road_training_table"](spark, SF))
    assert chain.count("Exchange hashpartitioning") == 1
    columns = chain.split("ReadSchema:")[1].splitlines()[0]
    assert "props" not in columns and "event_type" not in columns
    for name in ("rail_risk_table", "change_blocks", "lookahead_max", "sequence_windows"):
        assert plan(entry.queries()[name](spark, SF)).count("Exchange hashpartitioning") == 1, name
    for name in (
        "nearest_point", "minmax_affine", "network_join_predictions", "semi_join_network", "dimension_lookup_first",
        "first_line_of_station", "combine_forecasts", "state_lookup", "newest_snapshot", "split_by_time", "locate_events",
    ):
        text = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_feature_collections_are_bounded(spark, monkeypatch):
    from signalbox.plans import catalog

    made, whole = [], catalog.sinks.feature_collections
    monkeypatch.setattr(catalog.sinks, "feature_collections", lambda *a, **k: made.append(whole(*a, **k)) or made[-1])
    rows = catalog.QUERIES["feature_collections"](spark, entry.FLAGSHIP_DATA).count()
    sizes = [(r["line"], r["features"]) for r in made[0].select("line", "features").collect()]
    assert len({line for line, _ in sizes}) == 10 and sum(n for _, n in sizes) == rows and max(n for _, n in sizes) <= 10_000
