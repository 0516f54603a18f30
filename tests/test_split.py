"""Long histories in thousands of pieces, whatever their tiebreaker, and newest rows of any type."""

import inspect
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalbox.operators import newest, series, serving, split

T0 = datetime(2024, 5, 1)


def test_nothing_but_counts_reaches_the_driver():
    assert ".collect(" not in inspect.getsource(split) and "toPandas" not in inspect.getsource(split)


def long_series(spark, n=6000, crowded=False):
    """Key 1 holds nearly all rows; each of the others has three."""
    at = F.lit(T0) + F.make_dt_interval(mins=(F.lit(0) if crowded else F.col("id") % n))
    rows = spark.range(n).select(F.lit(1).alias("k"), at.alias("ts"), F.format_string("file-%07d", "id").alias("f"), (F.col("id") % 7).alias("v"))
    few = spark.range(30).select((F.col("id") % 10 + 2).cast("int").alias("k"), (F.lit(T0) + F.make_dt_interval(mins=F.col("id"))).alias("ts"), F.format_string("file-%07d", "id").alias("f"), F.col("id").alias("v"))
    return rows.union(few).repartition(6, "f")


def test_thousands_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(split, "PIECE_ROWS", 3)
    df = long_series(spark)
    plan = split.plan_split(df, ["k"], "ts", "f")
    assert plan.longs == 1 and plan.partitions == 2000
    marked = plan.mark(df)
    pieces = marked.where("k = 1").groupBy(split.PIECE).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy(split.PIECE).collect()
    assert len(pieces) > 1500 and max(p["n"] for p in pieces) < 20
    assert all(x["b"] < y["a"] for x, y in zip(pieces, pieces[1:]))
    assert {r[0] for r in marked.where("k > 1").select(split.PIECE).distinct().collect()} == {-1}
    got = series.gap_minutes(df, ["k"], "ts", "f", split=plan).groupBy("k").agg(F.count("*").alias("n"), F.sum("time_diff").alias("s"), F.max("time_diff").alias("m"))
    rows = {r["k"]: (r["n"], r["s"], r["m"]) for r in got.collect()}
    assert rows[1] == (6000, 5999 + 5.0, 5.0) and all(rows[k] == (3, 25.0, 10.0) for k in range(2, 12))


def test_one_crowded_time_is_cut_along_file_names(spark):
    df = long_series(spark, 600, crowded=True)
    plan = split.plan_split(df, ["k"], "ts", "f", max_rows=20)
    sizes = plan.mark(df).where("k = 1").groupBy(split.PIECE).count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) <= 60
    out = series.change_blocks(df, ["k"], "ts", "f", "v", split=plan).where("k = 1").agg(F.max("block_id")).first()[0]
    assert out == 599  # every row of key 1 differs from the one before


def test_too_many_long_keys_to_send(spark, monkeypatch):
    """All rows are sorted, and only keys that cross a boundary are cut."""
    monkeypatch.setattr(split, "MAX_BROADCAST_ROWS", 2)
    df = spark.range(400).select((F.col("id") % 10).cast("int").alias("k"), (F.lit(T0) + F.make_dt_interval(mins=F.col("id"))).alias("ts"), F.col("id").alias("i"))
    df = df.union(spark.range(5).select(F.lit(77), F.lit(T0), F.col("id")))
    plan = split.plan_split(df, ["k"], "ts", "i", max_rows=15)
    assert plan.longs == 10
    marked = plan.mark(df)
    pieces = {r["k"]: r["n"] for r in marked.groupBy("k").agg(F.count_distinct(split.PIECE).alias("n")).collect()}
    assert pieces[77] == 1 and max(pieces.values()) >= 2 and marked.count() == 405
    got = series.gap_minutes(df, ["k"], "ts", "i", split=plan).where("k < 10").agg(F.sum("time_diff")).first()[0]
    assert got == 10 * (5.0 + 390.0)


def test_nothing_is_cut_without_long_keys(spark):
    plan = split.plan_split(long_series(spark), ["k"], "ts", "f")
    assert plan.cuts is None and plan.mark(long_series(spark)).columns == ["k", "ts", "f", "v"]


ROWS = [
    (1, T0, 5, 1.0, "a"), (1, T0 + timedelta(seconds=1), -9, None, "b"), (1, T0 + timedelta(seconds=1), -10, 3.0, "c"), (1, None, 99, 4.0, "d"),
    (2, None, 1, 5.0, "e"), (2, None, None, 6.0, "f"), (3, datetime(1, 1, 1), 2**63 - 1, 7.0, "g"), (3, datetime(1, 1, 1), -(2**63), 8.0, "h"),
    (None, datetime(9999, 12, 31, 23, 59, 59), 2**63 - 1, 9.0, "i"), (None, datetime(9999, 12, 31, 23, 59, 59), 0, 10.0, "j"),
]
SCHEMA = "k int, ts timestamp_ntz, i bigint, v double, s string"
LAST, FIRST = {1: "b", 2: "e", 3: "g", None: "i"}, {1: "d", 2: "f", 3: "h", None: "j"}


@pytest.mark.parametrize("texts", (False, True))
def test_newest_and_first_rows(spark, texts):
    """By hash aggregation where all columns have a fixed width."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    given = df if texts else df.drop("s")
    value = {r[4]: r[3] for r in ROWS}
    last = serving.latest(given, ["k"], "ts", "i")
    first = series.first_rows(given, ["k"], "ts", "i", [c for c in given.columns if c != "k"])
    assert {r["k"]: r["v"] for r in last.collect()} == {k: value[s] for k, s in LAST.items()}
    assert {r["k"]: r["v"] for r in first.collect()} == {k: value[s] for k, s in FIRST.items()}
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and ("SortAggregate" in plan) == texts


def test_newest_without_tiebreaker_takes_one_whole_row(spark):
    df = spark.createDataFrame([(1, 5, i, -i) for i in range(50)], "k int, at int, a int, b int").repartition(4)
    (row,) = serving.latest(df, ["k"], "at").collect()
    assert row["a"] == -row["b"]


def test_packed_order(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    order = [F.col("ts").asc_nulls_first(), F.col("i").asc_nulls_first()]
    rows = df.withColumn("p", newest.packed(df, "ts", ["i"])).orderBy(*order).collect()
    packed = [r["p"] for r in rows]
    assert packed == sorted(packed) and len(set(packed)) == len(packed) and None not in packed
    assert newest.packed(df, "v", []) is None and newest.packed(df, "ts", ["s"]) is None and newest.packed(df, "ts", ["i", "v"]) is None
