"""Series operators against hand-worked cases and brute force, whole and cut into pieces."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalbox.operators import events, series
from signalbox.operators.split import PIECE, Series, plan_split

T0 = datetime(2024, 1, 2, 8, 0)


@pytest.fixture(scope="module")
def rows():
    """Key 1 holds most rows, with ties in time; keys 2..5 are short; one has a single row."""
    rng = np.random.default_rng(7)
    out = []
    for key, n in [(1, 160), (2, 13), (3, 12), (4, 5), (5, 1), (None, 40)]:
        at = 0
        for i in range(n):
            if not (key == 1 and 60 <= i < 110):  # fifty rows of the longest key share one time
                at += int(rng.choice([0, 0.5, 5, 20]) * 60)
            speed = None if rng.random() < 0.1 else float(np.round(rng.uniform(0, 60), 2))
            out.append((key, T0 + timedelta(seconds=at), len(out), speed, int(rng.random() < 0.4)))
    return pd.DataFrame(out, columns=["k", "ts", "id", "v", "flag"]).astype({"k": "Int64"})


@pytest.fixture(scope="module")
def frame(spark, rows):
    data = [
        (None if pd.isna(r.k) else int(r.k), r.ts.to_pydatetime(), r.id, None if pd.isna(r.v) else r.v, r.flag)
        for r in rows.itertuples()
    ]
    return spark.createDataFrame(data, "k int, ts timestamp, id int, v double, flag int").repartition(3).cache()


@pytest.fixture(params=["whole", "cut"])
def split(request, frame):
    return plan_split(frame, ["k"], "ts", "id", max_rows=9 if request.param == "cut" else 10**9)


def groups(rows):
    for key, g in rows.groupby("k", dropna=False):
        yield key, g.sort_values(["ts", "id"], kind="stable").reset_index(drop=True)


def values(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.select("id", *cols).collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for key in a:
        assert a[key] == pytest.approx(b[key], nan_ok=True), key


ARGS = (["k"], "ts", "id")


def test_split_cuts_only_large_keys(frame):
    plan = plan_split(frame, ["k"], "ts", "id", max_rows=9)
    sizes = Series(frame, ["k"], "ts", "id", plan).df.groupBy("k", PIECE).count().collect()
    pieces = {}
    for r in sizes:
        pieces.setdefault(r["k"], []).append((r[PIECE], r["count"]))
    assert [p for p, _ in pieces[5]] == [-1] and [p for p, _ in pieces[4]] == [-1]
    assert len(pieces[1]) > 8 and all(p >= 0 for p, _ in pieces[1])
    assert len(pieces[None]) > 2
    assert sum(n for p in pieces.values() for _, n in p) == frame.count()
    assert max(n for p in pieces.values() for _, n in p) <= 2 * 9 + 2  # also where times crowd
    assert plan_split(frame, ["k"], "ts").cuts is None  # small input: not even measured


def test_pieces_follow_time(frame):
    plan = plan_split(frame, ["k"], "ts", "id", max_rows=9)
    s = Series(frame, ["k"], "ts", "id", plan)
    at = F.struct("ts", "id")
    spans = s.df.groupBy("k", PIECE).agg(F.min(at).alias("a"), F.max(at).alias("b")).collect()
    for key in {r["k"] for r in spans}:
        mine = sorted((r for r in spans if r["k"] == key), key=lambda r: r[PIECE])
        assert all(x["b"] < y["a"] for x, y in zip(mine, mine[1:]))


def gaps(g, default=5.0):
    return (g.ts.diff().dt.total_seconds() / 60).fillna(default)


def test_gap_minutes(frame, rows, split):
    want = {i: (x,) for _, g in groups(rows) for i, x in zip(g.id, gaps(g))}
    close(values(series.gap_minutes(frame, *ARGS, split=split), "time_diff"), want)
    capped = series.gap_minutes(frame, *ARGS, max_gap=7.5, split=split)
    close(values(capped, "time_diff"), {i: (min(x, 7.5),) for i, (x,) in want.items()})


@pytest.mark.parametrize("mode,least", [("run", None), ("leading", None), ("run", 10.0)])
def test_run_minutes(frame, rows, split, mode, least):
    want = {}
    for _, g in groups(rows):
        block, minutes = 0, 0.0
        for i, v, d in zip(g.id, g.v, gaps(g)):
            if v < 30:
                minutes += d
            else:
                block, minutes = block + 1, 0.0
            shown = minutes if (mode == "run" or block == 0) else 0.0
            want[i] = (block, shown if least is None or shown >= least else 0.0)
    df = frame.withColumn("c", (F.col("v") < 30).cast("int"))
    df = series.gap_minutes(df, *ARGS, split=split)
    df = series.run_minutes(df, *ARGS, "c", mode=mode, min_minutes=least, split=split)
    close(values(df, "congestion_block", "congestion_minutes"), want)


def test_run_minutes_worked_example(spark):
    speeds = [20.0, 25.0, 40.0, 10.0, 12.0, 30.0]
    df = spark.createDataFrame(
        [(1, T0 + timedelta(minutes=5 * i), i, v) for i, v in enumerate(speeds)],
        "k int, ts timestamp, id int, v double",
    ).withColumn("c", (F.col("v") < 30).cast("int"))
    df = series.gap_minutes(df, *ARGS)
    run = series.run_minutes(df, *ARGS, "c")
    lead = series.run_minutes(df, *ARGS, "c", mode="leading")
    assert [x for _, x in sorted(values(run, "congestion_minutes").items())] == [
        (5.0,), (10.0,), (0.0,), (5.0,), (10.0,), (0.0,)
    ]
    assert [x for _, x in sorted(values(lead, "congestion_minutes").items())] == [
        (5.0,), (10.0,), (0.0,), (0.0,), (0.0,), (0.0,)
    ]
    with pytest.raises(ValueError):
        series.run_minutes(df, *ARGS, "c", mode="other")


@pytest.mark.parametrize("n", [6, 15])
def test_lead_label(frame, rows, split, n):
    want = {i: (x,) for _, g in groups(rows) for i, x in zip(g.id, g.v.shift(-n).fillna(0.0))}
    close(values(series.lead_label(frame, *ARGS, "v", rows=n, out="y", split=split), "y"), want)


@pytest.mark.parametrize("small", [False, True])
def test_lead_label_by_time(frame, rows, small, monkeypatch):
    if small:
        plan = series.Series.__post_init__

        def forced(self):
            self.split = plan_split(self.df, self.keys, self.order, "__kind", max_rows=11)
            plan(self)

        monkeypatch.setattr(series.Series, "__post_init__", forced)
    want = {}
    for _, g in groups(rows):
        for i, t in zip(g.id, g.ts):
            later = g[g.ts >= t + timedelta(minutes=30)]
            want[i] = (0.0 if later.empty or pd.isna(later.v.iloc[0]) else later.v.iloc[0],)
    close(values(series.lead_label(frame, *ARGS, "v", seconds=1800, out="y"), "y"), want)


def test_forward_fill(frame, rows, split):
    want = {i: (x,) for _, g in groups(rows) for i, x in zip(g.id, g.v.ffill().fillna(0.0))}
    close(values(series.forward_fill(frame, *ARGS, ["v"], split=split), "v"), want)


@pytest.mark.parametrize("n", [1, 10])
def test_lookahead_rows(frame, rows, split, n):
    want = {
        i: (float(g.flag[j : j + n].max()),) for _, g in groups(rows) for j, i in enumerate(g.id)
    }
    close(values(series.lookahead_max(frame, *ARGS, "flag", rows=n, out="y", split=split), "y"), want)


def test_lookahead_time(frame, rows, split):
    want = {}
    for _, g in groups(rows):
        for i, t in zip(g.id, g.ts):
            near = g[(g.ts >= t) & (g.ts <= t + timedelta(seconds=600))]
            want[i] = (float(near.flag.max()),)
    df = series.lookahead_max(frame, *ARGS, "flag", seconds=600, out="y", split=split)
    close(values(df, "y"), want)


def islands(rows):
    for key, g in groups(rows):
        block = (g.flag.diff().fillna(0) != 0).cumsum()
        yield key, g, block


def test_change_blocks(frame, rows, split):
    want = {i: (int(b),) for _, g, block in islands(rows) for i, b in zip(g.id, block)}
    close(values(series.change_blocks(frame, *ARGS, "flag", split=split), "block_id"), want)


def test_extract_events(frame, rows, split):
    want = set()
    for key, g, block in islands(rows):
        for _, e in g[g.flag == 1].groupby(block[g.flag == 1]):
            minutes = max(1.0, (e.ts.max() - e.ts.min()).total_seconds() / 60)
            want.add(
                (None if pd.isna(key) else int(key), e.ts.min().to_pydatetime(), int(e.id.iloc[0]),
                 minutes, int(1 + minutes // 5), len(e))
            )
    got = events.extract_events(frame, *ARGS, "flag", ["id"], split=split)
    cols = ["k", "ts", "id", "delay_duration_minutes", "affected_trains_count", "row_count"]
    assert {tuple(r) for r in got.select(*cols).collect()} == want
    assert events.event_count(frame, *ARGS, "flag", split=split).first()[0] == len(want)
    # every flagged row belongs to exactly one event
    assert got.agg(F.sum("row_count")).first()[0] == rows.flag.sum()


def test_events_worked_example(spark):
    flags = [0, 1, 1, 0, 1, 0, 0, 1, 1, 1]
    df = spark.createDataFrame(
        [("a", T0 + timedelta(minutes=i), i, f) for i, f in enumerate(flags)],
        "k string, ts timestamp, id int, flag int",
    )
    got = events.extract_events(df, *ARGS, "flag", ["id"]).orderBy("ts").collect()
    assert [(r["id"], r["delay_duration_minutes"], r["affected_trains_count"]) for r in got] == [
        (1, 1.0, 1), (4, 1.0, 1), (7, 2.0, 1)
    ]
    assert events.extract_events(df.where("flag = 0"), *ARGS, "flag", ["id"]).count() == 0
    long = spark.createDataFrame(
        [("a", T0 + timedelta(minutes=12 * i), i, 1) for i in range(2)],
        "k string, ts timestamp, id int, flag int",
    )
    assert events.extract_events(long, *ARGS, "flag", ["id"]).first()["affected_trains_count"] == 3


@pytest.mark.parametrize(
    "length,pad,drop_last",
    [(1, True, True), (3, True, True), (12, True, True), (12, True, False), (3, False, True), (3, False, False)],
)
def test_sequences(frame, rows, split, length, pad, drop_last):
    want = set()
    for _, g in groups(rows):
        ids, flags = list(g.id), list(g.flag)
        need = length + 1 if drop_last else length
        if len(ids) < need:
            if not pad:
                continue
            ids = [ids[0]] * (need - len(ids)) + ids
            flags = [flags[0]] * (need - len(flags)) + flags
        for i in range(len(ids) - need + 1):
            want.add((tuple(ids[i : i + length]), flags[i + length - 1]))
    got = series.sequences(
        frame, *ARGS, ["id"], "flag", length, pad=pad, drop_last=drop_last, split=split
    ).collect()
    assert len(got) == len(want)
    assert {(tuple(f["id"] for f in r["features"]), r["label"]) for r in got} == want


def test_constant_history_and_first_rows(frame, rows):
    one = series.constant_history(frame, ["v", "flag"], 12).first()
    assert len(one["features"]) == 12 and len(set(one["features"])) == 1
    got = {r["k"]: r["id"] for r in series.first_rows(frame, *ARGS, ["id"]).collect()}
    assert got == {None if pd.isna(k) else k: g.id[0] for k, g in groups(rows)}


def test_interpolate_gaps(frame, rows, split):
    df = frame.withColumn("known", F.coalesce(F.col("flag") == 1, F.lit(False))).withColumn(
        "v", F.coalesce("v", F.lit(0.0))
    )
    want = {}
    for _, g in groups(rows.fillna({"v": 0.0})):
        v, known = list(g.v), [j for j, f in enumerate(g.flag) if f]
        for a, b in zip(known, known[1:]):
            for k in range(1, b - a):
                v[a + k] = v[a] + (v[b] - v[a]) * k / (b - a)
        want.update({i: (x,) for i, x in zip(g.id, v)})
    close(values(series.interpolate_gaps(df, *ARGS, "known", ["v"], split=split), "v"), want)


def test_whole_chain_shuffles_once(frame, split):
    df = frame.withColumn("c", (F.col("v") < 30).cast("int"))
    df = series.gap_minutes(df, *ARGS, split=split)
    df = series.run_minutes(df, *ARGS, "c", split=split)
    df = series.lead_label(df, *ARGS, "congestion_minutes", split=split)
    if split.cuts is None:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
