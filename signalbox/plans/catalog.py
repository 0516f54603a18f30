"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbox.functions import calendar, geometry, rounding, severity
from signalbox.operators import dataset, events, learn, network, series, serving
from signalbox.plans import rail as rail_plan
from signalbox.plans import road as road_plan
from signalbox.plans import standin
from signalbox.session import work_dir
from signalbox.sources import sinks, snapshots, tables
from signalbox.streaming import events as stream_state
from signalbox.streaming import feeds, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ROAD = (["segment_id"], "datetime", "event_id")
RAIL = (["line", "sta"], "timestamp", "event_id")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---- documents -------------------------------------------------------------------------------


@query
def xml_flatten(spark, sf):
    return snapshots.flatten_road_xml(standin.road_documents(spark, sf)).rows


@query
def xml_document_policy(spark, sf):
    docs = standin.road_documents(spark, sf)
    return snapshots.flatten_road_xml(docs, on_error="document").rows


@query
def xml_rejected(spark, sf):
    refused = snapshots.flatten_road_xml(standin.road_documents(spark, sf), keep=["date", "time"]).rejected
    entry = F.from_json("entry", "segment_id string, speed string")
    return refused.select("date", "time", "reason", entry["segment_id"].alias("segment_id"), entry["speed"].alias("speed"))


@query
def json_flatten(spark, sf):
    return _stamped(snapshots.flatten_rail_json(standin.rail_documents(spark, sf)).rows)


@query
def json_flatten_zero(spark, sf):
    return _stamped(snapshots.flatten_rail_json(standin.rail_documents(spark, sf), missing="zero").rows)


@query
def json_flatten_live(spark, sf):
    docs = standin.rail_documents(spark, sf)
    flat = snapshots.flatten_rail_json(docs, missing="zero", on_error="document", keep_empty=False)
    return _stamped(flat.rows)


def _stamped(rows):
    return rows.withColumn("timestamp", calendar.timestamp_to_clock("timestamp"))


@query
def json_nest_roundtrip(spark, sf):
    rows = standin.table(spark, sf, "events", "event_id", "ts", "user_id", "value").select(
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"),
        F.concat(F.lit('line "'), (F.col("user_id") % 10).cast("string")).alias("line"),
        F.col("event_id").cast("string").alias("sta"),
        F.struct(F.lit("N").alias("isdelay"), F.create_map(F.lit("raw"), F.col("value").cast("string")).alias("extra")).alias("payload"),
    )
    docs = snapshots.nest_rail_json(rows, "ts", "line", "sta", "payload")
    parsed = docs.select("collected_at", F.from_json(
        "value", "data map<string, map<string, struct<extra: map<string, string>>>>").alias("d"))
    lines = parsed.select("collected_at", F.explode("d.data").alias("line", "stas"))
    stas = lines.select("collected_at", "line", F.explode("stas").alias("sta", "info"))
    return stas.select(
        "collected_at", "line", F.col("sta").cast("bigint").alias("event_id"),
        F.col("info.extra")["raw"].cast("double").alias("value"),
    )


def _as_files(docs, path, *folders):
    """Documents as an archive: one file each, in nested folders named by columns."""
    docs.select("value", *folders).write.mode("append").partitionBy(*folders).text(path)


@query
def archive_flatten(spark, sf):
    """Documents written to nested folders, one file each, and read back as an archive."""
    path = work_dir(spark, "archive")
    docs = standin.road_documents(spark, sf).withColumn("hour", F.substring("time", 1, 2))
    _as_files(docs, path, "date", "hour")
    rows = road_plan.observations(snapshots.read_archive(spark, path, "part-*"))
    folder = F.regexp_extract(snapshots.FILE, "/date=([^/]+)/hour=", 1)
    return rows.select(
        "segment_id", "speed", calendar.timestamp_to_clock("datetime").alias("datetime"), folder.alias("folder"),
        "hour", "day_of_week", "is_weekend", "is_peak",
    )


@query
def archive_between(spark, sf):
    """Three days of an archive in dated folders; the others stay unopened."""
    path = work_dir(spark, "archive")
    docs = standin.road_documents(spark, sf).withColumn("hour", F.substring("time", 1, 2))
    _as_files(docs, path, "date", "hour")
    first = docs.agg(F.min(F.to_date("date"))).first()[0]
    day = lambda n: str(first + timedelta(days=n))
    found = snapshots.read_between(spark, path, "part-*", day(1), day(3))
    rows = road_plan.observations(found.select("value", snapshots.FILE))
    return rows.select("segment_id", "speed", calendar.timestamp_to_clock("datetime").alias("datetime"))


@query
def newest_snapshot(spark, sf):
    """The document that was written last to a dated archive."""
    path, parsed = work_dir(spark, "newest"), work_dir(spark, "documents")
    standin.rail_documents(spark, sf).withColumn("day", F.substring("collected_at", 1, 8)).write.parquet(parsed)
    docs = spark.read.parquet(parsed)
    newest = F.col("collected_at") == docs.agg(F.max("collected_at")).scalar()
    for part in (docs.where(~newest), docs.where(newest)):
        _as_files(part, path, "day", "collected_at")
    return _stamped(snapshots.flatten_rail_json(snapshots.read_newest(spark, path, "part-*")).rows)


@query
def station_pixels_csv(spark, sf):
    """Customers as a table of station pixels in CSV; some have no real place."""
    rows = standin.table(spark, sf, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("x_projection"), F.col("c_custkey").cast("double").alias("y_projection"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") / 7).alias("x_real"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") / 3).alias("y_real"), F.col("c_mktsegment").alias("color"),
    )
    path = work_dir(spark, "pixels")
    rows.write.option("header", True).csv(path)
    return tables.read_station_pixels(spark, path)


@query
def paths_csv(spark, sf):
    """Paths in CSV, with the texts that stand for no projection and for a direction."""
    n = F.col("vec_id")
    rows = standin.path_texts(spark, sf).select(
        n.cast("string").alias("name"), "path", F.lit("#123456").alias("color"), F.lit("2").alias("stroke_width"), F.lit("line").alias("class"),
        F.when(n % 3 == 0, "null").otherwise("plane").alias("projection"),
        F.when(n % 2 == 0, "TRUE").when(n % 7 != 0, "FALSE").alias("reverseFirstPath"),
        F.when(n % 5 == 0, "TRUE").otherwise("true").alias("reverseSecondPath"),
    )
    path = work_dir(spark, "paths")
    rows.write.option("header", True).csv(path)
    back = tables.read_paths(spark, path)
    kept = ["name", "color", "projection", "reverseFirstPath", "reverseSecondPath"]
    return geometry.path_vertices(back.select(*kept, "path"), "path").drop("path")


@query
def configured_lines(spark, sf):
    """How many rows each station of the configured lines has."""
    lines = tables.line_stations(spark, {f"L{i}": [str(10 * j + i) for j in range(12)] for i in range(10)})
    rows = standin.rail(spark, sf).groupBy("line", "sta").agg(F.count(F.lit(1)).alias("n"))
    return lines.join(rows, ["line", "sta"])


@query
def delay_alerts(spark, sf):
    return serving.alerts(standin.rail(spark, sf)).select("event_id", "timestamp", "line", "sta")


# ---- scalar functions ------------------------------------------------------------------------


@query
def calendar_features(spark, sf):
    return calendar.add_calendar(standin.table(spark, sf, "events", "event_id", "ts"), "ts").drop("ts")


@query
def stamp_roundtrip(spark, sf):
    df = standin.table(spark, sf, "events", "event_id", "ts")
    stamp = calendar.timestamp_to_stamp("ts")
    civil = calendar.civil_timestamp(F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"))
    return df.select(
        "event_id",
        stamp.alias("stamp"),
        calendar.timestamp_to_clock(calendar.stamp_to_timestamp(stamp)).alias("clock"),
        F.unix_micros(civil).alias("civil_micros"),
        calendar.stamp_to_timestamp(F.concat(stamp, F.lit("x"))).isNull().alias("bad_is_null"),
    )


@query
def rounded_values(spark, sf):
    x = F.col("value")
    return standin.table(spark, sf, "events", "event_id", "value").select(
        "event_id",
        rounding.exact_round(x, 1).alias("one"),
        rounding.exact_round(x / 7, 2).alias("two"),
        rounding.exact_round(x / 300, 4).alias("four"),
        rounding.round_count(x - 20).alias("whole"),
        rounding.percent_text(x / 400).alias("percent"),
    )


# ---- series ----------------------------------------------------------------------------------


@query
def gap_minutes(spark, sf):
    return series.gap_minutes(standin.road(spark, sf), *ROAD).select("event_id", "segment_id", "time_diff")


@query
def gap_minutes_capped(spark, sf):
    return series.gap_minutes(standin.road(spark, sf), *ROAD, max_gap=60).select("event_id", "time_diff")


def _congestion(spark, sf, **options):
    return road_plan.congestion_features(standin.road(spark, sf), "event_id", **options)


@query
def run_minutes(spark, sf):
    return _congestion(spark, sf).select("event_id", "is_congested", "congestion_block", "congestion_minutes")


@query
def run_minutes_leading(spark, sf):
    return _congestion(spark, sf, mode="leading").select("event_id", "congestion_block", "congestion_minutes")


@query
def run_minutes_min(spark, sf):
    return _congestion(spark, sf, min_minutes=10).select("event_id", "congestion_minutes")


@query
def lead_label(spark, sf):
    return _congestion(spark, sf).select("event_id", "label_congestion_minutes")


@query
def lead_label_time(spark, sf):
    out = series.lead_label(standin.road(spark, sf), *ROAD, "speed", seconds=1800)
    return out.select("event_id", "label_speed")


@query
def road_training_table(spark, sf):
    return calendar.add_calendar(_congestion(spark, sf), "datetime").drop("event_id")


@query
def top_congested_segments(spark, sf):
    now = serving.latest(_congestion(spark, sf), ["segment_id"], "datetime", "event_id")
    return (
        now.select("segment_id", "datetime", "speed", "congestion_minutes")
        .orderBy(F.desc("congestion_minutes"), "segment_id")
        .limit(20)
    )


@query
def forward_fill(spark, sf):
    out = series.forward_fill(standin.rail(spark, sf), *RAIL, ["up_ttnt_1", "down_ttnt_1"])
    return out.select("event_id", "up_ttnt_1", "down_ttnt_1")


@query
def lookahead_max(spark, sf):
    return series.lookahead_max(standin.rail(spark, sf), *RAIL, "isdelay").select("event_id", "delay_risk_label")


@query
def lookahead_max_time(spark, sf):
    out = series.lookahead_max(standin.rail(spark, sf), *RAIL, "isdelay", seconds=36_000)
    return out.select("event_id", "delay_risk_label")


@query
def rail_risk_table(spark, sf):
    return rail_plan.risk_table(standin.rail(spark, sf), "event_id")


@query
def change_blocks(spark, sf):
    out = series.change_blocks(standin.rail(spark, sf), *RAIL, "isdelay")
    return out.select("event_id", "isdelay_changed", "block_id")


@query
def first_rows(spark, sf):
    return series.first_rows(standin.rail(spark, sf), *RAIL, ["timestamp", "up_ttnt_1", "down_ttnt_1"])


@query
def sequence_windows(spark, sf):
    return _entries(series.sequences(standin.road(spark, sf), *ROAD, ["speed"], "speed", 12), "speed")


@query
def sequence_windows_all(spark, sf):
    out = series.sequences(standin.road(spark, sf), *ROAD, ["speed"], "speed", 12, pad=False, drop_last=False)
    return _entries(out, "speed")


@query
def sequence_padding(spark, sf):
    rows = standin.road(spark, sf).withColumn("day", F.date_format("datetime", "yyyy-MM-dd"))
    out = series.sequences(rows, ["segment_id", "day"], "datetime", "event_id", ["speed"], "speed", 3)
    return _entries(out, "speed")


def _entries(samples, feature):
    return samples.select("event_id", "label", F.posexplode("features").alias("pos", "f")).select(
        "event_id", "label", "pos", F.col(f"f.{feature}").alias("value")
    )


@query
def constant_history(spark, sf):
    newest = serving.latest(standin.road(spark, sf), *ROAD)
    out = series.constant_history(newest, ["speed"], learn.ROAD_LENGTH)
    return out.select("segment_id", F.posexplode("features").alias("pos", "f")).select(
        "segment_id", "pos", F.col("f.speed").alias("value")
    )


@query
def gap_interpolate(spark, sf):
    rows = standin.rail(spark, sf).withColumn("known", F.col("isdelay") == 1).withColumn("x", F.col("down_ttnt_1"))
    return series.interpolate_gaps(rows, *RAIL, "known", ["x"]).select("event_id", "x")


# ---- events and data sets --------------------------------------------------------------------


def _events(spark, sf, **options):
    rows = calendar.add_calendar(standin.rail(spark, sf), "timestamp")
    return events.extract_events(rows, *RAIL, "isdelay", ["event_id", *rail_plan.EVENT_FEATURES], **options)


@query
def delay_events(spark, sf):
    return _events(spark, sf)


@query
def delay_events_observed(spark, sf):
    rows = standin.rail(spark, sf).withColumn("trains_listed", F.col("down_ttnt_1").cast("int"))
    out = events.extract_events(rows, *RAIL, "isdelay", ["event_id"], observed="trains_listed", max_gap=720)
    return out.select("event_id", "delay_duration_minutes", "observed_trains_count", "row_count")


@query
def delay_event_count(spark, sf):
    return events.event_count(standin.rail(spark, sf), *RAIL, "isdelay")


@query
def dataset_profile(spark, sf):
    return events.profile(rail_plan.risk_table(standin.rail(spark, sf), "event_id"), "delay_risk_label")


@query
def augment_events(spark, sf):
    out = dataset.augment(_events(spark, sf), ["event_id"], seed=7)
    noisy = {c: F.round(c, 6) for c in dataset.NOISE}
    return out.withColumns(noisy).select("event_id", "copy", *noisy, "affected_trains_count")


@query
def split_stable(spark, sf):
    return dataset.split_stable(standin.table(spark, sf, "events", "event_id"), ["event_id"], seed=7)


@query
def split_by_time(spark, sf):
    rows = standin.road(spark, sf)
    return dataset.split_by_time(rows, "datetime").groupBy("is_train").agg(F.count(F.lit(1)).alias("n"))


@query
def scaled_features(spark, sf):
    rows = dataset.scale(standin.rail(spark, sf), {"up_ttnt_1": dataset.ARRIVAL_SCALE, "down_ttnt_1": dataset.ARRIVAL_SCALE})
    return rows.select("event_id", "up_ttnt_1", "down_ttnt_1")


@query
def loss_metrics(spark, sf):
    rows = standin.rail(spark, sf).select("isdelay", (F.col("down_ttnt_1") / 100).alias("p"))
    out = dataset.loss_metrics(rows, "isdelay", "p")
    return out.select(F.round("mse", 6).alias("mse"), F.round("bce", 6).alias("bce"), "n")


@query
def preview(spark, sf):
    return standin.road(spark, sf).orderBy("datetime", "event_id").limit(5)


@query
def series_table_roundtrip(spark, sf):
    path = work_dir(spark, "series")
    sinks.write_series(standin.road(spark, sf), path, ["segment_id"], "datetime")
    return tables.read_table(spark, path, ["event_id", "segment_id", "speed", "event_date"])


# ---- learning --------------------------------------------------------------------------------


def _road_samples(spark, sf):
    rows = calendar.add_calendar(_congestion(spark, sf), "datetime")
    return rows, learn.road_samples(rows, "event_id")


@query
def train_score_road(spark, sf):
    rows, samples = _road_samples(spark, sf)
    return learn.score_road(rows, learn.train_regressor(samples, "label", seed=7), "event_id")


@query
def select_best_road(spark, sf):
    rows, samples = _road_samples(spark, sf)
    model = learn.select_best(samples, "label", 7, "regression", "datetime")
    return learn.score_road(rows, model, "event_id")


def _selected(spark, name, chosen, most=20):
    """What a selection must hold to, next to the loss of a constant; the labels here are random, so a model may lose to it."""
    known = chosen.loss is not None and 0 <= chosen.loss < float("inf")
    row = (name, chosen.n_train, chosen.n_validation, round(chosen.constant_loss, 4), 1 <= chosen.trees <= most, known)
    return spark.createDataFrame([row], "model string, n_train bigint, n_validation bigint, constant_loss double, size_in_range boolean, loss_known boolean")


@query
def select_road_model(spark, sf):
    return _selected(spark, "road", learn.selection(_road_samples(spark, sf)[1], "label", 7, "regression", "datetime"))


@query
def select_risk_model(spark, sf):
    samples = learn.risk_samples(rail_plan.risk_table(standin.rail(spark, sf), "event_id"), "event_id")
    return _selected(spark, "risk", learn.selection(samples, "label", 7, "classification", "timestamp"))


@query
def select_event_models(spark, sf):
    samples = learn.event_samples(_events(spark, sf))
    rows = [_selected(spark, name, learn.selection(samples, name, 7, "regression", "timestamp")) for name in learn.EVENT_OUTPUTS]
    return rows[0].unionAll(rows[1])


@query
def score_road_ranges(spark, sf):
    """Every segment is scored once, from its newest row, within what a label can be."""
    rows, samples = _road_samples(spark, sf)
    scored = learn.score_road(rows, learn.train_regressor(samples, "label", seed=7), "event_id")
    most = samples.agg(F.max("label")).scalar()
    inside = F.col("predicted_congestion_minutes").between(F.lit(0.0), most * 1.5 + 1)
    return scored.select("segment_id", "updated_at", inside.alias("in_range"))


@query
def score_rail_ranges(spark, sf):
    """The same of stations: a risk between 0 and 1, a tier that fits it, no negative duration or trains."""
    scored = train_score_rail(spark, sf)
    risk = F.col("delay_risk_probability")
    fits = F.col("color_code") == severity.rail_severity(risk)
    counts = (F.col("delay_duration_minutes") >= 0) & (F.col("affected_trains_count") >= 0)
    return scored.select("line", "sta", "updated_at", risk.between(0, 1).alias("risk_in_range"), fits.alias("tier_fits"), counts.alias("counts_in_range"))


@query
def training_without_delays(spark, sf):
    """A feed without delays: the risk table is written, the event table stays empty, and event training is skipped."""
    archive, risk, found = (work_dir(spark, n) for n in ("calm-archive", "calm-risk", "calm-events"))
    calm = F.regexp_replace("value", '"isdelay":"Y"', '"isdelay":"N"')
    _as_files(standin.rail_documents(spark, sf).select(calm.alias("value"), "collected_at"), archive, "collected_at")
    has_events = rail_plan.prepare_training_tables(spark, archive, risk, found, 7, pattern="part-*")
    rows = tables.read_table(spark, risk)
    return rows.agg(
        F.count(F.lit(1)).alias("risk_rows"), F.sum("delay_risk_label").alias("delays_ahead"),
        F.lit(spark.read.parquet(found).count()).cast("bigint").alias("event_rows"), F.lit(has_events).alias("has_events"),
    )


@query
def road_sample_totals(spark, sf):
    """What the road model learns from: samples, their labels, and the newest speed in each window."""
    samples = _road_samples(spark, sf)[1].withColumn("f", vector_to_array("features"))
    newest = F.element_at("f", -len(learn.ROAD_FEATURES)) * dataset.SPEED_SCALE
    return samples.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("label"), 3).alias("label_sum"), F.round(F.sum(newest), 3).alias("speed_sum"),
        F.max(F.size("f")).alias("width"),
    )


@query
def train_score_rail(spark, sf):
    rows = standin.rail(spark, sf)
    risk = rail_plan.risk_table(rows, "event_id")
    risk_model = learn.train_classifier(learn.risk_samples(risk, "event_id"), "label", 7, kind="logistic")
    training = dataset.augment(_events(spark, sf), ["event_id"], seed=7)
    models = learn.train_events(learn.event_samples(training), 7)
    return learn.score_rail(calendar.add_calendar(rows, "timestamp"), risk_model, models, "event_id", fill=True)


def _arrival_model(rows):
    """Down arrival from up arrival by least squares, whose answer is determined."""
    samples = rows.where("up_ttnt_1 is not null").select(array_to_vector(F.array("up_ttnt_1")).alias("features"), F.col("down_ttnt_1").alias("label"))
    return learn.train_regressor(samples, "label", seed=7, kind="linear")


@query
def least_squares_scores(spark, sf):
    """A fitted model applied to every row that has its input."""
    rows = standin.rail(spark, sf)
    model = _arrival_model(rows)
    known = rows.where("up_ttnt_1 is not null").withColumn("features", array_to_vector(F.array("up_ttnt_1")))
    return model.transform(known).select("event_id", F.round(learn.prediction_column(model), 6).alias("predicted"))


@query
def newest_filled(spark, sf):
    """Each station's newest row as forward filling leaves it, without filling the others."""
    return serving.latest_filled(standin.rail(spark, sf), *RAIL, ["up_ttnt_1", "down_ttnt_1"])


# ---- serving ---------------------------------------------------------------------------------


@query
def latest_state(spark, sf):
    return serving.latest(standin.rail(spark, sf), *RAIL)


@query
def road_state(spark, sf):
    return standin.road_state(spark, sf)


@query
def combine_forecasts(spark, sf):
    return standin.rail_state(spark, sf)


@query
def state_lookup(spark, sf):
    wanted = standin.table(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("segment_id"))
    state_table = standin.road_state(spark, sf)
    return serving.lookup(
        state_table, wanted, ["segment_id"], "predicted_congestion_minutes", digits=2, unknown="Not found or no data"
    )


@query
def state_lookup_rail(spark, sf):
    wanted = standin.table(spark, sf, "customer", "c_custkey").select(
        F.concat(F.lit("L"), (F.col("c_custkey") % 10).cast("string")).alias("line"),
        F.col("c_custkey").cast("string").alias("sta"),
    )
    return serving.lookup(standin.rail_state(spark, sf), wanted, ["line", "sta"], "delay_risk_probability")


@query
def state_partial_key(spark, sf):
    out = serving.lookup_where(standin.rail_state(spark, sf), line="L3", sta=None)
    return out.select("line", "sta", "color_code")


@query
def state_summary(spark, sf):
    return serving.summary(standin.road_state(spark, sf))


@query
def state_predictions(spark, sf):
    return serving.predictions(standin.rail_state(spark, sf), ["line", "sta"], "delay_risk_probability", 2)


@query
def road_severity(spark, sf):
    state_table = standin.road_state(spark, sf)
    tier = severity.road_severity(F.col("predicted_congestion_minutes"))
    return state_table.select("segment_id", tier.alias("tier"))


@query
def rail_severity(spark, sf):
    risk = F.col("value") / 400
    return standin.table(spark, sf, "events", "event_id", "value").select(
        "event_id", severity.rail_severity(risk).alias("color_code")
    )


@query
def active_events_ranked(spark, sf):
    out = serving.active_events(standin.rail_state(spark, sf))
    return out.select("line", "sta", "delay_risk_probability", "color_code", "risk_text")


@query
def active_events_top(spark, sf):
    out = serving.active_events(standin.rail_state(spark, sf), k=10)
    return out.select("line", "sta", "delay_risk_probability", "message")


@query
def active_station_count(spark, sf):
    return serving.active_count(standin.rail_state(spark, sf))


# ---- network ---------------------------------------------------------------------------------


@query
def network_join_predictions(spark, sf):
    roads = standin.table(spark, sf, "orders", "o_orderkey", "o_orderpriority")
    load = standin.table(spark, sf, "lineitem", "l_orderkey", "l_quantity").groupBy(
        F.col("l_orderkey").alias("o_orderkey")
    ).agg((F.max("l_quantity") - 30).alias("minutes"))
    return serving.road_network(roads, load, "o_orderkey", "minutes")


def _stations(spark, sf):
    at = standin.table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    return at.select(
        F.concat(F.lit("L"), (F.col("c_custkey") % 10).cast("string")).alias("line"),
        F.col("c_custkey").cast("string").alias("sta"),
        F.col("c_acctbal").alias("lon"),
        F.col("c_nationkey").cast("double").alias("lat"),
    )


@query
def rail_markers(spark, sf):
    out = serving.rail_network(_stations(spark, sf), standin.rail_state(spark, sf))
    return out.select("line", "sta", "color_code", "fill_color", "radius", "blinking")


@query
def locate_events(spark, sf):
    active = serving.active_events(standin.rail_state(spark, sf))
    return serving.locate_events(active, _stations(spark, sf)).select("line", "sta", "lon", "lat", "risk_text")


@query
def semi_join_network(spark, sf):
    roads = standin.table(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return network.keep_known(roads, standin.table(spark, sf, "lineitem", "l_orderkey"), "o_orderkey", "l_orderkey")


@query
def dimension_lookup_first(spark, sf):
    suppliers = standin.table(spark, sf, "supplier", "s_nationkey", "s_suppkey", "s_acctbal")
    first = network.first_per_key(suppliers, "s_nationkey", "s_suppkey")
    nations = standin.table(spark, sf, "nation", "n_nationkey", "n_name")
    return network.line_vertices(nations.withColumnRenamed("n_nationkey", "sta"), first.withColumnRenamed("s_nationkey", "sta"))


@query
def station_codes(spark, sf):
    names = standin.table(spark, sf, "customer", "c_custkey", "c_nationkey").withColumn(
        "name", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    )
    codes = standin.table(spark, sf, "nation", "n_name", "n_regionkey").select(
        F.col("n_name").alias("name"), F.when(F.col("n_regionkey") != 2, F.col("n_regionkey")).alias("code")
    )
    return network.lookup_code(names, codes, "name", "code").dropna(subset=["code"]).select("c_custkey", "name", "code")


@query
def line_colors(spark, sf):
    lines = standin.table(spark, sf, "region", "r_regionkey", "r_name").withColumnRenamed("r_name", "line")
    colors = tables.mapping(spark, {"ASIA": "#101010", "EUROPE": "#202020"}, "line string, color string")
    return network.with_color(lines, colors)


@query
def first_line_of_station(spark, sf):
    orders = standin.table(spark, sf, "orders", "o_custkey", "o_orderpriority").select(
        F.col("o_custkey").alias("sta"),
        F.col("o_orderpriority").alias("line"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("line_seq"),
    )
    stations = standin.table(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("sta"))
    return network.first_line_of_station(stations, orders)


def _lines(spark, sf):
    return standin.table(
        spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )


_TIE = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _strings(spark, sf, **options):
    return network.line_strings(
        _lines(spark, sf), ["l_orderkey"], "l_linenumber", "l_quantity", "l_extendedprice", tie=_TIE, **options
    )


@query
def ordered_polyline(spark, sf):
    return _vertices(_strings(spark, sf))


@query
def ordered_polyline_parts(spark, sf):
    return _vertices(_strings(spark, sf, max_vertices=4))


def _vertices(strings):
    return strings.select("l_orderkey", "part", F.posexplode("coordinates").alias("pos", "c")).select(
        "l_orderkey", "part", "pos", F.get("c", F.lit(0)).alias("x"), F.get("c", F.lit(1)).alias("y")
    )


@query
def geojson_roundtrip(spark, sf):
    """Line and point features written as text, read back and typed."""
    strings = _strings(spark, sf)
    lines = strings.select(
        sinks.feature_json(F.struct(F.col("l_orderkey").alias("id")), "LineString", F.col("coordinates")).alias("feature")
    )
    points = standin.places(spark, sf).select(
        sinks.feature_json(F.struct(F.col("vec_id").alias("id")), "Point", F.array("x", "y")).alias("feature")
    )
    path = work_dir(spark, "geojson")
    sinks.write_geojson_lines(lines.unionByName(points), path)
    back = tables.read_geojson_lines(spark, path)
    vertices = F.coalesce("line_string", F.array("point"))
    return back.select(F.col("properties")["id"].cast("bigint").alias("id"), "geometry_type", F.posexplode(vertices).alias("pos", "v")).select(
        "id", "geometry_type", "pos", F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y")
    )


@query
def feature_collections(spark, sf):
    stations = _stations(spark, sf)
    colors = tables.mapping(spark, {f"L{i}": f"#{i}{i}{i}" for i in range(5)}, "line string, color string")
    features = network.point_features(stations, colors).withColumn("line", F.get_json_object("feature", "$.properties.line"))
    # A line's stations are bounded by a block of station numbers, since here a line grows with the table.
    number = F.get_json_object("feature", "$.properties.sta").cast("bigint")
    docs = sinks.feature_collections(features.withColumn("block", F.floor(number / 100_000)), by=["line", "block"])
    features = docs.select(F.from_json("value", "features array<struct<properties: map<string, string>>>").alias("d"))
    p = F.col("p.properties")
    return features.select(F.explode("d.features").alias("p")).select(
        p["name"].alias("name"), p["color"].alias("color"), p["type"].alias("type")
    )


@query
def one_feature_collection(spark, sf):
    """All stations as one document in ordered parts, read back line by line."""
    stations = _stations(spark, sf)
    colors = tables.mapping(spark, {f"L{i}": f"#{i}{i}{i}" for i in range(5)}, "line string, color string")
    features = network.point_features(stations, colors).withColumn("sta", F.get_json_object("feature", "$.properties.sta").cast("bigint"))
    path = work_dir(spark, "one-collection")
    sinks.write_collection(features, path, ["sta"])
    f = F.from_json("feature", "properties map<string, string>, geometry struct<coordinates: array<double>>")
    p, c = f["properties"], f["geometry"]["coordinates"]
    return sinks.collection_lines(spark, path).select(p["name"].alias("name"), p["color"].alias("color"), F.get(c, F.lit(0)).alias("lon"), F.get(c, F.lit(1)).alias("lat"))


@query
def feature_collection_files(spark, sf):
    """One document of features for each line, written as a file and read back."""
    stations = _stations(spark, sf)
    colors = tables.mapping(spark, {f"L{i}": f"#{i}{i}{i}" for i in range(5)}, "line string, color string")
    features = network.point_features(stations, colors).withColumn("line", F.get_json_object("feature", "$.properties.line"))
    path = work_dir(spark, "collections")
    _as_files(sinks.feature_collections(features, by=["line"]), path, "line")
    back = tables.read_geojson(spark, path)
    p = F.col("properties")
    return back.select(
        p["name"].alias("name"), p["color"].alias("color"), p["type"].alias("type"), "geometry_type",
        F.get("point", F.lit(0)).alias("lon"), F.get("point", F.lit(1)).alias("lat"),
    )


@query
def network_features(spark, sf):
    """Regions as lines over their nations, placed by each nation's first supplier; read back from text."""
    nations = standin.table(spark, sf, "nation", "n_nationkey", "n_regionkey")
    names = standin.table(spark, sf, "region", "r_regionkey", "r_name")
    lines = nations.join(names, nations["n_regionkey"] == names["r_regionkey"]).select(
        F.col("r_name").alias("line"), F.col("n_nationkey").alias("seq"), F.col("n_nationkey").cast("string").alias("sta")
    )
    suppliers = standin.table(spark, sf, "supplier", "s_nationkey", "s_suppkey", "s_acctbal").select(
        F.col("s_nationkey").cast("string").alias("sta"), F.col("s_suppkey").cast("double").alias("lon"),
        F.col("s_acctbal").alias("lat"),
    )
    coords = network.first_per_key(suppliers, "sta", "lon")
    colors = tables.mapping(spark, {"ASIA": "#101010", "EUROPE": "#202020"}, "line string, color string")
    features = network.network_features(lines, coords, colors)
    parsed = features.select(
        F.from_json("feature", "properties map<string, string>, geometry struct<type: string, coordinates: string>").alias("f")
    )
    p, text = F.col("f.properties"), F.col("f.geometry.coordinates")
    line = F.from_json(text, "array<array<double>>")
    is_line = F.col("f.geometry.type") == "LineString"
    vertices = F.when(is_line, line).otherwise(F.array(F.from_json(text, "array<double>")))
    return parsed.select(
        p["line"].alias("line"), p["name"].alias("name"), p["type"].alias("type"), p["color"].alias("color"),
        F.posexplode(vertices).alias("pos", "v"),
    ).select("line", "name", "type", "color", "pos", F.get("v", F.lit(0)).alias("lon"), F.get("v", F.lit(1)).alias("lat"))


@query
def minmax_affine(spark, sf):
    return geometry.pixels_to_degrees(standin.places(spark, sf), "x", "y").select("vec_id", "pos", "lon", "lat")


@query
def nearest_point(spark, sf):
    """For every even place of a vector the nearest of all odd ones."""
    places = standin.places(spark, sf).withColumn("point_id", F.col("vec_id") * 32 + F.col("pos"))
    vertices = places.where("pos % 2 = 1").withColumnRenamed("point_id", "vertex_id")
    return network.nearest_vertex(places.where("pos % 2 = 0"), vertices, "point_id", "vertex_id")


@query
def path_parse(spark, sf):
    return geometry.path_vertices(standin.path_texts(spark, sf), "path").drop("path")


@query
def path_midpoints(spark, sf):
    paths = standin.path_texts(spark, sf)
    # out as text and in again: the text form loses nothing
    text = geometry.path_text(geometry.midpoint_controls(geometry.parse_path(F.col("path"))))
    subs = paths.select("vec_id", F.posexplode(geometry.parse_path(text)).alias("sub", "s"))
    segments = subs.select("vec_id", "sub", F.posexplode("s").alias("pos", "v"))
    points = segments.select("vec_id", "sub", "pos", F.posexplode("v.points").alias("i", "p"))
    return points.select("vec_id", "sub", "pos", "i", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


# The published parameters of a city's grid and of its datum's shift.
GRID = geometry.TransverseMercator(
    6378388.0, 297.0, 22 + 18 / 60 + 43.68 / 3600, 114 + 10 / 60 + 42.80 / 3600, 1.0, 836694.05, 819069.80,
    geometry.Datum(-162.619, -276.959, -161.764, 0.067753, -2.243649, -1.158827, -1.094246),
)


@query
def reproject_roads(spark, sf):
    lines = standin.grid_lines(spark, sf)
    placed = lines.select("ROUTE_ID", F.posexplode(geometry.reproject(F.col("geometry"), GRID)).alias("pos", "v"))
    return placed.select(
        "ROUTE_ID", "pos", F.round(F.get("v", F.lit(0)), 7).alias("lon"), F.round(F.get("v", F.lit(1)), 7).alias("lat")
    )


@query
def road_network_features(spark, sf):
    observed = standin.road(spark, sf).select("segment_id")
    out = road_plan.road_features(standin.grid_lines(spark, sf), observed, GRID, tolerance=0.01)
    kept = out.select("segment_id", "STREET_ENAME", F.posexplode("geometry").alias("pos", "v"))
    return kept.select(
        "segment_id", "STREET_ENAME", "pos", F.round(F.get("v", F.lit(0)), 7).alias("lon"), F.round(F.get("v", F.lit(1)), 7).alias("lat")
    )


# ---- streams ---------------------------------------------------------------------------------


DELIVERIES = 5


def _rail_rows(events_: DataFrame) -> DataFrame:
    return events_.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("L"), (F.col("user_id") % 10).cast("string")).alias("line"),
        F.col("user_id").cast("string").alias("sta"),
        (F.col("event_type") == "error").cast("int").alias("isdelay"),
        F.col("value").alias("up_ttnt_1"),
    )


def _in_order(rows: DataFrame) -> Column:
    """The delivery of a row: equal stretches of time, in order."""
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    return F.least(F.lit(DELIVERIES - 1), F.expr(f"(unix_micros(cast(timestamp as timestamp)) - {low}) div {(high - low) // DELIVERIES + 1}"))


def _shuffled(rows: DataFrame) -> Column:
    """The delivery of a row: any, so every one holds times from first to last."""
    return F.pmod(F.xxhash64("event_id"), F.lit(DELIVERIES))


def _deliver(spark, sf, root, run, number=_shuffled, again=None) -> None:
    """Lands the events in several deliveries and runs the stream to its end after each.

    Every run starts from the checkpoint that the one before has left. ``again(rows, k)`` are rows that are delivered
    once more, after delivery k.
    """
    rows = _rail_rows(standin.table(spark, sf, "events"))
    numbered = rows.withColumn("__k", number(rows))
    landing = f"{root}/landing"
    for k in range(DELIVERIES):
        numbered.where(F.col("__k") == k).drop("__k").write.mode("append").parquet(landing)
        run(spark.readStream.schema(rows.schema).parquet(landing)).awaitTermination()
        if again is not None:
            again(numbered, k).drop("__k").write.mode("append").parquet(landing)
    if again is not None:
        run(spark.readStream.schema(rows.schema).parquet(landing)).awaitTermination()


def _batches(process, root):
    return lambda stream: state.run_batches(stream, process, f"{root}/checkpoint", available_now=True)


@query
def stream_latest(spark, sf):
    root = work_dir(spark, "stream-latest")
    schema = _rail_rows(standin.table(spark, sf, "events")).schema
    table = state.LatestState(spark, root, schema, *RAIL, buckets=8)
    _deliver(spark, sf, root, _batches(table.process, root))
    return table.current()


@query
def stream_replaced(spark, sf):
    """A state that keeps the newest hour's snapshot alone."""
    root = work_dir(spark, "stream-replaced")
    hourly = lambda rows: rows.withColumn("timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    schema = hourly(_rail_rows(standin.table(spark, sf, "events"))).schema
    table = state.LatestState(spark, root, schema, *RAIL, mode="replace", buckets=8)
    _deliver(spark, sf, root, _batches(lambda batch, i: table.process(hourly(batch), i), root), _in_order)
    return table.current()


def _event_stream(spark, sf, root, again=None):
    """Events and late rows of the deliveries, written by kind; a closing row ends the stream."""
    schema = _rail_rows(standin.table(spark, sf, "events")).schema

    def run(stream):
        found = stream_state.event_stream(stream, RAIL[0], RAIL[1], RAIL[2], "isdelay", ["event_id", "up_ttnt_1"])
        writer = found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
        return writer.partitionBy("kind").trigger(availableNow=True).start()

    _deliver(spark, sf, root, run, _in_order, again)
    stream_state.closing(spark, schema, "timestamp").write.mode("append").parquet(f"{root}/landing")
    run(spark.readStream.schema(schema).parquet(f"{root}/landing")).awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query
def stream_events(spark, sf):
    found = _event_stream(spark, sf, work_dir(spark, "stream-events"))
    return found.where("kind = 'event'").drop("kind")


def _first_again(rows, k):
    """The first delivery once more, after the last one."""
    return rows.where((F.col("__k") == 0) & F.lit(k == DELIVERIES - 1))


@query
def stream_late_rows(spark, sf):
    """Rows that come once more long after their time are set aside and change no event."""
    found = _event_stream(spark, sf, work_dir(spark, "stream-late"), _first_again)
    return found.select("kind", "event_id", F.coalesce("row_count", F.lit(0)).alias("row_count"))


@query
def stream_scored_state(spark, sf):
    """Every micro-batch is reduced, scored and merged; the stand-in model is a share of the arrival."""
    root = work_dir(spark, "stream-scored")

    def score(rows):
        newest = serving.latest(rows, *RAIL)
        risk = rounding.exact_round(F.least(F.lit(1.0), F.col("up_ttnt_1") / 60), 4)
        return newest.select(
            "line", "sta", risk.alias("delay_risk_probability"), severity.rail_severity(risk).alias("color_code"),
            F.col("timestamp").alias("updated_at"),
        )

    return _scored(spark, sf, root, score)


def _scored(spark, sf, root, score):
    empty = score(spark.createDataFrame([], _rail_rows(standin.table(spark, sf, "events")).schema))
    table = state.LatestState(spark, root, empty.schema, ["line", "sta"], "updated_at", buckets=8)
    _deliver(spark, sf, root, lambda rows: feeds.scored_state(rows, score, table, f"{root}/checkpoint", available_now=True))
    return table.current()


@query
def stream_fitted_state(spark, sf):
    """A model fitted on the stored rows scores the newest row of every key of each micro-batch."""
    model = _arrival_model(standin.rail(spark, sf))

    def score(rows):
        newest = serving.latest(rows, *RAIL).withColumn("features", array_to_vector(F.array("up_ttnt_1")))
        shown = F.round(learn.prediction_column(model), 6)
        return model.transform(newest).select("line", "sta", shown.alias("predicted"), F.col("timestamp").alias("updated_at"))

    return _scored(spark, sf, work_dir(spark, "stream-fitted"), score)


@query
def stream_sequences(spark, sf):
    """The last rows of every key, kept in the engine's state and stored by bucket."""
    root = work_dir(spark, "stream-sequences")
    stored = "line string, sta string, newest timestamp_ntz, place int, up_ttnt_1 double, updated bigint"
    table = state.LatestState(spark, root, T._parse_datatype_string(stored), ["line", "sta", "place"], "updated", buckets=8)

    def run(stream):
        recent = stream_state.recent_rows(stream, *RAIL, ["up_ttnt_1"], learn.RISK_LENGTH)
        process = lambda batch, i: table.process(batch.withColumn("updated", F.lit(i).cast("bigint")), i)
        return state.run_batches(recent, process, f"{root}/checkpoint", available_now=True, mode="update")

    _deliver(spark, sf, root, run)
    return table.current().select("line", "sta", F.col("place").alias("pos"), F.col("up_ttnt_1").alias("value"))


def _last_minutes(rows, k):
    newest = rows.where(F.col("__k") == k)
    return newest.where(F.col("timestamp") > newest.agg(F.max("timestamp")).scalar() - F.expr("interval 5 minutes"))


@query
def stream_sorted_out(spark, sf):
    """Everything that was delivered, as unique, repeated or late: the last minutes of a delivery come twice, the first
    delivery again at the end."""
    root = work_dir(spark, "stream-sorted")

    def run(stream):
        found = stream_state.sorted_out(stream.select("event_id", "timestamp", "line", "sta"), ["line", "sta"], "timestamp")
        writer = found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
        return writer.partitionBy("status").trigger(availableNow=True).start()

    _deliver(spark, sf, root, run, _in_order, lambda rows, k: _last_minutes(rows, k).unionByName(_first_again(rows, k)))
    count = lambda status: F.count_if(F.col("status") == status).alias(status)
    counts = spark.read.parquet(f"{root}/out").groupBy("line", "sta", "timestamp").agg(*map(count, ("unique", "repeated", "late")), F.count(F.lit(1)).alias("delivered"))
    return counts


@query
def stream_road_documents(spark, sf):
    """XML documents land as files, a cut-off one in each delivery: their rows, and what was refused."""
    root, parsed = work_dir(spark, "stream-road"), work_dir(spark, "documents")
    number = F.pmod(F.substring("time", 1, 2).cast("int"), F.lit(3))
    standin.road_documents(spark, sf).withColumn("hour", F.substring("time", 1, 2)).withColumn("k", number).write.parquet(parsed)
    docs = spark.read.parquet(parsed)
    for k in range(3):
        arrived = docs.where(F.col("k") == k).select("value", "date", "hour")
        broken = arrived.agg(F.expr("max(substring(value, 1, length(value) - 20))").alias("value"))
        broken = broken.select("value", F.lit(f"broken-{k}").alias("date"), F.lit("xx").alias("hour"))
        _as_files(arrived.unionByName(broken), f"{root}/landing", "date", "hour")
        feeds.landed_road(spark, f"{root}/landing", root, f"{root}/checkpoint", 200, "part-*", available_now=True).awaitTermination()
    folder = lambda name: F.regexp_extract(snapshots.FILE, f"/{name}=([^/]+)/", 1)
    rows = spark.read.parquet(f"{root}/rows").select(
        F.lit("row").alias("kind"), "date", F.substring("time", 1, 2).alias("hour"), F.col("segment_id").cast("string").alias("segment_id"),
        "speed", F.lit(None).cast("string").alias("refused_speed"), F.lit(None).cast("string").alias("reason"),
    )
    entry = F.from_json("entry", "segment_id string, speed string")
    refused = spark.read.parquet(f"{root}/refused").select(
        F.lit("refused").alias("kind"), folder("date").alias("date"), folder("hour").alias("hour"), entry["segment_id"].alias("segment_id"),
        F.lit(None).cast("double").alias("speed"), entry["speed"].alias("refused_speed"), "reason",
    )
    return rows.unionByName(refused)


@query
def stream_alerts(spark, sf):
    """Alerts of a feed that delivers the last minutes of every delivery twice."""
    root = work_dir(spark, "stream-alerts")

    def run(stream):
        rows = stream.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        seen = state.drop_repeats(rows, ["line", "sta"], "timestamp", spread_by="event_id")
        return feeds.alert_stream(seen, f"{root}/out", f"{root}/checkpoint", available_now=True)

    _deliver(spark, sf, root, run, _in_order, _last_minutes)
    return spark.read.parquet(f"{root}/out").select("event_id", "line", "sta", "up_ttnt_1")


@query
def stream_documents(spark, sf):
    """Snapshot documents land as files, broken ones among them, in three deliveries, and leave as alerts."""
    root, parsed = work_dir(spark, "stream-documents"), work_dir(spark, "documents")
    number = F.pmod(F.substring("collected_at", 7, 2).cast("int"), F.lit(3))
    standin.rail_documents(spark, sf).withColumn("k", number).write.parquet(parsed)
    docs = spark.read.parquet(parsed)
    for k in range(3):
        arrived = docs.where(F.col("k") == k).select("value", "collected_at")
        cut_off = F.expr("max(substring(value, 1, length(value) - 2))").alias("value")
        broken = arrived.agg(cut_off).withColumn("collected_at", F.lit(f"broken-{k}"))
        _as_files(arrived.unionByName(broken), f"{root}/landing", "collected_at")
        rows = feeds.rail_rows(spark, f"{root}/landing", files_per_trigger=120, pattern="part-*")
        feeds.alert_stream(rows, f"{root}/out", f"{root}/checkpoint", available_now=True).awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.select(calendar.timestamp_to_clock("timestamp").alias("timestamp"), "line", "sta", "up_ttnt_1", "down_ttnt_1", "hour")
