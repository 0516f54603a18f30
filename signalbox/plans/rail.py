"""The rail feed end to end."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.functions.calendar import add_calendar
from signalbox.operators.dataset import augment
from signalbox.operators.events import extract_events
from signalbox.operators.learn import EVENT_OUTPUTS, event_samples, risk_samples, score_rail, select_best
from signalbox.operators.series import forward_fill, lookahead_max
from signalbox.operators.split import gathered, plan_split
from signalbox.session import work_dir
from signalbox.sources.sinks import write_series
from signalbox.sources.snapshots import FILE, flatten_rail_json, read_archive
from signalbox.sources.tables import read_table

KEYS = ["line", "sta"]
ORDER = "timestamp"
ARRIVALS = ["up_ttnt_1", "down_ttnt_1"]
EVENT_FEATURES = ["hour", "day_of_week", "is_weekend", "is_peak", *ARRIVALS]


def series(docs: DataFrame, missing: str = "null") -> DataFrame:
    """Documents to station rows; ``missing='zero'`` makes the later forward fill change nothing."""
    return flatten_rail_json(docs, missing=missing, keep=[FILE]).rows


def filled(rows: DataFrame, tie: str = FILE, split=None) -> DataFrame:
    return add_calendar(forward_fill(rows, KEYS, ORDER, tie, ARRIVALS, split=split), ORDER)


def risk_table(rows: DataFrame, tie: str = FILE, seconds: float | None = None, split=None) -> DataFrame:
    """Station series with the "delay ahead" label."""
    split = split or plan_split(rows, KEYS, ORDER, tie)
    rows = filled(split.spread(rows), tie, split)
    return gathered(lookahead_max(rows, KEYS, ORDER, tie, "isdelay", seconds=seconds, split=split))


def event_table(rows: DataFrame, tie: str = FILE, split=None) -> DataFrame:
    """Delay events with the features of their first row."""
    split = split or plan_split(rows, KEYS, ORDER, tie)
    return extract_events(
        filled(split.spread(rows), tie, split), KEYS, ORDER, tie, "isdelay", EVENT_FEATURES, observed="trains_listed", split=split
    )


def prepare_training_tables(
    spark: SparkSession, archive: str, risk_path: str, event_path: str, seed: int, pattern: str = "*.json"
) -> bool:
    """Archive of JSON snapshots to the risk and the augmented event table; parsed once, to a table.

    Returns whether there are delay events. Without any, the event table is written empty and event
    training is to be skipped.
    """
    parsed = work_dir(spark, "rail-rows")
    series(read_archive(spark, archive, pattern)).write.parquet(parsed)
    rows = read_table(spark, parsed)
    split = plan_split(rows, KEYS, ORDER, FILE)
    write_series(risk_table(rows, split=split), risk_path, KEYS, ORDER)
    events = event_table(rows, split=split)
    augment(events, [*KEYS, ORDER], seed).write.mode("overwrite").parquet(event_path)
    return not spark.read.parquet(event_path).isEmpty()


def train(risk: DataFrame, events: DataFrame, seed: int, tie: str = FILE, **options) -> tuple[Model, tuple[Model, Model]]:
    """The risk model and the two event models, each the best of its candidates on the newest samples."""
    samples = event_samples(events)
    best = select_best(risk_samples(risk, tie), "label", seed, "classification", ORDER, **options)
    return best, tuple(select_best(samples, output, seed, "regression", ORDER, **options) for output in EVENT_OUTPUTS)


def live_rows(docs: DataFrame) -> DataFrame:
    """Live features: strict documents, missing arrivals 0, calendar zeros for an unreadable stamp."""
    flat = flatten_rail_json(
        docs, missing="zero", on_error="document", keep_empty=False, keep_unstamped=True, keep=[FILE]
    )
    rows = add_calendar(flat.rows, ORDER)
    return rows.fillna(0, subset=["hour", "day_of_week", "is_weekend", "is_peak"])


def refresh(docs: DataFrame, risk_model: Model, event_models: tuple[Model, Model]) -> DataFrame:
    """One live refresh: newest documents to rail state."""
    return score_rail(live_rows(docs), risk_model, event_models, FILE)
