"""Training, selecting and applying the three models with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.functions.rounding import non_negative
from signalbox.operators.dataset import ARRIVAL_SCALE, SPEED_SCALE, loss_metrics, scale, sequence_vector, split_by_time
from signalbox.operators.serving import latest, latest_filled, rail_state
from signalbox.operators.series import constant_history, sequences
from signalbox.session import work_dir

# Model inputs and sequence lengths.
ROAD_FEATURES = ("speed", "hour", "day_of_week", "is_weekend", "is_peak")
RAIL_FEATURES = ("up_ttnt_1", "down_ttnt_1", "hour", "day_of_week", "is_weekend", "is_peak")
ROAD_LENGTH = 12
RISK_LENGTH = 10
EVENT_LENGTH = 1
#: Samples of one task of a training: about 150 MB as trees keep 60 features.
SAMPLES_PER_TASK = 200_000

ARRIVALS = ("up_ttnt_1", "down_ttnt_1")
_RAIL_SCALES = {c: ARRIVAL_SCALE for c in ARRIVALS}


def road_samples(series: DataFrame, tie: str, keys=("segment_id",), order="datetime", split=None) -> DataFrame:
    scaled = scale(series, {"speed": SPEED_SCALE})
    samples = sequences(
        scaled, list(keys), order, tie, ROAD_FEATURES, "label_congestion_minutes", ROAD_LENGTH, split=split
    )
    return sequence_vector(samples, ROAD_FEATURES)


def risk_samples(series: DataFrame, tie: str, keys=("line", "sta"), order="timestamp", split=None) -> DataFrame:
    samples = sequences(
        scale(series, _RAIL_SCALES), list(keys), order, tie, RAIL_FEATURES, "delay_risk_label", RISK_LENGTH, split=split
    )
    return sequence_vector(samples, RAIL_FEATURES)


def event_samples(events: DataFrame) -> DataFrame:
    """Sequences of length one: the snapshot at the event's start."""
    rows = constant_history(scale(events, _RAIL_SCALES), RAIL_FEATURES, EVENT_LENGTH)
    return sequence_vector(rows, RAIL_FEATURES)


EVENT_OUTPUTS = ("delay_duration_minutes", "affected_trains_count")


def written(samples: DataFrame) -> DataFrame:
    """Samples as a table in shared storage: training reads them many times, and they come out of windows.

    A file holds at most SAMPLES_PER_TASK of them and is read by a task of its own. Training keeps what a task reads, many
    times larger than its file, whose size says little about it. The files are read in a session of their own, where
    Spark neither joins nor cuts them.
    """
    spark, path = samples.sparkSession, work_dir(samples.sparkSession, "samples")
    samples.write.option("maxRecordsPerFile", SAMPLES_PER_TASK).parquet(path)
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"):
        own.conf.set(name, spark.conf.get(name))
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        own.conf.set(name, "1t")
    return own.read.parquet(path)


def regressor(label: str, seed: int, kind: str = "gbt", max_iter: int = 20, max_depth: int = 5) -> Estimator:
    columns = {"featuresCol": "features", "labelCol": label, "predictionCol": f"predicted_{label}"}
    if kind == "linear":
        return LinearRegression(**columns)
    return GBTRegressor(maxIter=max_iter, maxDepth=max_depth, seed=seed, **columns)


def classifier(label: str, seed: int, kind: str = "gbt", max_iter: int = 20) -> Estimator:
    columns = {"featuresCol": "features", "labelCol": label, "maxIter": max_iter}
    return GBTClassifier(seed=seed, **columns) if kind == "gbt" else LogisticRegression(**columns)


def train_regressor(samples: DataFrame, label: str, seed: int, **options) -> Model:
    return regressor(label, seed, **options).fit(written(samples.select("features", label)))


def train_classifier(samples: DataFrame, label: str, seed: int, **options) -> Model:
    return classifier(label, seed, **options).fit(written(samples.select("features", label)))


def train_events(samples: DataFrame, seed: int, **options) -> tuple[Model, Model]:
    """Two regressors, one per output: duration and affected trains."""
    kept = written(samples.select("features", *EVENT_OUTPUTS))
    return tuple(regressor(label, seed, **options).fit(kept) for label in EVENT_OUTPUTS)


def prediction_column(model: Model) -> str:
    return (model.stages[-1] if isinstance(model, PipelineModel) else model).getPredictionCol()


def validation_loss(model: Model, samples: DataFrame, label: str, task: str) -> float | None:
    """Mean squared error of a regression, cross-entropy of a classification; null without samples."""
    scored = model.transform(samples)
    shown = F.col(prediction_column(model)) if task == "regression" else F.get(vector_to_array("probability"), F.lit(1))
    losses = loss_metrics(scored.select(label, shown.alias("__p")), label, "__p").first()
    return losses["mse" if task == "regression" else "bce"]


class Selected(NamedTuple):
    """A model, how many trees it kept, and on the newest samples its loss and that of a constant."""

    model: Model
    trees: int
    loss: float | None
    constant_loss: float | None
    n_train: int
    n_validation: int


def selection(
    samples: DataFrame, label: str, seed: int, task: str, order: str, iterations: Sequence[int] = (10, 20), train: float = 0.8
) -> Selected:
    """One fit of up to ``max(iterations)`` trees, which ends where the newest samples in ``order`` gain nothing more.

    Neighbouring windows overlap, so the validation samples are the newest, not a random share. The constant is the
    mean label of the training samples.
    """
    if task not in ("regression", "classification"):
        raise ValueError(f"task must be 'regression' or 'classification', not {task!r}")
    parts = split_by_time(written(samples.select("features", label, order)), order, train)
    parts = parts.withColumn("is_validation", ~F.coalesce("is_train", F.lit(True)))
    known, newest = parts.where("not is_validation"), parts.where("is_validation")
    n_train, mean = known.agg(F.count(F.lit(1)), F.avg(label)).first()
    n_validation = newest.count()
    make = (regressor if task == "regression" else classifier)(label, seed, max_iter=max(iterations))
    if n_validation:
        make = make.setParams(validationIndicatorCol="is_validation", validationTol=0.0)
    model = make.fit(parts)
    kind = "mse" if task == "regression" else "bce"
    constant = loss_metrics(newest.select(label, F.lit(mean).alias("__p")), label, "__p").first()[kind]
    return Selected(model, model.getNumTrees, validation_loss(model, newest, label, task), constant, n_train, n_validation)


def select_best(
    samples: DataFrame, label: str, seed: int, task: str, order: str, iterations: Sequence[int] = (10, 20), train: float = 0.8
) -> Model:
    """The model of ``selection``."""
    return selection(samples, label, seed, task, order, iterations, train).model


def _vectors(rows: DataFrame, scales, features, length: int) -> DataFrame:
    """Adds the scoring sequence (the current row, repeated) as a vector; the rows keep raw values."""
    scaled = F.transform(
        F.array_repeat(F.struct(*[_scaled(f, scales) for f in features]), length),
        lambda r: F.array(*[r[f].cast("double") for f in features]),
    )
    return rows.withColumn("features", array_to_vector(F.flatten(scaled)))


def _scaled(feature: str, scales):
    value = F.col(feature)
    return (value / F.lit(float(scales[feature])) if feature in scales else value).alias(feature)


def _needed(rows: DataFrame, keys, order: str, tie, features) -> DataFrame:
    """What scoring reads: nothing else of the feed is computed, in particular no label."""
    tie = [tie] if isinstance(tie, str) else list(tie)
    return rows.select(*dict.fromkeys([*keys, order, *tie, *features]))


def score_road(rows: DataFrame, model: Model, tie: str, keys=("segment_id",), order="datetime") -> DataFrame:
    """Road state from each segment's newest row, repeated to the model's sequence length."""
    newest = latest(_needed(rows, keys, order, tie, ROAD_FEATURES), list(keys), order, tie)
    scored = model.transform(_vectors(newest, {"speed": SPEED_SCALE}, ROAD_FEATURES, ROAD_LENGTH))
    return scored.select(
        *keys,
        non_negative(F.col(prediction_column(model))).alias("predicted_congestion_minutes"),
        F.col(order).alias("updated_at"),
    )


def score_rail(
    rows: DataFrame,
    risk_model: Model,
    event_models: tuple[Model, Model],
    tie: str,
    keys=("line", "sta"),
    order="timestamp",
    fill: bool = False,
) -> DataFrame:
    """Rail state from each station's newest row: risk, duration, affected trains and tier.

    The three models add their columns to the same rows, so the feed is read and reduced once. A missing arrival
    counts as 0.0; with ``fill`` it takes the station's newest known one, as the training tables do.
    """
    keys = list(keys)
    rows = _needed(rows, keys, order, tie, RAIL_FEATURES)
    if fill:
        newest = latest_filled(rows, keys, order, tie, ARRIVALS)
    else:
        newest = latest(rows, keys, order, tie).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ARRIVALS})
    scored = risk_model.transform(_vectors(newest, _RAIL_SCALES, RAIL_FEATURES, RISK_LENGTH))
    scored = scored.withColumn("delay_risk_probability", F.get(vector_to_array("probability"), F.lit(1)))
    scored = scored.drop("features", "rawPrediction", "probability", "prediction")
    scored = _vectors(scored, _RAIL_SCALES, RAIL_FEATURES, EVENT_LENGTH)
    outputs = [F.col(prediction_column(m)) for m in event_models]
    for model in event_models:
        scored = model.transform(scored)
    return rail_state(
        scored.select(
            *keys,
            "delay_risk_probability",
            outputs[0].alias("duration"),
            outputs[1].alias("affected"),
            *ARRIVALS,
            F.col(order).alias("updated_at"),
        ),
        keys,
    )
