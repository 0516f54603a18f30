"""A task of a training holds a bounded number of samples, however small their files are."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from signalbox.operators import learn


def test_tasks_hold_a_bounded_number_of_samples(spark, monkeypatch):
    monkeypatch.setattr(learn, "SAMPLES_PER_TASK", 100)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    features = array_to_vector(F.array(F.col("id") % 2 * 1.0, F.lit(1.0)))
    samples = spark.range(0, 1050, 1, 3).select(features.alias("features"), (F.col("id") % 2 * 3.0).alias("label"), F.col("id").cast("timestamp").alias("at"))
    kept = learn.written(samples)
    sizes = [r["n"] for r in kept.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 1050 and max(sizes) <= 100 and len(sizes) <= 12
    assert kept.rdd.getNumPartitions() == len(sizes)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    chosen = learn.selection(samples, "label", 7, "regression", "at", iterations=(2,))
    assert (chosen.n_train, chosen.n_validation) == (840, 210) and chosen.loss < 1e-9
