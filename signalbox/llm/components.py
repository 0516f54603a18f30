"""Connected components of a large graph by alternating large and small stars.

Every round is joins and grouped minima; a round's edges are cut from their lineage with checkpoint(), which
writes to the folder in spark.checkpoint.dir. Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.session import work_dir


def checkpointed(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(work_dir(spark, "checkpoints"))
    return df.checkpoint()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of the component.

    Loops and repeated edges are allowed; no edges give no rows. Stars of any size are fine: the minimum over a
    node's neighbours is combined before the shuffle.
    """
    pairs = checkpointed(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    )
    before = None
    while True:
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = large.join(least, "a")
        small = kept.select("a", F.col("m").alias("b")).unionAll(kept.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        pairs = checkpointed(small.distinct())
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
