"""Stored state that micro-batches update, and the latest-value and history tables built on it.

State is a table in shared storage, cut into buckets by key. A batch reads and writes the buckets of its own keys alone.
Merging a batch a second time changes nothing, so a batch that is run again after a failure gives the same result. A
state folder belongs to one stream checkpoint: a new checkpoint counts its batches from 0 and needs a new folder. The
work on a batch is done by the batch operators, hence skew in a batch is handled as it is there: newest rows and short
histories are reduced before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from signalbox.operators.serving import latest

VERSION = "__version"
# Versions kept of a bucket, so that a reader can finish while the next batches are written.
KEPT = 4
# Buckets of a table; a small batch rewrites few of them.
BUCKETS = 64
# Default lateness that streams wait for.
LATENESS = "10 minutes"


@dataclass(frozen=True)
class BucketTable:
    """A keyed table below ``root``: folders by bucket and slot, each slot a version of its bucket.

    Spark's dynamic partition overwrite replaces the written folders only. The newest version of a bucket is found
    from the number in its rows; the next one goes to the slot after it.
    """

    spark: SparkSession
    root: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int = BUCKETS

    def _stored(self) -> DataFrame:
        partitions = [StructField("bucket", IntegerType()), StructField("slot", IntegerType())]
        stored = StructType([*self.schema.fields, StructField(VERSION, LongType()), *partitions])
        return self.spark.read.schema(stored).parquet(self.root)

    def versions(self, before: int | None = None) -> dict[int, tuple[int, int]]:
        """The newest (version, slot) of each bucket, or the newest before a batch."""
        try:
            rows = self._stored()
        except AnalysisException:  # nothing was written yet
            return {}
        rows = rows if before is None else rows.where(F.col(VERSION) < before)
        found = rows.groupBy("bucket", "slot").agg(F.max(VERSION).alias("version")).collect()  # buckets times slots
        out: dict[int, tuple[int, int]] = {}
        for r in found:
            out[r["bucket"]] = max(out.get(r["bucket"], (-1, -1)), (r["version"], r["slot"]))
        return out

    def newest(self) -> int:
        """The newest batch that changed something, so that a reader or a restarted job can pick up the state."""
        return max((v for v, _ in self.versions().values()), default=-1)

    def _at(self, versions: dict[int, tuple[int, int]]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], StructType([*self.schema.fields, StructField("bucket", IntegerType())]))
        rows = self._stored()
        slots = sorted({slot for _, slot in versions.values()})
        # Few conditions, on partition columns, whatever the number of buckets.
        here = [F.col("slot").eqNullSafe(F.lit(s)) & F.col("bucket").isin([b for b, (_, at) in versions.items() if at == s]) for s in slots]
        wanted = here[0]
        for h in here[1:]:
            wanted = wanted | h
        newest = F.create_map(*[F.lit(x) for b, (v, _) in versions.items() for x in (b, v)])
        return rows.where(wanted).where(F.col(VERSION) == newest[F.col("bucket")]).drop(VERSION, "slot")

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is, or as it was after a batch (while its versions are kept)."""
        return self._at(self.versions(None if version is None else version + 1)).drop("bucket")

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def merge(self, batch: DataFrame, version: int, both: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replaces the buckets of the batch's keys by ``both(batch, stored rows of those buckets)``."""
        rows = self.bucketed(batch.select(*self.schema.names))
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # at most all buckets
        if not touched:
            return
        before = self.versions(version)
        stored = self._at({b: before[b] for b in touched if b in before})
        merged = self.bucketed(both(rows.drop("bucket"), stored.drop("bucket")).select(*self.schema.names))
        slot = F.create_map(*[F.lit(x) for b in touched for x in (b, (before[b][1] + 1) % KEPT if b in before else 0)])
        out = merged.withColumn(VERSION, F.lit(version).cast("bigint")).withColumn("slot", slot[F.col("bucket")])
        writer = out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket", "slot").parquet(self.root)


def run_batches(
    stream: DataFrame,
    process: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = None,
    available_now: bool = False,
    mode: str = "append",
) -> StreamingQuery:
    """Runs ``process`` on every micro-batch. The batch is kept while it is processed."""

    def once(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            process(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(once).outputMode(mode).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


class LatestState:
    """Newest row per key. A micro-batch without usable rows leaves the state as it was.

    ``mode='upsert'`` keeps keys that a refresh does not mention; ``'replace'`` shows only the newest
    snapshot of the last batch with rows, as a dashboard that swaps its whole answer does.
    """

    def __init__(self, spark, root: str, schema: StructType, keys, order: str, tie=(), mode: str = "upsert", buckets: int = BUCKETS):
        if mode not in ("upsert", "replace"):
            raise ValueError(f"mode must be 'upsert' or 'replace', not {mode!r}")
        self.columns = schema.names
        stored = StructType([*schema.fields, StructField("__batch", LongType())])
        self.table = BucketTable(spark, f"{root}/latest", stored, tuple(keys), buckets)
        self.keys, self.order, self.mode = list(keys), order, mode
        self.tie = [tie] if isinstance(tie, str) else list(tie)
        self.version = self.table.newest()

    def process(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*self.columns).withColumn("__batch", F.lit(batch_id).cast("bigint"))

        def both(new: DataFrame, stored: DataFrame) -> DataFrame:
            if self.mode == "replace":  # what an earlier batch left is never shown again
                return latest(new, self.keys, self.order, self.tie)
            return latest(new.unionByName(stored), self.keys, self.order, self.tie)

        self.table.merge(rows, batch_id, both)
        self.version = max(self.version, batch_id)

    def current(self) -> DataFrame:
        rows = self.table.read()
        if self.mode == "replace":
            newest = rows.agg(F.max(F.struct("__batch", self.order))).scalar()
            rows = rows.where(F.struct("__batch", self.order) == newest)
        return rows.drop("__batch")


class History:
    """The last ``length`` rows of every key, as input for sequence models."""

    def __init__(self, spark, root: str, schema: StructType, keys, order: str, tie, length: int, buckets: int = BUCKETS):
        self.table = BucketTable(spark, f"{root}/history", schema, tuple(keys), buckets)
        self.keys, self.order, self.length = list(keys), order, length
        self.tie = [tie] if isinstance(tie, str) else list(tie)
        self.version = self.table.newest()

    def process(self, batch: DataFrame, batch_id: int) -> None:
        newest = Window.partitionBy(*self.keys).orderBy(*[F.col(c).desc() for c in (self.order, *self.tie)])

        def both(new: DataFrame, stored: DataFrame) -> DataFrame:
            # A rank filter of this form is also applied before the shuffle, so a task sees few rows per key.
            ranked = new.unionByName(stored).withColumn("__r", F.row_number().over(newest))
            return ranked.where(F.col("__r") <= self.length).drop("__r")

        self.table.merge(batch.select(*self.table.schema.names), batch_id, both)
        self.version = max(self.version, batch_id)

    def current(self) -> DataFrame:
        return self.table.read()

    def sequences(self, features: Sequence[str]) -> DataFrame:
        """One sequence per key, oldest first, padded on the left with copies of the first row."""
        position = [self.order, *self.tie]
        entry = F.struct(*position, F.struct(*features).alias("__f"))
        rows = self.current().groupBy(*self.keys).agg(
            F.array_sort(F.collect_list(entry)).alias("__rows"), F.max(self.order).alias(self.order)
        )
        values = F.transform("__rows", lambda r: r["__f"])
        missing = F.lit(self.length) - F.size("__rows")
        padded = F.concat(F.array_repeat(F.get(values, F.lit(0)), missing), values)
        return rows.select(*self.keys, self.order, padded.alias("features"))


def drop_repeats(
    stream: DataFrame,
    keys: Sequence[str],
    order: str,
    lateness: str = LATENESS,
    spread_by: str | None = None,
    ways: int = 16,
) -> DataFrame:
    """Skips snapshots that were already seen: same keys and same time within the allowed lateness.

    A stream's de-duplication is not combined before its shuffle. ``spread_by`` (the source file, say)
    first reduces many copies of one row in ``ways`` tasks to one copy each.
    """
    stream = stream.withWatermark(order, lateness)
    if spread_by:
        salted = stream.withColumn("__way", F.pmod(F.xxhash64(spread_by), F.lit(ways)))
        stream = salted.dropDuplicatesWithinWatermark([*keys, order, "__way"]).drop("__way")
    return stream.dropDuplicatesWithinWatermark([*keys, order])
