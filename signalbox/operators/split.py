"""Splitting of long histories, so that no window task holds more than a fair share of rows.

Most series operators are windows per key. One key may hold a third of all rows, and then one task
would too. ``plan_split`` measures the keys with a map-side combined count, whatever the size of the input.
The rows of keys above ``PIECE_ROWS`` are then sorted over many partitions by key, time and tiebreaker: Spark's
range partitioning finds the boundaries, wherever they fall, also inside one crowded time. The partition is the
row's piece. Windows then partition by (key, piece), and what crosses a cut (a running total, the previous row, the
next few rows) travels through a summary with one row per piece.

The marked rows are written to the shared folder: a range is drawn from a sample, so that marking the same rows a
second time could cut them elsewhere, and a summary must be of the same pieces as the rows that it is joined to.

Bounds: there are at most ``MAX_PIECES`` partitions, hence at most that many cut keys, and pieces beyond one for each
key; beyond ``MAX_PIECES * PIECE_ROWS`` rows of long keys a piece grows. Neither keys nor boundaries reach the driver,
only counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from signalbox.session import work_dir

PIECE = "__piece"

# Rows that one window task may hold of a key; a longer key is cut into pieces of about that size.
PIECE_ROWS = 1_000_000
# Partitions that the rows of long keys are sorted over.
MAX_PIECES = 50_000
# Long keys or summaries of pieces that may be broadcast; their number is measured.
MAX_BROADCAST_ROWS = 100_000


def null_safe(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, (l.eqNullSafe(r) for l, r in zip(left, right)))


def _sized(rows: DataFrame, count: int) -> DataFrame:
    """A table of at most ``count`` rows, broadcast while that is few; beyond it the join shuffles."""
    return F.broadcast(rows) if count <= MAX_BROADCAST_ROWS else rows


@dataclass(frozen=True)
class Split:
    """The long keys of a table; ``cuts`` is None when there are none.

    ``cuts`` is a stored table of the long keys, ``longs`` their number, ``partitions`` over how many their rows are
    sorted. A piece is a stretch of a key's rows in the order of (order, tie).
    """

    keys: tuple[str, ...]
    order: str
    tie: tuple[str, ...] = ()
    cuts: DataFrame | None = None
    longs: int = 0
    partitions: int = 0
    limit: int = 0

    @property
    def pieces(self) -> int:
        """At most so many pieces have a number."""
        return self.partitions + min(self.longs, self.partitions) if self._broad else self.partitions + self.longs

    @property
    def _broad(self) -> bool:
        """Whether there are too many long keys to pick out their rows, so that all rows are sorted."""
        return self.longs > MAX_BROADCAST_ROWS

    def _match(self, df: DataFrame, keys: DataFrame, flag: str) -> DataFrame:
        """Marks the rows whose keys are in the table."""
        names = [f"__long_{i}" for i in range(len(self.keys))]
        table = keys.select(*self.keys).toDF(*names).withColumn(flag, F.lit(True))
        joined = df.join(F.broadcast(table), null_safe([F.col(k) for k in self.keys], [F.col(n) for n in names]), "left")
        return joined.drop(*names).withColumn(flag, F.col(flag).isNotNull())

    def mark(self, df: DataFrame) -> DataFrame:
        """Adds the piece number: -1 for whole keys, rising numbers in time order for cut ones."""
        if self.cuts is None:
            return df
        flagged = df.withColumn("__long", F.lit(True)) if self._broad else self._match(df, self.cuts, "__long")
        position = [*self.keys, self.order, *self.tie]
        ranged = flagged.where("__long").drop("__long").repartitionByRange(self.partitions, *position).sortWithinPartitions(*position)
        spark, folder = df.sparkSession, work_dir(df.sparkSession, "pieces")
        ranged.withColumn(PIECE, F.spark_partition_id()).write.parquet(folder)
        long = spark.read.parquet(folder)
        if not self._broad:
            whole = flagged.where("not __long").drop("__long").withColumn(PIECE, F.lit(-1))
            return whole.unionByName(long)
        # A boundary lies in one key, so there are fewer cut keys than partitions.
        over = long.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n"), F.min(PIECE).alias("a"), F.max(PIECE).alias("b"))
        marked = self._match(long, over.where((F.col("n") > self.limit) & (F.col("a") < F.col("b"))), "__cut")
        return marked.withColumn(PIECE, F.when(F.col("__cut"), F.col(PIECE)).otherwise(F.lit(-1))).drop("__cut")

    def spread(self, df: DataFrame) -> DataFrame:
        """Marks the rows and brings each piece together; unchanged when nothing is cut.

        Done once at the head of a chain of operators, they all work on this one shuffle, and so do the
        summaries of the pieces. End the chain with ``gathered``.
        """
        if self.cuts is None:
            return df
        return self.mark(df).repartition(*self.keys, PIECE)


def gathered(df: DataFrame) -> DataFrame:
    """Ends a chain that began with ``Split.spread``."""
    return df.drop(PIECE)


def plan_split(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str | Sequence[str] | None = None,
    max_rows: int | None = None,
) -> Split:
    """Measures the keys. Plan once, pass the result to several operators.

    ``tie`` names the tiebreakers, of any type that can be ordered. ``max_rows`` overrides the rows a
    piece may have (tests use a tiny value).
    """
    keys = tuple(keys)
    tie = (tie,) if isinstance(tie, str) else tuple(tie or ())
    limit = max_rows or PIECE_ROWS
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    long = F.col("__n") > limit
    longs, rows = counts.agg(F.count_if(long), F.sum(F.when(long, F.col("__n")))).first()
    if not longs:
        return Split(keys, order, tie)
    # Written, so that every later stage, also a re-run one, cuts the same keys.
    spark, folder = df.sparkSession, work_dir(df.sparkSession, "long-keys")
    counts.where(long).select(*keys).write.parquet(folder)
    return Split(keys, order, tie, spark.read.parquet(folder), longs, min(MAX_PIECES, -(-rows // limit)), limit)


@dataclass
class Series:
    """A keyed, ordered series ready for windows, cut where it has to be."""

    df: DataFrame
    keys: Sequence[str]
    order: str
    tie: Sequence[str]
    split: Split | None = None
    cut: bool = field(init=False)
    chained: bool = field(init=False)

    def __post_init__(self) -> None:
        if isinstance(self.tie, str):
            self.tie = [self.tie]
        if self.split is None:
            self.split = plan_split(self.df, self.keys, self.order, self.tie)
        self.cut = self.split.cuts is not None
        self.chained = PIECE in self.df.columns
        if not self.chained:
            self.df = self.split.spread(self.df)

    @property
    def part(self) -> list[str]:
        return [*self.keys, PIECE] if self.cut else list(self.keys)

    @property
    def position(self) -> list[str]:
        return [self.order, *self.tie]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(*self.position)

    def backwards(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(*[F.col(c).desc() for c in self.position])

    def so_far(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def rest(self) -> WindowSpec:
        """From the end back to the current row (a running frame, unlike "current .. following")."""
        return self.backwards().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def at(self) -> Column:
        return F.struct(*[F.col(c) for c in self.position])

    # ---- what crosses a cut -----------------------------------------------------------------

    def carry(
        self,
        df: DataFrame,
        summary: dict[str, Column],
        across: Callable[[DataFrame, WindowSpec], DataFrame],
        keep: Sequence[str],
    ) -> DataFrame:
        """Summarises each piece, lets ``across`` combine the pieces of a key in time order, and joins
        the ``keep`` columns of the result to the rows. Rows of whole keys get nulls."""
        # Which pieces count is decided after the aggregate, so that no filter changes the shuffle below.
        pieces = (
            df.groupBy(*self.part)
            .agg(F.max(PIECE).alias("__cut"), *[c.alias(n) for n, c in summary.items()])
            .where(F.col("__cut") >= 0)
            .drop("__cut")
        )
        return self._join(df, across(pieces, Window.partitionBy(*self.keys).orderBy(PIECE)), keep)

    def neighbours(self, df: DataFrame, value: Column, n: int, name: str, before: bool) -> DataFrame:
        """Adds the ``n`` values just before (or after) the row's piece, in time order."""
        order = self.backwards() if before else self.window()
        edge = (
            df.select(*self.part, F.row_number().over(order).alias("__r"), value.alias("__v"))
            .where(F.when(F.col(PIECE) >= 0, F.col("__r")) <= n)
            .groupBy(*self.part)
            .agg(F.array_sort(F.collect_list(F.struct("__r", "__v"))).alias("__edge"))
        )
        values = F.transform("__edge", lambda e: e["__v"])
        edge = edge.withColumn("__edge", F.reverse(values) if before else values)
        pieces = Window.partitionBy(*self.keys).orderBy(PIECE)
        frame = pieces.rowsBetween(-n, -1) if before else pieces.rowsBetween(1, n)
        joined = F.flatten(F.collect_list("__edge").over(frame))
        edge = edge.withColumn("__edge", joined)
        size = F.size("__edge")
        nearest = (
            F.slice("__edge", F.greatest(F.lit(1), size - (n - 1)), F.lit(n))
            if before
            else F.slice("__edge", 1, n)
        )
        return self._join(df, edge.withColumn(name, nearest), [name])

    def _join(self, df: DataFrame, pieces: DataFrame, keep: Sequence[str]) -> DataFrame:
        names = [f"__on_{i}" for i in range(len(self.part))]
        pieces = pieces.select(
            *[F.col(p).alias(n) for p, n in zip(self.part, names)], *[F.col(k) for k in keep]
        )
        match = null_safe([F.col(p) for p in self.part], [F.col(n) for n in names])
        return df.join(_sized(pieces, self.split.pieces), match, "left").drop(*names)

    def done(self, df: DataFrame, *temporary: str) -> DataFrame:
        return df.drop(*temporary) if self.chained else df.drop(PIECE, *temporary)
