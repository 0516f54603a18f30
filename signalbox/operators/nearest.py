"""Nearest vertices by best-first search in packed box trees.

A tree packs boxes along a space-filling curve, FAN to a node, and every level is one set of arrays. A point first goes
straight down to the nearest leaf, so that it carries the distance of a real vertex as its bound; then it visits
further leaves in the order of their distance, until the next one is farther than its bound. The search runs over a batch
of points at a time, and only the answer leaves it, however many vertices lie at nearly the same distance.

Vertices up to a measured number form one tree, which is sent to the tasks that hold the points; the points are not
moved. More vertices are cut into pages in the order of the curve, each a tree of its own. A small tree of the
pages' boxes sends every point to the page nearest to it, then, with the bound found there, to the few others that
may hold something nearer. A page that is asked for by many points is sent to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbox.session import work_dir

FAN = 64
#: Distinct places that may be sent to every task: 24 bytes each and their ids.
MAX_SENT = 262_144
#: Places of a page, unless there would be more than MAX_PAGES / 2 of them: the boxes of all pages are sent to every task.
PAGE, MAX_PAGES = 16_384, 65_536
#: Points that one task looks up in one page.
POINTS_PER_TASK = 100_000
#: Further pages that a point visits in the second round; every later round allows eight times as many.
PAGES_A_ROUND = 8
#: Points searched at a time, and pairs of a point and a node that are held at a time.
CHUNK, PAIRS = 4096, 1 << 20


_STEPS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _cells(v: np.ndarray) -> np.ndarray:
    """The rank of each value, equal values alike, as one of 2^16 cells."""
    at = np.sort(v)
    return np.searchsorted(at, v) * (1 << 16) // max(1, len(v))


def _spread(n: np.ndarray) -> np.ndarray:
    """Every other bit of the result is a bit of the number."""
    for shift, mask in _STEPS:
        n = (n | n << shift) & mask
    return n


class Boxes:
    """A packed tree over boxes; points are boxes without extent.

    ``rank`` orders equal distances. Nodes of level 0 are the boxes themselves, in packed order.
    """

    def __init__(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, rank: np.ndarray) -> None:
        n = len(x0)
        # A Z-order curve over the ranks of x and y: square cells, each with about as many boxes.
        order = np.argsort(_spread(_cells(x0 + x1)) | _spread(_cells(y0 + y1)) << 1, kind="stable")
        self.order, self.rank = order, rank[order]
        self.levels = [np.stack([x0[order], y0[order], x1[order], y1[order]])]
        while self.levels[-1].shape[1] > FAN:
            below = self.levels[-1]
            starts = np.arange(0, below.shape[1], FAN)
            self.levels.append(np.stack([np.minimum.reduceat(below[i], starts) for i in (0, 1)] + [np.maximum.reduceat(below[i], starts) for i in (2, 3)]))

    @staticmethod
    def _distance(box: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """Squared distance to the nearest place of a box, never above that of a vertex in it, as rounded."""
        dx = np.maximum(np.maximum(box[0] - px, px - box[2]), 0.0)
        dy = np.maximum(np.maximum(box[1] - py, py - box[3]), 0.0)
        return dx * dx + dy * dy

    def _children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node x FAN) children one level below, and which of them exist."""
        child = nodes[:, None] * FAN + np.arange(FAN)
        there = child < self.levels[level].shape[1]
        return np.where(there, child, 0), there

    def _best_of(self, level: int, nodes: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each (point, node) the distance of its nearest child and that child; equal ones by rank at the bottom."""
        child, there = self._children(level, nodes)
        d = np.where(there, self._distance(self.levels[level][:, child], px[:, None], py[:, None]), np.inf)
        least = d.min(1)
        tie = self.rank[child] if level == 0 else child
        first = np.where(there & (d == least[:, None]), tie, np.iinfo(np.int64).max).argmin(1)
        return least, child[np.arange(len(nodes)), first]

    def nearest(self, px: np.ndarray, py: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance and number (of the boxes as given) of the nearest box of each point.

        ``known`` are distances beyond which nothing is wanted: boxes farther away are left out, and a point without any
        other has NaN and -1.
        """
        part = lambda a: None if known is None else known[a : a + CHUNK]
        out = [self._search(px[a : a + CHUNK], py[a : a + CHUNK], part(a)) for a in range(0, len(px), CHUNK)]
        if not out:
            return np.empty(0), np.empty(0, np.int64)
        d, best = np.concatenate([d for d, _ in out]), np.concatenate([b for _, b in out])
        return np.where(best < 0, np.nan, d), np.where(best < 0, -1, self.order[best])

    def _search(self, px: np.ndarray, py: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        m, top = len(px), len(self.levels) - 1
        node = np.zeros(m, np.int64)
        # Straight down to a leaf: its nearest child is the first bound, unless a nearer one is known.
        for level in range(top, 0, -1):
            _, node = self._best_of(level, node, px, py)
        bound, best = self._best_of(0, node, px, py)
        if known is not None:
            best, bound = np.where(bound <= known, best, -1), np.minimum(bound, known)
        if top == 0:
            return bound, best
        home = node
        # All leaves that may hold something as near, from the top down.
        point, nodes = np.arange(m), np.zeros(m, np.int64)
        for level in range(top, 0, -1):
            if len(point) * FAN > PAIRS and m > 1:  # far too many ties: half the points at a time
                half = m // 2
                parts = [self._search(px[h], py[h], None if known is None else known[h]) for h in (slice(half), slice(half, None))]
                return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            child, there = self._children(level, nodes)
            near = there & (self._distance(self.levels[level][:, child], px[point][:, None], py[point][:, None]) <= bound[point][:, None])
            row, column = np.nonzero(near)
            point, nodes = point[row], child[row, column]
        left = nodes != home[point]
        point, nodes = point[left], nodes[left]
        d = self._distance(self.levels[1][:, nodes], px[point], py[point])
        order = np.lexsort((d, point))
        point, nodes, d = point[order], nodes[order], d[order]
        turn = np.arange(len(point)) - np.searchsorted(point, point)  # the leaf's place in its point's order
        first, many = 0, 1
        while len(point):
            now = (turn >= first) & (turn < first + many)
            p = point[now]
            least, child = self._best_of(0, nodes[now], px[p], py[p])
            # The best of a point's leaves of this turn, by distance and then by rank.
            order = np.lexsort((self.rank[child], least, p))
            p, least, child = p[order], least[order], child[order]
            head = np.r_[True, p[1:] != p[:-1]] if len(p) else np.empty(0, bool)
            p, least, child = p[head], least[head], child[head]
            better = (least < bound[p]) | (least == bound[p]) & ((best[p] < 0) | (self.rank[child] < self.rank[best[p]]))
            bound[p[better]], best[p[better]] = least[better], child[better]
            left = (turn >= first + many) & (d <= bound[point])
            point, nodes, d, turn = point[left], nodes[left], d[left], turn[left]
            first, many = first + many, many * 2
        return bound, best

    def within(self, px: float, py: float, bound: float) -> np.ndarray:
        """Numbers of the boxes as near as the bound, by distance and then by rank."""
        nodes = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            child, there = self._children(level, nodes)
            child = child[there]
            d = self._distance(self.levels[level][:, child], px, py)
            nodes, d = child[d <= bound], d[d <= bound]
        return self.order[nodes[np.lexsort((self.rank[nodes], d))]]


def _ranks(ids: list) -> np.ndarray:
    """The place of each id in their order."""
    out = np.empty(len(ids), np.int64)
    out[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
    return out


def _placed(df: DataFrame, x: str, y: str) -> Column:
    return F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)


def _floats(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def nearest_vertex(
    points: DataFrame, vertices: DataFrame, point_id: str, vertex_id: str, x: str = "x", y: str = "y"
) -> DataFrame:
    """For every point the vertex at the smallest squared distance; the lowest id wins a tie.

    Exact, and one row a point leaves a search. Returns point_id, vertex_id, distance2; a point
    without coordinates, or any point where there are no vertices, has nulls.
    """
    spark = points.sparkSession
    places = vertices.select(F.col(vertex_id).alias("v"), F.col(x).cast("double").alias("vx"), F.col(y).cast("double").alias("vy"))
    places = places.where(_placed(places, "vx", "vy")).groupBy("vx", "vy").agg(F.min("v").alias("v"))
    folder = work_dir(spark, "places")
    places.write.parquet(folder)  # the distinct places, read several times
    places = spark.read.parquet(folder)
    count = places.count()
    kind = vertices.schema[vertex_id].dataType
    located = points.select(F.col(point_id).alias("p"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
    located = located.where(_placed(located, "px", "py"))
    if not count:
        found = located.select("p", F.lit(None).cast("double").alias("d"), F.lit(None).cast(kind).alias("v"))
    elif count <= MAX_SENT:
        found = _sent(located, places, kind)
    else:
        found = _paged(located, places, count, kind)
    best = found.groupBy("p").agg(F.min(F.struct("d", "v")).alias("m"))
    best = best.select(F.col("p").alias(point_id), F.col("m.v").alias(vertex_id), F.col("m.d").alias("distance2"))
    return points.select(point_id).distinct().join(best, point_id, "left")


def _tree(vx: np.ndarray, vy: np.ndarray, ids: list) -> Boxes:
    return Boxes(vx, vy, vx, vy, _ranks(ids))


def _schema(located: DataFrame, kind: T.DataType, *names: str) -> T.StructType:
    every = [*located.schema.fields, T.StructField("d", T.DoubleType()), T.StructField("v", kind), T.StructField("page", T.LongType()), T.StructField("visited", T.LongType())]
    return T.StructType([f for n in names for f in every if f.name == n])


def _sent(located: DataFrame, places: DataFrame, kind: T.DataType) -> DataFrame:
    """Searches one tree of all places, at most MAX_SENT, in the tasks that hold the points."""
    from pyspark.sql.pandas.types import to_arrow_schema

    given = places.select("vx", "vy", "v").toArrow()
    vx, vy, ids = _floats(given.column(0)), _floats(given.column(1)), given.column(2).combine_chunks()
    schema = _schema(located, kind, "p", "d", "v")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _tree(vx, vy, ids.to_pylist())
        for batch in batches:
            d, number = tree.nearest(_floats(batch.column(1)), _floats(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d), ids.take(pa.array(number)).cast(arrow.field("v").type)], schema=arrow)

    return located.mapInArrow(run, schema)


def _curve(places: DataFrame) -> DataFrame:
    """Adds ``z``, the place on a Z-order curve over the extent of all places."""
    x0, x1, y0, y1 = places.agg(F.min("vx"), F.max("vx"), F.min("vy"), F.max("vy")).first()

    def spread(v: str, low: float, high: float) -> Column:
        cells = float((1 << 31) - 1)
        n = F.floor((F.col(v) - low) / F.lit((high - low) or 1.0) * cells).cast("bigint")
        for shift, mask in _STEPS:
            n = (n.bitwiseOR(F.shiftleft(n, shift))).bitwiseAND(F.lit(mask))
        return n

    # Steps in columns of their own, so that none is written out again inside the next.
    return places.select("*", spread("vx", x0, x1).alias("zx"), spread("vy", y0, y1).alias("zy")).select("v", "vx", "vy", F.col("zx").bitwiseOR(F.shiftleft("zy", 1)).alias("z"))


def _pages(places: DataFrame, count: int) -> DataFrame:
    """Places with the number of their page: runs along the curve, cut by x and y where it has one value."""
    from pyspark.sql.pandas.types import to_arrow_schema

    size = max(PAGE, -(-2 * count // MAX_PAGES))
    schema = T.StructType([T.StructField("page", T.LongType()), *[places.schema[n] for n in ("v", "vx", "vy")]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            page = (at + np.arange(batch.num_rows)) // size + (task << 32)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(page), *[c.cast(f.type) for c, f in zip(batch.columns, list(arrow)[1:])]], schema=arrow)

    order = ["z", "vx", "vy"]
    ranged = _curve(places).repartitionByRange(*order).sortWithinPartitions(*order)
    folder = work_dir(places.sparkSession, "pages")
    ranged.select("v", "vx", "vy").mapInArrow(run, schema).write.parquet(folder)
    return places.sparkSession.read.parquet(folder)


def _paged(located: DataFrame, places: DataFrame, count: int, kind: T.DataType) -> DataFrame:
    """Searches page by page: the nearest page first, then those that its answer leaves open."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = located.sparkSession
    paged = _pages(places, count)
    boxes = paged.groupBy("page").agg(F.min("vx").alias("x0"), F.min("vy").alias("y0"), F.max("vx").alias("x1"), F.max("vy").alias("y1")).orderBy("page").toPandas()  # bounded by MAX_PAGES
    numbers = boxes["page"].to_numpy()
    edges = [boxes[c].to_numpy() for c in ("x0", "y0", "x1", "y1")]
    over = lambda: Boxes(*edges, np.arange(len(numbers)))
    pair = _schema(located, kind, "p", "px", "py", "d", "page", "visited")
    pair_arrow = to_arrow_schema(pair)

    def first_page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = over()
        for batch in batches:
            _, number = tree.nearest(_floats(batch.column(1)), _floats(batch.column(2)))
            unknown = pa.nulls(len(number), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, unknown, pa.array(numbers[number]), pa.array(np.ones(len(number), np.int64))], schema=pair_arrow)

    def next_pages(limit: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = over()
            for batch in batches:
                rows, pages, visited = [], [], []
                for i, (px, py, d, seen) in enumerate(zip(*(_floats(batch.column(c)).tolist() for c in (1, 2, 3, 4)))):
                    near = tree.within(px, py, d)[seen : seen + limit]
                    rows += [i] * len(near)
                    pages.append(numbers[near])
                    visited += [seen + len(near)] * len(near)
                take = pa.array(rows, pa.int64())
                kept = [batch.column(c).take(take) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(pages) if pages else np.empty(0, np.int64)), pa.array(visited, pa.int64())], schema=pair_arrow)

        return run

    done = _schema(located, kind, "p", "px", "py", "d", "v", "visited")

    done_arrow = to_arrow_schema(done)

    def look(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return done_arrow.empty_table()
        ids = held.column("v").combine_chunks()
        tree = _tree(_floats(held.column("vx")), _floats(held.column("vy")), ids.to_pylist())
        # Pages after the first are searched within what is known; a page without anything as near has NaN and null.
        known = None if asked.column("d").null_count else _floats(asked.column("d"))
        d, number = tree.nearest(_floats(asked.column("px")), _floats(asked.column("py")), known)
        made = {"d": pa.array(d), "v": ids.take(pa.array(number, mask=number < 0))}
        return pa.table({f.name: (made[f.name] if f.name in made else asked.column(f.name)).cast(f.type) for f in done_arrow}, schema=done_arrow)

    def visit(pairs: DataFrame) -> DataFrame:
        """The nearest place in each page asked for; a page asked for by many points is held by several tasks."""
        asked = pairs.groupBy("page").agg(F.ceil(F.count(F.lit(1)) / POINTS_PER_TASK).cast("int").alias("ways")).where("ways > 1").collect()  # of pages
        ways = F.lit(1)
        for r in asked:
            ways = F.when(F.col("page") == r["page"], r["ways"]).otherwise(ways) if len(asked) <= 64 else ways
        if len(asked) > 64:
            held = spark.createDataFrame([(r["page"], r["ways"]) for r in asked], "page bigint, ways int")
            spread = lambda df: df.join(F.broadcast(held), "page", "left").withColumn("ways", F.coalesce("ways", F.lit(1)))
        else:
            spread = lambda df: df.withColumn("ways", ways)
        left = spread(pairs).withColumn("way", F.pmod(F.xxhash64("p", "px", "py"), F.col("ways")).cast("int")).drop("ways")
        right = spread(paged).withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).drop("ways")
        return left.groupBy("page", "way").cogroup(right.groupBy("page", "way")).applyInArrow(look, done)

    def stored(df: DataFrame, label: str) -> DataFrame:
        folder = work_dir(spark, label)
        df.write.parquet(folder)
        return spark.read.parquet(folder)

    state = stored(visit(stored(located.mapInArrow(first_page, pair), "asked")), "found")
    answers, limit = [], PAGES_A_ROUND
    while True:
        answers.append(state.select("p", "d", "v"))
        pairs = stored(state.select("p", "px", "py", "d", "visited").mapInArrow(next_pages(limit), pair), "asked")
        if pairs.isEmpty():
            break
        # Points that go on carry the best of what they have found, and how many pages they have seen.
        again = pairs.select("p", "px", "py").distinct()
        match = [again[c].eqNullSafe(state[c]) for c in ("p", "px", "py")]
        before = state.join(again, match, "left_semi")
        both = visit(pairs).unionByName(before)
        best = both.groupBy("p", "px", "py").agg(F.min(F.struct("d", "v")).alias("m"), F.max("visited").alias("visited"))
        state = stored(best.select("p", "px", "py", "m.d", "m.v", "visited"), "found")
        limit *= 8
    out = answers[0]
    for more in answers[1:]:
        out = out.unionAll(more)
    return out
