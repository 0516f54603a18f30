"""Window operators on any keyed, ordered series.

All of them take ``(df, keys, order, tie)``: the key columns, the ordering column (a time, or a
position) and a tiebreaker that makes the order total. Each costs one shuffle on the keys; chained on
the same keys they share it. ``split`` accepts a plan from ``plan_split`` so that a chain measures the
keys once. Sums are kept in whole microseconds, so results do not depend on how a key was cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbox.functions.calendar import MICROS_PER_MINUTE, micros
from signalbox.operators.newest import row_at
from signalbox.operators.split import PIECE, Series, Split

# Fixed values of the road feed: the gap assumed before a segment's first row, and the label offset.
FIRST_GAP_MINUTES = 5.0
LABEL_ROWS = 6
# Fixed value of the rail feed: rows a delay label looks ahead, the current row included.
LOOKAHEAD_ROWS = 10

PER_MINUTE = float(MICROS_PER_MINUTE)


def gap_minutes(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str | Sequence[str],
    default: float = FIRST_GAP_MINUTES,
    max_gap: float | None = None,
    out: str = "time_diff",
    split: Split | None = None,
) -> DataFrame:
    """Minutes since the key's previous row; ``default`` on its first row; optionally capped."""
    s = Series(df, keys, order, tie, split)
    rows, before = s.df, F.lag(order, 1).over(s.window())
    if s.cut:
        rows = s.carry(
            rows,
            {"__end": F.max(order)},
            lambda p, w: p.withColumn("__before", F.lag("__end", 1).over(w)),
            ["__before"],
        )
        before = F.coalesce(before, F.col("__before"))
    rows = rows.withColumn("__prev", before)
    gap = F.coalesce((micros(order) - micros("__prev")) / F.lit(PER_MINUTE), F.lit(float(default)))
    if max_gap is not None:
        gap = F.least(gap, F.lit(float(max_gap)))
    return s.done(rows.withColumn(out, gap), "__prev", "__before")


def run_minutes(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str | Sequence[str],
    cond: str,
    gap: str = "time_diff",
    mode: str = "run",
    min_minutes: float | None = None,
    block: str = "congestion_block",
    out: str = "congestion_minutes",
    split: Split | None = None,
) -> DataFrame:
    """Minutes accumulated within the current run of rows where ``cond`` is 1; 0 elsewhere.

    ``block`` counts the rows so far where the condition does not hold. ``mode='leading'`` accumulates
    only in the run that starts a key's series and reports 0 for every later run. Runs that have not
    yet reached ``min_minutes`` report 0.

    The minutes of a run are a difference of two running values: the total so far, and that total at
    the last row outside a run. So every step shares one window, and one sort.
    """
    if mode not in ("run", "leading"):
        raise ValueError(f"mode must be 'run' or 'leading', not {mode!r}")
    s = Series(df, keys, order, tie, split)
    holds = F.coalesce(F.col(cond).cast("int"), F.lit(0)) == 1
    span = F.round(F.coalesce(F.col(gap), F.lit(0.0)) * F.lit(PER_MINUTE)).cast("bigint")
    rows = s.df.withColumns(
        {
            block: F.sum(F.when(holds, 0).otherwise(1)).over(s.so_far()),
            "__total": F.sum(F.when(holds, span).otherwise(F.lit(0))).over(s.so_far()),
        }
    ).withColumn("__outside", F.max(F.when(~holds, F.col("__total"))).over(s.so_far()))
    if s.cut:

        def across(pieces: DataFrame, w) -> DataFrame:
            earlier = w.rowsBetween(Window.unboundedPreceding, -1)
            return pieces.withColumns(
                {
                    "__total_in": F.coalesce(F.sum("__t").over(earlier), F.lit(0)),
                    "__block_in": F.sum("__b").over(earlier),
                }
            ).withColumn("__outside_in", F.max(F.col("__total_in") + F.col("__o")).over(earlier))

        rows = s.carry(
            rows,
            {"__t": F.max("__total"), "__b": F.max(block), "__o": F.max("__outside")},
            across,
            ["__total_in", "__block_in", "__outside_in"],
        )
        total_in = F.coalesce(F.col("__total_in"), F.lit(0))
        rows = rows.withColumns(
            {
                block: F.col(block) + F.coalesce(F.col("__block_in"), F.lit(0)),
                "__total": F.col("__total") + total_in,
                "__outside": F.coalesce(F.col("__outside") + total_in, F.col("__outside_in")),
            }
        )
    counted = holds if mode == "run" else holds & (F.col(block) == 0)
    run = (F.col("__total") - F.coalesce(F.col("__outside"), F.lit(0))) / F.lit(PER_MINUTE)
    if min_minutes is not None:
        counted = counted & (run >= F.lit(float(min_minutes)))
    rows = rows.withColumn(out, F.when(counted, run).otherwise(F.lit(0.0)))
    return s.done(
        rows, "__total", "__outside", "__total_in", "__block_in", "__outside_in"
    )


def lead_label(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str | Sequence[str],
    value: str,
    rows: int = LABEL_ROWS,
    seconds: float | None = None,
    fill: float = 0.0,
    out: str | None = None,
    split: Split | None = None,
) -> DataFrame:
    """The value ``rows`` rows later; ``fill`` where the series has no such row.

    With ``seconds`` the label is the value at the first row at least that much later, so gaps in the
    series do not stretch the horizon.
    """
    out = out or f"label_{value}"
    if seconds is not None:
        return _lead_label_time(df, keys, order, tie, value, seconds, fill, out)
    s = Series(df, keys, order, tie, split)
    marked, later = s.df, F.lead(value, rows).over(s.window())
    if s.cut:
        marked = _rows_left(s, s.neighbours(marked, F.col(value), rows, "__next", before=False))
        beyond = F.get("__next", F.lit(rows - 1) - F.col("__left"))
        later = F.when(F.col("__left") < rows, beyond).otherwise(later)
    return s.done(
        marked.withColumn(out, F.coalesce(later, F.lit(fill))), "__next", "__left"
    )


def _rows_left(s: Series, df: DataFrame) -> DataFrame:
    """Rows that follow the current one in its piece."""
    everything = Window.partitionBy(*s.part)
    left = F.count(F.lit(1)).over(everything) - F.row_number().over(s.window())
    return df.withColumn("__left", left.cast("int"))


def _lead_label_time(df, keys, order, tie, value, seconds, fill, out) -> DataFrame:
    """Probes are merged into the series: each row also asks, ``seconds`` later, for the next value.

    Going backwards in time, a probe takes the nearest real row at or after its moment. The union is a
    series like any other, so it is cut like any other.
    """
    tie = [tie] if isinstance(tie, str) else list(tie)
    at = micros(order)
    shift = F.lit(int(seconds * 1_000_000))
    # At equal times a probe sorts first, so that it sees the row it coincides with.
    both = df.withColumn(
        "__entry",
        F.explode(
            F.array(
                F.struct((at + shift).alias("t"), F.lit(0).alias("kind")),
                F.struct(at.alias("t"), F.lit(1).alias("kind")),
            )
        ),
    ).withColumns({"__t": F.col("__entry.t"), "__kind": F.col("__entry.kind")})
    real = F.when(F.col("__kind") == 1, F.struct(F.col(value).alias("v")))
    s = Series(both, keys, "__t", ["__kind", *tie])
    rows, found = s.df, F.last(real, ignorenulls=True).over(s.rest())
    if s.cut:
        rows = s.carry(
            rows,
            {"__first": F.min_by(real, F.when(F.col("__kind") == 1, s.at()))},
            lambda p, w: p.withColumn(
                "__found",
                F.last("__first", ignorenulls=True).over(
                    Window.partitionBy(*keys)
                    .orderBy(F.col(s.part[-1]).desc())
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
            ),
            ["__found"],
        )
        found = F.coalesce(found, F.col("__found"))
    rows = rows.withColumn(out, F.coalesce(found["v"], F.lit(fill))).where("__kind = 0")
    return s.done(rows, "__entry", "__t", "__kind", "__found")


def forward_fill(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str | Sequence[str],
    cols: Sequence[str],
    fill: float | None = 0.0,
    split: Split | None = None,
) -> DataFrame:
    """Replaces nulls by the key's latest earlier value, and by ``fill`` where there is none."""
    s = Series(df, keys, order, tie, split)
    filled = {c: F.last(c, ignorenulls=True).over(s.so_far()) for c in cols}
    rows = s.df
    if s.cut:
        rows = s.carry(
            rows,
            {f"__l_{c}": F.max_by(c, F.when(F.col(c).isNotNull(), s.at())) for c in cols},
            lambda p, w: p.withColumns(
                {
                    f"__in_{c}": F.last(f"__l_{c}", ignorenulls=True).over(
                        w.rowsBetween(Window.unboundedPreceding, -1)
                    )
                    for c in cols
                }
            ),
            [f"__in_{c}" for c in cols],
        )
        filled = {c: F.coalesce(v, F.col(f"__in_{c}")) for c, v in filled.items()}
    if fill is not None:
        filled = {c: F.coalesce(v, F.lit(fill)) for c, v in filled.items()}
    return s.done(rows.withColumns(filled), *[f"__in_{c}" for c in cols])


def lookahead_max(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str | Sequence[str],
    flag: str,
    rows: int = LOOKAHEAD_ROWS,
    seconds: float | None = None,
    out: str = "delay_risk_label",
    split: Split | None = None,
) -> DataFrame:
    """The largest ``flag`` among the current and the next ``rows - 1`` rows, as a double.

    With ``seconds`` the horizon is time instead: 1.0 if a row with flag 1 lies within it.
    """
    s = Series(df, keys, order, tie, split)
    marked = s.df
    if seconds is not None:
        moment = F.when(F.col(flag) == 1, micros(order))
        # Rows that share the current row's time count too, whatever their tiebreaker.
        back = Window.partitionBy(*s.part).orderBy(F.col(order).desc())
        upcoming = F.min(moment).over(
            back.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        )
        if s.cut:

            def across(pieces: DataFrame, w) -> DataFrame:
                back_pieces = Window.partitionBy(*keys).orderBy(F.col(s.part[-1]).desc())
                earlier = (Window.unboundedPreceding, -1)
                return pieces.withColumns(
                    {
                        "__beyond": F.min("__first").over(back_pieces.rowsBetween(*earlier)),
                        "__so_far": F.max("__last").over(w.rowsBetween(*earlier)),
                    }
                )

            summary = {"__first": F.min(moment), "__last": F.max(moment)}
            marked = s.carry(marked, summary, across, ["__beyond", "__so_far"])
            # A crowded time may itself be cut: its rows in earlier pieces are not in the past.
            same_time = F.when(F.col("__so_far") == micros(order), F.col("__so_far"))
            upcoming = F.coalesce(same_time, upcoming, F.col("__beyond"))
        marked = marked.withColumn("__upcoming", upcoming)
        near = F.col("__upcoming") <= micros(order) + F.lit(int(seconds * 1_000_000))
        label = F.coalesce(near, F.lit(False)).cast("double")
        return s.done(marked.withColumn(out, label), "__upcoming", "__beyond", "__so_far")

    label = F.max(flag).over(s.window().rowsBetween(0, rows - 1))
    if s.cut and rows > 1:
        marked = _rows_left(s, s.neighbours(marked, F.col(flag), rows - 1, "__next", before=False))
        wanted = F.greatest(F.lit(0), F.lit(rows - 1) - F.col("__left"))
        label = F.greatest(label, F.array_max(F.slice("__next", F.lit(1), wanted)))
    return s.done(marked.withColumn(out, label.cast("double")), "__next", "__left")


def change_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str | Sequence[str],
    flag: str,
    changed: str = "isdelay_changed",
    block: str = "block_id",
    starts: str | None = None,
    max_gap: float | None = None,
    split: Split | None = None,
) -> DataFrame:
    """Marks rows whose flag differs from the key's previous row, and numbers the stretches between.

    The first row of a key is no change, so its block is 0. With ``max_gap`` a pause of more than that
    many minutes is a change as well. ``starts`` names a column that marks the first row of each stretch.
    """
    s = Series(df, keys, order, tie, split)
    before = F.lag(F.struct(F.col(flag).alias("flag"), F.col(order).alias("at")), 1).over(s.window())
    rows = s.df.withColumn("__prev", before)
    if s.cut:
        last = F.struct(F.col(flag).alias("flag"), F.col(order).alias("at"))
        rows = s.carry(
            rows,
            {"__last": F.max_by(last, s.at())},
            lambda p, w: p.withColumn("__last_in", F.lag("__last", 1).over(w)),
            ["__last_in"],
        )
        rows = rows.withColumn("__prev", F.coalesce("__prev", "__last_in"))
    differs = F.coalesce(F.col(flag) != F.col("__prev.flag"), F.lit(False))
    if max_gap is not None:
        pause = (micros(order) - micros("__prev.at")) / F.lit(PER_MINUTE)
        differs = differs | F.coalesce(pause > F.lit(float(max_gap)), F.lit(False))
    rows = rows.withColumn(changed, differs.cast("int"))
    if starts:
        rows = rows.withColumn(starts, F.col("__prev").isNull() | (F.col(changed) == 1))
    rows = rows.withColumn(block, F.sum(changed).over(s.so_far()))
    if s.cut:
        rows = s.carry(
            rows,
            {"__b": F.sum(changed)},
            lambda p, w: p.withColumn(
                "__block_in", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, -1))
            ),
            ["__block_in"],
        )
        rows = rows.withColumn(block, F.col(block) + F.coalesce(F.col("__block_in"), F.lit(0)))
    return s.done(rows, "__prev", "__last_in", "__block_in")


def row_positions(s: Series, df: DataFrame, position: str, total: str | None = None) -> DataFrame:
    """The row's 1-based position in its key's whole series, and optionally the series' length."""
    cols = {position: F.row_number().over(s.window()).cast("bigint")}
    if total:
        cols[total] = F.count(F.lit(1)).over(Window.partitionBy(*s.part))
    df = df.withColumns(cols)
    if s.cut:
        df = s.carry(
            df,
            {"__n": F.count(F.lit(1))},
            lambda p, w: p.withColumns(
                {
                    "__n_in": F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                    "__n_all": F.sum("__n").over(Window.partitionBy(*s.keys)),
                }
            ),
            ["__n_in", "__n_all"],
        )
        df = df.withColumn(position, F.col(position) + F.coalesce(F.col("__n_in"), F.lit(0)))
        if total:
            df = df.withColumn(total, F.coalesce(F.col("__n_all"), F.col(total)))
        df = df.drop("__n_in", "__n_all")
    return df


def sequences(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str | Sequence[str],
    features: Sequence[str],
    label: str,
    length: int,
    pad: bool = True,
    drop_last: bool = True,
    split: Split | None = None,
) -> DataFrame:
    """Training samples: the features of ``length`` consecutive rows, and the label of the last.

    A series of at most ``length`` rows gives one sample, padded on the left with copies of its first
    row. ``drop_last`` leaves out the window that ends at the newest row (and so pads one row more).
    Returns keys, order and tie of the window's last real row, ``features`` (an array of structs) and
    ``label``.
    """
    kept = list(dict.fromkeys([*keys, order, *([tie] if isinstance(tie, str) else tie)]))
    piece = [PIECE] if PIECE in df.columns else []
    narrow = df.select(*kept, *piece, F.struct(*features).alias("__f"), F.col(label).alias("label"))
    s = Series(narrow, keys, order, tie, split)
    rows = row_positions(s, s.df, "__i", "__n")
    recent = F.collect_list("__f").over(s.window().rowsBetween(-(length - 1), 0))
    if s.cut:
        rows = s.neighbours(rows, F.col("__f"), length - 1, "__earlier", before=True)
        recent = F.concat(F.coalesce(F.col("__earlier"), F.array()), recent)
    rows = rows.withColumn("__w", recent)
    size = F.size("__w")
    window = F.slice("__w", F.greatest(F.lit(1), size - (length - 1)), F.lit(length))

    i, n = F.col("__i"), F.col("__n")
    newest = n - 1 if drop_last else n
    full = (i >= length) & (i <= newest)
    if pad:
        short = n <= length if drop_last else n < length
        missing = F.greatest(F.lit(0), F.lit(length) - newest).cast("int")
        copies = F.array_repeat(F.get("__w", F.lit(0)), missing)
        padded = F.slice(F.concat(copies, F.col("__w")), 1, length)
        window = F.when(short, padded).otherwise(window)
        full = F.when(short, i == F.greatest(F.lit(1), newest)).otherwise(full)
    return (
        s.done(rows.where(full))
        .select(*kept, window.alias("features"), "label")
    )


def constant_history(
    df: DataFrame, features: Sequence[str], length: int, out: str = "features"
) -> DataFrame:
    """A scoring sequence made of ``length`` copies of the current row."""
    return df.withColumn(out, F.array_repeat(F.struct(*features), length))


def first_rows(
    df: DataFrame, keys: Sequence[str], order: str, tie: str | Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Each key's first row, reduced before the shuffle (see ``newest``)."""
    tie = [tie] if isinstance(tie, str) else list(tie)
    return row_at(df, keys, order, tie, cols, last=False)


def interpolate_gaps(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str | Sequence[str],
    known: str,
    cols: Sequence[str],
    split: Split | None = None,
) -> DataFrame:
    """Places rows where ``known`` is false evenly between the nearest known rows before and after.

    The k-th of n unknown rows gets ``a + (b - a) * k / (n + 1)``. Rows outside two known ones stay.
    """
    s = Series(df, keys, order, tie, split)
    rows = row_positions(s, s.df, "__i")
    anchor = F.when(
        F.coalesce(F.col(known), F.lit(False)), F.struct(F.col("__i").alias("i"), *cols)
    )
    before = F.last(anchor, ignorenulls=True).over(s.so_far())
    after = F.last(anchor, ignorenulls=True).over(s.rest())
    if s.cut:
        rows = rows.withColumn("__anchor", anchor)

        def across(pieces: DataFrame, w) -> DataFrame:
            back = Window.partitionBy(*keys).orderBy(F.col(s.part[-1]).desc())
            earlier = (Window.unboundedPreceding, -1)
            return pieces.withColumns(
                {
                    "__a_in": F.last("__l", ignorenulls=True).over(w.rowsBetween(*earlier)),
                    "__b_in": F.last("__f", ignorenulls=True).over(back.rowsBetween(*earlier)),
                }
            )

        rows = s.carry(
            rows, {"__f": F.min("__anchor"), "__l": F.max("__anchor")}, across, ["__a_in", "__b_in"]
        )
        before = F.coalesce(before, F.col("__a_in"))
        after = F.coalesce(after, F.col("__b_in"))
    rows = rows.withColumns({"__a": before, "__b": after})
    inside = ~F.coalesce(F.col(known), F.lit(False)) & F.col("__a").isNotNull() & F.col(
        "__b"
    ).isNotNull()
    k = F.col("__i") - F.col("__a.i")
    width = F.col("__b.i") - F.col("__a.i")
    placed = {
        c: F.when(
            inside, F.col(f"__a.{c}") + (F.col(f"__b.{c}") - F.col(f"__a.{c}")) * k / width
        ).otherwise(F.col(c))
        for c in cols
    }
    # All new values are computed before any column is replaced: anchors hold the old ones.
    return s.done(
        rows.withColumns(placed), "__i", "__a", "__b", "__anchor", "__a_in", "__b_in"
    )
