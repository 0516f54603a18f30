"""Delay events, recent histories and repeated rows of a stream, in the engine's own keyed state.

Keys are dealt over a fixed number of buckets, and the state is a bucket's: one call of Python works on all rows of its
keys at once, since a call for every key, or every (key, time), takes far longer than its rows. ``buckets`` belongs to the
checkpoint, like the number of shuffle partitions. A bucket's rows of a batch and of the lateness are held by one task, so a
stream with more of them takes more buckets.

Rows wait in their bucket's state until the watermark has passed them, so they may arrive out of order within the allowed
lateness; timers on event time wake a bucket when that happens. What comes later than the watermark would be
dropped by the engine before any operator sees it. So the watermark is drawn from a second row for every row, which
ends there, while the row itself carries no event time that the engine knows; the operator compares it with the
watermark and passes it on as late. Every row delivered leaves as what it is.

A stream ends like any other time passes: ``closing`` gives a row of a time far beyond all others, upon which all
waiting rows are ready and all open events closed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from signalbox.functions.calendar import MICROS_PER_MINUTE, minutes_between
from signalbox.operators.events import MIN_EVENT_MINUTES, MINUTES_PER_TRAIN, affected_trains

LATENESS = "10 minutes"
#: The end of all streams, in milliseconds: 9000-01-01.
END = 221_845_392_000_000
_STATE = "waiting binary, open binary"
#: Groups of keys that share a state.
BUCKETS = 128
#: Rows that are looked up at a time.
CHUNK = 50_000
_BUCKET, _UNKNOWN = "__bucket", "__unknown_"
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def closing(spark: SparkSession, schema: T.StructType, order: str) -> DataFrame:
    """A row that ends the stream: nothing but a time beyond all others."""
    return spark.range(1).select(*[(F.lit("9999-01-01 00:00:00") if f.name == order else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _clocked(rows: DataFrame, order: str, lateness: str) -> DataFrame:
    """The rows with ``at`` in microseconds, behind a watermark that none of them is dropped by."""
    time = F.col(order).cast("timestamp")
    timed = rows.withColumn("at", F.unix_micros(time)).where("at is not null")
    both = timed.withColumn("clock", F.explode(F.array(time, F.lit(None).cast("timestamp"))))
    return both.withWatermark("clock", lateness).where("clock is null")


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes | None) -> pd.DataFrame | None:
    return None if not data else pa.ipc.open_stream(data).read_pandas()


def _joined(frames: list[pd.DataFrame]) -> pd.DataFrame:
    frames = [f for f in frames if f is not None and len(f)]
    return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame()


def _wake(state: GroupState, moments: list[float]) -> None:
    """Sets the timer to the earliest of the moments (microseconds) that the watermark hasn't passed."""
    ahead = [int(m // 1000) + 1 for m in moments]
    wanted = min((m for m in ahead if m > state.getCurrentWatermarkMs()), default=None)
    if wanted is not None:
        state.setTimeoutTimestamp(wanted)


def _bucketed(rows: DataFrame, by: Sequence[str], buckets: int) -> DataFrame:
    return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))


def _numbers(schema: T.StructType, names: Sequence[str]) -> list[str]:
    return [n for n in names if isinstance(schema[n].dataType, _NUMBERS)]


def _unknown(schema: T.StructType, names: Sequence[str]) -> list[str]:
    """The flags of the numbers among the columns: pandas has no null for them, and would make long ones inexact."""
    return [_UNKNOWN + n for n in _numbers(schema, names)]


def _flagged(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Numbers without nulls, next to flags that say where they were."""
    numbers = _numbers(rows.schema, names)
    zero = {n: F.coalesce(n, F.lit(0).cast(rows.schema[n].dataType)) for n in numbers}
    return rows.withColumns({_UNKNOWN + n: F.col(n).isNull() for n in numbers}).withColumns(zero)


def _unflagged(schema: T.StructType, name: str) -> Column:
    """A column as it was before ``_flagged``."""
    if not _numbers(schema, [name]):
        return F.col(name)
    value = F.col(name)
    if isinstance(schema[name].dataType, (T.FloatType, T.DoubleType)):  # on the way back NaN has become null
        value = F.coalesce(value, F.lit(float("nan")).cast(schema[name].dataType))
    return F.when(~F.col(_UNKNOWN + name), value).alias(name)


def _flags(names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, T.BooleanType()) for n in names]


def _codes(rows: pd.DataFrame, by: Sequence[str]) -> np.ndarray:
    """A number for each distinct key."""
    return rows.groupby(list(by), dropna=False, sort=False).ngroup().to_numpy()


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a bucket, about CHUNK of them at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= CHUNK:
            yield _joined(held)
            held, size = [], 0
    if size:
        yield _joined(held)


class _Events:
    """The events of a bucket's keys: waiting rows, and for a key its open event as a row with start, end and row count."""

    def __init__(self, keys: Sequence[str], flag: str, tie: str, unknown_tie: str | None, features: Sequence[str], pause: float | None) -> None:
        self.keys, self.flag, self.tie, self.unknown_tie, self.features, self.pause = list(keys), flag, tie, unknown_tie, list(features), pause

    def step(self, waiting: pd.DataFrame, opened: pd.DataFrame | None, mark: float, ended: bool) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame | None]:
        """Closed events, rows that still wait, and the open events, once the watermark is at ``mark``."""
        columns = list(dict.fromkeys([*self.keys, *self.features, "start", "end", "count"]))
        frames = []
        if opened is not None and len(opened):
            frames.append(opened.assign(__later=False, __hit=True, __known=False, __tie=None))
        if len(waiting):
            ready = waiting[waiting["at"] <= mark]
            waiting = waiting[waiting["at"] > mark]
            known = ready[self.tie].notna() if self.unknown_tie is None else ~ready[self.unknown_tie]
            # Nulls first, as in the batch operator's order.
            ready = ready.assign(__later=True, __hit=ready[self.flag] == 1, __known=known, start=ready["at"], end=ready["at"], count=1)
            ready = ready.sort_values(["at", "__known", self.tie], kind="stable")
            frames.append(ready[[*columns, "__later", "__hit"]])
        frames = [f[[*columns, "__later", "__hit"]] for f in frames if len(f)]
        if not frames:
            return pd.DataFrame(), waiting, None
        rows = pd.concat(frames, ignore_index=True)
        code = _codes(rows, self.keys)
        order = np.argsort(code, kind="stable")  # a key's open event, then its rows in order
        rows, code = rows.iloc[order], code[order]
        hit, at, end = rows["__hit"].to_numpy(bool), rows["start"].to_numpy(), rows["end"].to_numpy()
        changed = code[1:] != code[:-1]
        begins = np.r_[True, changed | ~hit[:-1]]
        if self.pause is not None:
            begins |= np.r_[True, at[1:] - end[:-1] > self.pause]
        of_key = np.r_[changed, True][hit]  # whether a flagged row is the last of its key
        heads = np.flatnonzero(begins[hit])
        if not len(heads):
            return pd.DataFrame(), waiting, None
        hits = rows[hit]
        tails = np.r_[heads[1:], len(hits)] - 1
        events = hits.iloc[heads][columns].assign(end=hits["end"].to_numpy()[tails], count=np.add.reduceat(hits["count"].to_numpy(), heads))
        going = of_key[tails] & (not ended)
        if self.pause is not None:
            going &= events["end"].to_numpy() + self.pause >= mark
        return events[~going], waiting, events[going] if going.any() else None


def event_stream(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str,
    flag: str,
    features: Sequence[str],
    lateness: str = LATENESS,
    timeout_minutes: float | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The same events as the batch operator, whatever the micro-batches; and the rows that came too late.

    ``kind`` is ``event`` or ``late``. An event is opened by the first flagged row, and closed by a calm row, by a pause
    of more than ``timeout_minutes``, or by the end of the stream. A late row has its own time and features, and
    null for what only events have. A bucket keeps state only while rows wait or an event is open.
    """
    keys, features = list(keys), [f for f in features if f != order]
    clocked = _clocked(rows, order, lateness)
    plain = clocked.select(*dict.fromkeys([*keys, "at", tie, flag, *features, "clock"]))
    named = [c for c in plain.columns if c not in ("at", "clock")]
    needed = _flagged(_bucketed(plain, keys, buckets), named)
    kept = [c for c in needed.columns if c not in ("clock", _BUCKET)]
    pause = None if timeout_minutes is None else timeout_minutes * MICROS_PER_MINUTE
    shown = list(dict.fromkeys([*keys, *features]))
    unknown = _unknown(rows.schema, shown)
    fields = [T.StructField("kind", T.StringType()), T.StructField("at", T.LongType()), *[rows.schema[c] for c in shown], *_flags(unknown)]
    out = T.StructType([*fields, T.StructField("end", T.LongType()), T.StructField("row_count", T.LongType())])
    by = [*keys, *_unknown(rows.schema, keys)]
    work = _Events(by, flag, tie, next(iter(_unknown(rows.schema, [tie])), None), [c for c in (*shown, *unknown) if c not in by], pause)

    def made(frame: pd.DataFrame, kind: str) -> pd.DataFrame:
        return frame.assign(kind=kind)[out.names].astype({"at": "int64", "end": "int64", "row_count": "int64"})

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        mark = now * 1000.0
        waiting, opened = (_unpacked(s) for s in state.get) if state.exists else (None, None)
        new = [waiting]
        if not state.hasTimedOut:
            for batch in batches:
                late = batch.loc[batch["at"] <= mark, kept]
                if len(late):
                    yield made(late.assign(end=late["at"], row_count=0), "late")
                new.append(batch.loc[batch["at"] > mark, kept])
        done, waiting, opened = work.step(_joined(new), opened, mark, now >= END)
        if len(waiting) or opened is not None:
            state.update((_packed(waiting) if len(waiting) else b"", _packed(opened) if opened is not None else b""))
            moments = [END * 1000.0 - 1000.0] + ([waiting["at"].min()] if len(waiting) else [])
            if opened is not None and pause is not None:
                moments.append(opened["end"].min() + pause)
            _wake(state, moments)
        elif state.exists:
            state.remove()
        if len(done):
            yield made(done.rename(columns={"start": "at", "count": "row_count"}), "event")

    found = needed.groupBy(_BUCKET).applyInPandasWithState(advance, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    kind = rows.schema[order].dataType
    started, ended = (F.timestamp_micros(c).cast(kind) for c in ("at", "end"))
    of_event = lambda c: F.when(F.col("kind") == "event", c)
    duration = of_event(F.greatest(F.lit(MIN_EVENT_MINUTES), minutes_between(F.timestamp_micros("at"), F.timestamp_micros("end"))))
    return found.withColumn("delay_duration_minutes", duration).select(
        "kind", *[_unflagged(rows.schema, k) for k in keys], started.alias(order), *[_unflagged(rows.schema, f) for f in features], "delay_duration_minutes",
        of_event(affected_trains(F.col("delay_duration_minutes"), MINUTES_PER_TRAIN)).alias("affected_trains_count"),
        of_event(ended).alias("end_time"), of_event(F.col("row_count")).alias("row_count"),
    )


def sorted_out(rows: DataFrame, keys: Sequence[str], order: str, lateness: str = LATENESS, buckets: int = BUCKETS) -> DataFrame:
    """Every row with its ``status``: unique, repeated (keys and time were seen before) or late (beyond the watermark).

    Nothing is dropped. A (keys, time) is remembered until the watermark passes it; what comes after that is late, so
    no two rows of one (keys, time) are unique. The times of a key lie in different buckets.
    """
    keys = list(keys)
    clocked = _clocked(rows, order, lateness)
    names = [f.name for f in clocked.schema if f.name not in ("clock", "at", *keys)]
    schema = clocked.schema
    needed = _flagged(_bucketed(clocked, [*keys, "at"], buckets), [*keys, *names])
    by = [*keys, *_unknown(schema, keys), "at"]
    values = [*names, *_unknown(schema, names)]
    fields = [*[schema[c] for c in (*keys, *names)], *_flags(_unknown(schema, [*keys, *names])), T.StructField("at", T.LongType())]
    out = T.StructType([*fields, T.StructField("status", T.StringType())])

    def mark(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() * 1000
        seen = _unpacked(state.get[0]) if state.exists else pd.DataFrame()
        if len(seen):
            seen = seen[seen["at"] > now]
        for rows in () if state.hasTimedOut else _pieces(batches):
            status = np.where(rows["at"] <= now, "late", "repeated").astype(object)
            timely = rows[by].iloc[np.flatnonzero(rows["at"] > now)]
            both = _joined([seen, timely])
            code = _codes(both, by) if len(both) else np.empty(0, np.int64)
            old, fresh = code[: len(seen)], code[len(seen) :]
            place = np.flatnonzero((rows["at"] > now).to_numpy())
            new = ~np.isin(fresh, old)
            place, fresh = place[new], fresh[new]
            # Of equal rows in one batch any is the first; by the order of their values it is always the same one.
            often = np.bincount(fresh)[fresh] > 1 if len(fresh) else np.empty(0, bool)
            rank = np.zeros(len(fresh), np.int64)
            if names and often.any():
                text = rows.iloc[place[often]][values].astype(str).agg("\x00".join, axis=1).to_numpy(object)
                rank[often] = np.unique(text, return_inverse=True)[1]
            ordered = np.lexsort((rank, fresh))
            first = ordered[np.r_[True, np.diff(fresh[ordered]) != 0]] if len(fresh) else ordered
            status[place[first]] = "unique"
            seen = _joined([seen, rows[by].iloc[place[first]]])
            yield rows.assign(status=status)[out.names]
        if len(seen):
            state.update((_packed(seen),))
            _wake(state, [seen["at"].max()])
        elif state.exists:
            state.remove()

    found = needed.groupBy(_BUCKET).applyInPandasWithState(mark, out, "seen binary", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(*[_unflagged(schema, c) for c in (*keys, *names)], "status")


def recent_rows(rows: DataFrame, keys: Sequence[str], order: str, tie: str, features: Sequence[str], length: int, buckets: int = BUCKETS) -> DataFrame:
    """The last ``length`` rows of every key that a batch changed: keys, newest, place (from 0, oldest first) and features,
    filled up at the beginning with copies of the oldest. A stream of updates; a key's later ones replace the earlier."""
    keys, features = list(keys), list(features)
    timed = rows.withColumn("at", F.unix_micros(F.col(order).cast("timestamp")))
    plain = timed.select(*dict.fromkeys([*keys, "at", tie, *features]))
    schema = plain.schema
    needed = _flagged(_bucketed(plain, keys, buckets), plain.columns)
    kept = [c for c in needed.columns if c != _BUCKET]
    by, shown = [*keys, *_unknown(schema, keys)], list(dict.fromkeys([*keys, *features]))
    unknown = _unknown(schema, shown)
    out = T.StructType([
        *[schema[c] for c in shown], *_flags(unknown), T.StructField("newest", T.LongType()), T.StructField("place", T.IntegerType()),
        T.StructField(f"{_UNKNOWN}newest", T.BooleanType()),
    ])
    unknown_tie = next(iter(_unknown(schema, [tie])), None)

    def last(held: pd.DataFrame) -> pd.DataFrame:
        """A bucket's last rows of each key, in order; nulls are the oldest, as in the batch operator's order."""
        known = held[tie].notna() if unknown_tie is None else ~held[unknown_tie]
        held = held.assign(__timed=~held[f"{_UNKNOWN}at"], __known=known).sort_values(["__timed", "at", "__known", tie], kind="stable")
        return held.groupby(by, dropna=False, sort=False).tail(length)[kept]

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, touched = _unpacked(state.get[0]) if state.exists else None, []
        for rows in _pieces(batches):  # no more than one chunk beyond the rows that stay
            touched = [_joined([*touched, rows[by]]).drop_duplicates()]
            held = last(_joined([held, rows[kept]]))
        if not touched:
            return
        state.update((_packed(held),))
        code = _codes(_joined([held[by], *touched]), by)
        changed, code = np.isin(code[: len(held)], code[len(held) :]), code[: len(held)]
        order = np.argsort(code, kind="stable")
        order = order[changed[order]]
        rows, code = held.iloc[order], code[order]
        heads = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        sizes = np.diff(np.r_[heads, len(code)])
        copies = np.ones(len(code), np.int64)
        copies[heads] += length - sizes
        frame = rows.iloc[np.repeat(np.arange(len(rows)), copies)].assign(place=np.tile(np.arange(length, dtype=np.int32), len(heads)))
        newest = rows.iloc[heads + sizes - 1]
        for name, source in (("newest", "at"), (f"{_UNKNOWN}newest", f"{_UNKNOWN}at")):
            frame[name] = np.repeat(newest[source].to_numpy(), length)
        yield frame[out.names]

    found = needed.groupBy(_BUCKET).applyInPandasWithState(advance, out, "rows binary", "update", GroupStateTimeout.NoTimeout)
    newest = F.when(~F.col(f"{_UNKNOWN}newest"), F.timestamp_micros("newest").cast(rows.schema[order].dataType)).alias("newest")
    return found.select(*[_unflagged(schema, k) for k in keys], newest, "place", *[_unflagged(schema, f) for f in features])
