"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a Python task holds as separate strings at a time.
SLICE_BYTES = 4 << 20

Kept = TypeVar("Kept")
#: What a Python worker keeps between tasks: what one operator learnt, until the worker runs another operator.
_kept: dict[Hashable, object] = {}


def keep(key: Hashable, make: Callable[[], Kept]) -> Kept:
    """What this worker made for ``key`` in an earlier task, or makes now; what it kept for another key goes before."""
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go(but: Hashable = None) -> None:
    """Forgets what the worker keeps, except for the key ``but``: the memory is the next operator's."""
    for key in [k for k in _kept if k != but]:
        del _kept[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(name: str) -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def hex_digest(column: Column) -> Column:
    """Lowercase SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(column.cast("binary"), 256)


def keep_others(df: DataFrame, names: list[str]) -> list[Column]:
    """The input's columns, without those that an operator is about to add (names compare as Spark's do)."""
    new = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in new]


def own_prefix(df: DataFrame) -> str:
    """A beginning for helper names that no column of the table has (names compare as Spark's do)."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def slices(batch: pa.RecordBatch, column: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``most`` bytes of text (SLICE_BYTES); a longer row is a run of its own."""
    most = most or SLICE_BYTES
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, text: str, fields: str, work: Callable[[], Callable[[list[str]], list]], keeps: Hashable = None, slice_bytes: int | None = None) -> DataFrame:
    """Adds the columns of ``fields`` (a DDL string), computed from whole texts, one Arrow batch at a time.

    ``work()`` runs once per task and returns a function from texts (null: empty) to one list or Arrow array
    for each field. New columns replace input columns of the same name; rows are neither moved nor reordered.
    ``keeps`` is the key of what ``work`` keeps between tasks; a worker lets go of anything else.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    added = T._parse_datatype_string(fields)
    names = {f.name.lower() for f in added.fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = T.StructType(kept + added.fields)
    arrow = to_arrow_schema(schema)
    kept_names, source = [f.name for f in kept], own_prefix(df) + "text"
    wide = df.select(*[F.col(f"`{n}`") for n in kept_names], body(text).alias(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keeps)
        step = work()
        for batch in batches:
            for part in slices(batch, source, slice_bytes):
                made = step(part.column(source).to_pylist())
                columns = [part.column(i) for i in range(len(kept_names))]
                new = list(arrow)[len(kept_names) :]
                columns += [pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(made, new, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return wide.mapInArrow(run, schema)
