"""Nested snapshot documents: reading, flattening with an error policy, and writing them back.

A document is one text value: one whole file of an archive or landing folder, or a payload column of
any DataFrame, batch or streaming. Flattening is expressions only, so it needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox import schemas
from signalbox.functions.calendar import stamp_to_timestamp, timestamp_to_stamp

FILE = "source_file"


class Flattened(NamedTuple):
    """Good rows, and what was refused with the reason. Both are lazy; unused ones cost nothing."""

    rows: DataFrame
    rejected: DataFrame


# ---- scans -----------------------------------------------------------------------------------


def read_archive(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Every file below ``path`` that matches, one document per row, with its path as tiebreaker."""
    return (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(path)
        .select("value", F.col("_metadata.file_path").alias(FILE))
    )


def read_between(
    spark: SparkSession, path: str, pattern: str, since: str | None = None, until: str | None = None, folder: str = "date"
) -> DataFrame:
    """The documents of an archive whose ``folder`` (``date=2024-01-31``, say) lies in a range, both ends included.

    The folders are partitions, so those outside the range are neither listed for reading nor opened; folders below
    them become columns too. Values are compared as texts, which for dates and zero-padded hours is their order.
    """
    # Declared as a text, a folder's value isn't taken for a number.
    reader = spark.read.schema(f"value string, `{folder}` string").option("wholetext", True)
    docs = reader.option("pathGlobFilter", pattern).option("basePath", path).text(path)
    value = F.col(folder)
    if since is not None:
        docs = docs.where(value >= since)
    if until is not None:
        docs = docs.where(value <= until)
    return docs.select("value", *[c for c in docs.columns if c != "value"], F.col("_metadata.file_path").alias(FILE))


def read_modified(spark: SparkSession, path: str, pattern: str, after: str | None = None, before: str | None = None) -> DataFrame:
    """The documents of an archive of any layout that were written in a range of time (``2024-01-31T08:00:00``).

    Files outside it are listed, but not opened.
    """
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    reader = reader if after is None else reader.option("modifiedAfter", after)
    reader = reader if before is None else reader.option("modifiedBefore", before)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias(FILE))


def stream_landing(
    spark: SparkSession, path: str, pattern: str, files_per_trigger: int | None = None
) -> DataFrame:
    """The same documents as a stream over a landing folder."""
    reader = spark.readStream.option("wholetext", True).option("pathGlobFilter", pattern)
    reader = reader.option("recursiveFileLookup", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias(FILE))


def read_newest(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Only the most recently written document below ``path``; listing does not open the other files."""
    newest = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
        .agg(F.max_by("path", F.struct("modificationTime", "path")))
        .first()[0]
    )
    if newest is None:
        return spark.createDataFrame([], f"value string, {FILE} string")
    return read_archive(spark, newest, pattern)


# ---- road: XML -------------------------------------------------------------------------------


def _number(text: Column, kind: str) -> Column:
    """A number, or null. Java's type suffixes ("1.5d") do not make a number."""
    return F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text.try_cast(kind))


def flatten_road_xml(
    df: DataFrame, payload: str = "value", on_error: str = "row", keep: Sequence[str] = ()
) -> Flattened:
    """One row per valid segment: date, time, segment_id, speed, plus the ``keep`` columns.

    A segment counts if it has all three children and ``valid`` is exactly ``Y``; only then are its
    numbers read. ``on_error='row'`` refuses a segment with a bad number, ``'document'`` refuses its
    whole document. The root element's name does not matter.
    """
    _check_policy(on_error)
    schema = f"{schemas.ROAD_SNAPSHOT}, _corrupt string"
    options = {"columnNameOfCorruptRecord": "_corrupt", "ignoreSurroundingSpaces": "false"}
    docs = df.withColumn("__d", F.from_xml(payload, schema, options))

    def candidate(s: Column) -> Column:
        return s["segment_id"].isNotNull() & s["speed"].isNotNull() & (s["valid"] == "Y")

    def bad(s: Column) -> Column:
        return (
            _number(s["segment_id"], "bigint").isNull() | _number(s["speed"], "double").isNull()
        )

    docs = docs.withColumn(
        "__s", F.filter("__d.segments.segment", lambda s: F.coalesce(candidate(s), F.lit(False)))
    )
    refused = (
        F.when(F.col("__d").isNull() | F.col("__d._corrupt").isNotNull(), "unreadable document")
        .when(F.col("__d.date").isNull() | F.col("__d.time").isNull(), "no date or time")
        .when(F.col("__d.segments").isNull(), "no segments")
    )
    if on_error == "document":
        refused = refused.when(F.exists("__s", bad), "bad number in a valid segment")
    docs = docs.withColumns({"__why": refused, "__date": F.col("__d.date"), "__time": F.col("__d.time")})
    rows = _entries(docs, keep, "__date", "__time", good=lambda s: ~bad(s)).select(
        *keep,
        F.col("__date").alias("date"),
        F.col("__time").alias("time"),
        _number(F.col("__e.segment_id"), "bigint").alias("segment_id"),
        _number(F.col("__e.speed"), "double").alias("speed"),
    )
    bad_entries = F.transform(F.filter("__s", bad), lambda e: F.struct(F.lit("bad number").alias("why"), e.alias("e")))
    return Flattened(rows, _rejected(docs, keep, payload, bad_entries))


def _entries(docs: DataFrame, keep: Sequence[str], *extra: str, good=None) -> DataFrame:
    """One row per good element of the array ``__s`` of an accepted document, with the ``extra`` columns.

    The explode copies the columns beside it into every row, so what it is given has to be small: a column of its own
    for each value of the document, never the parsed document or a field of it, which would bring the whole along.
    The array decides what leaves. A filter on the reason would be pushed below the explode and parse every
    document a second time.
    """
    found = F.col("__s") if good is None else F.filter("__s", good)
    return docs.select(*keep, *extra, F.explode(F.when(F.col("__why").isNull(), found)).alias("__e"))


def _rejected(docs: DataFrame, keep: Sequence[str], payload: str, bad: Column | None = None) -> DataFrame:
    """One row per bad element of an accepted document, and exactly one (without element) for a refused document."""
    refused = F.array(F.struct(F.col("__why").alias("why"), F.get("__s", F.lit(-1)).alias("e")))
    cols = [*keep, *[c for c in (payload,) if c not in keep]]
    found = F.when(F.col("__why").isNotNull(), refused)
    found = found if bad is None else found.otherwise(bad)
    return docs.select(*cols, F.explode(found).alias("__x")).select(
        *cols, F.col("__x.why").alias("reason"), F.to_json("__x.e").alias("entry")
    )


def _check_policy(on_error: str) -> None:
    if on_error not in ("row", "document"):
        raise ValueError(f"on_error must be 'row' or 'document', not {on_error!r}")


# ---- rail: JSON ------------------------------------------------------------------------------


def flatten_rail_json(
    df: DataFrame,
    payload: str = "value",
    missing: str = "null",
    on_error: str = "row",
    keep_empty: bool = True,
    keep_unstamped: bool = False,
    keep: Sequence[str] = (),
) -> Flattened:
    """One row per (line, station): timestamp, line, sta, isdelay, first arrivals, trains on the boards.

    ``missing='null'`` leaves an absent or unreadable arrival null so that it can be filled forward;
    ``'zero'`` makes it 0.0. A first train without a ``ttnt`` field counts as 0.0 either way.
    ``on_error='document'`` refuses a whole document if any first train lacks a readable ``ttnt``.
    ``keep_empty=False`` skips stations without a payload or without a ``data`` field.
    ``keep_unstamped`` keeps documents whose capture stamp is unreadable, with a null timestamp.
    """
    _check_policy(on_error)
    if missing not in ("null", "zero"):
        raise ValueError(f"missing must be 'null' or 'zero', not {missing!r}")
    schema = f"{schemas.RAIL_SNAPSHOT}, _corrupt string"
    options = {"columnNameOfCorruptRecord": "_corrupt"}
    docs = df.withColumn("__d", F.from_json(payload, schema, options))
    stations = F.flatten(
        F.transform(
            F.map_entries("__d.data"),
            lambda line: F.transform(
                F.map_entries(line["value"]),
                lambda sta: F.struct(
                    line["key"].alias("line"), sta["key"].alias("sta"), sta["value"].alias("info")
                ),
            ),
        )
    )

    def first_train(s: Column, direction: str) -> Column:
        board = s["info"]["data"][F.concat_ws("-", s["line"], s["sta"])]
        return F.get(board[direction], F.lit(0))

    def arrival(s: Column, direction: str) -> Column:
        train = first_train(s, direction)
        listed = F.when(
            train.isNotNull() & ~F.map_contains_key(train, "ttnt"), F.lit(0.0)
        ).otherwise(_number(train["ttnt"], "double"))
        return listed if missing == "null" else F.coalesce(listed, F.lit(0.0))

    def unreadable(s: Column, direction: str) -> Column:
        train = first_train(s, direction)
        return train.isNotNull() & _number(train["ttnt"], "double").isNull()

    def present(s: Column) -> Column:
        return s["info"].isNotNull() & (F.lit(keep_empty) | s["info"]["data"].isNotNull())

    docs = docs.withColumn("__s", F.filter(stations, present))
    stamp = stamp_to_timestamp("__d.collected_at")
    refused = F.when(
        F.col("__d").isNull() | F.col("__d._corrupt").isNotNull(), "unreadable document"
    )
    if not keep_unstamped:
        refused = refused.when(F.coalesce(F.col("__d.collected_at"), F.lit("")) == "", "no stamp")
        refused = refused.when(stamp.isNull(), "unreadable stamp")
    if on_error == "document":
        strict = F.exists("__s", lambda s: unreadable(s, "UP") | unreadable(s, "DOWN"))
        refused = refused.when(strict, "first train without a readable ttnt")
    docs = docs.withColumns({"__why": refused, "__stamp": stamp})
    e = F.col("__e")
    board = e["info"]["data"][F.concat_ws("-", e["line"], e["sta"])]
    waiting = [F.coalesce(F.array_size(board[d]), F.lit(0)) for d in ("UP", "DOWN")]
    rows = _entries(docs, keep, "__stamp").select(
        *keep,
        F.col("__stamp").alias("timestamp"),
        e["line"].alias("line"),
        e["sta"].alias("sta"),
        (F.coalesce(e["info"]["isdelay"], F.lit("N")) == "Y").cast("int").alias("isdelay"),
        arrival(e, "UP").alias("up_ttnt_1"),
        arrival(e, "DOWN").alias("down_ttnt_1"),
        (waiting[0] + waiting[1]).alias("trains_listed"),
    )
    return Flattened(rows, _rejected(docs, keep, payload))


# ---- writing documents -----------------------------------------------------------------------


def nest_rail_json(
    df: DataFrame,
    ts: str,
    line: str,
    sta: str,
    payload: str,
    order: Sequence[str] = (),
) -> DataFrame:
    """Assembles station payloads (a struct column) into one nested document per capture second.

    If a station occurs twice in a second, the later payload stays: by ``ts``, then the ``order`` columns, then
    the payload's text.
    """
    # The text is the last thing compared, so the greatest struct holds it; the columns before it have names of their own.
    later = F.struct(F.col(ts).alias("__t"), *[F.col(o).alias(f"__{i}") for i, o in enumerate(order)], F.to_json(payload).alias("__j"))
    keys = df.select(timestamp_to_stamp(ts).alias("collected_at"), line, sta, later.alias("__o"))
    once = keys.groupBy("collected_at", line, sta).agg(F.max("__o")["__j"].alias("__j"))
    lines = once.groupBy("collected_at", line).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(sta), F.col("__j"))))).alias("stas")
    )
    return lines.groupBy("collected_at").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(line), _object("stas"))))).alias("d")
    ).select(
        "collected_at",
        F.concat(
            F.lit('{"collected_at":"'), F.col("collected_at"), F.lit('","data":'), _object("d"), F.lit("}")
        ).alias("value"),
    )


def _object(column: str) -> Column:
    """JSON object text from a map of names to JSON texts."""
    fields = F.transform(
        F.map_entries(column),
        # to_json of a one-field array quotes and escapes the name; the quotes end the trimming
        lambda e: F.concat(F.btrim(F.to_json(F.array(e["key"])), F.lit("[]")), F.lit(":"), e["value"]),
    )
    return F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))


def nest_road_xml(
    df: DataFrame,
    date: str,
    time: str,
    segment: str,
    speed: str,
    valid: str,
) -> DataFrame:
    """Road rows as XML snapshot documents, one per (date, time)."""

    def tag(name: str, value: Column) -> Column:
        escaped = F.replace(
            F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")
        )
        return F.concat(F.lit(f"<{name}>"), escaped, F.lit(f"</{name}>"))

    element = F.concat(
        F.lit("<segment>"),
        *[
            F.coalesce(tag(name, F.col(c).cast("string")), F.lit(""))
            for name, c in (("segment_id", segment), ("speed", speed), ("valid", valid))
        ],
        F.lit("</segment>"),
    )
    return (
        df.groupBy(date, time)
        .agg(F.array_join(F.array_sort(F.collect_list(element)), "").alias("__s"))
        .select(
            date,
            time,
            F.concat(
                F.lit("<snapshot>"),
                tag("date", F.col(date)),
                tag("time", F.col(time)),
                F.lit("<segments>"),
                F.col("__s"),
                F.lit("</segments></snapshot>"),
            ).alias("value"),
        )
    )
