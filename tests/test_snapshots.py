"""Document parsing: every kind of good and bad document, both error policies, round trips, files."""

import json
import os
import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from signalbox.sources import sinks, snapshots, tables

SEG = "<segment><segment_id>{}</segment_id><speed>{}</speed><valid>{}</valid></segment>"


def road(*segments, head="<date>2024-01-02</date><time>08:00:00</time>"):
    return f"<any>{head}<segments>{''.join(segments)}</segments></any>"


ROAD = {
    "normal": road(SEG.format(1, 25.5, "Y"), SEG.format(2, "x", "N"), SEG.format(3, 40, "Y")),
    "bad": road(SEG.format(4, "fast", "Y"), SEG.format(5, 31.25, "Y")),
    "suffix": road(SEG.format(15, "1.5d", "Y")),
    "empty": road("<segment><segment_id>6</segment_id><speed/><valid>Y</valid></segment>", SEG.format(7, 1, "Y")),
    "child": road("<segment><segment_id>8</segment_id><valid>Y</valid></segment>", SEG.format(9, 2, "Y")),
    "spaced": road(SEG.format(" 10 ", " 3.5 ", "Y"), SEG.format(11, 1, " Y")),
    "single": road(SEG.format(12, 4, "Y")),
    "undated": road(SEG.format(13, 4, "Y"), head="<time>08:00:00</time>"),
    "none": "<any><date>2024-01-02</date><time>08:00:00</time></any>",
    "broken": road(SEG.format(14, 5, "Y"))[:-20],
    "blank": "",
}


@pytest.fixture(scope="module")
def road_docs(spark):
    return spark.createDataFrame(list(ROAD.items()), "name string, value string")


def ids(flat):
    return sorted(r["segment_id"] for r in flat.rows.collect())


def test_road_row_policy(road_docs):
    flat = snapshots.flatten_road_xml(road_docs, keep=["name"])
    assert ids(flat) == [1, 3, 5, 7, 9, 10, 12]
    first = flat.rows.where("segment_id = 10").first()
    assert (first["date"], first["time"], first["speed"]) == ("2024-01-02", "08:00:00", 3.5)
    why = {(r["name"], r["reason"]) for r in flat.rejected.collect()}
    assert why == {
        ("bad", "bad number"), ("suffix", "bad number"), ("empty", "bad number"),
        ("undated", "no date or time"), ("none", "no segments"),
        ("broken", "unreadable document"), ("blank", "unreadable document"),
    }


def test_road_document_policy(road_docs):
    flat = snapshots.flatten_road_xml(road_docs, on_error="document", keep=["name"])
    assert ids(flat) == [1, 3, 9, 10, 12]
    assert flat.rejected.where("name = 'bad'").count() == 1
    with pytest.raises(ValueError):
        snapshots.flatten_road_xml(road_docs, on_error="never")


def rail(data, stamp="20240102_080000"):
    return json.dumps({"collected_at": stamp, "data": data})


RAIL = {
    "both": rail({"T": {"A": {"isdelay": "Y", "data": {"T-A": {"UP": [{"ttnt": "3"}, {"ttnt": "9"}], "DOWN": [{"ttnt": 4}]}}}}}),
    "empty": rail({"T": {"B": {"isdelay": "N", "data": {"T-B": {"UP": [], "DOWN": [{"ttnt": "2"}]}}}}}),
    "nodata": rail({"T": {"C": {"isdelay": "Y"}}}),
    "noflag": rail({"T": {"D": {"data": {"T-D": {}}}}}),
    "nottnt": rail({"T": {"E": {"data": {"T-E": {"UP": [{"dest": "X"}], "DOWN": []}}}, "F": {"data": {}}}}),
    "words": rail({"T": {"G": {"data": {"T-G": {"UP": [{"ttnt": "soon"}]}}}}}),
    "stamp": rail({"T": {"H": {}}}, "yesterday"),
    "unstamped": json.dumps({"data": {"T": {"I": {}}}}),
    "broken": '{"collected_at": "2024',
}


@pytest.fixture(scope="module")
def rail_docs(spark):
    return spark.createDataFrame(list(RAIL.items()), "name string, value string")


def boards(flat):
    return {r["sta"]: (r["isdelay"], r["up_ttnt_1"], r["down_ttnt_1"], r["trains_listed"]) for r in flat.rows.collect()}


def test_rail_nulls(rail_docs):
    flat = snapshots.flatten_rail_json(rail_docs, keep=["name"])
    assert boards(flat) == {
        "A": (1, 3.0, 4.0, 3), "B": (0, None, 2.0, 1), "C": (1, None, None, 0), "D": (0, None, None, 0),
        "E": (0, 0.0, None, 1), "F": (0, None, None, 0), "G": (0, None, None, 1),
    }
    assert flat.rows.first()["timestamp"] == datetime(2024, 1, 2, 8)
    assert {(r["name"], r["reason"]) for r in flat.rejected.collect()} == {
        ("stamp", "unreadable stamp"), ("unstamped", "no stamp"), ("broken", "unreadable document")
    }


def test_rail_zeros_and_live_policy(rail_docs):
    zero = boards(snapshots.flatten_rail_json(rail_docs, missing="zero"))
    assert zero["B"] == (0, 0.0, 2.0, 1) and zero["G"] == (0, 0.0, 0.0, 1)
    live = snapshots.flatten_rail_json(
        rail_docs, missing="zero", on_error="document", keep_empty=False, keep_unstamped=True
    )
    assert set(boards(live)) == {"A", "B", "D"}
    with pytest.raises(ValueError):
        snapshots.flatten_rail_json(rail_docs, missing="maybe")


@pytest.mark.parametrize("policy", ["row", "document"])
def test_documents_are_parsed_once(spark, policy):
    docs = spark.createDataFrame([("x",)], "value string")
    for flatten, call in (
        (snapshots.flatten_rail_json, ("from_json(", "JsonToStructsEvaluator(")),
        (snapshots.flatten_road_xml, ("from_xml(", "XmlToStructsEvaluator(")),
    ):
        for side in flatten(docs, on_error=policy):
            plan = side._jdf.queryExecution().executedPlan().toString()
            assert sum(plan.count(c) for c in call) == 1


@pytest.mark.parametrize("policy", ["row", "document"])
def test_rows_do_not_carry_their_document(spark, policy):
    docs = spark.createDataFrame([("x",)], "value string")
    for flatten, narrow in ((snapshots.flatten_rail_json, {"__stamp"}), (snapshots.flatten_road_xml, {"__date", "__time"})):
        plan = flatten(docs, on_error=policy).rows._jdf.queryExecution().executedPlan().toString()
        (beside,) = re.findall(r"Generate explode\(.*, \[([^\]]*)\], false, \[", plan)
        assert {re.sub(r"#.*", "", c.strip()) for c in beside.split(",")} == narrow


def test_rejected_entries_and_documents(road_docs):
    flat = snapshots.flatten_road_xml(road_docs, keep=["name"])
    got = {r["name"]: (r["value"], r["reason"], r["entry"] and json.loads(r["entry"])) for r in flat.rejected.collect()}
    assert flat.rejected.count() == len(got) == 7
    assert got["bad"] == (ROAD["bad"], "bad number", {"segment_id": "4", "speed": "fast", "valid": "Y"})
    assert got["broken"] == (ROAD["broken"], "unreadable document", None)


def test_names_with_separators(spark):
    names = ["a\u2028b", "[x]", 'say "]"', "\u0085"]
    df = spark.createDataFrame([(datetime(2024, 1, 2, 8), n, n + "s") for n in names], "ts timestamp, line string, sta string")
    docs = snapshots.nest_rail_json(df.withColumn("p", F.struct(F.lit("Y").alias("isdelay"))), "ts", "line", "sta", "p")
    rows = snapshots.flatten_rail_json(docs).rows.select("line", "sta", "isdelay").collect()
    assert sorted(map(tuple, rows)) == sorted((n, n + "s", 1) for n in names)


def test_rail_round_trip(spark):
    data = [
        (datetime(2024, 1, 2, 8, m), line, f'{line}"{i}', "Y" if i % 2 else "N", float(i))
        for m in range(3) for line in ("A", "B") for i in range(4)
    ]
    df = spark.createDataFrame(data, "ts timestamp, line string, sta string, isdelay string, up double")
    key = F.concat_ws("-", "line", "sta")
    train = F.create_map(F.lit("ttnt"), F.col("up").cast("string"))
    board = F.create_map(key, F.struct(F.array(train).alias("UP")))
    docs = snapshots.nest_rail_json(
        df.withColumn("p", F.struct("isdelay", board.alias("data"))), "ts", "line", "sta", "p"
    )
    assert docs.count() == 3
    back = snapshots.flatten_rail_json(docs).rows.select(
        "timestamp", "line", "sta", F.when(F.col("isdelay") == 1, "Y").otherwise("N"), "up_ttnt_1"
    )
    assert sorted(map(tuple, back.collect())) == sorted(data)


def test_later_payload_stays(spark):
    rows = [("2024-01-02 08:00:00.1", 1, "Y"), ("2024-01-02 08:00:00.1", 2, "N"), ("2024-01-02 08:00:00.0", 3, "Z")]
    df = spark.createDataFrame(rows, "t string, n int, isdelay string").selectExpr("cast(t as timestamp) ts", "n", "'L' line", "'S' sta", "struct(isdelay) p")
    (doc,) = snapshots.nest_rail_json(df, "ts", "line", "sta", "p", ["n"]).collect()
    assert json.loads(doc["value"])["data"] == {"L": {"S": {"isdelay": "N"}}}


def test_road_round_trip(spark):
    data = [("2024-01-02", f"08:0{m}:00", i, i / 4, "Y") for m in range(3) for i in range(5)]
    df = spark.createDataFrame(data, "date string, time string, segment_id long, speed double, valid string")
    docs = snapshots.nest_road_xml(df, "date", "time", "segment_id", "speed", "valid")
    assert docs.count() == 3
    rows = snapshots.flatten_road_xml(docs).rows
    assert sorted(map(tuple, rows.collect())) == sorted(r[:4] for r in data)


def test_archive_and_newest(spark, tmp_path):
    (tmp_path / "day1" / "deep").mkdir(parents=True)
    (tmp_path / "day1" / "a.xml").write_text(ROAD["normal"])
    (tmp_path / "day1" / "deep" / "b.xml").write_text(ROAD["single"])
    (tmp_path / "day1" / "c.txt").write_text(ROAD["child"])
    docs = snapshots.read_archive(spark, str(tmp_path), "*.xml")
    flat = snapshots.flatten_road_xml(docs, keep=[snapshots.FILE])
    assert ids(flat) == [1, 3, 12]
    assert {os.path.basename(r[0]) for r in flat.rows.select(snapshots.FILE).collect()} == {"a.xml", "b.xml"}

    for i, name in enumerate(["z.json", "a.json"]):
        (tmp_path / name).write_text(RAIL["both"] if i else RAIL["empty"])
        os.utime(tmp_path / name, (time.time() + i * 10,) * 2)
    newest = snapshots.read_newest(spark, str(tmp_path), "*.json")
    assert set(boards(snapshots.flatten_rail_json(newest))) == {"A"}
    assert snapshots.read_newest(spark, str(tmp_path / "day1"), "*.json").count() == 0


def test_dimension_sources(spark, tmp_path):
    (tmp_path / "stations.csv").write_bytes(
        b"name,x_projection,y_projection,x_real,y_real,color\r\nUpper End,1,2,3.5,4,red\r\n"
    )
    row = tables.read_station_pixels(spark, str(tmp_path / "stations.csv")).first()
    assert (row["name"], row["x_real"], row["color"]) == ("Upper End", 3.5, "red")
    (tmp_path / "paths.csv").write_text(
        "name,path,color,stroke_width,class,projection,reverseFirstPath,reverseSecondPath\n"
        'a,"M0,0L1,1",none,0,land,null,TRUE,FALSE\nb,"M0,0",none,0,land,M1 1,true,\n'
    )
    got = {r["name"]: (r["path"], r["projection"], r["reverseFirstPath"], r["reverseSecondPath"])
           for r in tables.read_paths(spark, str(tmp_path / "paths.csv")).collect()}
    assert got == {"a": ("M0,0L1,1", None, True, False), "b": ("M0,0", "M1 1", False, False)}
    dim = tables.line_stations(spark, {"Z": ["q", "p"], "A": ["p"]})
    assert sorted(map(tuple, dim.collect())) == [("A", 1, 0, "p"), ("Z", 0, 0, "q"), ("Z", 0, 1, "p")]


def test_geojson_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0])], "n string, c array<double>")
    point = df.select(sinks.feature_json(F.struct("n"), "Point", F.col("c")).alias("feature"))
    line = df.select(sinks.feature_json(F.struct("n"), "LineString", F.array("c", "c")).alias("feature"))
    both = point.unionByName(line)
    sinks.write_geojson_lines(both, str(tmp_path / "lines"))
    one = sinks.feature_collections(both)
    assert one.count() == 1 and json.loads(one.first()["value"])["type"] == "FeatureCollection"
    assert sinks.feature_collections(both.withColumn("k", F.monotonically_increasing_id()), by=["k"]).count() == 2
    one.select("value").write.text(str(tmp_path / "doc"))
    for table in (tables.read_geojson_lines(spark, str(tmp_path / "lines")), tables.read_geojson(spark, str(tmp_path / "doc"))):
        got = {r["geometry_type"]: (r["properties"], r["point"], r["line_string"]) for r in table.collect()}
        assert got == {"Point": ({"n": "a"}, [1.0, 2.0], None), "LineString": ({"n": "a"}, None, [[1.0, 2.0]] * 2)}


def test_write_series(spark, tmp_path):
    df = spark.createDataFrame([(k, datetime(2024, 1, 1 + d)) for k in range(3) for d in range(2)], "k int, ts timestamp")
    sinks.write_series(df, str(tmp_path / "t"), ["k"], "ts")
    assert sorted(p.name for p in (tmp_path / "t").glob("event_date=*")) == ["event_date=2024-01-01", "event_date=2024-01-02"]
    assert tables.read_table(spark, str(tmp_path / "t"), ["k"]).count() == 6
