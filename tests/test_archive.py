"""Archives by time, and collections of any size."""

import json
import os

import pytest

from signalbox.sources import sinks, snapshots


@pytest.fixture
def archive(tmp_path):
    for day in range(1, 6):
        for hour in (7, 8):
            folder = tmp_path / "a" / f"date=2024-01-{day:02}" / f"hour={hour:02}"
            folder.mkdir(parents=True)
            (folder / "doc.txt").write_text(f"{day}-{hour}")
    return tmp_path / "a"


def test_a_range_opens_only_its_folders(spark, archive):
    broken = archive / "date=2024-01-05" / "hour=07" / "doc.txt.gz"
    broken.write_bytes(b"this is no gzip file")
    got = snapshots.read_between(spark, str(archive), "doc*", "2024-01-02", "2024-01-03")
    assert sorted(r["value"] for r in got.collect()) == ["2-7", "2-8", "3-7", "3-8"]
    assert all("date=2024-01-0" in r["source_file"] for r in got.collect())
    assert "PartitionFilters: [isnotnull" in got._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="doc.txt.gz"):  # it is opened if the range reaches it
        snapshots.read_between(spark, str(archive), "doc*", "2024-01-04").collect()
    hours = snapshots.read_between(spark, str(archive), "doc*", "08", folder="hour").collect()
    assert sorted(r["value"] for r in hours) == [f"{d}-8" for d in range(1, 6)]


def test_files_by_time_of_writing(spark, tmp_path):
    for i in range(4):
        folder = tmp_path / f"{i}"
        folder.mkdir()
        (folder / "doc.txt").write_text(str(i))
        os.utime(folder / "doc.txt", (1_700_000_000 + 3600 * i,) * 2)
    got = snapshots.read_modified(spark, str(tmp_path), "doc*", "2023-11-14T23:00:00", "2023-11-15T01:00:00")
    assert sorted(r["value"] for r in got.collect()) == ["1", "2"]
    assert snapshots.read_modified(spark, str(tmp_path), "doc*").count() == 4


@pytest.mark.parametrize("n", (0, 1, 2, 1000))
def test_parts_join_to_one_document(spark, tmp_path, n):
    rows = [(i % 500, json.dumps({"type": "Feature", "properties": {"i": i, "text": "]} , é"}, "geometry": None}, ensure_ascii=False)) for i in range(n)]
    features = spark.createDataFrame(rows, "at int, feature string").repartition(5)
    path = str(tmp_path / "c")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        sinks.write_collection(features, path, ["at"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "c").glob("part-*"))
    whole = json.loads("".join(p.read_text(encoding="utf-8") for p in parts))
    assert whole["type"] == "FeatureCollection" and [f["properties"]["i"] % 500 for f in whole["features"]] == sorted(i % 500 for i in range(n))
    back = [json.loads(r["feature"]) for r in sinks.collection_lines(spark, path).collect()]
    assert sorted(f["properties"]["i"] for f in back) == list(range(n))
    if n == 1000:
        assert len([p for p in parts if p.stat().st_size]) > 1
