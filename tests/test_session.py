"""Work folders: named below the shared folder, and removed on request."""

import pathlib

import pytest

from signalbox.session import remove_work, work_dir, work_folders


def test_work_folders_are_removed(spark):
    known = work_folders(spark)
    a, b = work_dir(spark, "a"), work_dir(spark, "b")
    spark.range(3).write.parquet(a)
    assert work_folders(spark) == [*known, a, b] and pathlib.Path(a).exists()
    remove_work(spark, [a, b])
    assert work_folders(spark) == known and not pathlib.Path(a).exists()
    with pytest.raises(ValueError):
        remove_work(spark, [str(pathlib.Path(a).parent)])
