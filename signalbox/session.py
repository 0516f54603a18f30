"""Session helpers: settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "signalbox", master: str | None = None, **conf: str) -> SparkSession:
    """A session with civil-time semantics pinned to UTC and adaptive execution on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Timestamps in the feeds carry no zone; a fixed UTC session keeps their arithmetic exact."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


#: Per application: the folder that stands in for the cluster's, and the work folders named so far.
_roots: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used when the cluster sets it. Only where it is
    unset on a local master (tests, a laptop) does this fall back to a temporary folder, which goes when Python ends.
    """
    app, root = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if not root and app not in _roots:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        _roots[app] = tempfile.mkdtemp(prefix="signalbox-")
        atexit.register(shutil.rmtree, _roots[app], ignore_errors=True)
    folder = os.path.join(root or _roots[app], f"{label}-{uuid.uuid4().hex}")
    _made.setdefault(app, []).append(folder)
    return folder


def work_folders(spark: SparkSession) -> list[str]:
    """The work folders of this application that haven't been removed, in the order in which they were named."""
    return list(_made.get(spark.sparkContext.applicationId, ()))


def remove_work(spark: SparkSession, folders: list[str] | None = None) -> None:
    """Removes work folders of this application, all of them by default. Results that are still to be read from them
    must have been written elsewhere."""
    made = _made.get(spark.sparkContext.applicationId, [])
    for folder in list(made) if folders is None else folders:
        if folder not in made:
            raise ValueError(f"{folder} is no work folder of this application")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        made.remove(folder)
