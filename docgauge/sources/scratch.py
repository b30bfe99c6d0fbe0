"""Where intermediate results go: a folder that driver and executors share, or Spark's own blocks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> Path:
    """A new folder below spark.checkpoint.dir, removed when the driver ends.

    Where the setting is missing a local master uses the machine's temporary folder. Directories are read by path, so the
    shared folder must be mounted.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        told = tempfile.gettempdir()
    if "://" in told and not told.startswith("file://"):
        raise RuntimeError(f"{told} isn't mounted as a folder")
    out = Path(told.removeprefix("file://")) / f"docgauge-{what}-{uuid.uuid4().hex}"
    out.mkdir(parents=True)
    atexit.register(shutil.rmtree, out, ignore_errors=True)
    return out


def settled(df: DataFrame) -> DataFrame:
    """df, computed once, kept as a reliable checkpoint and cut off from its plan.

    Spark keeps a description of every plan it ran in the driver's heap, with those of all cached tables in it, so plans on top of
    each other must not show each other. The folder is spark.checkpoint.dir; only a local master may do without.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        told = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(told or f"file://{shared_folder(df.sparkSession, 'cuts')}")
    return df.checkpoint()
