"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without that setting gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = getattr(spark, "_sightline_folder", None)
    if folder is None:
        place = tempfile.mkdtemp(prefix="sightline-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        spark._sightline_folder = folder = f"file://{place}"
    return folder
