"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder of its own, removed at exit; a
    cluster session is refused, since no machine-local folder is shared there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        folder = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL.append("file://" + folder)
    return _LOCAL[0]
