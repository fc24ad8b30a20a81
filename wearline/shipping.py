"""Make this package importable in executors that do not share the driver's folders."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "wearline.shipped"


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_wearline_shipped", None) == context.applicationId:
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent).as_posix())
    target = os.path.join(tempfile.mkdtemp(prefix="wearline-"), "wearline_src.zip")
    Path(target).write_bytes(buffer.getvalue())
    context.addPyFile(target)
    context._wearline_shipped = context.applicationId


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; without the setting, a folder of this machine if Spark runs on it alone."""
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a shared folder")
        configured = tempfile.mkdtemp(prefix="wearline-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured
