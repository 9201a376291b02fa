"""Sessions for this engine, and its package on the workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: Settings that hold at any size; partition counts and memory are the cluster's.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def create(master: str | None = None, app: str = "sealstone", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package to Python workers, once a context.

    Spark pickles module functions by name; workers on other machines import
    them from the archive that addPyFile hands out.
    """
    context = spark.sparkContext
    if getattr(context, "_sealstone_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="sealstone-py-")
    context.addPyFile(shutil.make_archive(os.path.join(folder, "sealstone"), "zip", os.path.dirname(package), os.path.basename(package)))
    context._sealstone_shipped = True
