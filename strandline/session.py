"""A session with the settings the operators are written for. Any other session works as well, if its executors can import the package (``ship``)."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the session's Python workers, which needn't have it installed; once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        here = os.path.dirname(os.path.abspath(__file__))
        # the driver reads it here and hands it out, as long as it runs
        folder = tempfile.mkdtemp(prefix="strandline-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/strandline", "zip", os.path.dirname(here), os.path.basename(here)))
    return spark


def session(master: str, **settings: str) -> SparkSession:
    """A session on any master, as Spark spells it. On a cluster spark.checkpoint.dir must name a shared folder, here or in its own settings."""
    builder = SparkSession.builder.master(master).appName("strandline").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    for k, v in settings.items():
        builder = builder.config(k, v)
    return ship(builder.getOrCreate())


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    memory = os.environ.get("STRANDLINE_MEMORY", memory)
    return session(f"local[{cpus}]", **{"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false"})
