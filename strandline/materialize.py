"""Cutting lineage.

Iterative operators write each round as a Parquet table and read it again. The folder is the one that the cluster names in
``spark.checkpoint.dir``, which all executors share, so a lost executor loses no round. Only where the setting is missing and all runs on one
machine (tests) is a temporary folder used. What a query leaves there is deleted by ``scratch`` once its result is written, and with the application.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}
#: The tables of each application that are still there.
_tables: dict[str, list[Cut]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or a temporary one if the session runs on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="strandline-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return f"file://{_local[app]}"


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete the application's tables but the first ``keep``. What was made from them can't be computed again."""
    tables = _tables.get(spark.sparkContext.applicationId, [])
    for t in tables[keep:]:
        t.drop()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, results are written; at its end the intermediate tables that came meanwhile are deleted."""
    keep = len(_tables.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, keep)


def _clean_up(spark: SparkSession) -> None:
    # the session may be gone already
    with contextlib.suppress(Exception):
        release(spark)


class Cut:
    """A table written to the shared folder. ``df`` reads it; ``drop()`` deletes it once nothing reads it any more.

    count: a condition; ``counted`` is the number of rows that meet it, taken while the rows are written.
    """

    def __init__(self, df: DataFrame, name: str = "cut", count: str | None = None):
        self.spark, schema = df.sparkSession, df.schema
        seen = Observation()
        if count:
            df = df.observe(seen, F.count_if(F.expr(count)).alias("n"))
        self.path = f"{shared_dir(self.spark)}/strandline/{self.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.counted = seen.get["n"] if count else None
        self.df = self.spark.read.schema(schema).parquet(self.path)
        app = self.spark.sparkContext.applicationId
        if app not in _tables:
            _tables[app] = []
            atexit.register(_clean_up, self.spark)
        _tables[app].append(self)

    def drop(self) -> None:
        tables = _tables.get(self.spark.sparkContext.applicationId, [])
        if self in tables:
            tables.remove(self)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df and return a reader of what was written."""
    return Cut(df, name).df
