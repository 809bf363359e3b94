"""Scripts and events as streams: what changes is parsed as it arrives, and usage counts follow it.

The batch operators that keep no state (parsing, routing, unpacking, normalisation) take streams as they are; here are the ones that need
a watermark or state, expressed with Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import assemble


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of events as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(events: DataFrame, keys: list[str], at: str = "scanned_at", late: str = "2 hours") -> DataFrame:
    """Events without repeats among those that arrive within the watermark; state is dropped behind it. Events behind it are left to missed()."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def usage_by_window(events: DataFrame, at: str = "scanned_at", late: str | None = "2 hours", window: str = "1 hour") -> DataFrame:
    """(window_start, project_id, kind, n): reads, writes and erases by time window, late events up to the watermark included; merged_usage() has those behind it too. late None: events have a watermark already."""
    routed = assemble.routed(events.withWatermark(at, late) if late else events)
    counts = routed.groupBy(F.window(at, window).alias("w"), "project_id", "kind").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "project_id", "kind", "n")


def missed(arrived: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """The late table, as a batch: events of the folder (arrived) that a stream of deduplicated() hasn't written because they came behind its watermark, each key once.

    Every other event has its key in what was written. Run it while the stream stands still, or events that it hasn't read yet count as well.
    """
    known = written.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return arrived.join(known, on, "left_anti").dropDuplicates(keys)


def merged_usage(arrived: DataFrame, written: DataFrame, keys: list[str], at: str = "scanned_at", window: str = "1 hour") -> DataFrame:
    """usage_by_window as a batch over what a stream of deduplicated() wrote and what it missed: no event is lost."""
    return usage_by_window(written.unionByName(missed(arrived, written, keys)), at, None, window)
