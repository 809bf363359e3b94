"""Results that name whole groups or whole orders, without a task that holds one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.materialize import cut

#: Rows of links or numbers (of some 40 bytes) that one task finishes. What is more is brought down to that by rounds of joins first.
IN_ONE_TASK = 1 << 20
#: How many members a list shows. ``membership`` has all.
LISTED = 1_000


def membership(df: DataFrame, keys: list[str], member: str, where: str = "n > 1") -> DataFrame:
    """(keys, member, n_rows): each different member of each group, with the number of its rows; ``where`` says which groups, by n (different members) and n_rows (all rows).

    NULL keys make a group; NULL members don't count. A row for each member, however large a group is.
    """
    each, sizes, on = _groups(df, keys, member, where)
    return each.join(sizes, on, "left_semi").select(*keys, member, F.col("_rows").alias("n_rows"))


def _groups(df: DataFrame, keys: list[str], member: str, where: str) -> tuple[DataFrame, DataFrame, Column]:
    each = df.where(F.col(member).isNotNull()).groupBy(*keys, member).agg(F.count("*").alias("_rows"))
    sizes = each.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(F.count("*").alias("n"), F.sum("_rows").alias("n_rows")).where(where)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return each, sizes, on


def listed(df: DataFrame, keys: list[str], member: str, where: str = "n > 1") -> DataFrame:
    """(keys, n, n_rows, members): one row for each group. n counts its different members, n_rows all rows; members are the first LISTED of them in order, joined by ' | '.

    ``where`` says which groups; NULL keys make a group, NULL members don't count. Groups are counted by partial aggregation, and the rank limit
    keeps LISTED members of a group before the shuffle as well, so a group of any size costs no task more than that. ``membership`` has the rest.
    """
    each, sizes, on = _groups(df, keys, member, where)
    first = each.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(member))).where(F.col("_r") <= LISTED)
    lists = first.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(member)), " | ").alias("members"))
    return lists.join(sizes, on).select(*keys, "n", "n_rows", "members")


def in_one_task(df: DataFrame, f: Callable[..., list[np.ndarray]], schema: str, names: list[str]) -> DataFrame:
    """f of all columns of df as arrays; df has at most IN_ONE_TASK rows, give or take a factor. A NULL number is -1. Without rows there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(all_) if (all_ := [b for b in batches if b.num_rows]) else None
        if table is not None:
            numbers = [np.array(c.fill_null(-1) if pa.types.is_integer(c.type) else c.to_pylist(), dtype=None if pa.types.is_integer(c.type) else object) for c in table.columns]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in f(*numbers)], names)

    return df.repartition(1).mapInArrow(run, schema)


def over_cores(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as tasks can run at once: for rows that cost much more to work on than to move, of which a scan gives few partitions (small files, large row groups)."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str, previous: dict[str, Column] | None = None) -> DataFrame:
    """df with ``name``: the place of each row within its by group (the whole table without by), from 1, in the given order.

    previous: further columns, by name: what the expression gives for the row before in the group, NULL for a group's first row. Rows are
    range-partitioned by group and order, so a group of any size is spread over tasks; what earlier partitions hold of a group is added from
    one count, and one last row, for each partition and group. Ties get any order.
    """
    keys = [F.col(b).asc() for b in by]
    before_it = F.struct(*(c.alias(n) for n, c in (previous or {}).items())) if previous else F.lit(True)
    spread = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_pid", F.spark_partition_id())
    rows = cut(spread.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    counts = rows.groupBy(*by, "_pid").agg(F.count("*").alias("_n"), F.max_by(before_it, "_at").alias("_last"))
    parts = Window.partitionBy(*by).orderBy("_pid")
    before = F.coalesce(F.sum("_n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*(F.col(b).alias(f"_b_{b}") for b in by), F.col("_pid").alias("_b_pid"), before.alias("_before"), F.lag("_last").over(parts).alias("_last"))
    within = Window.partitionBy(*by, "_pid").orderBy("_at")
    on = F.col("_pid") == F.col("_b_pid")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    rows = rows.withColumn("_i", F.row_number().over(within)).withColumn("_prev", F.lag(before_it).over(within)).join(starts, on)
    more = (F.coalesce("_prev", "_last")[n].alias(n) for n in previous or {})
    return rows.select(*df.columns, (F.col("_i") + F.col("_before")).alias(name), *more)
