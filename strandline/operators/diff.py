"""Differences between two copies of a table (problem 5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEFT, _RIGHT = 1, 2


def residues(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """The rows of cols with ``_side``: 1 only in left, 2 only in right, 3 in both.

    Repeated rows count once, so EXCEPT ALL of the distinct rows in both directions is one grouping of the union by all columns, in which
    NULL equals only NULL. Partial aggregation removes the repeats before the shuffle.
    """
    both = left.select(*cols, F.lit(_LEFT).alias("_side")).unionByName(right.select(*cols, F.lit(_RIGHT).alias("_side")))
    return both.groupBy(*cols).agg(F.bit_or("_side").alias("_side"))


def repeats(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """(cols, n_left, n_right) of the rows that stand in both copies, but not as often: what EXCEPT ALL in both directions leaves besides the residues. NULL equals only NULL."""
    count = lambda df, l, r: df.select(*cols, F.lit(l).alias("_l"), F.lit(r).alias("_r"))
    both = count(left, 1, 0).unionByName(count(right, 0, 1)).groupBy(*cols).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))
    return both.where("n_left > 0 AND n_right > 0 AND n_left <> n_right")


def differences(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, kind, field) of each difference: ``left_only``, ``right_only`` with field '', ``differs`` with the field's name.

    Rows of a key may repeat; they count once. If one copy holds several different rows of a key, a field differs if the sets of its values
    differ. NULL keys and values are compared as values of their own. Empty tables and further columns are allowed.
    """
    rows = residues(left, right, [*keys, *fields])
    sides = []
    for side, tag in ((_LEFT, "l"), (_RIGHT, "r")):
        # one row for each key before the join, so that no key makes pairs of rows
        one = rows.where(F.col("_side") == side).groupBy(*keys)
        one = one.agg(F.count("*").alias(f"_n{tag}"), F.max(F.struct(*fields)).alias(f"_{tag}"))
        sides.append(one.select(*(F.col(k).alias(f"_{tag}_{k}") for k in keys), f"_n{tag}", f"_{tag}"))
    l, r = sides
    joined = l.join(r, _same_key(keys, "_l_", "_r_"), "full").select(
        *(F.when(F.col("_nl").isNotNull(), F.col(f"_l_{k}")).otherwise(F.col(f"_r_{k}")).alias(k) for k in keys), "_nl", "_nr", "_l", "_r"
    )
    # keys of which a row is in both copies besides the residues: the copies disagree within themselves
    agree = rows.where("_side = 3").select(*(F.col(k).alias(f"_a_{k}") for k in keys)).distinct().withColumn("_agree", F.lit(True))
    joined = joined.join(agree, _same_key(keys, "", "_a_"), "left").select(*keys, "_nl", "_nr", "_l", "_r", F.coalesce("_agree", F.lit(False)).alias("_agree"))
    in_left = F.col("_nl").isNotNull() | F.col("_agree")
    in_right = F.col("_nr").isNotNull() | F.col("_agree")
    several = in_left & in_right & (F.col("_agree") | (F.col("_nl") > 1) | (F.col("_nr") > 1))
    differing = F.filter(F.array(*(F.when(~F.col(f"_l.{f}").eqNullSafe(F.col(f"_r.{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    plain = joined.where(~several).select(
        *keys,
        F.when(~in_right, "left_only").when(~in_left, "right_only").otherwise("differs").alias("kind"),
        F.explode(F.when(in_left & in_right, differing).otherwise(F.array(F.lit("")))).alias("field"),
    )
    conflicts = joined.where(several).select(*(F.col(k).alias(f"_c_{k}") for k in keys))
    return plain.unionByName(_by_value(rows, conflicts, keys, fields))


def _by_value(rows: DataFrame, conflicts: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """For the keys of conflicts: the fields whose sets of values differ between the copies."""
    values = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    of = rows.join(conflicts, _same_key(keys, "", "_c_"), "left_semi").select(*keys, "_side", values.alias("_v"))
    sides = of.groupBy(*keys, F.col("_v.field").alias("field"), F.col("_v.value").alias("_value")).agg(F.bit_or("_side").alias("_in"))
    return sides.where("_in <> 3").select(*keys, F.lit("differs").alias("kind"), "field").distinct()


def _same_key(keys: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in keys))
