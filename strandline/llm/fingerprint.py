"""Copies hidden by formatting (problem 2).

A record's normalised fields are hashed as (name, value) pairs and the hashes are added up modulo 2^62, so that neither the order of the
fields nor the order of the members of a multi-valued field matters, and nothing is sorted. Records are grouped by the sum; what the hash
brought together is then compared field by field, and a collision is taken apart again by the fields themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.materialize import cut

#: Rows of one group of copies that one task joins at most; larger groups are split by a salt.
ROWS_PER_SALT = 200_000


def words(c: Column) -> Column:
    """The runs of letters and digits of a text, in order, joined by one blank; case is folded fully (ß as ss, final sigma as sigma).

    NULL stays NULL; a text without letters and digits gives the empty text.
    """
    # capitals first, so that ß becomes SS; the replacement of the capital ß also keeps the optimizer from merging both conversions
    folded = F.replace(F.lower(F.replace(F.upper(c), F.lit("ẞ"), F.lit("SS"))), F.lit("ς"), F.lit("σ"))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def pair_hash(name: str, value: Column) -> Column:
    """The hash of one (field name, value) pair; NULL has a hash of its own."""
    return F.xxhash64(F.lit(name), F.coalesce(value.cast("string"), F.lit("\u0000null")), value.isNull())


def members_hash(name: str, values: Column) -> Column:
    """The sum of the members' hashes: equal for the same members, as often, in any order. NULL and empty count as no members."""
    return F.aggregate(
        F.coalesce(values, F.array().cast("array<string>")), F.lit(0).cast("bigint"), lambda acc, x: _plus(acc, pair_hash(name, x))
    )


def _plus(total: Column, h: Column) -> Column:
    """Addition modulo 2^62, which no setting of ANSI mode lets overflow. h is hashed again, so that sums of related hashes don't cancel out."""
    mask = F.lit((1 << 62) - 1)
    return (total + F.xxhash64(h, F.lit(0x5EED)).bitwiseAND(mask)).bitwiseAND(mask)


def fingerprint(scalars: dict[str, Column], multi: dict[str, Column]) -> Column:
    """The commutative hash of a record: scalars by name, multi-valued fields (arrays of strings) by name."""
    total = F.lit(0).cast("bigint")
    for name, c in scalars.items():
        total = _plus(total, pair_hash(name, c))
    for name, c in multi.items():
        total = _plus(total, members_hash(name, c))
    return total


def _same_members(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same members as often, without sorting."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)

    def as_often(x: Column) -> Column:
        return F.size(F.filter(a, lambda y: y.eqNullSafe(x))) == F.size(F.filter(b, lambda y: y.eqNullSafe(x)))

    # equal arrays are the usual case and are decided first
    return (a == b) | ((F.size(a) == F.size(b)) & F.forall(a, as_often))


def copies(df: DataFrame, id_col: str, scalars: list[str], multi: list[str] = (), fp_col: str = "fp") -> DataFrame:
    """(first_id, copy_id) of every row of df that repeats a row with a smaller id.

    df has id_col (unique), the normalised fields and fp_col. Rows are equal if all scalars are equal (NULL equals NULL) and all multi fields
    hold the same members as often (NULL counts as empty). An empty df gives no rows. Other columns are ignored.

    Rows are normalised once and written by fingerprint and fields; grouping reads only fingerprints and ids of that table, and rows without a
    copy end at the join with the groups. A group of any size is compared in pieces of ROWS_PER_SALT rows.
    """
    fields = [*scalars, *multi]
    rows = cut(df.select(F.col(fp_col).alias("_fp"), F.col(id_col).alias("_id"), *fields), "rows")
    groups = rows.groupBy(F.col("_fp").alias("_gfp")).agg(F.min("_id").alias("_least"), F.count("*").alias("_n")).where("_n > 1")
    # a hot fingerprint is split by adaptive execution here, as nothing above needs this partitioning
    rows = cut(rows.join(groups, F.col("_fp") == F.col("_gfp")).drop("_gfp"), "members")
    salts = F.ceil(F.col("_n") / ROWS_PER_SALT).cast("int")
    firsts = rows.where("_id = _least").select(
        F.col("_fp").alias("f_fp"), F.col("_id").alias("f_id"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("f_salt"), *(F.col(c).alias(f"f_{c}") for c in fields)
    )
    later = rows.where("_id > _least").withColumn("_salt", F.pmod(F.col("_id"), salts).cast("int"))
    equal = F.lit(True)
    for c in scalars:
        equal = equal & F.col(c).eqNullSafe(F.col(f"f_{c}"))
    for c in multi:
        equal = equal & _same_members(F.col(c), F.col(f"f_{c}"))
    pairs = later.join(firsts, (F.col("_fp") == F.col("f_fp")) & (F.col("_salt") == F.col("f_salt"))).withColumn("_equal", equal)
    # fields travel on only for the rows that merely collided
    found = pairs.select(
        F.col("f_id").alias("first_id"), F.col("_id").alias("copy_id"), "_equal", F.when(~F.col("_equal"), F.struct("_fp", *fields)).alias("_odd")
    )
    found = cut(found, "copies")
    return found.where("_equal").select("first_id", "copy_id").unionByName(_collided(found, scalars, multi))


def _collided(found: DataFrame, scalars: list[str], multi: list[str]) -> DataFrame:
    """(first_id, copy_id) of copies among the rows that only collided with their group's first row, by the fields themselves.

    They are rare (none is expected below billions of rows), but none is lost.
    """
    odd = found.where("NOT _equal").select("copy_id", "_odd.*")
    keys = ["_fp", *scalars]
    for c in multi:
        # here alone members are put in order: the few collided rows need a key
        odd = odd.withColumn(f"_k_{c}", F.sort_array(F.coalesce(F.col(c), F.array().cast("array<string>"))))
        keys.append(f"_k_{c}")
    firsts = odd.groupBy(*keys).agg(F.min("copy_id").alias("_first"))
    firsts = firsts.select("_first", *(F.col(k).alias(f"_o_{i}") for i, k in enumerate(keys)))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_o_{i}"))
    return odd.join(firsts, on).where("copy_id > _first").select(F.col("_first").alias("first_id"), "copy_id")


def collapsed(df: DataFrame, id_col: str, scalars: list[str], multi: list[str] = (), fp_col: str = "fp") -> DataFrame:
    """(first_id, n_copies): each record once, with the number of rows that hold it. Records without a repeat have n_copies 1."""
    pairs = copies(df, id_col, scalars, multi, fp_col)
    repeats = pairs.groupBy("first_id").agg(F.count("*").alias("_n"))
    later = pairs.select(F.col("copy_id").alias("_c"))
    return (
        df.select(F.col(id_col).alias("first_id"))
        .join(later, F.col("first_id") == F.col("_c"), "left_anti")
        .join(repeats, "first_id", "left")
        .select("first_id", (F.coalesce("_n", F.lit(0)) + 1).alias("n_copies"))
    )
