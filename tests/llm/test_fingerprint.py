"""Copies hidden by formatting on small fixtures, and against SQL over whole tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.llm import fingerprint, queries


def _fp(df, scalars, multi):
    return df.withColumn("fp", fingerprint.fingerprint({c: F.col(c) for c in scalars}, {c: F.col(c) for c in multi}))


def test_copies_ignore_format_and_order(spark):
    rows = [
        (5, "Straße/A_b.csv", ["x/y", "z"]),
        (7, "STRASSE / a b.CSV", ["Z", "x y"]),
        (9, "strasse-a-b csv", ["x.y", "z", "z"]),
        (11, None, None),
        (12, "q", None),
        (13, "Q", []),
        (14, "q", [None]),
        (15, "", ["x"]),
        (16, "//", ["X"]),
    ]
    df = spark.createDataFrame(rows, "id long, p string, m array<string>").where("p is not null")
    df = df.select("id", fingerprint.words(F.col("p")).alias("p"), F.transform("m", fingerprint.words).alias("m"))
    got = fingerprint.copies(_fp(df, ["p"], ["m"]), "id", ["p"], ["m"])
    assert {tuple(r) for r in got.collect()} == {(5, 7), (12, 13), (15, 16)}
    counted = fingerprint.collapsed(_fp(df, ["p"], ["m"]), "id", ["p"], ["m"])
    assert {tuple(r) for r in counted.collect()} == {(5, 2), (9, 1), (12, 2), (14, 1), (15, 2)}
    assert fingerprint.copies(_fp(df.limit(0), ["p"], ["m"]), "id", ["p"], ["m"]).collect() == []


def test_collisions_are_taken_apart(spark):
    # one fingerprint for all rows: only the fields decide
    rows = [(i, f"v{i % 3}", ["a", "b"] if i % 2 else ["b", "a"]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, p string, m array<string>").withColumn("fp", F.lit(1).cast("bigint"))
    got = {tuple(r) for r in fingerprint.copies(df, "id", ["p"], ["m"]).collect()}
    assert got == {(i % 3, i) for i in range(3, 30)}


def test_hot_group_is_salted(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_SALT", 10)
    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("p"))
    got = fingerprint.copies(_fp(df, ["p"], []), "id", ["p"]).collect()
    assert {tuple(r) for r in got} == {(0, i) for i in range(3, 500, 3)}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in Path(sf_dir).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, sf_dir).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())
