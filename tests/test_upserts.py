"""Partial upserts: files of untouched buckets, lost writers, repeated keys, empty updates."""

import os

import pytest
from pyspark.sql import functions as F

from groundwork.operators import upserts as U

SCHEMA = "k int, v string, n int"


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{root}/data") for f in names if f.endswith(".parquet")}


def read(spark, root):
    return {(r["k"]): (r["v"], r["n"]) for r in U.current(spark, root, SCHEMA).collect()}


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = f"{tmp_path}/t"
    U.create(spark.range(200).selectExpr("cast(id as int) as k", "'old' as v", "0 as n"), root, ["k"], 16)
    before = files(root)
    touched = U.upsert(rows(spark, (7, "new", 1), (7, "newer", 2), (500, "added", 1)), root, ["k"], [F.col("n").desc()], 16)
    assert 1 <= len(touched) <= 2 and before < files(root)
    new = files(root) - before
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in new} == set(touched)
    got = read(spark, root)
    assert len(got) == 201 and got[7] == ("newer", 2) and got[500] == ("added", 1) and got[8] == ("old", 0)
    assert U.upsert(rows(spark, (7, "older", 1)), root, ["k"], [F.col("n").desc()], 16) and read(spark, root)[7] == ("newer", 2)
    assert U.upsert(rows(spark), root, ["k"], [F.col("n").desc()], 16) == [] and len(read(spark, root)) == 201


def test_a_writer_that_is_lost_before_its_commit(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/t"
    U.create(rows(spark, (1, "a", 0), (2, "b", 0), (None, "c", 0)), root, ["k"], 4)
    commit = U._commit

    def lost(df, root, n, touched):
        df.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/{n}")
        raise RuntimeError("lost")

    monkeypatch.setattr(U, "_commit", lost)
    with pytest.raises(RuntimeError):
        U.upsert(rows(spark, (1, "x", 1), (3, "y", 1)), root, ["k"], [F.col("n").desc()], 4)
    assert read(spark, root) == {1: ("a", 0), 2: ("b", 0), None: ("c", 0)}
    monkeypatch.setattr(U, "_commit", commit)
    U.upsert(rows(spark, (2, "z", 1), (None, "d", 1)), root, ["k"], [F.col("n").desc()], 4)
    assert read(spark, root) == {1: ("a", 0), 2: ("z", 1), None: ("d", 1)}


def test_an_empty_table(spark, tmp_path):
    root = f"{tmp_path}/t"
    U.create(rows(spark), root, ["k"])
    assert read(spark, root) == {}
    U.upsert(rows(spark, (1, "a", 0)), root, ["k"], [F.col("n").desc()])
    assert read(spark, root) == {1: ("a", 0)}
