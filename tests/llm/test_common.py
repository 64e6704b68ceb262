"""Helpers: places among bounds, packed blobs, ranks, skewed joins."""

import bisect

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import common


def test_place(spark):
    for bounds in ([], [5], [1, 2], [3, 3, 9], list(range(0, 100, 7))):
        df = spark.range(120).select(F.when(F.col("id") < 110, F.col("id")).alias("v"))
        rows = df.withColumn("p", common.place(F.col("v"), F.array(*map(F.lit, bounds)).cast("array<long>"), len(bounds))).collect()
        assert all(r.p == (0 if r.v is None else bisect.bisect_right(bounds, r.v)) for r in rows)


def test_pack():
    arrays = [b"", b"abc\0", np.arange(5, dtype=np.uint64), np.zeros(0, np.int32), np.array([1, 255], np.uint8)]
    for a, b in zip(arrays, common.unpack(common.pack(arrays, 3)), strict=True):
        assert a == b if isinstance(a, bytes) else (a == b).all() and a.dtype == b.dtype
    x = np.array([0, 1, 2**40, 2**63], np.uint64)
    assert (common.from_planes(common.planes(x), np.uint64) == x).all()
    assert len(common.from_planes(common.planes(x[:0]), np.uint64)) == 0


def test_ranked_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    rows = common.ranked(df, ["k"], [F.col("id")], F.xxhash64("id"), "rank", 7).collect()
    for k in range(3):
        assert sorted(r["rank"] for r in rows if r.k == k) == list(range(len([r for r in rows if r.k == k])))


def test_skew_join_keeps_all_rows(spark):
    left = spark.range(9000).select(F.when(F.col("id") < 6000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("w"), F.min("id").alias("m"))
    rows = common.skew_join(left, right, "k", "w", F.xxhash64("id")).collect()
    assert len(rows) == 9000 and all(r.m is not None for r in rows)
