"""Helpers shared by the operators: words, shared storage, skewed joins, packed blobs."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separates words: everything else is part of a word, unchanged.
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Stands for a null integer id in join keys; sorts before every other id.
NULL_ID = -(2**63)
#: Rows in an Arrow batch handed to Python, so that long texts don't pile up.
ARROW_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset and all runs in one process, one of our own."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None)
    if not at:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            at = current.get()
        elif not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            at = "file://" + tempfile.mkdtemp(prefix="lectern-")
            sc.setCheckpointDir(at)
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage.

    The files stay until the folder is cleaned, as results read them lazily.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def null_key(c: Column) -> Column:
    """A string key in which null differs from every value."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))


def row_hash(*cs: Column) -> Column:
    return F.xxhash64(*cs)


def skew_join(left: DataFrame, right: DataFrame, key: str, weight: str, spread: Column, how: str = "left") -> DataFrame:
    """Joins left with right (one row a key, stored) on a non-null key.

    ``weight`` is a column of right with the number of left rows of the key.
    Keys with more rows than half a partition should hold are dealt over
    several partitions: left rows by ``spread``, the right row copied to each.
    At most 2 x shuffle partitions keys can be that heavy, so the list of them
    that is broadcast is bounded. The weight column is dropped.
    """
    parts = partitions(left.sparkSession)
    total = right.agg(F.sum(weight)).first()[0] or 0
    limit = max(1000, math.ceil(total / (2 * parts)))
    hot = F.broadcast(right.filter(F.col(weight) > limit).select(key, F.ceil(F.col(weight) / limit).cast("long").alias("_lt_salts")))
    dealt = left.join(hot, key, "left").withColumn("_lt_salt", F.pmod(spread, F.coalesce("_lt_salts", F.lit(1).cast("long")))).drop("_lt_salts")
    copies = F.when(F.col(weight) > limit, F.ceil(F.col(weight) / limit)).otherwise(1).cast("long")
    copied = right.withColumn("_lt_salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop(weight)
    return dealt.join(copied, [key, "_lt_salt"], how).drop("_lt_salt")


def ranked(df: DataFrame, keys: list[str], order: list[Column], spread: Column, name: str, buckets: int) -> DataFrame:
    """Adds a rank from 0 within keys, gapless, without one task for one key.

    Rows are dealt into buckets by ``spread``; ranks count bucket by bucket. Only
    the counts of (keys, bucket) meet in one place.
    """
    from pyspark.sql import Window as W

    df = df.withColumn("_lt_bucket", F.pmod(spread, F.lit(buckets).cast("long")))
    counts = df.groupBy(*keys, "_lt_bucket").agg(F.count("*").alias("_lt_n"))
    before = W.partitionBy(*keys).orderBy("_lt_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_lt_start", F.coalesce(F.sum("_lt_n").over(before), F.lit(0))).drop("_lt_n")
    own = F.row_number().over(W.partitionBy(*keys, "_lt_bucket").orderBy(*order)).cast("long") - 1
    return df.withColumn("_lt_own", own).join(starts.hint("merge"), [*keys, "_lt_bucket"]).withColumn(name, F.col("_lt_own") + F.col("_lt_start")).drop("_lt_own", "_lt_start", "_lt_bucket")


def with_fields(df: DataFrame, fields: str) -> T.StructType:
    """df's schema and more fields after it."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(fields).fields])


def tidy(run):
    """run, a function of Arrow batches, that gives its memory back when a task ends: workers are used again by other stages."""

    def tidied(batches):
        import ctypes
        import gc

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return tidied


def pack(arrays: list, level: int = 1) -> bytes:
    """Byte strings and flat numpy arrays as one zstd-compressed blob."""
    import struct

    import pyarrow as pa

    parts = [(b"-", a) if isinstance(a, bytes) else (a.dtype.str[1:].encode(), a.tobytes()) for a in arrays]
    raw = struct.pack("<B", len(parts)) + b"".join(struct.pack("<2sI", k, len(x)) for k, x in parts) + b"".join(x for _, x in parts)
    return struct.pack("<I", len(raw)) + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def unpack(blob: bytes) -> list:
    import struct

    import numpy as np
    import pyarrow as pa

    raw = pa.decompress(memoryview(blob)[4:], decompressed_size=struct.unpack_from("<I", blob)[0], codec="zstd", asbytes=True)
    at, out = 1 + 6 * raw[0], []
    for k in range(raw[0]):
        kind, size = struct.unpack_from("<2sI", raw, 1 + 6 * k)
        out.append(raw[at : at + size] if kind == b"-\0" else np.frombuffer(raw, "<" + kind.decode(), size // int(kind[1:2]), at))
        at += size
    return out


def planes(a):
    """An integer array as its bytes, the first of all numbers, then the second, and so on, which compresses well."""
    import numpy as np

    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def from_planes(raw: bytes, dtype):
    import numpy as np

    kind = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def place(value: Column, bounds: Column, n: int) -> Column:
    """Number of the n sorted bounds at or below value, by halving; null is below all."""

    def halved(step):  # a lambda's second parameter would be an index
        return lambda at: F.when(F.get(bounds, at + F.lit(step - 1)) <= value, at + F.lit(step)).otherwise(at)

    low = F.lit(0)
    for k in reversed(range(n.bit_length())):
        low = bind(low, halved(1 << k))
    return low.cast("long")
