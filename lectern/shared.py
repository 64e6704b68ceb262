"""Tables in the folder that driver and executors share: lineage cuts, and indexes that queries of one application use again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs in one process, a folder of our own."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if at or current.isDefined():
        if not current.isDefined():
            sc.setCheckpointDir(at)
        return at or current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    at = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
    sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, so that plans built on it stay small."""
    folder(df.sparkSession)
    return df.checkpoint()


def state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: another state is another table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files, found = fs.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


_KEPT: dict[tuple, dict[str, str]] = {}


def kept(spark: SparkSession, name: str, sources: list[str], make: Callable[[Callable], None]) -> dict[str, DataFrame]:
    """Tables that make(put) writes by put(name, df), which returns the table read again; made once for an application and a state of its sources."""
    key = (spark.sparkContext.applicationId, name, *(state(spark, s) for s in sources))
    if key not in _KEPT:
        root = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        paths: dict[str, str] = {}

        def put(table: str, df: DataFrame) -> DataFrame:
            df.write.parquet(f"{root}/{table}")
            paths[table] = f"{root}/{table}"
            return spark.read.parquet(paths[table])

        make(put)
        _KEPT[key] = paths
    return {t: spark.read.parquet(p) for t, p in _KEPT[key].items()}
