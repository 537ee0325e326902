"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without it (tests) gets a temporary folder, a cluster an error."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found and held.isDefined():
        found = held.get()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="querykiln-")
    if held.isEmpty():
        sc.setCheckpointDir(found)
    return found


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        if spark.sparkContext._jsc is not None:
            try:
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            except Exception:  # the session may be gone at exit
                pass


@contextlib.contextmanager
def set_while(spark: SparkSession, values: dict):
    """What is written inside is planned with these settings."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back, so that every use reads instead of working it out.

    A lost executor costs no more than the reading. The shuffle files of the write go
    with it, the table when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/querykiln-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
