"""Where intermediate results are kept: a folder that driver and executors share.

Everything that one session writes lies in a folder of its own under `spark.checkpoint.dir`. It is removed
when the session's JVM ends; `scratch` and `release` remove it earlier.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN = "spark.tessera.scratch"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it names none, a local folder in local mode and an error elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.gettempdir()}/tessera-checkpoints"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def run_dir(spark: SparkSession) -> str:
    """The folder of this session, or of the innermost `scratch`."""
    own = spark.conf.get(_OWN, None)
    if not own:
        own = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
        files, path = _path(spark, own)
        files.deleteOnExit(path)
        spark.conf.set(_OWN, own)
    return own


def release(spark: SparkSession) -> None:
    """Remove what the session has written; results that aren't written yet can't be read any more."""
    own = spark.conf.get(_OWN, None)
    if own:
        files, path = _path(spark, own)
        files.delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is kept inside goes at the end: the results must be written elsewhere by then."""
    outer = run_dir(spark)
    spark.conf.set(_OWN, f"{outer}/{uuid.uuid4().hex}")
    try:
        yield
        release(spark)
    finally:
        spark.conf.set(_OWN, outer)


def keep(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a result and read it back: later steps don't compute it again, and no executor holds the only copy.

    ``folder`` is one of `run_dir`, for results that outlive the innermost `scratch`.
    """
    path = f"{folder or run_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
