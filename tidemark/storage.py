"""Storage that all executors share: checkpoints that survive a lost executor, folders for a query's own files."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as a URI with its scheme.

    It is below ``spark.checkpoint.dir`` where the cluster names one. Where none is set, a local session
    uses a temporary folder and any other the warehouse, which is shared.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        told = sc.getConf().get("spark.checkpoint.dir", None)
        if not told:
            local = sc.master.startswith("local") and "cluster" not in sc.master
            told = tempfile.mkdtemp(prefix="checkpoint-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        sc.setCheckpointDir(told)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, so that a lost executor does not cost the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system of a URI."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    p, fs = file_system(spark, path)
    fs.delete(p, True)


@contextmanager
def own_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder in the shared one, deleted at the end whatever happens; what is returned must not read it."""
    folder = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    try:
        yield folder
    finally:
        remove(spark, folder)
