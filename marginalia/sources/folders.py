"""The folder that driver and executors share, and tables kept there on the way to a result."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder(application: str) -> str:
    """One temporary folder an application; only a single machine uses it."""
    return tempfile.mkdtemp(prefix=f"marginalia-{application}-")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where none is set: on a single machine a temporary folder, on a cluster a
    folder in the warehouse if that lies in a shared store.

    Raises ValueError on a cluster whose warehouse is a path of the local file system: every machine would see files of
    its own there, and tables read back would be partly or wholly empty.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return _own_folder(spark.sparkContext.applicationId)
    at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/marginalia-scratch"
    store = spark._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getUri().getScheme() == "file":
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share: {at} is local to each machine")
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read from there: computed once, whatever reads it and whichever executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
