"""Files in the cluster's shared storage, read and written by tasks at their URI."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from .common import checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A URI of a folder of its own under the shared folder."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    For loops: what the optimizer believes of a checkpoint's size is that of the plan it cut, which every round multiplies
    until planning takes longer than the work; of a table it sees the files.
    """
    folder = new_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; what has no scheme is a local path."""
    if uri.startswith("file:/"):
        path = uri[len("file:"):]
        return fs.LocalFileSystem(), "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(uri)
