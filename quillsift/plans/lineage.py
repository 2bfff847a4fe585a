"""Cutting a loop's lineage."""

from __future__ import annotations

import re
import tempfile
from contextlib import nullcontext
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from quillsift.session import unbroadcast


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names, or on one machine one of its own.

    A cluster that names none is an error: a folder of the driver's own would be written where no other machine reads.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


def settled(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there.

    A table rather than a checkpoint: that would hand its constraints on, and they multiply from one turn of a loop to
    the next.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/settled-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of files up to which a table counts as small.
SMALL = 2_000_000


def gathered(df: DataFrame, wide: bool = False) -> DataFrame:
    """settled(df), as one partition if it is small; wide: whether df reads tables that are not.

    Steps that join and group such tables alone then are one stage, without shuffles or broadcasts, after each of which
    the driver would plan all the rest again. A loop's many plans fill its memory.
    """
    spark = df.sparkSession
    with nullcontext() if wide else unbroadcast(spark):
        table = settled(df)
    folder = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent()
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return table.coalesce(1) if size <= SMALL else table


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes the files of settled tables that nothing reads any more."""
    for table in tables:
        for file in table.inputFiles():
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("settled-"):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
                break
