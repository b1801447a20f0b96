"""Access to the input tables and to the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most bytes of a written table (as Parquet) that a lookup broadcasts; beyond it the join shuffles.
BROADCAST_BYTES = 4 << 20


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder, as in tests."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isEmpty():
        return held.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="foliant-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read from there, so that its lineage ends here, columns can be
    pruned and the planner knows its size. ``by`` is a column of few values, each in files of its own. The files go when
    the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid4().hex}"
    df.write.parquet(path, partitionBy=[by] if by else None)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def bytes_of(written: DataFrame) -> int:
    """The planner's size of a table read from files; no job runs for it."""
    return int(str(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def looked_up(rows: DataFrame, written: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with a written table (see ``cut``): by broadcast while its files have at most ``BROADCAST_BYTES``,
    else by a shuffle, in which adaptive execution splits hot keys."""
    return rows.join(F.broadcast(written) if bytes_of(written) <= BROADCAST_BYTES else written, on, how)
