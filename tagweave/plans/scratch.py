"""Tables between the steps of a plan, in the folder that the cluster shares."""

from __future__ import annotations

import math
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The local folders of applications that run on one machine and name no shared one.
_own: dict[str, str] = {}


def hadoop_path(spark: SparkSession, path: str):
    """(path, its file system) as the JVM has them, so that any store that Spark reads will do."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that they needn't have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = Path(__file__).resolve().parents[1]
        made = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(made)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file as a whole; null where there is none."""
    there, fs = hadoop_path(spark, path)
    if not fs.exists(there):
        return None
    stream = fs.open(there)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def scratch(spark: SparkSession) -> str:
    """A path below spark.checkpoint.dir that goes with the JVM.

    Where that setting is absent, a local folder will do for a session on one machine, and for it alone: the executors
    of a cluster would each write to their own disk, so that there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="tagweave-"))
    path = f"{root.rstrip('/')}/tagweave-{uuid.uuid4().hex}"
    there, fs = hadoop_path(spark, path)
    fs.deleteOnExit(there)
    return path


#: Bytes a core below which a table is dealt over all of them.
SPREAD = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it is small: its files may be one block, which is one task. Larger tables have their own."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD else df


#: Bytes of the files that a table is read from, for each task of a shuffle whose tasks hold what they are dealt.
SHARE = 4 << 20


def tasks(df: DataFrame, shares: int = 1) -> int:
    """Parts for a shuffle of df that grow with the files it is read from, so many shares each; the session's number at least."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 50 else max(least, math.ceil(size / (shares * SHARE)))  # rows without files tell no size


def dealt(df: DataFrame, *by: str, shares: int = 1) -> DataFrame:
    """df dealt by columns over tasks(df, shares) parts, if these are more than the next shuffle would make itself."""
    n = tasks(df, shares)
    return df.repartition(n, *by) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def materialize(df: DataFrame) -> DataFrame:
    """df, written and read again: its lineage ends, and executors may come and go."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, n: int, key: str) -> DataFrame:
    """df, which is dealt by key over n parts, written and read again in n buckets: a join on key deals its other side alone.

    There should be as many buckets as a shuffle has parts at least, or Spark would deal the table anew.
    """
    name = f"tagweave_{uuid.uuid4().hex}"
    df.write.bucketBy(n, key).sortBy(key).option("path", scratch(df.sparkSession)).saveAsTable(name)
    return df.sparkSession.table(name)


def discard(*tables: DataFrame) -> None:
    """Removes the files of materialized tables that no plan will read again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.rpartition("/")[2].startswith("tagweave-"):
                there, fs = hadoop_path(spark, folder)
                fs.delete(there, True)
