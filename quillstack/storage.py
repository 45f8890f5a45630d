"""Reading tables, and where intermediate ones go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A table of fewer files than cores is dealt out if it has so many bytes at least, and at most as many for each core.
DEAL_BYTES = 1 << 20, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a folder of the warehouse takes its place; only in local mode, where all run on one machine, is it
    a temporary one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        alone = master == "local" or master.startswith("local[")
        path = "file://" + tempfile.mkdtemp(prefix="quillstack-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.quillstack"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Spark's setting to remove a query's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet under the shared folder and returns the table read back.

    The table outlives lost executors and goes when the application ends; the write's shuffle files go when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. A row group is one task's, so a few small files would keep a few cores busy: their rows are dealt out.

    Tables of at least as many files as cores, and large ones, are read as they are.
    """
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where)
    least, most = DEAL_BYTES
    return df.repartition(cores) if held.getFileCount() < cores and least < held.getLength() < most * cores else df
