"""How tables are laid out over tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def spread(scan: DataFrame) -> DataFrame:
    """A scan over at least as many tasks as there are cores.

    A table of few files or row groups keeps most cores idle where rows are expensive, as texts are.  Only a scan of fewer
    partitions than cores is dealt anew, which bounds what is shuffled; larger ones stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = f"file://{tempfile.mkdtemp(prefix='arborist-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/arborist/{what}-{uuid.uuid4().hex}"


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of a table's files, which tell whether what was made of it is still up to date."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def stored(df: DataFrame, *by: str) -> DataFrame:
    """df written to the shared folder, a folder for each value of `by`, and read again: its lineage is cut."""
    spark = df.sparkSession
    path = new_folder(spark, "table")
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with numbers from 0 by a column's order; ranges are numbered apart, so no task takes all rows."""
    rows = stored(df.repartitionByRange(by).withColumn("_slice", F.spark_partition_id()))
    sizes = rows.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_slice", F.coalesce(before, F.lit(0)).alias("_before"))  # a row a partition
    at = F.row_number().over(Window.partitionBy("_slice").orderBy(by)) - 1
    return rows.join(sizes, "_slice").withColumn(name, at + F.col("_before")).drop("_slice", "_before")
