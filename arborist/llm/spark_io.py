"""Reading tables, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session names it; only where it is unset (tests), a temporary folder is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="arborist-")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/arborist/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut, and losing an executor loses nothing."""
    spark = df.sparkSession
    at = new_folder(spark, what)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


class Scratch:
    """Tables of one job in the shared folder, which are deleted when they aren't needed any more."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.at, self.names = spark, new_folder(spark, what), []

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """As stored()."""
        at = f"{self.at}/{len(self.names)}-{name}"
        self.names.append(at)
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out.kept_at = at
        return out

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(table.kept_at)

    def keep_only(self, *tables: DataFrame) -> None:
        for at in set(self.names) - {t.kept_at for t in tables}:
            self._delete(at)


def plain(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 ... by place, so that names that clash (but for case, or at all) don't matter."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns alone, cast to kinds; of columns with one name the first that has it exactly."""
    numbered = plain(df)
    return numbered.select(*(F.col(f"c{df.columns.index(name)}").cast(kind).alias(name) for name, kind in kinds.items()))


def documents_only(df: DataFrame) -> DataFrame:
    return pick(df, doc_id="bigint", text="string")


def held_out(mod: int, rest: int, doc_id="doc_id"):
    """crc32(doc_id as text) mod `mod` is `rest`; a null id counts as the text ''."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % mod == rest
