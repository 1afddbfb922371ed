"""Text encoders with a cache of vectors by content.

A vector is stored under the SHA-256 of its text and the encoder's name.  Encoding a table looks its distinct texts up, encodes
those alone that aren't there, by an iterator function that makes its model once a task, and adds them as one more set of
files, so that a run that fails adds nothing.  Changed texts have other digests.

Cases: a null text is the empty text; repeated texts are encoded once; another encoder's name is another cache; two runs at the
same time may both add a text's vector, and either is taken.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_embedding
from .layout import stored

#: Makes a model in a task: a function from a list of texts to vectors.
Factory = Callable[[], Callable[[list[str]], np.ndarray]]


def passage(docs: DataFrame):
    """What is encoded of a document: title and text, as far as there are both."""
    title = F.coalesce(F.col("title"), F.lit("")) if "title" in docs.columns else F.lit("")
    return F.trim(F.concat_ws("\n", F.when(title != "", title), F.coalesce("text", F.lit(""))))


class Encoder:
    """A named encoder; vectors are kept in folder (none: in the shared folder, for this encoder alone)."""

    def __init__(self, name: str, size: int, factory: Factory | None = None, folder: str | None = None):
        if size < 1:
            raise ValueError("vectors have at least one number")
        self.name, self.size, self.factory, self.folder = name, size, factory, folder

    def _vectors(self, texts: DataFrame) -> DataFrame:
        """(digest, embedding) of texts (digest, text)."""
        if self.factory is None:  # hashed words, within the JVM
            return texts.select("digest", hash_embedding(F.col("text"), self.size).alias("embedding"))
        factory, size = self.factory, self.size

        def run(batches):
            model = factory()
            for batch in batches:
                if not len(batch):
                    continue
                vectors = np.asarray(model(batch["text"].tolist()), float)
                if vectors.shape != (len(batch), size):
                    raise ValueError(f"the encoder gave {vectors.shape} for {len(batch)} texts of {size} numbers")
                yield pd.DataFrame({"digest": batch["digest"], "embedding": list(vectors)})

        return texts.mapInPandas(run, "digest string, embedding array<double>")

    def _cache(self, spark: SparkSession) -> DataFrame:
        schema = "digest string, embedding array<double>, name string"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        rows = spark.read.schema(schema).parquet(self.folder) if there else spark.createDataFrame([], schema)
        return rows.where(F.col("name") == self.name).select("digest", "embedding")

    def encode(self, rows: DataFrame, key: str, text="text") -> tuple[DataFrame, int]:
        """(key, embedding) of rows, and how many texts were encoded for it."""
        spark = rows.sparkSession
        if self.folder is None:
            from .layout import new_folder

            self.folder = new_folder(spark, f"vectors-{self.name}")
        column = F.col(text) if isinstance(text, str) else text
        named = rows.select(key, F.coalesce(column, F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
        new = named.select("digest", "text").join(self._cache(spark).select("digest").distinct(), "digest", "left_anti").dropDuplicates(["digest"])
        made = stored(self._vectors(new))
        n = made.count()
        if n:
            made.withColumn("name", F.lit(self.name)).write.mode("append").parquet(self.folder)
        held = self._cache(spark).groupBy("digest").agg(F.first("embedding").alias("embedding"))
        return named.select(key, "digest").join(held, "digest").select(key, "embedding"), n


__all__ = ["Encoder", "passage"]
