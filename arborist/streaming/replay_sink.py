"""A replay folder and a registry that a stream may write to again after a failure.

Batches of trajectories go to a folder of their own, named by the batch's number, which a repeated batch replaces; so a batch
that is run again changes nothing.  The registry is one small JSON file; a change writes a new file and renames it over the
old one, which the file system does at once, so readers see the versions before or after it, and never two that are promoted.
A version that is added again replaces itself.  Changes come from one writer at a time, the stream's driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


class Replay:
    """Trajectories by batch in a folder of JSON lines."""

    def __init__(self, folder: str, schema: str):
        self.folder, self.schema = folder, schema

    def put(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").json(f"{self.folder}/batch={batch}")

    def extend(self, rows: DataFrame) -> None:
        """Adds rows outside a stream, under a number of their own."""
        rows.write.mode("error").json(f"{self.folder}/batch={uuid.uuid4().int >> 66}")

    def load(self, spark: SparkSession) -> DataFrame:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).option("basePath", self.folder).json(f"{self.folder}/batch=*").drop("batch")


class Registry:
    """Versions (version, metric, batch, promoted and notes) of which one at most is promoted."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def versions(self) -> list[dict]:
        fs = self._path("registry.json").getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(self._path("registry.json")):
            return []
        return json.loads(self.spark.read.option("wholetext", "true").text(f"{self.folder}/registry.json").first()["value"])

    def current(self) -> dict | None:
        return next((v for v in self.versions() if v["promoted"]), None)

    def add(self, version: str, metric: float, promote: bool, **notes) -> None:
        """The version in place of a like-named one; if it is promoted, no other is."""
        kept = [v | {"promoted": v["promoted"] and not promote} for v in self.versions() if v["version"] != version]
        self._swap([*kept, {"version": version, "metric": metric, "promoted": promote, **notes}])

    def _swap(self, versions: list[dict]) -> None:
        jvm, target = self.spark._jvm, self._path("registry.json")
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        new = self._path(f".registry-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(versions, sort_keys=True).encode()))
        out.close()
        options = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, target, options)


def learn_stream(stream: DataFrame, replay: Replay, registry: Registry, train: Callable[[DataFrame], float | None], checkpoint: str, delta: float = 0.0, once: bool = True) -> StreamingQuery:
    """Stores each batch, trains on the whole replay, and promotes a version (named by the batch) that is better by delta.

    A batch that is run again stores the same rows, and its version replaces the one it may have left.
    """

    def batch(rows: DataFrame, number: int) -> None:
        replay.put(rows, number)
        name = f"batch-{number}"
        base = max((v["metric"] for v in registry.versions() if v["promoted"] and v["version"] != name), default=None)
        metric = train(replay.load(rows.sparkSession))
        if metric is not None:
            registry.add(name, metric, base is None or metric >= base + delta, batch=number)

    out = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="15 minutes")).start()


__all__ = ["Registry", "Replay", "learn_stream"]
