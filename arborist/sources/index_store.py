"""Saving and loading of an index: parquet tables and the build's configuration; and JSON lines."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.hierarchy import BuildConfig

NEEDED = ("documents", "nodes", "members")


def save(folder: str, config: BuildConfig, documents: DataFrame, nodes: DataFrame, members: DataFrame, embeddings: DataFrame | None = None) -> None:
    """Writes the tables as parquet and the configuration as one row of JSON."""
    spark = documents.sparkSession
    tables = {"documents": documents, "nodes": nodes, "members": members}
    if embeddings is not None:
        tables["embeddings"] = embeddings
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.createDataFrame([(json.dumps(asdict(config)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/config")


def load(spark: SparkSession, folder: str, embeddings: bool = True) -> tuple[BuildConfig, dict[str, DataFrame]]:
    """The configuration and the tables; embeddings may be absent, the others must be there."""
    config = BuildConfig(**json.loads(spark.read.text(f"{folder}/config").first()["value"]))
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in NEEDED}
    if embeddings:
        try:
            tables["embeddings"] = spark.read.parquet(f"{folder}/embeddings")
        except Exception as e:  # Spark names a missing path only in its error
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return config, tables


def append_json(rows: DataFrame, folder: str) -> int:
    """Appends rows as JSON lines; gives their number."""
    rows.write.mode("append").json(folder)
    return rows.count()


def read_json(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines by a given schema (so that no pass infers it); blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(folder)


def save_vectors(vectors: DataFrame, key: str, folder: str) -> None:
    """Vectors (key, embedding) as parquet: queries' embeddings, or nodes' centroids, which then need no other cache."""
    vectors.select(key, F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(folder)


def load_vectors(spark: SparkSession, folder: str, expected: int | None = None) -> DataFrame | None:
    """The saved vectors; None if their number isn't the expected one, so that they are made again."""
    rows = spark.read.parquet(folder)
    return rows if expected is None or rows.count() == expected else None


def _checksum(rows: list[tuple[str, list[int], list[float]]]) -> str:
    digest = hashlib.sha256()
    for name, shape, values in sorted(rows):
        digest.update(json.dumps([name, shape]).encode() + np.asarray(values, "<f8").tobytes())
    return digest.hexdigest()


def save_weights(spark: SparkSession, weights: dict[str, np.ndarray], folder: str, notes: dict | None = None) -> str:
    """A policy's weights as rows (param, shape, values), beside one row of JSON with their checksum and notes."""
    rows = [(k, [int(n) for n in w.shape], np.asarray(w, float).ravel().tolist()) for k, w in sorted(weights.items())]
    checksum = _checksum(rows)
    spark.createDataFrame(rows, "param string, shape array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/weights")
    spark.createDataFrame([(json.dumps({"sha256": checksum, **(notes or {})}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")
    return checksum


def load_weights(spark: SparkSession, folder: str) -> tuple[dict[str, np.ndarray], dict]:
    """Weights and notes; ValueError if the weights aren't those that the checksum was made of."""
    notes = json.loads(spark.read.text(f"{folder}/meta").first()["value"])
    rows = [(r["param"], list(r["shape"]), list(r["values"])) for r in spark.read.parquet(f"{folder}/weights").collect()]
    if _checksum(rows) != notes["sha256"]:
        raise ValueError(f"the weights in {folder} don't match their checksum")
    return {name: np.array(values).reshape(shape) for name, shape, values in rows}, notes


def save_run(folder: str, results: DataFrame, traces: DataFrame, summary: dict) -> None:
    """An evaluation's results and traces as JSON lines, and its summary as one row."""
    results.write.mode("overwrite").json(f"{folder}/results")
    traces.write.mode("overwrite").json(f"{folder}/traces")
    results.sparkSession.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")
