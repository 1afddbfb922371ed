"""Training and promotion as a stream over the replay folder, in place of a polling loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def promotion_stream(
    spark: SparkSession,
    replay: str,
    schema: str,
    checkpoint: str,
    train: Callable[[DataFrame], float | None],
    registry: Callable[[], float | None],
    promote: Callable[[float], None],
    least_rows: int = 1,
    delta: float = 0.0,
    once: bool = True,
) -> StreamingQuery:
    """Runs train on the whole replay folder whenever a batch of new trajectories has least_rows; promotes if the metric
    is at least registry()'s plus delta (or nothing is promoted yet).

    With `once` the files that are there are processed and the stream ends; else it goes on.  The stream's checkpoint
    makes a restart go on after the last finished batch.
    """

    def batch(rows: DataFrame, _: int) -> None:
        if rows.limit(least_rows).count() < least_rows:
            return
        metric, baseline = train(spark.read.schema(schema).json(replay)), registry()
        if metric is not None and (baseline is None or metric >= baseline + delta):
            promote(metric)

    stream = spark.readStream.schema(schema).json(replay).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="15 minutes")).start()


def reward_windows(events: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and mean rewards by tumbling window; batch and stream alike (late rows past the watermark are dropped by a
    stream)."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), "n", "mean")
