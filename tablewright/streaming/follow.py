"""Structured Streaming over files that keep arriving. Cleaning steps that look at one row at a time run as they are; the others are refused."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewright.dataset import Dataset
from tablewright.functions.exprs import col
from tablewright.operators.cleaning import CleaningAction, CleaningError, replay


def arriving(spark: SparkSession, folder: str, schema: str, kind: str = "parquet", most_files: int = 1_000) -> DataFrame:
    """The files of a folder as a stream, at most so many per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).format(kind).load(folder)


def cleaned(stream: DataFrame, batches: Iterable[Sequence[CleaningAction]]) -> DataFrame:
    """The stream after a history of cleaning batches."""
    batches = [tuple(b) for b in batches]
    for a in (a for batch in batches for a in batch):
        if a.kind == "drop_duplicates" or a.kind == "convert_numeric" and "whole" not in dict(a.parameters):
            raise CleaningError(f"{a.action_id} needs all rows at once and can't run on a stream")
    return replay(Dataset(stream), batches).frame


def counts(stream: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """period, by, count per window of event time; what comes later than ``late`` is left out, so the state is bounded."""
    known = stream.withWatermark(time, late)
    made = known.groupBy(F.window(col(time), window).alias("w"), col(by)).agg(F.count(F.lit(1)).alias("count"))
    return made.select(F.col("w.start").alias("period"), col(by), "count")


def append(stream: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes the stream as Parquet, each row once; ``once`` stops when all that is there was read."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", target)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
