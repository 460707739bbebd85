"""Cleaning of event files as they arrive, with the batch functions unchanged.

Timestamps, devices and the bot flag depend on one row only. Identity does not: a cookie's
owner may show up later, so translation and propagation stay in the batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfare.operators.cleaning import clean_events
from wayfare.operators.identity import flag_bots
from wayfare.schemas import EVENTS


def read_event_files(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files with the columns of ``schemas.EVENTS`` in that order."""
    return spark.readStream.schema(EVENTS).option("header", True).csv(folder)


def clean_arriving(events: DataFrame) -> DataFrame:
    return flag_bots(clean_events(events)).withColumn("dia", F.to_date("event_date"))


def append_clean(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a parquet table by day and stop; each file counts once."""
    return (
        clean_arriving(events)
        .writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .partitionBy("dia")
        .trigger(availableNow=True)
        .start()
    )
