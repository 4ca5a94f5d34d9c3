"""Streaming forms: bucket counts with a watermark, per-account history as state, and daily scoring by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ORIGIN = "2024-01-01 00:00:00"


def with_event_time(events: DataFrame) -> DataFrame:
    """``ts`` from the log's seconds."""
    return events.withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.lit(ORIGIN)) + F.col("Time")))


def bucket_counts(events: DataFrame, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """Events and failures per account and fixed bucket; late rows are taken up to the watermark."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", f"{minutes} minutes"), "DomainName", "UserName")
        .agg(F.count("*").alias("n"), F.count_if(F.col("EventID") == 4625).alias("failures"))
        .select(F.col("window.start").alias("start"), "DomainName", "UserName", "n", "failures")
    )


def failure_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of failures with no longer pause than ``gap``."""
    return (
        events.filter("EventID = 4625")
        .withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "DomainName", "UserName")
        .agg(F.count("*").alias("failures"))
        .select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "DomainName", "UserName", "failures")
    )


def new_sources(events: DataFrame) -> DataFrame:
    """Every first sight of a source by an account. State: one flag for each account and source."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = min(int(frame["Time"].min()) for frame in frames)
        out = [] if state.exists else [(key[0], key[1], first, key[2])]
        state.update((True,))
        yield pd.DataFrame(out, columns=["DomainName", "UserName", "Time", "Source"])

    schema = "DomainName string, UserName string, Time long, Source string"
    known = events.filter("Source <> ''").select("DomainName", "UserName", "Source", "Time")
    return known.groupBy("DomainName", "UserName", "Source").applyInPandasWithState(step, schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def score_by_batch(events: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Each micro-batch is scored as a table and written under its own number, so a repeated batch replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
