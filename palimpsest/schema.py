"""Envelopes, and adapters from the star-schema test tables to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATA, TOMBSTONE = "DATA", "TOMBSTONE"
RECORD_TYPES = ("DATA", "TOMBSTONE", "CHECKPOINT", "METADATA", "BATCH_HEADER", "BATCH_FOOTER")

RECORDS = (
    "key STRING, sequence BIGINT, ts TIMESTAMP, record_type STRING, value STRING,"
    " headers MAP<STRING,STRING>, checksum STRING"
)
LOG_EVENTS = (
    "topic STRING, key STRING, value STRING, ts TIMESTAMP, sequence BIGINT, headers MAP<STRING,STRING>,"
    " event_id STRING, partition INT"
)
DOMAIN_EVENTS = (
    "event_id STRING, event_type STRING, aggregate_id STRING, aggregate_type STRING, ts TIMESTAMP, sequence BIGINT,"
    " version INT, metadata STRING, payload STRING, causation_id STRING, correlation_id STRING"
)
SNAPSHOTS = (
    "snapshot_id STRING, snapshot_type STRING, sequence BIGINT, ts TIMESTAMP, size_bytes BIGINT, record_count BIGINT,"
    " key_count BIGINT, base_snapshot_id STRING"
)
HLC = "STRUCT<physical: DOUBLE, logical: BIGINT, node_id: STRING>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with an instant for ``ts`` and an exact ``value``."""
    e = table(spark, sf_dir, "events")
    return e.withColumns({"ts": F.col("ts").cast("timestamp"), "value": F.col("value").cast("decimal(18,2)")})


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of one key per user; an error event deletes the key."""
    dead = F.col("event_type") == "error"
    return events(spark, sf_dir).select(
        F.concat(F.lit("user:"), "user_id").alias("key"),
        F.col("event_id").alias("sequence"),
        "ts",
        F.when(dead, TOMBSTONE).otherwise(DATA).alias("record_type"),
        F.when(~dead, F.col("value")).alias("value"),
        "event_type",
    )


def domain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as domain events of one account per user."""
    return events(spark, sf_dir).select(
        F.concat(F.lit("account:"), "user_id").alias("aggregate_id"),
        F.lit("account").alias("aggregate_type"),
        "event_type",
        F.col("event_id").alias("sequence"),
        "ts",
        "value",
    )


def replica_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations of three replicas, with a hybrid logical clock each."""
    node = F.concat(F.lit("node"), F.col("event_id") % 3)
    return events(spark, sf_dir).select(
        F.concat(F.lit("user:"), "user_id").alias("key"),
        F.col("event_id").alias("idx"),
        node.alias("node"),
        F.struct(F.unix_micros("ts").alias("physical"), F.lit(0).cast("long").alias("logical"), node.alias("node_id")).alias("hlc"),
        "event_type",
        "value",
    )
