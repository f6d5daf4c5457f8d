"""Snapshots of versioned tables: capture, chains, restore, compaction, divergence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import set_checksum
from ..functions.scores import CompactionLimits, compaction_score
from .versioned import latest

FULL, INCREMENTAL, DELTA, CHECKPOINT = "FULL", "INCREMENTAL", "DELTA", "CHECKPOINT"


def capture(records: DataFrame, sequence: int, base_sequence: int | None = None) -> DataFrame:
    """Every key's newest version up to ``sequence``, deletions included; only keys
    that changed after ``base_sequence`` for an incremental one."""
    rows = records.filter(F.col("sequence") <= sequence)
    if base_sequence is not None:
        rows = rows.filter(F.col("sequence") > base_sequence)
    return latest(rows)


def describe(records: DataFrame, sequence: int, base_sequence: int | None = None) -> DataFrame:
    """record_count (all versions) and key_count (without keys that begin with ``_``)."""
    rows = records.filter(F.col("sequence") <= sequence)
    if base_sequence is not None:
        rows = rows.filter(F.col("sequence") > base_sequence)
    plain = F.when(~F.col("key").startswith("_"), F.col("key"))
    return rows.agg(F.count(F.lit(1)).alias("record_count"), F.countDistinct(plain).alias("key_count"))


def restore(chain: list[DataFrame]) -> DataFrame:
    """The state that a base and its increments add up to: the newest version wins."""
    out = chain[0]
    for part in chain[1:]:
        out = out.unionByName(part)
    return latest(out)


def chain(snapshots: DataFrame, snapshot_id: str) -> list[str]:
    """Ids from the base to a snapshot, by following base_snapshot_id in SQL."""
    spark = snapshots.sparkSession
    snapshots.createOrReplaceTempView("_snapshots")
    rows = spark.sql(
        """
        WITH RECURSIVE up(id, base, depth) AS (
          SELECT snapshot_id, base_snapshot_id, 0 FROM _snapshots WHERE snapshot_id = :id
          UNION ALL
          SELECT s.snapshot_id, s.base_snapshot_id, depth + 1 FROM _snapshots s JOIN up ON s.snapshot_id = up.base)
        SELECT id FROM up ORDER BY depth DESC
        """,
        args={"id": snapshot_id},
    ).collect()
    return [r["id"] for r in rows]


def list_snapshots(snapshots: DataFrame, snapshot_type=None, min_sequence=None, max_sequence=None) -> DataFrame:
    out = snapshots
    if snapshot_type is not None:
        out = out.filter(F.col("snapshot_type") == snapshot_type)
    if min_sequence is not None:
        out = out.filter(F.col("sequence") >= min_sequence)
    if max_sequence is not None:
        out = out.filter(F.col("sequence") <= max_sequence)
    return out.orderBy(F.desc("sequence"))


def newest_below(snapshots: DataFrame, sequence: int, snapshot_type: str = FULL) -> DataFrame:
    rows = snapshots.filter((F.col("sequence") < sequence) & (F.col("snapshot_type") == snapshot_type))
    return rows.agg(F.max_by("snapshot_id", "sequence").alias("snapshot_id"))


def keep_newest(snapshots: DataFrame, n: int = 3) -> DataFrame:
    return snapshots.orderBy(F.desc("sequence")).limit(n)


def stats_by_type(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("snapshot_type").agg(
        F.count(F.lit(1)).alias("snapshots"), F.sum("size_bytes").alias("size_bytes"), F.sum("record_count").alias("records")
    )


def verify(snapshot: DataFrame, rows: int, checksum: int, *columns: str) -> bool:
    found = set_checksum(snapshot, *columns).first()
    return (found["rows"], found["checksum"] or 0) == (rows, checksum or 0)


def scored(snapshots: DataFrame, strategy: str, limits=CompactionLimits()) -> DataFrame:
    """``snapshots`` (with age_seconds) and their compaction score."""
    return snapshots.withColumn("score", compaction_score(strategy, F.col("age_seconds"), F.col("size_bytes"), F.col("record_count"), limits))


def compaction_candidates(snapshots: DataFrame, strategy: str, preserve_recent: int = 2, limits=CompactionLimits()) -> DataFrame:
    """Snapshots over one half by ascending score, without the last ``preserve_recent``; 0 selects none."""
    rows = scored(snapshots, strategy, limits).filter("score > 0.5")
    if preserve_recent == 0:
        return rows.filter(F.lit(False))
    kept = rows.orderBy(F.desc("score"), F.desc("snapshot_id")).limit(preserve_recent).select("snapshot_id")
    return rows.join(F.broadcast(kept), "snapshot_id", "left_anti")  # preserve_recent rows


def divergence(a: DataFrame, b: DataFrame, key: str = "key", value: str = "hash") -> DataFrame:
    """Keys of two replicas that differ: missing on either side, or another hash."""
    left, right = a.select(key, F.col(value).alias("left_hash")), b.select(key, F.col(value).alias("right_hash"))
    out = left.join(right, key, "full_outer").filter(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
    kind = F.when(F.col("left_hash").isNull(), "missing_left").when(F.col("right_hash").isNull(), "missing_right").otherwise("different")
    return out.withColumn("divergence", kind)


def write_snapshot(spark: SparkSession, records: DataFrame, folder: str, snapshot_id: str, sequence: int, base: str | None = None, base_sequence=None, now=None):
    """Write a snapshot's Parquet folder and append its row to the folder's metadata table."""
    state = capture(records, sequence, base_sequence)
    state.write.parquet(f"{folder}/data/{snapshot_id}")
    facts = describe(records, sequence, base_sequence).first()
    row = (snapshot_id, FULL if base is None else INCREMENTAL, sequence, facts["record_count"], facts["key_count"], base)
    schema = "snapshot_id string, snapshot_type string, sequence long, record_count long, key_count long, base_snapshot_id string"
    spark.createDataFrame([row], schema).withColumn("ts", F.lit(now).cast("timestamp")).write.mode("append").parquet(f"{folder}/meta")


def read_snapshot(spark: SparkSession, folder: str, snapshot_id: str) -> DataFrame:
    """The restored state of a snapshot, through its chain."""
    ids = chain(spark.read.parquet(f"{folder}/meta"), snapshot_id)
    return restore([spark.read.parquet(f"{folder}/data/{i}") for i in ids])
