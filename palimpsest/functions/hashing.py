"""Partition numbers, checksums and state hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partition_of(key: Column, partitions: int) -> Column:
    """md5(key), read as a 128-bit integer, modulo ``partitions``; 0 for a null key.

    The two halves are reduced apart, as no SQL integer holds 128 bits.
    """
    digest = F.md5(key.cast("binary"))
    high, low = (F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17))
    wrap = (1 << 64) % partitions
    part = ((high % partitions) * wrap + low % partitions) % partitions
    return F.coalesce(part.cast("int"), F.lit(0))


def canonical(*columns: Column) -> Column:
    """One string for several values; nulls are kept apart from empty strings."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns])


def checksum(*columns: Column) -> Column:
    return F.sha2(canonical(*columns), 256)


def set_checksum(df: DataFrame, *columns: str) -> DataFrame:
    """(rows, checksum) of a table, whatever its rows' order: partial sums merge on the map side."""
    h = F.xxhash64(*columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("checksum"))


def state_hash(df: DataFrame, key: str, value_hash: str, buckets: int = 256, fan: int = 256) -> DataFrame:
    """SHA-256 of the sorted (key, hash) pairs, by way of ``buckets`` bucket hashes.

    Each bucket hashes its own sorted pairs, so no task needs them all; choose
    ``buckets`` so that one holds some ten thousand keys.  More than ``fan`` of
    them are hashed ``fan`` at a time, level by level, to the one at the top.
    """
    pair = F.concat(key, F.lit(":"), value_hash)
    per = df.groupBy(F.pmod(F.crc32(F.col(key).cast("binary")), F.lit(buckets)).cast("int").alias("bucket")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(pair)), ","), 256).alias("h")
    )
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), ",")
    while buckets > fan:
        per = per.groupBy(F.floor(F.col("bucket") / fan).cast("int").alias("up")).agg(F.sha2(top, 256).alias("h")).withColumnRenamed("up", "bucket")
        buckets = -(-buckets // fan)
    return per.agg(F.sha2(top, 256).alias("state_hash"))
