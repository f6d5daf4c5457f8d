"""An append-only store of versions in Parquet, and its sidecars."""

from __future__ import annotations

import json
import struct
import threading
import time
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import checksum
from ..operators import versioned
from ..schema import DATA, RECORDS, TOMBSTONE

SEGMENT_RECORDS = 1_000_000


class AppendOnlyStore:
    """Versions under ``path``; every append is one atomic Spark write.

    Values are JSON strings.  Sequences continue after the highest one in the
    store; within an append they follow the given order.  Writers take turns:
    an append holds a lock file beside the store while it numbers and writes.
    A writer that died leaves it behind; ``unlock`` removes it.
    """

    _turn = threading.Lock()

    def __init__(self, spark: SparkSession, path: str, create_if_missing: bool = True, segment_records: int = SEGMENT_RECORDS):
        self.spark, self.path, self.segment_records = spark, path, segment_records
        if create_if_missing and not self._exists():
            self.append_table(spark.createDataFrame([], RECORDS))

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    @contextmanager
    def _lock(self, timeout: float = 120.0):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}._lock")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        until = time.monotonic() + timeout
        with self._turn:  # threads of this process; the file keeps other processes out
            while True:
                try:
                    fs.create(path, False).close()  # fails if it is there
                    break
                except Py4JJavaError:
                    if time.monotonic() > until:
                        raise TimeoutError(f"another writer holds {self.path}._lock") from None
                    time.sleep(0.05)
            try:
                yield
            finally:
                fs.delete(path, False)

    def unlock(self) -> None:
        """Remove the lock of a writer that died."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}._lock")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)

    @property
    def records(self) -> DataFrame:
        return self.spark.read.schema(RECORDS).parquet(self.path)

    def append_table(self, records: DataFrame) -> None:
        records.write.option("maxRecordsPerFile", self.segment_records).mode("append").parquet(self.path)

    def append(self, rows: list[tuple], ts=None) -> None:
        """Append (key, value, record_type, headers) tuples; values are any JSON."""
        with self._lock():
            self._append(rows, ts)

    def _append(self, rows: list[tuple], ts) -> None:
        top = self.records.agg(F.max("sequence")).first()[0]
        top = 0 if top is None else top
        data = [(k, top + n + 1, None if v is None else json.dumps(v, sort_keys=True, default=str), t, h) for n, (k, v, t, h) in enumerate(rows)]
        df = self.spark.createDataFrame(data, "key string, sequence long, value string, record_type string, headers map<string,string>")
        df = df.withColumn("ts", F.lit(ts).cast("timestamp") if ts is not None else F.current_timestamp())
        self.append_table(with_checksum(df).select(*[f.name for f in T._parse_datatype_string(RECORDS).fields]))

    def put(self, key: str, value, headers: dict | None = None, ts=None) -> None:
        self.append([(key, value, DATA, headers)], ts)

    def put_many(self, values: dict, ts=None) -> None:
        self.append([(k, v, DATA, None) for k, v in values.items()], ts)

    def delete(self, key: str, ts=None) -> None:
        self.append([(key, None, TOMBSTONE, None)], ts)

    def get(self, key: str):
        rows = versioned.latest(self.records.filter(F.col("key") == key)).collect()
        return rows[0] if rows else None

    def verify(self) -> DataFrame:
        """Versions whose stored checksum is not that of their content."""
        return self.records.filter(~record_checksum().eqNullSafe(F.col("checksum")))

    def compact_to(self, path: str) -> None:
        versioned.compact(self.records).write.parquet(path)


def record_checksum():
    heads = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))))))
    return checksum(F.col("key"), F.col("value"), F.col("sequence"), F.unix_micros("ts"), F.col("record_type"), heads)


def with_checksum(df: DataFrame) -> DataFrame:
    return df.withColumn("checksum", record_checksum())


def frame(record: dict) -> bytes:
    """A record as a big-endian length and JSON, the log files' framing."""
    data = json.dumps(record).encode()
    return struct.pack(">I", len(data)) + data


def read_framed(spark: SparkSession, path: str) -> DataFrame:
    """Records of framed JSON files: a row for each, the JSON as ``body``."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                at, out = 0, []
                while at + 4 <= len(content):
                    (n,) = struct.unpack_from(">I", content, at)
                    out.append((name, at, bytes(content[at + 4 : at + 4 + n]).decode()))
                    at += 4 + n
                yield pd.DataFrame(out, columns=["file", "offset", "body"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, offset long, body string")


def to_domain_event(events: DataFrame) -> DataFrame:
    """(type, data) with the whole event as JSON."""
    return events.select(F.col("event_type").alias("type"), F.to_json(F.struct(*events.columns)).alias("data"))


def save_read_model(state: DataFrame, path: str, compression: str = "snappy") -> None:
    state.write.mode("overwrite").option("compression", compression).parquet(path)


def load_read_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_dead_letters(letters: DataFrame, path: str) -> None:
    letters.write.mode("append").parquet(path)
