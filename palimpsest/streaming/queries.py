"""Structured Streaming forms of the windowed, projected and stateful operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import shared_folder
from ..operators.windows import aggregate, window_column

ON_CLOSE, ON_WATERMARK, ON_EVERY_EVENT, ON_COUNT, ON_TIMEOUT = "ON_CLOSE", "ON_WATERMARK", "ON_EVERY_EVENT", "ON_COUNT", "ON_TIMEOUT"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for checkpoints and sinks where all machines see it."""
    return shared_folder(spark, name)


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events table as a file stream, with an instant for ``ts``."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(sf_dir)
    return rows.withColumns({"ts": F.col("ts").cast("timestamp"), "value": F.col("value").cast("decimal(18,2)")})


def windowed_stream(stream: DataFrame, kind: str, aggregations, size=None, step=None, by=None, cutoff="0 seconds", arrival="event_id") -> DataFrame:
    """A row for each window; late rows beyond ``cutoff`` are dropped by the watermark.

    Output mode append emits a window once the watermark passes its end
    (ON_CLOSE, ON_WATERMARK); update emits it with every micro-batch that
    changes it (ON_EVERY_EVENT).
    """
    by = by or []
    column = window_column(kind, size, step)
    grouped = stream.withWatermark("ts", cutoff).groupBy(*by, *([column] if column is not None else []))
    out = grouped.agg(*[aggregate(a, arrival=arrival) for a in aggregations])
    if column is None:
        return out
    names = [a if isinstance(a, str) else a[0] for a in aggregations]
    return out.select(*by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *names)


def output_mode(trigger: str) -> str:
    known = {ON_CLOSE: "append", ON_WATERMARK: "append", ON_EVERY_EVENT: "update", ON_COUNT: "update", ON_TIMEOUT: "update"}
    if trigger not in known:
        raise ValueError(f"unknown trigger: {trigger}")
    return known[trigger]


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over what is there and read its Parquet sink."""
    spark = stream.sparkSession
    folder = work_dir(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/out").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_batches(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Pass every micro-batch to ``each(batch, batch_id)``, at least once."""
    folder = work_dir(stream.sparkSession, name)
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def project_stream(stream: DataFrame, name: str, changes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A projection kept by micro-batches: the changes of all batches.

    Each batch's changes go to a folder named by its id, which a repeated batch
    overwrites, so that every batch counts exactly once.
    """
    spark = stream.sparkSession
    folder = work_dir(spark, name)

    def each(batch: DataFrame, batch_id: int) -> None:
        changes(batch).write.mode("overwrite").parquet(f"{folder}/state/batch_id={batch_id}")

    run_batches(stream, name, each)
    return spark.read.parquet(f"{folder}/state").drop("batch_id")


def subscribe(stream: DataFrame, event_type: str, handler: Callable[[dict], None]) -> None:
    """Pass events of one type to a handler; its errors are swallowed, as those of any subscriber."""

    def each(batch: DataFrame, _: int) -> None:
        for row in batch.filter(F.col("event_type") == event_type).toLocalIterator():
            try:
                handler(row.asDict())
            except Exception:  # one subscriber must not stop the stream
                continue

    run_batches(stream, "subscribe", each)


def emit_on_count(stream: DataFrame, by: str, n: int) -> DataFrame:
    """ON_COUNT: a row (key, emitted, total) for every ``n`` events of a key, from keyed state."""
    from pyspark.sql.streaming import StatefulProcessor

    class Counting(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("state", "n bigint, total double, emitted bigint")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            held, total, emitted = self.state.get() if self.state.exists() else (0, 0.0, 0)
            out = []
            for pdf in rows:
                for v in pdf["value"]:
                    held, total = held + 1, total + float(v)
                    if held == n:
                        emitted += 1
                        out.append((key[0], emitted, round(total, 2)))
                        held, total = 0, 0.0
            self.state.update((held, total, emitted))
            yield pd.DataFrame(out, columns=["key", "emitted", "total"])

        def close(self) -> None:
            pass

    rows = stream.select(F.col(by).cast("string").alias("key"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(Counting(), "key string, emitted bigint, total double", "append", "none")


def emit_on_timeout(stream: DataFrame, by: str, timeout_ms: int) -> DataFrame:
    """ON_TIMEOUT: a row (key, n) once a key's event time stands still for ``timeout_ms``."""
    from pyspark.sql.streaming import StatefulProcessor

    class Idle(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("state", "n bigint, due bigint")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            n, due = self.state.get() if self.state.exists() else (0, 0)
            last = 0
            for pdf in rows:
                n += len(pdf)
                last = max(last, int(pdf["at"].max()))
            if due:
                self.handle.deleteTimer(due)
            due = max(due, last + timeout_ms)
            self.handle.registerTimer(due)
            self.state.update((n, due))
            yield pd.DataFrame({"key": pd.Series(dtype=str), "n": pd.Series(dtype="int64")})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            n, _ = self.state.get()
            self.state.clear()
            yield pd.DataFrame({"key": [key[0]], "n": [n]})

        def close(self) -> None:
            pass

    rows = stream.withWatermark("ts", "0 seconds").select(F.col(by).cast("string").alias("key"), "ts", F.unix_millis("ts").alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(Idle(), "key string, n bigint", "append", "eventTime")
