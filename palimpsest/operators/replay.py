"""Filtered replay with batches, retries and dead letters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ranges


@dataclass(frozen=True)
class ReplayFilter:
    """All given conditions hold; empty lists and None do not restrict (0 does)."""

    event_types: tuple[str, ...] = ()
    aggregate_ids: tuple[str, ...] = ()
    aggregate_types: tuple[str, ...] = ()
    correlation_ids: tuple[str, ...] = ()
    start_time: object = None
    end_time: object = None
    start_sequence: int | None = None
    end_sequence: int | None = None
    custom: Column | None = field(default=None, compare=False)

    def column(self) -> Column:
        out = F.lit(True)
        for name in ("event_type", "aggregate_id", "aggregate_type", "correlation_id"):
            if values := getattr(self, f"{name}s"):
                out = out & F.col(name).isin(*values)
        for low, high, name in (("start_time", "end_time", "ts"), ("start_sequence", "end_sequence", "sequence")):
            if getattr(self, low) is not None:
                out = out & (F.col(name) >= F.lit(getattr(self, low)))
            if getattr(self, high) is not None:
                out = out & (F.col(name) <= F.lit(getattr(self, high)))
        return out if self.custom is None else out & self.custom


def iter_events(events: DataFrame, where: ReplayFilter, start_sequence: int = 0) -> DataFrame:
    return events.filter((F.col("sequence") >= start_sequence) & where.column())


def batches(events: DataFrame, size: int = 100, by: str | None = None) -> DataFrame:
    """Adds batch: numbers of ``size`` events in order of sequence, per ``by`` or over all.

    Over all, events are numbered inside ranges of sequences and after the
    counts of the ranges before, so no task holds them all.
    """
    if by:
        rank = F.row_number().over(Window.partitionBy(by).orderBy("sequence")) - 1
        return events.withColumn("batch", F.floor(rank / size))
    dealt = ranges.cut(events, "sequence", name="_block")
    sizes = dealt.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy("_block").orderBy("sequence")) - 1
    out = dealt.withColumn("_local", local).join(sizes.select("_block", before.alias("_before")), "_block")
    return out.withColumn("batch", F.floor((F.col("_local") + F.col("_before")) / size)).drop("_block", "_local", "_before")


def rate(processed: Column, started: Column, ended: Column) -> list[Column]:
    """duration (seconds, to the microsecond) of a replay and events_per_second, 0 if it took no time."""
    took = (F.unix_micros(ended) - F.unix_micros(started)) / 1e6
    return [took.alias("duration"), F.when(took > 0, processed / took).otherwise(0.0).alias("events_per_second")]


def metrics(events: DataFrame, failed: Column) -> DataFrame:
    """processed, failed, skipped (none ever is), first and last sequence of a replay."""
    return events.agg(
        F.count_if(~failed).alias("processed"), F.count_if(failed).alias("failed"), F.lit(0).cast("long").alias("skipped"),
        F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"),
    )


def run(events: DataFrame, handler: Callable[[dict], None], retries: int = 3, columns: list[str] | None = None, stop_on_error: bool = False) -> DataFrame:
    """Pass every event to a handler: the event, status, attempts, error and error_type.

    A failing event is tried once and then ``retries`` times; a success on the
    way counts as none failed.  Events stay in their partitions; repartition by
    aggregate and sort first where an aggregate's order matters.
    """
    columns = columns or events.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.select(*columns).schema.fields)

    def go(frames):
        for pdf in frames:
            status, attempts, errors, kinds = [], [], [], []
            for row in pdf.to_dict("records"):
                error = None
                for n in range(1, retries + 2):
                    try:
                        handler(row)
                        error = None
                        break
                    except Exception as e:  # the handler's own
                        error = e
                if error is not None and stop_on_error:
                    raise error
                status.append("ok" if error is None else "dead")
                attempts.append(n)
                errors.append(None if error is None else str(error))
                kinds.append(None if error is None else type(error).__name__)
            yield pdf.assign(status=status, attempts=attempts, error=errors, error_type=kinds)

    return events.select(*columns).mapInPandas(go, f"{fields}, status string, attempts int, error string, error_type string")


def dead_letters(events: DataFrame, failed: Column, error: str = "handler failed", error_type: str = "ValueError", retries: int = 3) -> DataFrame:
    """The quarantine rows of events for which a condition makes the handler fail."""
    return events.filter(failed).withColumns(
        {"error": F.lit(error), "error_type": F.lit(error_type), "retry_count": F.lit(retries), "first_failed_at": F.col("ts"), "last_failed_at": F.col("ts")}
    )


def select_dead_letters(letters: DataFrame, event_type: str | None = None, since=None) -> DataFrame:
    out = letters if event_type is None else letters.filter(F.col("event_type") == event_type)
    return out if since is None else out.filter(F.col("first_failed_at") >= F.lit(since))


def dead_letter_stats(letters: DataFrame) -> DataFrame:
    return letters.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def retry_dead_letters(letters: DataFrame, handler: Callable[[dict], None], retries: int = 0) -> tuple[DataFrame, DataFrame]:
    """(recovered, still dead) after passing the letters' events to a handler again."""
    names = [c for c in letters.columns if c not in ("error", "error_type", "status", "attempts")]
    out = run(letters, handler, retries, names)
    return out.filter("status = 'ok'"), out.filter("status = 'dead'")


def resume(events: DataFrame, checkpoint_sequence: int | None) -> DataFrame:
    """What is left after a checkpoint; everything without one."""
    return events if checkpoint_sequence is None else events.filter(F.col("sequence") > checkpoint_sequence)
