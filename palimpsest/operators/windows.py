"""Windowed aggregation over points (ts, value, and an arrival order).

The same column builders serve batch and streaming; see ``streaming`` for the
latter.  Windows are half open and epoch aligned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ranges

TUMBLING, SLIDING, SESSION, GLOBAL = "TUMBLING", "SLIDING", "SESSION", "GLOBAL"


def aggregate(name: str | tuple[str, Callable], value: str = "value", arrival: str = "arrival") -> Column:
    """An aggregate by name, or from a (name, callable) pair; unknown names are errors.

    ``count`` counts null values too; ``first`` and ``last`` go by arrival, as
    does the list of ``collect``.
    """
    if isinstance(name, tuple):
        return name[1](F.col(value)).alias(name[0])
    v = F.col(value)
    known = {
        "count": lambda: F.count(F.lit(1)),
        "sum": lambda: F.sum(v),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "avg": lambda: F.avg(v),
        "first": lambda: F.min_by(v, arrival),
        "last": lambda: F.max_by(v, arrival),
        "collect": lambda: F.transform(F.array_sort(F.collect_list(F.struct(F.col(arrival).alias("o"), v.alias("v")))), lambda x: x["v"]),
    }
    if name not in known:
        raise ValueError(f"unknown aggregation: {name}")
    return known[name]().alias(name)


def window_column(kind: str, size: str | None = None, step: str | None = None, ts: str = "ts") -> Column | None:
    if kind == TUMBLING:
        return F.window(ts, size).alias("w")
    if kind == SLIDING:
        return F.window(ts, size, step).alias("w")
    if kind == SESSION:
        return F.session_window(ts, size).alias("w")
    if kind == GLOBAL:
        return None
    raise ValueError(f"unknown window type: {kind}")


def windowed(points: DataFrame, kind: str, aggregations, size=None, step=None, by: list[str] | None = None, arrival="arrival") -> DataFrame:
    """A row for each window (and key): window_start, window_end and the aggregates."""
    aggs = [aggregate(a, arrival=arrival) for a in aggregations]
    by = by or []
    column = window_column(kind, size, step)
    if column is None:
        return points.groupBy(*by).agg(*aggs)
    out = points.groupBy(*by, column).agg(*aggs)
    names = [a if isinstance(a, str) else a[0] for a in aggregations]
    return out.select(*by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *names)


def window_id(kind: str, start: Column) -> Column:
    return F.concat(F.lit(f"{kind.lower()}_"), F.unix_seconds(start))


def sliding_as_coded(points: DataFrame, size: int, step: int) -> DataFrame:
    """Windows anchored at each event, ``start = ts - size + step + k * step``, ids in whole seconds.

    Adds window_second.  A step over the size gives no window.
    """
    n = size // step
    if n == 0:
        return points.withColumn("window_second", F.lit(0).cast("long")).filter(F.lit(False))
    at = F.unix_micros("ts") - size * 1_000_000 + step * 1_000_000
    starts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor((at + k * (step * 1_000_000)) / 1_000_000))
    return points.withColumn("window_second", F.explode(starts))


def session_bucket_as_coded(ts: Column, gap_seconds: int) -> Column:
    """The fixed bucket that stands for a session in the simplified assigner."""
    return F.floor(F.unix_micros(ts) / (gap_seconds * 1_000_000)).cast("long")


def every_event(points: DataFrame, by: list[str], arrival: str = "arrival") -> DataFrame:
    """The state after each event: running count and sum of its key."""
    w = Window.partitionBy(*by).orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumns({"running_count": F.count(F.lit(1)).over(w), "running_sum": F.sum("value").over(w)})


def with_watermark_and_late(points: DataFrame, size: int, cutoff: float = 0.0, arrival: str = "arrival", block: Column | None = None) -> DataFrame:
    """Adds watermark (running maximum of ts by arrival) and late.

    A global running maximum would need all rows in one task; instead arrival is
    cut into ranges, or blocks if ``block`` is given (it must rise with arrival),
    each takes its own running maximum, and the maxima of earlier ones, a row
    each, are added.
    """
    dealt = ranges.cut(points, arrival, name="_block") if block is None else points.withColumn("_block", block)
    tops = dealt.groupBy("_block").agg(F.max("ts").alias("_top"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    prior = tops.select("_block", F.max("_top").over(before).alias("_prior"))
    own = Window.partitionBy("_block").orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("watermark", F.max("ts").over(own)).join(prior, "_block")
    out = out.withColumn("watermark", F.greatest("watermark", "_prior")).drop("_block", "_prior")
    end = (F.floor(F.unix_micros("ts") / (size * 1_000_000)) + 1) * size * 1_000_000
    return out.withColumn("late", end <= F.unix_micros("watermark") - F.lit(int(cutoff * 1_000_000)))


def time_series(points: DataFrame, interval: str, aggregations=("count", "sum", "avg", "min", "max"), by=None, arrival="arrival") -> DataFrame:
    return windowed(points, TUMBLING, list(aggregations), interval, by=by, arrival=arrival)


def newest(results: DataFrame) -> DataFrame:
    """The result of the latest window."""
    return results.orderBy(F.desc("window_start")).limit(1)


def earliest_end(results: DataFrame) -> DataFrame:
    return results.agg(F.min("window_end").alias("earliest_end"))


def close_early(points: DataFrame, kind: str, aggregations, start, size: str, step: str | None = None, arrival: str = "arrival") -> DataFrame:
    """The result of the window that begins at ``start``, from what has arrived so far."""
    out = windowed(points, kind, aggregations, size, step, arrival=arrival)
    return out.filter(F.col("window_start") == F.lit(start))
