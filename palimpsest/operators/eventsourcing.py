"""Event streams of aggregates: versions, guarded appends, folds, commands."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def by_aggregate():
    return Window.partitionBy("aggregate_id").orderBy("sequence")


class ConcurrencyError(RuntimeError):
    """An aggregate is not at the version that an append expected."""


def with_versions(events: DataFrame) -> DataFrame:
    """Each aggregate's events numbered from 1 in order of sequence."""
    return events.withColumn("version", F.row_number().over(by_aggregate()))


def aggregate_versions(events: DataFrame) -> DataFrame:
    """The newest version of every aggregate, that is its number of events."""
    return events.groupBy("aggregate_id").agg(F.count(F.lit(1)).alias("version"))


def events_of(events: DataFrame, aggregate_id: str, from_version: int = 0) -> DataFrame:
    """Events after ``from_version`` of exactly this aggregate, in order."""
    return with_versions(events.filter(F.col("aggregate_id") == aggregate_id)).filter(F.col("version") > from_version).orderBy("version")


def all_events(events: DataFrame, from_sequence: int = 0, limit: int | None = None) -> DataFrame:
    out = events.filter(F.col("sequence") > from_sequence).orderBy("sequence")
    return out.limit(limit) if limit else out


def event_count(events: DataFrame, aggregate_id: str | None = None) -> DataFrame:
    rows = events if aggregate_id is None else events.filter(F.col("aggregate_id") == aggregate_id)
    return rows.agg(F.count(F.lit(1)).alias("event_count"))


def check_expected(events: DataFrame, expected: DataFrame) -> DataFrame:
    """(aggregate_id, expected_version) against the store: actual_version and ok.

    An aggregate without events is never in conflict.
    """
    actual = aggregate_versions(events).withColumnRenamed("version", "actual_version")
    out = expected.join(actual, "aggregate_id", "left")
    ok = F.col("actual_version").isNull() | F.col("expected_version").isNull() | (F.col("actual_version") == F.col("expected_version"))
    return out.withColumn("ok", ok)


def append(events: DataFrame, new: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """The store with ``new`` events, sequenced after all others in the order of ``new.sequence``."""
    if expected is not None:
        bad = check_expected(events, expected).filter(~F.col("ok")).select("aggregate_id").take(1)
        if bad:
            raise ConcurrencyError(bad[0]["aggregate_id"])
    top = events.agg(F.coalesce(F.max("sequence"), F.lit(-1)).alias("_top"))
    low = new.agg(F.min("sequence").alias("_low"))
    moved = new.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(low))  # one row each
    moved = moved.withColumn("sequence", F.col("sequence") - F.col("_low") + F.col("_top") + 1).drop("_top", "_low")
    return events.unionByName(moved)


def fold_sum(events: DataFrame, delta: Column, name: str = "balance") -> DataFrame:
    """State of every aggregate whose events add to it, with its version."""
    return events.groupBy("aggregate_id").agg(F.sum(delta).alias(name), F.count(F.lit(1)).alias("version"))


def fold_last(events: DataFrame, columns: list[str]) -> DataFrame:
    """State of every aggregate whose newest event tells it whole."""
    best = events.groupBy("aggregate_id").agg(F.max_by(F.struct(*columns), "sequence").alias("s"), F.count(F.lit(1)).alias("version"))
    return best.select("aggregate_id", "s.*", "version")


def running(events: DataFrame, delta: Column, name: str = "balance") -> DataFrame:
    """The state after each event."""
    return with_versions(events).withColumn(name, F.sum(delta).over(by_aggregate().rowsBetween(Window.unboundedPreceding, 0)))


def fold(events: DataFrame, step: Callable[[dict, dict], dict], initial: dict, schema: str) -> DataFrame:
    """State by an arbitrary Python step over each aggregate's events in order.

    ``schema`` names the state's columns.  Events are sorted in their partitions
    and pass through a task batch by batch: it holds one batch and one state,
    however long an aggregate is.  Use the native folds where they can say it.
    """
    import pandas as pd

    fields = [c.split()[0] for c in schema.split(",")]

    def run(frames):
        who, state, some = None, None, False
        for pdf in frames:
            done = []
            for row in pdf.to_dict("records"):
                if not some or row["aggregate_id"] != who:
                    if some:
                        done.append({"aggregate_id": who, **{k: state.get(k) for k in fields}})
                    who, state, some = row["aggregate_id"], dict(initial), True
                state = step(state, row)
            yield pd.DataFrame(done, columns=["aggregate_id", *fields])
        if some:
            yield pd.DataFrame([{"aggregate_id": who, **{k: state.get(k) for k in fields}}])

    dealt = events.repartition("aggregate_id").sortWithinPartitions("aggregate_id", "sequence")
    return dealt.mapInPandas(run, f"aggregate_id string, {schema}")


class AggregateRegistry:
    """Folds by aggregate type."""

    def __init__(self):
        self._folds: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, aggregate_type: str):
        def deco(f):
            self._folds[aggregate_type] = f
            return f

        return deco

    def reconstruct(self, aggregate_type: str, events: DataFrame) -> DataFrame:
        if aggregate_type not in self._folds:
            raise ValueError(f"unknown aggregate type: {aggregate_type}")
        return self._folds[aggregate_type](events.filter(F.col("aggregate_type") == aggregate_type))


#: Status changes that an order allows.
ORDER_TRANSITIONS = (
    (None, "pending"), ("pending", "confirmed"), ("confirmed", "shipped"), ("shipped", "delivered"),
    ("pending", "cancelled"), ("confirmed", "cancelled"),
)


def check_transitions(events: DataFrame, status: str, allowed=ORDER_TRANSITIONS) -> DataFrame:
    """Each event with its aggregate's previous status and whether the change is allowed."""
    spark = events.sparkSession
    table = spark.createDataFrame(list(allowed), "_from string, _to string").withColumn("legal", F.lit(True))
    rows = events.withColumn("previous", F.lag(status).over(by_aggregate()))
    hit = F.col("previous").eqNullSafe(F.col("_from")) & (F.col(status) == F.col("_to"))
    out = rows.join(F.broadcast(table), hit, "left").drop("_from", "_to")
    return out.withColumn("legal", F.coalesce("legal", F.lit(False)))


def handle_commands(commands: DataFrame, states: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Commands joined to states, accepted if the rule of their type holds; others get an error."""
    joined = commands.join(states, "aggregate_id", "left")
    ok, known = F.lit(False), F.col("command_type").isin(*rules)
    for kind, rule in rules.items():
        ok = F.when(F.col("command_type") == kind, F.coalesce(rule, F.lit(False))).otherwise(ok)
    error = F.when(~known, "unknown command").when(~ok, "rejected")
    return joined.withColumns({"success": ok, "error": error})


class Repository:
    """Aggregates of one store: save with a check of the version, load a fold, exists."""

    def __init__(self, events: DataFrame, fold_state: Callable[[DataFrame], DataFrame]):
        self.events, self.fold_state = events, fold_state

    def save(self, new: DataFrame, expected: DataFrame | None = None) -> "Repository":
        """The repository after an append; this one stays as it is."""
        return Repository(append(self.events, new, expected), self.fold_state)

    def load(self, aggregate_id: str) -> DataFrame:
        return self.fold_state(self.events.filter(F.col("aggregate_id") == aggregate_id))

    def exists(self, aggregate_id: str) -> bool:
        return not self.events.filter(F.col("aggregate_id") == aggregate_id).isEmpty()
