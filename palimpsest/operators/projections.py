"""Projections: read models kept from events, in batch or by micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Projection:
    """A named read model.

    ``handlers`` map an event type to a function from that type's events to
    changes; ``combine`` merges changes with the state.  With no handler for
    a type its events are passed over.
    """

    name: str
    combine: Callable[[DataFrame | None, DataFrame], DataFrame]
    handlers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def on(self, event_type: str):
        def deco(f):
            self.handlers[event_type] = f
            return f

        return deco

    def changes(self, events: DataFrame) -> DataFrame:
        parts = [f(events.filter(F.col("event_type") == kind)) for kind, f in self.handlers.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def rebuild(self, events: DataFrame) -> DataFrame:
        """The state from all events."""
        return self.combine(None, self.changes(events))


@dataclass(frozen=True)
class Checkpoint:
    name: str
    sequence: int = -1
    events_processed: int = 0
    errors: int = 0


class ProjectionManager:
    """Registry of projections with a checkpoint on the global sequence each."""

    def __init__(self):
        self._projections: dict[str, Projection] = {}
        self.checkpoints: dict[str, Checkpoint] = {}
        self.states: dict[str, DataFrame] = {}

    def register(self, p: Projection) -> None:
        if not p.name or p.name in self._projections:
            raise ValueError(f"empty or duplicate projection name: {p.name!r}")
        self._projections[p.name] = p
        self.checkpoints[p.name] = Checkpoint(p.name)

    def unregister(self, name: str) -> bool:
        self.checkpoints.pop(name, None)
        self.states.pop(name, None)
        return self._projections.pop(name, None) is not None

    def get_projection(self, name: str) -> Projection | None:
        return self._projections.get(name)

    def list_projections(self) -> list[str]:
        return list(self._projections)

    def process(self, events: DataFrame) -> None:
        """Bring every projection up to date with events past its checkpoint; one that fails stays where it was."""
        for name, p in self._projections.items():
            done = self.checkpoints[name]
            new = events.filter(F.col("sequence") > done.sequence)
            seen = new.agg(F.max("sequence").alias("top"), F.count(F.lit(1)).alias("n")).first()
            if not seen["n"]:
                continue
            try:
                self.states[name] = p.combine(self.states.get(name), p.changes(new))
                self.checkpoints[name] = Checkpoint(name, seen["top"], done.events_processed + seen["n"], done.errors)
            except Exception:  # the projection's own
                self.checkpoints[name] = Checkpoint(name, done.sequence, done.events_processed, done.errors + 1)

    def rebuild(self, name: str, events: DataFrame) -> DataFrame:
        if name not in self._projections:
            raise ValueError(f"unknown projection: {name}")
        self.states.pop(name, None)
        self.checkpoints[name] = Checkpoint(name)
        seen = events.agg(F.max("sequence").alias("top"), F.count(F.lit(1)).alias("n")).first()
        self.states[name] = self._projections[name].rebuild(events)
        self.checkpoints[name] = Checkpoint(name, seen["top"] if seen["n"] else -1, seen["n"])
        return self.states[name]

    def rebuild_all(self, events: DataFrame) -> None:
        for name in self._projections:
            self.rebuild(name, events)

    def stats(self, spark) -> DataFrame:
        rows = [(c.name, c.sequence, c.events_processed, c.errors) for c in self.checkpoints.values()]
        return spark.createDataFrame(rows, "name string, sequence long, events_processed long, errors long")


def counting(name: str, by: str) -> Projection:
    """A projection that counts events by a column."""

    def combine(state, changes):
        both = changes if state is None else state.unionByName(changes)
        return both.groupBy(by).agg(F.sum("n").alias("n"))

    p = Projection(name, combine)
    p.changes = lambda events: events.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return p


def orders_by(orders: DataFrame, column: str) -> DataFrame:
    return orders.groupBy(column).agg(F.count(F.lit(1)).alias("orders"), F.sum("total").alias("total"))


def delivered_revenue(orders: DataFrame, delivered: str = "F") -> DataFrame:
    """Revenue counts once an order is delivered."""
    return orders.agg(F.sum(F.when(F.col("status") == delivered, F.col("total"))).alias("revenue"))


def order_total(items):
    """Sum of price times quantity of an array of items; 0 and 1 stand for missing ones."""
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(x["price"], F.lit(0.0)) * F.coalesce(x["quantity"], F.lit(1)))
