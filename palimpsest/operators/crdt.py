"""Conflict-free merges of replicated state, as aggregates over long tables.

State is one row per register, tag, node or key; merging replicas is their
union and one aggregation.  The merges are associative, commutative and
idempotent, so they combine on the map side.  A hybrid logical clock is a
struct (physical, logical, node_id), whose order is the clock's order; equal
clocks with different values go by the value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(replicas: list[DataFrame]) -> DataFrame:
    if not replicas:
        raise ValueError("nothing to merge")
    return reduce(lambda a, b: a.unionByName(b), replicas)


def happened_before_hlc(a: Column, b: Column) -> Column:
    return a < b


def hlc_tick(clock: Column, now: Column) -> Column:
    """The next clock for an event of the clock's own node at physical time ``now``."""
    later = now > clock["physical"]
    return F.struct(
        F.greatest(now, clock["physical"]).alias("physical"),
        F.when(later, F.lit(0)).otherwise(clock["logical"] + 1).cast("long").alias("logical"), clock["node_id"].alias("node_id"),
    )


def hlc_receive(clock: Column, other: Column, now: Column) -> Column:
    """The clock after a message with clock ``other`` came: after both and not before ``now``."""
    top = F.greatest(now, clock["physical"], other["physical"])
    at = lambda c: F.when(c["physical"] == top, c["logical"] + 1).otherwise(0)
    return F.struct(top.alias("physical"), F.greatest(at(clock), at(other)).cast("long").alias("logical"), clock["node_id"].alias("node_id"))


# vector clocks: MAP<node, n>, a missing node counts as 0


def clock_merge(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def clock_increment(clock: Column, node: str) -> Column:
    one = F.create_map(F.lit(node), F.lit(1).cast("long"))
    return F.map_zip_with(clock, one, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def clock_get(clock: Column, node: str) -> Column:
    return F.coalesce(F.try_element_at(clock, F.lit(node)), F.lit(0))


def happens_before(a: Column, b: Column) -> Column:
    """All entries at most the other's, and one less."""
    sides = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, F.lit(0)) - F.coalesce(x, F.lit(0))))
    return F.forall(sides, lambda d: d >= 0) & F.exists(sides, lambda d: d > 0)


def is_concurrent(a: Column, b: Column) -> Column:
    """Neither is before the other; true for equal clocks too."""
    return ~happens_before(a, b) & ~happens_before(b, a)


def clocks_equal(a: Column, b: Column) -> Column:
    sides = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, F.lit(0)) - F.coalesce(x, F.lit(0))))
    return F.forall(sides, lambda d: d == 0)


def merge_clocks(clocks: DataFrame, by: str) -> DataFrame:
    """n-ary merge of long clocks (by, node, n)."""
    return clocks.groupBy(by, "node").agg(F.max("n").alias("n"))


# registers


def lww_merge(states: DataFrame, by: str = "key") -> DataFrame:
    """Last writer wins: value, clock and tombstone of the greatest clock; the value is null if that is a tombstone."""
    order = F.struct("hlc", "value")
    best = states.groupBy(by).agg(F.max_by(F.struct("value", "hlc", "tombstone"), order).alias("s"))
    return best.select(by, F.when(~F.col("s.tombstone"), F.col("s.value")).alias("value"), F.col("s.hlc").alias("hlc"), F.col("s.tombstone").alias("tombstone"))


def fww_merge(states: DataFrame, by: str = "key") -> DataFrame:
    """First writer wins."""
    best = states.groupBy(by).agg(F.min_by(F.struct("value", "hlc", "tombstone"), F.struct("hlc", "value")).alias("s"))
    return best.select(by, "s.*")


def mv_merge(states: DataFrame, by: str = "key") -> DataFrame:
    """Multi-value register: every value with its greatest clock; none is discarded."""
    return states.groupBy(by, "value").agg(F.max("hlc").alias("hlc"))


def lww_map(states: DataFrame, by: str = "key") -> DataFrame:
    """Entries by last writer; keys whose value is null or deleted are hidden."""
    return lww_merge(states, by).filter(F.col("value").isNotNull())


# sets


def or_set_tombstones(tags: DataFrame, removals: DataFrame) -> DataFrame:
    """Tags that removals reach: of the same value, not newer than the removal."""
    r = removals.groupBy("value").agg(F.max("hlc").alias("_until"))
    return tags.join(r, "value").filter(F.col("hlc") <= F.col("_until")).select("tag").distinct()


def or_set(tags: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Values with a tag that is not a tombstone, of all replicas."""
    return tags.join(tombstones.select("tag").distinct(), "tag", "left_anti").select("value").distinct()


def or_set_state(states: DataFrame, by: str | None = None) -> DataFrame:
    """Tags (value, tag, hlc, removed) of all replicas: once each, removed if any replica has it so."""
    keys = [by] if by else [c for c in ("name",) if c in states.columns]
    return states.groupBy(*keys, "value", "tag").agg(F.max("hlc").alias("hlc"), F.bool_or("removed").alias("removed"))


def two_phase_set(ops: DataFrame) -> DataFrame:
    """Values that were added and never removed; a removed value never comes back."""
    seen = ops.groupBy("value").agg(F.bool_or(F.col("op") == "add").alias("a"), F.bool_or(F.col("op") == "remove").alias("r"))
    return seen.filter("a and not r").select("value")


def two_phase_apply(ops: DataFrame) -> DataFrame:
    """One replica's state from its operations in order of idx: an add after a remove and a remove before any add do nothing."""
    first_add = F.min(F.when(F.col("op") == "add", F.col("idx")))
    last_remove = F.max(F.when(F.col("op") == "remove", F.col("idx")))
    s = ops.groupBy("value").agg(first_add.alias("a"), last_remove.alias("r"))
    return s.filter("a is not null").select("value", F.coalesce(F.col("r") > F.col("a"), F.lit(False)).alias("removed"))


# counters


def g_counter(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum over nodes of the greatest count that any replica has for the node."""
    by = by or []
    per = states.groupBy(*by, "node").agg(F.max("count").alias("count"))
    return per.groupBy(*by).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("value"))


def pn_counter(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Increments (sign P) less decrements (sign N), each a G-Counter."""
    by = by or []
    per = states.groupBy(*by, "node", "sign").agg(F.max("count").alias("count"))
    side = lambda s: F.coalesce(F.sum(F.when(F.col("sign") == s, F.col("count"))), F.lit(0))
    out = per.groupBy(*by).agg(side("P").alias("positive"), side("N").alias("negative"))
    return out.withColumn("value", F.col("positive") - F.col("negative"))


def lexicographic_counter(states: DataFrame, by: str = "key") -> DataFrame:
    """The greatest (counter, node_id)."""
    best = states.groupBy(by).agg(F.max(F.struct("counter", "node_id")).alias("s"))
    return best.select(by, "s.counter", "s.node_id")


def check_increments(ops: DataFrame, amount: str = "count") -> DataFrame:
    """``ops``, or an error where an amount is negative."""
    message = F.concat(F.lit("negative increment: "), F.col(amount).cast("string"))
    return ops.withColumn(amount, F.when(F.col(amount) < 0, F.raise_error(message)).otherwise(F.col(amount)))


# resolvers, op logs, diagnosis


def resolver(name: str, custom: Callable[[Column], Column] | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """A merge of register states by a resolver's name."""
    known: dict[str, Callable] = {
        "last_writer_wins": lww_merge,
        "first_writer_wins": fww_merge,
        "merge_all": lambda s, by="key": s.groupBy(by).agg(F.array_sort(F.collect_set("value")).alias("value")),
        "custom": lambda s, by="key": s.groupBy(by).agg(custom(F.col("value")).alias("value")),
    }
    if name not in known or (name == "custom" and custom is None):
        raise ValueError(f"unknown resolver: {name}")
    return known[name]


MERGES = {
    "LWWRegister": lww_merge, "MVRegister": mv_merge, "LWWMap": lww_map, "GCounter": g_counter, "PNCounter": pn_counter,
    "LexicographicCounter": lexicographic_counter, "TwoPhaseSet": two_phase_set, "ORSet": or_set_state,
    "GCounterMap": lambda s, by="key": g_counter(s, [by]), "PNCounterMap": lambda s, by="key": pn_counter(s, [by]),
}


def merge(kinds: list[str], replicas: list[DataFrame], **options) -> DataFrame:
    """Merge replicas of one CRDT type; mixed types are a TypeError, none a ValueError."""
    if not replicas:
        raise ValueError("nothing to merge")
    if len(set(kinds)) > 1:
        raise TypeError(f"cannot merge {sorted(set(kinds))}")
    return MERGES[kinds[0]](union_all(replicas), **options)


def merge_map(a: DataFrame, b: DataFrame, resolve: Callable[[DataFrame, str], DataFrame] = lww_merge, by: str = "key") -> DataFrame:
    """Two maps merged entry by entry over the original entries."""
    return resolve(a.unionByName(b), by)


def merge_gcounter_map(a: DataFrame, b: DataFrame, by: str = "key") -> DataFrame:
    """Two maps of counters, entry by entry."""
    return merge(["GCounterMap"] * 2, [a, b], by=by)


def merge_pncounter_map(a: DataFrame, b: DataFrame, by: str = "key") -> DataFrame:
    return merge(["PNCounterMap"] * 2, [a, b], by=by)


def oplog_slice(ops: DataFrame, since: int = 0, until: int | None = None) -> DataFrame:
    out = ops.filter(F.col("idx") >= since)
    return out if until is None else out.filter(F.col("idx") < until)


def oplog_registers(ops: DataFrame) -> DataFrame:
    """Registers after a log of sets and deletes: the last in log order stands."""
    best = ops.groupBy("key").agg(F.max_by(F.struct("operation_type", "value"), "idx").alias("s"))
    return best.select("key", F.when(F.col("s.operation_type") == "set", F.col("s.value")).alias("value"))


def oplog_counters(ops: DataFrame) -> DataFrame:
    """Counters after a log of increments and decrements."""
    signed = F.when(F.col("operation_type") == "decrement", -F.col("value")).otherwise(F.col("value"))
    return ops.groupBy("key").agg(F.sum(signed).alias("value"))


def oplog_sets(ops: DataFrame) -> DataFrame:
    """(key, value) after a log of adds and removes: the last operation on a value stands."""
    best = ops.groupBy("key", "value").agg(F.max_by("operation_type", "idx").alias("op"))
    return best.filter("op = 'add'").select("key", "value")


def diagnose(a: DataFrame, b: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Entries that both have with different values."""
    left, right = a.select(*by, F.col(value).alias("left_value")), b.select(*by, F.col(value).alias("right_value"))
    return left.join(right, by).filter(~F.col("left_value").eqNullSafe(F.col("right_value")))
