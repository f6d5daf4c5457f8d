"""Compaction scores, quorum sizes, rates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CompactionLimits:
    """The strategies' defaults."""

    min_age: float = 3600.0
    max_age: float = 7 * 86400.0
    max_size: int = 1 << 30
    min_count: int = 10_000
    max_count: int = 1_000_000
    size_weight: float = 0.4
    time_weight: float = 0.3
    count_weight: float = 0.3


def _ramp(x: Column, low: float, high: float) -> Column:
    return F.when(x < low, 0.0).when(x > high, 1.0).otherwise(x / high)


def compaction_score(strategy: str, age: Column, size: Column, count: Column, limits=CompactionLimits()) -> Column:
    """Score of a snapshot by a strategy's name; one half for any other name."""
    by_time = _ramp(age, limits.min_age, limits.max_age)
    by_size = F.least(size / limits.max_size, F.lit(1.0))
    by_count = _ramp(count, limits.min_count, limits.max_count)
    mixed = limits.time_weight * by_time + limits.size_weight * by_size + limits.count_weight * by_count
    return {"TIME": by_time, "SIZE": by_size, "COUNT": by_count, "HYBRID": mixed}.get(strategy, F.lit(0.5))


def required_replicas(level: Column, nodes: Column) -> Column:
    """Replicas that must acknowledge at a consistency level."""
    return (
        F.when(level == "STRONG", nodes)
        .when(level == "QUORUM", F.floor(nodes / 2) + 1)
        .when(level == "LOCAL_QUORUM", F.greatest(F.lit(1), F.floor(nodes / 3)))
        .otherwise(1)
        .cast("int")
    )


def commit_index(match_indexes: Column) -> Column:
    """The highest index that a majority of nodes has, from an array of each node's index."""
    ordered = F.sort_array(match_indexes, asc=False)
    return F.get(ordered, F.floor(F.size(match_indexes) / 2).cast("int"))


def grants_vote(term: Column, index: Column, own_term: Column, own_index: Column) -> Column:
    """Whether a candidate's log is at least as new as one's own."""
    return (term > own_term) | ((term == own_term) & (index >= own_index))


def megabytes_per_second(size: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, size / (1024 * 1024) / seconds).otherwise(0.0)
