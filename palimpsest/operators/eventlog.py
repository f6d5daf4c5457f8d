"""A partitioned event log over DataFrames: produce, fetch, offsets, lag, consumers.

Offsets are the log-wide sequence, so a partition's offsets have gaps; reading
takes the next events at or after a position.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import partition_of


@dataclass(frozen=True)
class Topic:
    name: str
    partitions: int = 3
    replication_factor: int = 1
    retention_ms: int = 7 * 24 * 3600 * 1000
    retention_bytes: int = 10 << 30
    config: dict = field(default_factory=dict)


class TopicRegistry:
    """Topics by name; deleting one leaves its events."""

    def __init__(self):
        self._topics: dict[str, Topic] = {}

    def create(self, name: str, **options) -> Topic:
        if name in self._topics:
            raise ValueError(f"topic exists: {name}")
        self._topics[name] = Topic(name, **options)
        return self._topics[name]

    def delete(self, name: str) -> None:
        if name not in self._topics:
            raise ValueError(f"no such topic: {name}")
        del self._topics[name]

    def names(self) -> list[str]:
        return list(self._topics)

    def info(self, name: str) -> Topic | None:
        return self._topics.get(name)


def produce(rows: DataFrame, topic: Topic) -> DataFrame:
    """Events of a topic with their partition; a given partition column is kept where it is set."""
    part = partition_of(F.col("key"), topic.partitions)
    if "partition" in rows.columns:
        part = F.coalesce(F.col("partition"), part)
    return rows.withColumns({"topic": F.lit(topic.name), "partition": part})


def produce_batch(spark, items: list, topic: Topic, next_sequence: int, key: str | None = None) -> DataFrame:
    """Events of a list: an item with ``value`` may bring key, headers and partition; any other item is the value."""
    rows = []
    for n, item in enumerate(items):
        own = item if isinstance(item, dict) and "value" in item else {"value": item}
        rows.append((own.get("key", key), json.dumps(own["value"], default=str), next_sequence + n, own.get("headers"), own.get("partition")))
    schema = "key string, value string, sequence long, headers map<string,string>, partition int"
    return produce(spark.createDataFrame(rows, schema), topic)


def fetch(log: DataFrame, topic: str, partition: int, offset: int, max_events: int = 100) -> DataFrame:
    """The next ``max_events`` events at or after an offset."""
    own = (F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("sequence") >= offset)
    return log.filter(own).orderBy("sequence").limit(max_events)


def replay_range(log: DataFrame, topic: str, partition: int, start: int, end: int | None = None) -> DataFrame:
    own = (F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("sequence") >= start)
    rows = log.filter(own)
    return (rows if end is None else rows.filter(F.col("sequence") <= end)).orderBy("sequence")


def offsets(log: DataFrame) -> DataFrame:
    """Earliest and latest offset and number of events of each partition that has any."""
    return log.groupBy("topic", "partition").agg(
        F.min("sequence").alias("earliest"), F.max("sequence").alias("latest"), F.count(F.lit(1)).alias("events")
    )


def partition_offsets(log: DataFrame, topic: str, partition: int) -> DataFrame:
    """One row even for an empty partition: latest -1, earliest 0."""
    rows = log.filter((F.col("topic") == topic) & (F.col("partition") == partition))
    return rows.agg(F.coalesce(F.max("sequence"), F.lit(-1)).alias("latest"), F.coalesce(F.min("sequence"), F.lit(0)).alias("earliest"))


def unread(log: DataFrame, committed: DataFrame) -> DataFrame:
    """Events at or after the committed next offset of their partition; all where none is committed."""
    known = committed.select("topic", "partition", F.col("next_offset").alias("_next"))
    out = log.join(known, ["topic", "partition"], "left")
    return out.filter(F.col("_next").isNull() | (F.col("sequence") >= F.col("_next"))).drop("_next")


def lag(log: DataFrame, committed: DataFrame) -> DataFrame:
    """Number of unread events of each partition; partitions that are read up have 0."""
    known = committed.select("topic", "partition", F.col("next_offset").alias("_next"))
    behind = F.col("_next").isNull() | (F.col("sequence") >= F.col("_next"))
    return log.join(known, ["topic", "partition"], "left").groupBy("topic", "partition").agg(F.count_if(behind).alias("lag"))


class Consumer:
    """Reads topics in the order of their list, then of partitions; remembers next offsets.

    The table that ``commit`` returns is what to store and to give to the next
    consumer of the group.
    """

    def __init__(self, log: DataFrame, group_id: str, topics: list[str], auto_offset_reset: str = "earliest", committed: dict | None = None):
        self.log, self.group_id, self.topics, self.reset = log, group_id, list(topics), auto_offset_reset
        self.position: dict[tuple[str, int], int] = dict(committed or {})

    def _start(self) -> dict[tuple[str, int], int]:
        ends = {(r["topic"], r["partition"]): r["latest"] for r in offsets(self.log.filter(F.col("topic").isin(*self.topics))).collect()}
        for at, last in ends.items():
            self.position.setdefault(at, 0 if self.reset == "earliest" else last + 1)
        return ends

    def seek(self, topic: str, partition: int, offset: int) -> None:
        self.position[topic, partition] = offset

    def tell(self, topic: str, partition: int) -> int:
        return self.position.get((topic, partition), 0)

    def poll(self, max_events: int = 100) -> list:
        ends = self._start()
        out = []
        for topic in self.topics:
            for t, p in sorted(k for k in ends if k[0] == topic):
                if len(out) >= max_events or self.position[t, p] > ends[t, p]:
                    continue
                rows = fetch(self.log, t, p, self.position[t, p], max_events - len(out)).collect()
                if rows:
                    self.position[t, p] = rows[-1]["sequence"] + 1
                out += rows
        return out

    def commit(self) -> DataFrame:
        rows = [(self.group_id, t, p, n) for (t, p), n in sorted(self.position.items())]
        return self.log.sparkSession.createDataFrame(rows, "group_id string, topic string, partition int, next_offset long")


def delivery_order(log: DataFrame, topics: list[str]) -> DataFrame:
    """All events with their place in a consumer's order: topics as listed, partitions, offsets."""
    at = F.array_position(F.array(*[F.lit(t) for t in topics]), F.col("topic"))
    w = Window.partitionBy("topic", "partition").orderBy("sequence")
    return log.filter(F.col("topic").isin(*topics)).withColumns({"topic_order": at, "place": F.row_number().over(w)})
