"""The store's verbs as one object over DataFrames: no sockets, no pool."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import crdt, versioned
from .sources.store import AppendOnlyStore


class NotFoundError(KeyError):
    """No version of the key exists, or its latest is a deletion."""


class Client:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, AppendOnlyStore(spark, path)
        self._lww: list[tuple] = []
        self._counts: dict[tuple[str, str], int] = {}
        self._tags: list[tuple] = []
        self._gone: list[tuple] = []
        self._clock = 0

    # key-value

    def put(self, key, value, ts=None):
        self.store.put(key, value, ts=ts)

    def get(self, key):
        r = self.store.get(key)
        if r is None or r["record_type"] == "TOMBSTONE":
            raise NotFoundError(key)
        return json.loads(r["value"])

    def delete(self, key, ts=None):
        self.store.delete(key, ts)

    def exists(self, key) -> bool:
        r = self.store.get(key)
        return r is not None and r["record_type"] != "TOMBSTONE"

    def scan(self, prefix=None, start_key=None, end_key=None, limit=100) -> list[str]:
        return [r["key"] for r in versioned.scan(self.store.records, prefix, start_key, end_key, limit).select("key").collect()]

    def get_history(self, key) -> DataFrame:
        return versioned.history(self.store.records, key).orderBy("sequence")

    def get_as_of(self, key, ts):
        rows = versioned.as_of(self.store.records.filter(F.col("key") == key), ts, with_interval=False).collect()
        return json.loads(rows[0]["value"]) if rows and rows[0]["value"] is not None else None

    def put_many(self, values: dict, ts=None):
        self.store.put_many(values, ts)

    def get_many(self, keys) -> dict:
        rows = versioned.live(versioned.latest(self.store.records.filter(F.col("key").isin(*keys)))).collect()
        return {r["key"]: json.loads(r["value"]) for r in rows}

    def emit(self, aggregate_id, event_type, data, ts=None):
        """Append a domain event under its aggregate's key."""
        self.store.append([(f"{aggregate_id}", {"event_type": event_type, "data": data}, "DATA", {"event_type": event_type})], ts)

    def subscribe(self, event_type, handler) -> int:
        """Pass all stored events of a type to a handler in order; the number passed.  Streams do it continuously."""
        rows = self.store.records.filter(F.col("headers")["event_type"] == event_type).orderBy("sequence").toLocalIterator()
        n = 0
        for r in rows:
            handler(json.loads(r["value"]))
            n += 1
        return n

    def ping(self) -> bool:
        return True

    def get_stats(self) -> dict:
        return versioned.stats(self.store.records).first().asDict()

    # replicated types: operations are rows, reading merges them

    def _now(self):
        self._clock += 1
        return self._clock

    def lww_set(self, name, value, node="node0", at=None):
        self._lww.append((name, json.dumps(value), (float(at if at is not None else self._now()), 0, node), False))

    def lww_get(self, name):
        schema = "key string, value string, hlc struct<physical: double, logical: bigint, node_id: string>, tombstone boolean"
        rows = crdt.lww_merge(self.spark.createDataFrame(self._lww, schema)).filter(F.col("key") == name).collect()
        return json.loads(rows[0]["value"]) if rows and rows[0]["value"] is not None else None

    def gcounter_increment(self, name, amount=1, node="node0"):
        if amount < 0:
            raise ValueError("negative increment")
        self._counts[name, node] = self._counts.get((name, node), 0) + amount

    def gcounter_get(self, name) -> int:
        rows = [(k, n, c) for (k, n), c in self._counts.items() if k == name]
        return crdt.g_counter(self.spark.createDataFrame(rows, "key string, node string, count long")).first()["value"]

    def orset_add(self, name, value, node="node0"):
        at = self._now()
        self._tags.append((name, f"{node}:{at}", json.dumps(value)))

    def orset_remove(self, name, value):
        self._gone += [(n, t) for n, t, v in self._tags if n == name and v == json.dumps(value)]

    def orset_get(self, name) -> list:
        tags = self.spark.createDataFrame([(t, v) for n, t, v in self._tags if n == name], "tag string, value string")
        gone = self.spark.createDataFrame([(t,) for n, t in self._gone if n == name], "tag string")
        return sorted(json.loads(r["value"]) for r in crdt.or_set(tags, gone).collect())

    def merge_crdt(self, kind: str, replicas: list[DataFrame], **options) -> DataFrame:
        return crdt.merge([kind] * len(replicas), replicas, **options)
