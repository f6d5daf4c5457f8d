"""The store, the client and streams."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from palimpsest.client import Client, NotFoundError
from palimpsest.sources import store as sources
from palimpsest.streaming import queries as streaming

from .conftest import SF


def test_client_verbs(spark, tmp_path):
    c = Client(spark, str(tmp_path / "s"))
    c.put("users:1", {"name": "Alice"}, ts="2024-01-01 00:00:00")
    c.put("users:1", {"name": "Bob"}, ts="2024-01-02 00:00:00")
    c.put_many({"users:2": 2, "orders:1": 3}, ts="2024-01-03 00:00:00")
    assert c.get("users:1") == {"name": "Bob"} and c.get_as_of("users:1", "2024-01-01 12:00:00") == {"name": "Alice"}
    assert c.scan("users:") == ["users:1", "users:2"] and c.get_many(["users:2", "none"]) == {"users:2": 2}
    assert c.get_history("users:1").count() == 2
    c.delete("users:2", ts="2024-01-04 00:00:00")
    assert not c.exists("users:2") and c.exists("users:1")
    with pytest.raises(NotFoundError):
        c.get("users:2")
    assert c.get_stats()["total_records"] == 5 and c.ping()
    assert c.store.verify().count() == 0
    c.emit("acc:1", "Opened", {"n": 1}, ts="2024-01-05 00:00:00")
    seen = []
    assert c.subscribe("Opened", seen.append) == 1 and seen[0]["data"] == {"n": 1}
    c.store.compact_to(str(tmp_path / "compact"))
    assert [r["sequence"] for r in spark.read.parquet(str(tmp_path / "compact")).orderBy("key").collect()] == [1, 2, 3]


def test_client_replicated_types(spark, tmp_path):
    c = Client(spark, str(tmp_path / "s"))
    c.lww_set("r", "a", at=1)
    c.lww_set("r", "b", at=2)
    assert c.lww_get("r") == "b"
    c.gcounter_increment("g", 2, "n1")
    c.gcounter_increment("g", 3, "n2")
    assert c.gcounter_get("g") == 5
    for x in ("Apple", "Banana"):
        c.orset_add("s", x)
    c.orset_remove("s", "Banana")
    assert c.orset_get("s") == ["Apple"]


def test_framed_files(spark, tmp_path):
    records = [{"key": f"k{i}", "value": i} for i in range(5)]
    (tmp_path / "a.dat").write_bytes(b"".join(map(sources.frame, records)))
    got = [json.loads(r["body"]) for r in sources.read_framed(spark, str(tmp_path)).orderBy("offset").collect()]
    assert got == records


def test_read_model_and_dead_letters(spark, tmp_path):
    df = spark.range(3)
    sources.save_read_model(df, str(tmp_path / "m"))
    sources.save_dead_letters(df, str(tmp_path / "d"))
    sources.save_dead_letters(df, str(tmp_path / "d"))
    assert sources.load_read_model(spark, str(tmp_path / "m")).count() == 3 and spark.read.parquet(str(tmp_path / "d")).count() == 6


def test_domain_event_form(spark):
    df = spark.createDataFrame([("Opened", 1)], "event_type string, n int")
    r = sources.to_domain_event(df).first()
    assert r["type"] == "Opened" and json.loads(r["data"])["n"] == 1


def test_subscribe_swallows_errors(spark):
    seen, lock = [], threading.Lock()

    def handler(row):
        with lock:
            seen.append(row["event_id"])
        raise RuntimeError("mine")

    streaming.subscribe(streaming.event_stream(spark, SF), "signup", handler)
    assert len(seen) == spark.read.parquet(f"{SF}/events.parquet").filter("event_type = 'signup'").count()


def test_timeout_emits_idle_keys(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = streaming.run_to_table(streaming.emit_on_timeout(streaming.event_stream(spark, SF), "user_id", 86_400_000), "idle")
    e = spark.read.parquet(f"{SF}/events.parquet")
    total = out.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    assert 0 < total <= e.count()


def test_output_modes():
    assert streaming.output_mode("ON_CLOSE") == "append" and streaming.output_mode("ON_EVERY_EVENT") == "update"
    with pytest.raises(ValueError):
        streaming.output_mode("NEVER")


def test_writers_take_turns(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = sources.AppendOnlyStore(spark, str(tmp_path / "shared"))
    with ThreadPoolExecutor(5) as pool:
        list(pool.map(lambda w: [store.put(f"w{w}-{k}", k) for k in range(4)], range(5)))
    assert sorted(r["sequence"] for r in store.records.collect()) == list(range(1, 21))
