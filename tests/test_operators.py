"""Operators on literal inputs, and the laws of merges."""

from datetime import datetime, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import hashing, scores
from palimpsest.functions.intervals import parse_window
from palimpsest.operators import crdt, eventlog, eventsourcing, projections, replay, slices, snapshots, versioned, windows

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def at(s):
    return datetime.fromtimestamp(s, timezone.utc)


@pytest.fixture(scope="module")
def counter(spark):
    rows = [("counter", 1, at(100), "DATA", 0), ("counter", 2, at(200), "DATA", 10), ("counter", 3, at(300), "DATA", 25), ("counter", 4, at(400), "TOMBSTONE", None)]
    return spark.createDataFrame(rows, "key string, sequence long, ts timestamp, record_type string, value int")


def test_latest_is_the_deletion(counter):
    assert versioned.latest(counter).first()["record_type"] == "TOMBSTONE"
    assert versioned.scan(counter).count() == 0
    assert versioned.scan(counter, include_tombstones=True).count() == 1


def test_as_of_is_inclusive(counter):
    value = lambda t: versioned.as_of(counter, at(t)).first()["value"]
    assert [value(100), value(199), value(200), value(350), value(400)] == [0, 0, 10, 25, None]
    assert versioned.as_of(counter, at(99)).count() == 0


def test_equal_times_resolve_to_the_lowest_sequence(spark):
    df = spark.createDataFrame([("k", 1, at(5), "DATA", 1), ("k", 2, at(5), "DATA", 2)], "key string, sequence long, ts timestamp, record_type string, value int")
    assert versioned.as_of(df, at(5)).first()["value"] == 1
    assert versioned.latest(df).first()["value"] == 2


def test_history_ends_at_deletion(counter):
    h = versioned.history(counter).orderBy("sequence").collect()
    assert [r["value"] for r in h] == [0, 10, 25] and h[-1]["valid_to"].timestamp() == 400
    assert versioned.history(counter, include_tombstones=True).count() == 4


def test_diff(counter):
    d = versioned.diff(counter, at(100), at(300)).first()
    assert (d["change_type"], d["old_value"], d["new_value"]) == ("modified", 0, 25)
    assert versioned.diff(counter, at(100), at(400)).first()["change_type"] == "modified"
    assert versioned.diff(counter, at(100), at(400), deletes_as_removed=True).first()["change_type"] == "removed"
    assert versioned.diff(counter, at(50), at(100)).first()["change_type"] == "added"
    assert versioned.diff(counter, at(200), at(200)).count() == 0


def test_compact_numbers_live_keys(spark):
    rows = [(f"k{i:03}", i, at(i), "TOMBSTONE" if i % 5 == 0 else "DATA", i) for i in range(50)]
    df = spark.createDataFrame(rows, "key string, sequence long, ts timestamp, record_type string, value int")
    out = versioned.compact(df).orderBy("sequence").collect()
    assert [r["sequence"] for r in out] == list(range(1, 41)) and [r["key"] for r in out] == sorted(r["key"] for r in out)


def test_parse_window():
    assert [parse_window(x) for x in ("30s", "5m", "1h", "1d", "1w", "7")] == [30, 300, 3600, 86400, 604800, 3600]
    with pytest.raises(ValueError):
        parse_window("500ms")


def points(spark, times):
    return spark.createDataFrame([(at(t), float(t), k) for k, t in enumerate(times)], "ts timestamp, value double, arrival long")


def test_tumbling(spark):
    out = windows.windowed(points(spark, [0, 4, 5, 9, 10]), windows.TUMBLING, ["count"], "5 seconds").orderBy("window_start").collect()
    assert [r["count"] for r in out] == [2, 2, 1]


def test_sliding_as_coded(spark):
    out = windows.sliding_as_coded(points(spark, [10]), 5, 2).select("window_second").collect()
    assert sorted(r[0] for r in out) == [7, 9]
    assert windows.sliding_as_coded(points(spark, [10]), 2, 5).count() == 0


def test_sessions_merge_at_the_gap(spark):
    out = windows.windowed(points(spark, [0, 1800, 3601]), windows.SESSION, ["count"], "30 minutes").orderBy("window_start").collect()
    assert [r["count"] for r in out] == [2, 1]


def test_late(spark):
    out = windows.with_watermark_and_late(points(spark, [10, 1]), 5).orderBy("arrival").collect()
    assert [r["late"] for r in out] == [False, True]


def test_watermark_crosses_blocks(spark):
    out = windows.with_watermark_and_late(points(spark, [5, 9, 3, 7]), 5, block=F.floor(F.col("arrival") / 2)).orderBy("arrival").collect()
    assert [r["watermark"].timestamp() for r in out] == [5, 9, 9, 9]


def test_unknown_names():
    with pytest.raises(ValueError):
        windows.aggregate("mode")
    with pytest.raises(ValueError):
        crdt.resolver("coin")
    with pytest.raises(ValueError):
        crdt.merge([], [])


def test_partitioner(spark):
    import hashlib

    keys = [f"user:{i}" for i in range(60)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k string")
    for n in (3, 7, 12):
        got = {r["k"]: r["p"] for r in df.select("k", hashing.partition_of(F.col("k"), n).alias("p")).collect()}
        assert got == {k: int(hashlib.md5(k.encode()).hexdigest(), 16) % n for k in keys} | {None: 0}


def test_account(spark):
    rows = [("acc", "Opened", 100, 1), ("acc", "Deposit", 50, 2), ("acc", "Withdrawal", 30, 3), ("acc", "Deposit", 100, 4)]
    e = spark.createDataFrame(rows, "aggregate_id string, event_type string, amount int, sequence long")
    delta = F.when(F.col("event_type") == "Withdrawal", -F.col("amount")).otherwise(F.col("amount"))
    assert eventsourcing.fold_sum(e, delta).first()["balance"] == 220
    assert [r["balance"] for r in eventsourcing.running(e, delta).orderBy("sequence").collect()] == [100, 150, 120, 220]


def test_append_guards_versions(spark):
    e = spark.createDataFrame([("a", 0)], "aggregate_id string, sequence long")
    new = spark.createDataFrame([("a", 0), ("b", 1)], "aggregate_id string, sequence long")
    ok = spark.createDataFrame([("a", 1), ("b", 9)], "aggregate_id string, expected_version int")
    bad = spark.createDataFrame([("a", 0)], "aggregate_id string, expected_version int")
    assert sorted(r["sequence"] for r in eventsourcing.append(e, new, ok).collect()) == [0, 1, 2]
    with pytest.raises(eventsourcing.ConcurrencyError):
        eventsourcing.append(e, new, bad)


def test_projection_registry(spark):
    m = projections.ProjectionManager()
    m.register(projections.counting("one", "event_type"))
    with pytest.raises(ValueError):
        m.register(projections.counting("one", "event_type"))
    with pytest.raises(ValueError):
        m.register(projections.counting("", "event_type"))
    e = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "event_type string, sequence long")
    m.process(e.filter("sequence < 3"))
    m.process(e)
    assert {r["event_type"]: r["n"] for r in m.states["one"].collect()} == {"a": 2, "b": 1}
    assert m.checkpoints["one"].events_processed == 3 and m.list_projections() == ["one"] and m.unregister("one")


def test_replay_retries(spark):
    e = spark.createDataFrame([(i,) for i in range(4)], "sequence long")
    seen: dict = {}

    def handler(row):
        seen[row["sequence"]] = seen.get(row["sequence"], 0) + 1
        if row["sequence"] == 3 or row["sequence"] == 2 and seen[2] < 3:
            raise ValueError("no")

    out = {r["sequence"]: (r["status"], r["attempts"]) for r in replay.run(e.coalesce(1), handler, 3).collect()}
    assert out == {0: ("ok", 1), 1: ("ok", 1), 2: ("ok", 3), 3: ("dead", 4)}


def test_filter_treats_zero_as_set(spark):
    e = spark.createDataFrame([("x", "a", i) for i in range(5)], "event_type string, aggregate_id string, sequence long")
    assert replay.iter_events(e, replay.ReplayFilter(end_sequence=0)).count() == 1


def test_consumer_reads_on(spark):
    rows = spark.createDataFrame([(f"user:{i % 3}", i) for i in range(30)], "key string, sequence long")
    registry = eventlog.TopicRegistry()
    log = eventlog.produce(rows, registry.create("t")).cache()
    c = eventlog.Consumer(log, "g", ["t"])
    first = c.poll(12)
    kept = {(r["topic"], r["partition"]): r["next_offset"] for r in c.commit().collect()}
    rest = eventlog.Consumer(log, "g", ["t"], committed=kept).poll(100)
    assert sorted(r["sequence"] for r in first + rest) == list(range(30))
    with pytest.raises(ValueError):
        registry.create("t")
    with pytest.raises(ValueError):
        registry.delete("u")


def test_vector_clocks(spark):
    df = spark.createDataFrame([({"n1": 2, "n2": 1}, {"n1": 1, "n3": 3}), ({"a": 1}, {"a": 2, "b": 1}), ({"a": 1}, {"a": 1})], "a map<string,long>, b map<string,long>")
    a, b = F.col("a"), F.col("b")
    out = df.select(crdt.clock_merge(a, b).alias("m"), crdt.happens_before(a, b).alias("h"), crdt.happens_before(b, a).alias("r"), crdt.is_concurrent(a, b).alias("c")).collect()
    assert out[0]["m"] == {"n1": 2, "n2": 1, "n3": 3} and out[0]["c"]
    assert (out[1]["h"], out[1]["r"], out[1]["c"]) == (True, False, False)
    assert (out[2]["h"], out[2]["c"]) == (False, True)


def counts(spark, rows):
    return spark.createDataFrame(rows, "node string, count long")


def test_counters(spark):
    a, b = counts(spark, [("n1", 5), ("n2", 3)]), counts(spark, [("n1", 2), ("n3", 10)])
    assert crdt.g_counter(crdt.union_all([a, b])).first()["value"] == 18
    pn = spark.createDataFrame([("n", "P", 10), ("n", "N", 3)], "node string, sign string, count long")
    assert crdt.pn_counter(pn).first()["value"] == 7


@FEW
@given(st.lists(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 9)), max_size=4), min_size=3, max_size=3))
def test_g_counter_laws(spark, replicas):
    a, b, c = ([(n, max(v for m, v in r if m == n)) for n in {n for n, _ in r}] for r in replicas)
    value = lambda *rs: crdt.g_counter(counts(spark, [x for r in rs for x in r])).first()["value"]
    want = sum(max(v for m, v in a + b + c if m == n) for n in {n for n, _ in a + b + c})
    assert value(a, b, c) == value(c, b, a) == value(a, b, b, c, a) == want


def test_lww(spark):
    schema = "key string, value string, hlc struct<physical: double, logical: bigint, node_id: string>, tombstone boolean"
    rows = [("r", "v1", (100.0, 0, "a"), False), ("r", "v2", (101.0, 0, "b"), False)]
    assert crdt.lww_merge(spark.createDataFrame(rows, schema)).first()["value"] == "v2"
    assert crdt.fww_merge(spark.createDataFrame(rows, schema)).first()["value"] == "v1"
    dead = spark.createDataFrame([*rows, ("r", None, (102.0, 0, "a"), True)], schema)
    assert crdt.lww_merge(dead).first()["value"] is None and crdt.lww_map(dead).count() == 0
    assert crdt.mv_merge(spark.createDataFrame(rows, schema)).count() == 2


def test_sets(spark):
    tags = spark.createDataFrame([("t1", "Apple"), ("t2", "Banana"), ("t3", "Banana"), ("t4", "Milk")], "tag string, value string")
    gone = spark.createDataFrame([("t2",), ("t3",)], "tag string")
    assert sorted(r["value"] for r in crdt.or_set(tags, gone).collect()) == ["Apple", "Milk"]
    ops = spark.createDataFrame([("item1", "add"), ("item1", "remove"), ("item1", "add"), ("x", "add")], "value string, op string")
    assert [r["value"] for r in crdt.two_phase_set(ops).collect()] == ["x"]


def test_negative_increment(spark):
    with pytest.raises(Exception, match="negative increment"):
        crdt.check_increments(counts(spark, [("a", -1)])).collect()


def test_snapshot_chain(spark, tmp_path):
    rows = [("a", 1, 1), ("b", 2, 2), ("a", 3, 3), ("_m", 4, 4)]
    df = spark.createDataFrame(rows, "key string, sequence long, value int")
    folder = str(tmp_path)
    snapshots.write_snapshot(spark, df, folder, "s1", 2)
    snapshots.write_snapshot(spark, df, folder, "s2", 4, "s1", 2)
    got = {r["key"]: r["value"] for r in snapshots.read_snapshot(spark, folder, "s2").collect()}
    assert got == {"a": 3, "b": 2, "_m": 4}
    assert snapshots.describe(df, 4).first()["key_count"] == 2


def test_required_replicas(spark):
    df = spark.createDataFrame([(x, 5) for x in ("STRONG", "QUORUM", "LOCAL_QUORUM", "EVENTUAL")], "l string, n int")
    assert [r[0] for r in df.select(scores.required_replicas(F.col("l"), F.col("n"))).collect()] == [5, 3, 1, 1]


def test_state_hash_ignores_order(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, h string")
    assert hashing.state_hash(a, "key", "h").first() == hashing.state_hash(a.orderBy(F.desc("key")), "key", "h").first()


def test_slices_and_waiting(counter):
    cache = slices.SliceCache(counter, entries=1)
    assert cache.get(at(200)).first()["value"] == 10 and cache.get(at(200)).count() == 1 and cache.get(at(300)).first()["value"] == 25
    assert cache.stats() == {"entries": 1, "hits": 1, "misses": 2}
    cache.invalidate()
    assert slices.until(lambda: counter, "counter", F.col("value") > 5, 0)["sequence"] == 2
    assert slices.until_changed(lambda: counter, "counter", at(400), 0) is None


def test_produce_batch_and_repository(spark):
    log = eventlog.produce_batch(spark, [{"value": 1, "key": "k", "partition": 2}, "plain"], eventlog.Topic("t"), 10).orderBy("sequence").collect()
    assert [(r["key"], r["value"], r["sequence"]) for r in log] == [("k", "1", 10), (None, '"plain"', 11)] and log[0]["partition"] == 2 and log[1]["partition"] == 0
    e = spark.createDataFrame([("a", 0, 5)], "aggregate_id string, sequence long, n int")
    repo = eventsourcing.Repository(e, lambda x: eventsourcing.fold_sum(x, F.col("n"), "total"))
    later = repo.save(spark.createDataFrame([("a", 0, 7)], "aggregate_id string, sequence long, n int"))
    assert later.load("a").first()["total"] == 12 and repo.exists("a") and not repo.exists("b")


def test_close_early(spark):
    out = windows.close_early(points(spark, [0, 4, 5]), windows.TUMBLING, ["count"], at(0), "5 seconds")
    assert [r["count"] for r in out.collect()] == [2]


def test_snapshot_at_has_no_window(spark):
    from palimpsest.operators import versioned
    from palimpsest.schema import records

    plan = versioned.snapshot_at(records(spark, "/root/testdata/sf0.001"), "2024-01-10")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_sparse_ids_keep_no_window_over_rows(spark):
    """Ids far apart: batches and watermarks are those of dense ids, and one row a range is all that one task sees."""
    from palimpsest.operators import replay, windows

    rows = spark.range(0, 5000).select((F.col("id") * 10**12).alias("sequence"), F.timestamp_seconds(F.col("id") % 1000).alias("ts"))
    out = {r["sequence"] // 10**12: r["batch"] for r in replay.batches(rows, 100).collect()}
    assert out == {k: k // 100 for k in range(5000)}
    marks = windows.with_watermark_and_late(rows.withColumnRenamed("sequence", "arrival"), 60).collect()
    assert all(r["watermark"].timestamp() == min(r["arrival"] // 10**12, 999) for r in marks)


def test_json_of_every_type_comes_back(spark):
    from palimpsest.operators import crdt_state

    hlc = "struct<physical:double,logical:bigint,node_id:string>"
    at = (1.5, 2, "n")
    states = {
        "LWWRegister": ([("a", "x", at, False), ("b", None, at, True)], f"name string, value string, hlc {hlc}, tombstone boolean"),
        "MVRegister": ([("a", "x", at, False), ("a", "y", at, False)], f"name string, value string, hlc {hlc}, tombstone boolean"),
        "LWWMap": ([("a", "k", "x", at, False), ("a", "l", None, at, True)], f"name string, key string, value string, hlc {hlc}, tombstone boolean"),
        "ORSet": ([("a", "x", "t1", at, False), ("a", "x", "t2", at, True)], f"name string, value string, tag string, hlc {hlc}, removed boolean"),
        "TwoPhaseSet": ([("a", "x", "add"), ("a", "x", "remove"), ("a", "y", "add")], "name string, value string, op string"),
        "GCounter": ([("a", "n1", 3), ("a", "n2", 4)], "name string, node string, count long"),
        "PNCounter": ([("a", "P", "n1", 3), ("a", "N", "n1", 4)], "name string, sign string, node string, count long"),
        "GCounterMap": ([("a", "k", "n1", 3), ("a", "l", "n1", 4)], "name string, key string, node string, count long"),
        "PNCounterMap": ([("a", "k", "P", "n1", 3), ("a", "l", "N", "n1", 4)], "name string, key string, sign string, node string, count long"),
        "LexicographicCounter": ([("a", 5, "n1")], "name string, counter long, node_id string"),
    }
    for kind, (rows, schema) in states.items():
        df = spark.createDataFrame(rows, schema)
        back = crdt_state.decode(kind, crdt_state.encode(kind, df))
        assert sorted(map(tuple, back.select(*df.columns).collect()), key=str) == sorted(map(tuple, df.collect()), key=str), kind
    assert crdt_state.decode("GCounter", spark.createDataFrame([("a", '{"type":"pn_counter"}')], "name string, state string")).count() == 0


def test_auto_merge_tells_what_went_wrong(spark):
    from palimpsest.operators import crdt_state

    a = spark.createDataFrame([("c", "n1", 3)], "name string, node string, count long")
    b = spark.createDataFrame([("c", "n1", 5), ("c", "n2", 1)], a.schema)
    good = crdt_state.auto_merge(("GCounter", "GCounter"), a, b)
    assert good.success and good.merged.first()["value"] == 6 and [tuple(r) for r in good.conflicts.collect()] == [("counter_mismatch", "c/n1", "3", "5")]
    clash = crdt_state.auto_merge(("GCounter", "ORSet"), a, b)
    assert not clash.success and clash.merged is None and "GCounter" in clash.errors[0]
    assert not crdt_state.auto_merge(("ORSet", "ORSet"), a, b).success


def test_state_hash_by_levels(spark):
    from palimpsest.functions import hashing

    df = spark.range(300).select(F.col("id").cast("string").alias("key"), F.md5(F.col("id").cast("string")).alias("hash"))
    one = [hashing.state_hash(x, "key", "hash", buckets=64, fan=4).first()[0] for x in (df, df.orderBy(F.desc("id")))]
    other = hashing.state_hash(df.filter("id <> 7"), "key", "hash", buckets=64, fan=4).first()[0]
    assert one[0] == one[1] != other


def test_interval_overlaps_of_all_lengths(spark):
    import random

    rng = random.Random(3)
    rows = [(k % 2, k, a, a + int(10 ** rng.uniform(0, 15))) for k in range(160) for a in [rng.randrange(10**14)]] + [(0, 900, 5, 5), (1, 901, 9, 3)]
    df = spark.createDataFrame(rows, "key int, n long, start_us long, end_us long")
    out = sorted((r["a_n"], r["b_n"]) for r in versioned.interval_overlaps(df, df, "key", 1_000_000).collect())
    assert out == sorted((x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])


def test_as_of_join_of_a_hot_key(spark):
    import random

    rng = random.Random(4)
    left = [("hot" if rng.random() < 0.8 else rng.choice("abc"), k, rng.randrange(500)) for k in range(400)]
    right = [("hot" if rng.random() < 0.8 else rng.choice("abd"), k, rng.randrange(500)) for k in range(300)]
    out = versioned.as_of_join(
        spark.createDataFrame(left, "key string, id long, at long").repartition(5), spark.createDataFrame(right, "key string, id long, at long").repartition(3),
        "key", "at", "at", ["id"], "id",
    ).collect()
    assert len(out) == len(left)
    for r in out:
        known = [(x[2], x[1]) for x in right if x[0] == r["key"] and x[2] <= r["at"]]
        assert r["right_id"] == (max(known)[1] if known else None)
