"""Registered queries over the test tables, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing, scores
from ..operators import crdt, crdt_state, eventlog, eventsourcing, projections, replay, snapshots, versioned, windows
from ..schema import RECORDS as RECORD_SCHEMA
from ..schema import domain_events, events, records, replica_ops, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

T1, T2 = "2024-01-10 00:00:00", "2024-01-20 00:00:00"

RECORDS = """
records AS (
  SELECT concat('user:', user_id) AS key, event_id AS sequence, ts, event_type,
         CASE event_type WHEN 'error' THEN 'TOMBSTONE' ELSE 'DATA' END AS record_type,
         CASE WHEN event_type <> 'error' THEN CAST(value AS DECIMAL(18,2)) END AS value
  FROM events),
history AS (SELECT *, lead(ts) OVER (PARTITION BY key ORDER BY sequence) AS valid_to FROM records)
"""
LATEST = RECORDS + ", latest AS (SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY key ORDER BY sequence DESC) = 1)"


def asof_cte(name: str, t: str) -> str:
    return f"""{name} AS (SELECT * FROM history WHERE ts <= TIMESTAMP '{t}'
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, sequence) = 1)"""


def flat(df: DataFrame, *columns: str) -> DataFrame:
    """Plain columns: instants as microseconds (named ..._us), decimals as doubles."""
    out = []
    for f in (df.select(*columns) if columns else df).schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            out.append(F.unix_micros(c).alias(f"{f.name}_us"))
        elif isinstance(f.dataType, T.DecimalType):
            out.append(c.cast("double").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def query(sql: str | None):
    def deco(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return deco


ROW = "key, sequence, epoch_us(ts) AS ts_us, record_type, CAST(value AS DOUBLE) AS value"
ROW_COLUMNS = ("key", "sequence", "ts", "record_type", "value")
VALID = ROW + ", epoch_us(valid_to) AS valid_to_us"


# scans, filters, limits


@query(f"WITH {LATEST} SELECT {ROW} FROM latest")
def latest_state(spark, d):
    return flat(versioned.latest(records(spark, d)), *ROW_COLUMNS)


@query(f"WITH {LATEST} SELECT {ROW} FROM latest WHERE record_type <> 'TOMBSTONE' AND key LIKE 'user:1%'")
def live_scan_prefix(spark, d):
    return flat(versioned.scan(records(spark, d), prefix="user:1"), *ROW_COLUMNS)


@query(f"WITH {LATEST} SELECT {ROW} FROM latest WHERE record_type <> 'TOMBSTONE' AND key BETWEEN 'user:2' AND 'user:5'")
def live_scan_range(spark, d):
    return flat(versioned.scan(records(spark, d), start_key="user:2", end_key="user:5"), *ROW_COLUMNS)


@query(f"WITH {LATEST} SELECT {ROW} FROM latest WHERE record_type <> 'TOMBSTONE' ORDER BY key LIMIT 20")
def scan_limit(spark, d):
    return flat(versioned.scan(records(spark, d), limit=20), *ROW_COLUMNS)


@query(f"WITH {LATEST} SELECT {ROW} FROM latest")
def scan_with_tombstones(spark, d):
    return flat(versioned.scan(records(spark, d), include_tombstones=True), *ROW_COLUMNS)


@query(f"WITH {RECORDS} SELECT DISTINCT key FROM records")
def all_keys(spark, d):
    return versioned.keys(records(spark, d))


@query(f"WITH {RECORDS} SELECT count(*) AS total_records, count(DISTINCT key) AS key_count, max(sequence) AS high_sequence FROM records")
def key_stats(spark, d):
    return versioned.stats(records(spark, d))


@query(f"WITH {RECORDS} SELECT {ROW} FROM records WHERE ts BETWEEN TIMESTAMP '{T1}' AND TIMESTAMP '{T2}'")
def range_versions(spark, d):
    return flat(versioned.between_times(records(spark, d), _ts(T1), _ts(T2)), *ROW_COLUMNS)


def _ts(text: str):
    from datetime import datetime, timezone

    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


# time travel


@query(f"WITH {RECORDS} SELECT {VALID}, epoch_us(valid_to) - epoch_us(ts) AS duration_us FROM history WHERE record_type <> 'TOMBSTONE'")
def history_validity(spark, d):
    out = versioned.history(records(spark, d))
    return flat(out.withColumn("duration_us", versioned.duration_us(out)), *ROW_COLUMNS, "valid_to", "duration_us")


@query(f"WITH {RECORDS} SELECT {VALID}, record_type = 'TOMBSTONE' AS is_deleted FROM history")
def history_with_tombstones(spark, d):
    return flat(versioned.history(records(spark, d), include_tombstones=True), *ROW_COLUMNS, "valid_to", "is_deleted")


@query(f"WITH {RECORDS} SELECT {ROW} FROM records WHERE key = 'user:7'")
def raw_history_one_key(spark, d):
    return flat(records(spark, d).filter("key = 'user:7'").orderBy("sequence"), *ROW_COLUMNS)


@query(f"WITH {RECORDS} SELECT key, string_agg(CAST(sequence AS VARCHAR), ',' ORDER BY sequence) AS versions FROM records GROUP BY key")
def versions_per_key(spark, d):
    return versioned.versions(records(spark, d)).select("key", F.array_join(F.col("versions").cast("array<string>"), ",").alias("versions"))


@query(f"WITH {RECORDS}, {asof_cte('a', T1)} SELECT {VALID} FROM a")
def as_of_all(spark, d):
    return flat(versioned.as_of(records(spark, d), _ts(T1)), *ROW_COLUMNS, "valid_to")


@query(f"WITH {RECORDS}, {asof_cte('a', T1)} SELECT {ROW} FROM a")
def as_of_point_only(spark, d):
    return flat(versioned.as_of(records(spark, d), _ts(T1), with_interval=False), *ROW_COLUMNS)


@query(f"WITH {RECORDS} SELECT {VALID} FROM history WHERE sequence = 500")
def as_of_sequence(spark, d):
    return flat(versioned.as_of_sequence(records(spark, d), 500), *ROW_COLUMNS, "valid_to")


@query(f"WITH {RECORDS}, {asof_cte('a', T2)} SELECT {ROW} FROM a WHERE record_type <> 'TOMBSTONE'")
def snapshot_at(spark, d):
    return flat(versioned.snapshot_at(records(spark, d), _ts(T2)), *ROW_COLUMNS)


DIFF = f"""WITH {RECORDS}, {asof_cte('a', T1)}, {asof_cte('b', T2)},
j AS (SELECT coalesce(a.key, b.key) AS key, a.key IS NOT NULL AS in_a, b.key IS NOT NULL AS in_b,
             a.value AS old_value, b.value AS new_value, a.ts AS old_ts, b.ts AS new_ts
      FROM {{a}} a FULL OUTER JOIN {{b}} b ON a.key = b.key)
SELECT key, CASE WHEN NOT in_a THEN 'added' WHEN NOT in_b THEN 'removed' ELSE 'modified' END AS change_type,
       CAST(old_value AS DOUBLE) AS old_value, CAST(new_value AS DOUBLE) AS new_value, epoch_us(old_ts) AS old_ts_us, epoch_us(new_ts) AS new_ts_us
FROM j WHERE NOT in_a OR NOT in_b OR old_value IS DISTINCT FROM new_value"""


@query(DIFF.format(a="a", b="b"))
def diff_all(spark, d):
    return flat(versioned.diff(records(spark, d), _ts(T1), _ts(T2)))


@query(DIFF.format(a="(SELECT * FROM a WHERE record_type <> 'TOMBSTONE')", b="(SELECT * FROM b WHERE record_type <> 'TOMBSTONE')"))
def diff_deletes_as_removed(spark, d):
    return flat(versioned.diff(records(spark, d), _ts(T1), _ts(T2), deletes_as_removed=True))


@query(f"WITH {RECORDS} SELECT {VALID} FROM history WHERE ts BETWEEN TIMESTAMP '{T1}' AND TIMESTAMP '{T2}'")
def changes_between(spark, d):
    return flat(versioned.changes_between(records(spark, d), _ts(T1), _ts(T2)), *ROW_COLUMNS, "valid_to")


@query(f"WITH {RECORDS} SELECT {VALID} FROM history WHERE key = 'user:3' AND ts BETWEEN TIMESTAMP '{T2}' AND TIMESTAMP '2024-02-01 00:00:00'")
def changes_since(spark, d):
    return flat(versioned.changes_since(records(spark, d), _ts(T2), _ts("2024-02-01 00:00:00"), "user:3"), *ROW_COLUMNS, "valid_to")


def _temporal(interval: str) -> str:
    return f"""WITH {RECORDS} SELECT key, epoch_us(time_bucket(INTERVAL '{interval}', ts, TIMESTAMP '1970-01-01')) AS bucket_us,
      CAST(sum(value) AS DOUBLE) AS result FROM records WHERE record_type <> 'TOMBSTONE' GROUP BY ALL"""


@query(_temporal("1 hour"))
def temporal_agg_1h(spark, d):
    return flat(versioned.temporal_aggregate(records(spark, d), "1h"))


@query(_temporal("1 day"))
def temporal_agg_1d(spark, d):
    return flat(versioned.temporal_aggregate(records(spark, d), "1d"))


@query(f"""WITH {RECORDS}, v AS (SELECT min_by(value, sequence) AS value FROM records WHERE key = 'user:3' AND record_type = 'DATA')
SELECT epoch_us(ts) AS valid_from_us, epoch_us(coalesce(valid_to, TIMESTAMP '2024-02-01')) AS valid_to_us
FROM history, v WHERE key = 'user:3' AND record_type = 'DATA' AND history.value = v.value ORDER BY sequence LIMIT 1""")
def value_time_range(spark, d):
    r = records(spark, d)
    one = r.filter("key = 'user:3' and record_type = 'DATA'").agg(F.min_by("value", "sequence")).first()[0]
    return flat(versioned.value_time_range(r, "user:3", one, _ts("2024-02-01 00:00:00")))


@query(f"""WITH {RECORDS}, {asof_cte('a', T1)}
SELECT key, 1000000 + row_number() OVER (ORDER BY key) - 1 AS sequence, epoch_us(TIMESTAMP '{T2}') AS ts_us, 'DATA' AS record_type, CAST(value AS DOUBLE) AS value FROM a""")
def revert_preview(spark, d):
    return flat(versioned.revert(records(spark, d), _ts(T1), 1_000_000, _ts(T2)))


@query(f"WITH {RECORDS} SELECT {ROW} FROM records WHERE ts > TIMESTAMP '{T1}' QUALIFY row_number() OVER (PARTITION BY key ORDER BY sequence) = 1")
def first_change_after(spark, d):
    return flat(versioned.first_change_after(records(spark, d), _ts(T1)), *ROW_COLUMNS)


@query(f"WITH {RECORDS} SELECT {ROW} FROM records WHERE value > 50 QUALIFY row_number() OVER (PARTITION BY key ORDER BY sequence) = 1")
def until_predicate(spark, d):
    return flat(versioned.first_match(records(spark, d), F.col("value") > 50), *ROW_COLUMNS)


@query(f"WITH {LATEST} SELECT key, row_number() OVER (ORDER BY key) AS sequence, epoch_us(ts) AS ts_us, record_type, CAST(value AS DOUBLE) AS value FROM latest WHERE record_type <> 'TOMBSTONE'")
def store_compact(spark, d):
    return flat(versioned.compact(records(spark, d)), *ROW_COLUMNS)


# joins


@query("""SELECT p.event_id, p.user_id, epoch_us(p.ts) AS ts_us, v.event_id AS right_event_id, epoch_us(v.ts) AS right_ts_us
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_join_orders_events(spark, d):
    e = events(spark, d)
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    return flat(versioned.as_of_join(left, right, "user_id", "ts", "ts", ["event_id", "ts"], "event_id"))


OVERLAP = """, v AS (SELECT key, sequence, epoch_us(ts) AS start_us, epoch_us(valid_to) AS end_us, event_type FROM history WHERE valid_to IS NOT NULL)
SELECT a.key, a.sequence AS a_sequence, b.sequence AS b_sequence FROM v a JOIN v b ON a.key = b.key
WHERE a.event_type = 'view' AND b.event_type = 'click' AND a.start_us <= b.end_us AND b.start_us <= a.end_us"""


@query(f"WITH {RECORDS} {OVERLAP}")
def interval_overlap(spark, d):
    h = versioned.with_validity(records(spark, d)).filter("valid_to is not null")
    v = h.select("key", "sequence", "event_type", F.unix_micros("ts").alias("start_us"), F.unix_micros("valid_to").alias("end_us"))
    a = v.filter("event_type = 'view'").drop("event_type")
    b = v.filter("event_type = 'click'").drop("event_type")
    return versioned.interval_overlaps(a, b, "key", 86_400_000_000).select("key", "a_sequence", "b_sequence")


# windows


def _points(spark, d):
    return events(spark, d).withColumn("arrival", F.col("event_id"))


AGGS = """count(*) AS count, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sum, min(value) AS min, max(value) AS max,
 round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last"""
NAMES = ["count", "sum", "min", "max", "avg", "first", "last"]


def _rounded(df):
    return df.withColumn("avg", F.round(F.col("sum").cast("double") / F.col("count"), 6))


def _tumbling(interval: str) -> str:
    return f"""SELECT user_id, epoch_us(time_bucket(INTERVAL '{interval}', ts, TIMESTAMP '1970-01-01')) AS window_start_us,
      epoch_us(time_bucket(INTERVAL '{interval}', ts, TIMESTAMP '1970-01-01') + INTERVAL '{interval}') AS window_end_us, {AGGS} FROM events GROUP BY ALL"""


@query(_tumbling("1 hour"))
def tumbling_all_aggs(spark, d):
    return flat(_rounded(windows.windowed(_points(spark, d), windows.TUMBLING, NAMES, "1 hour", by=["user_id"])))


@query(_tumbling("7 hours"))
def tumbling_7h(spark, d):
    return flat(_rounded(windows.windowed(_points(spark, d), windows.TUMBLING, NAMES, "7 hours", by=["user_id"])))


@query("""SELECT concat('tumbling_', epoch(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01'))::BIGINT) AS window_id, count(*) AS count FROM events GROUP BY 1""")
def tumbling_window_ids(spark, d):
    out = windows.windowed(_points(spark, d), windows.TUMBLING, ["count"], "1 day")
    return out.select(windows.window_id(windows.TUMBLING, F.col("window_start")).alias("window_id"), "count")


@query("""WITH w AS (SELECT time_bucket(INTERVAL '2 hours', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '2 hours' AS s, value
  FROM events, (SELECT unnest(range(3)) AS k))
SELECT epoch_us(s) AS window_start_us, epoch_us(s + INTERVAL '6 hours') AS window_end_us, count(*) AS count, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sum FROM w GROUP BY s""")
def sliding_sum(spark, d):
    return flat(windows.windowed(_points(spark, d), windows.SLIDING, ["count", "sum"], "6 hours", "2 hours"))


@query("""WITH w AS (SELECT CAST(floor((epoch_us(ts) - 21600000000 + 7200000000 + k * 7200000000) / 1e6) AS BIGINT) AS window_second, value
  FROM events, (SELECT unnest(range(3)) AS k))
SELECT window_second, count(*) AS count, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sum FROM w GROUP BY 1""")
def sliding_as_coded(spark, d):
    out = windows.sliding_as_coded(_points(spark, d), 21600, 7200).groupBy("window_second")
    return flat(out.agg(F.count(F.lit(1)).alias("count"), F.sum("value").alias("sum")))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) > INTERVAL '30 minutes' THEN 1 ELSE 0 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS window_start_us, epoch_us(max(ts) + INTERVAL '30 minutes') AS window_end_us, count(*) AS count,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sum FROM s GROUP BY user_id, s.s""")
def session_windows(spark, d):
    return flat(windows.windowed(_points(spark, d), windows.SESSION, ["count", "sum"], "30 minutes", by=["user_id"]))


@query("SELECT CAST(epoch_us(ts) // 1800000000 AS BIGINT) AS session, count(*) AS count FROM events GROUP BY 1")
def session_bucket_as_coded(spark, d):
    return _points(spark, d).groupBy(windows.session_bucket_as_coded(F.col("ts"), 1800).alias("session")).agg(F.count(F.lit(1)).alias("count"))


@query(f"SELECT {AGGS} FROM events")
def global_window(spark, d):
    return flat(_rounded(windows.windowed(_points(spark, d), windows.GLOBAL, NAMES)))


@query("""SELECT user_id, event_id, count(*) OVER w AS running_count, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS running_sum
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def every_event_running(spark, d):
    return flat(windows.every_event(_points(spark, d), ["user_id"]), "user_id", "event_id", "running_count", "running_sum")


ARRIVAL = "CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 15) AS BIGINT)"
LATE = f"""WITH a AS (SELECT *, {ARRIVAL} AS arrival FROM events),
w AS (SELECT *, max(ts) OVER (ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS watermark FROM a),
l AS (SELECT event_id, watermark, (epoch_us(ts) // 3600000000 + 1) * 3600000000 AS end_us FROM w)"""


def _late(spark, d):
    hash_ = F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    p = events(spark, d).withColumn("arrival", hash_)
    return windows.with_watermark_and_late(p, 3600, block=F.shiftright("arrival", 50))


@query(LATE + " SELECT event_id, epoch_us(watermark) AS watermark_us, end_us <= epoch_us(watermark) AS late FROM l")
def watermark_per_event(spark, d):
    return flat(_late(spark, d), "event_id", "watermark", "late")


@query(LATE + " SELECT end_us - 3600000000 AS window_start_us, count(*) AS events, count(*) FILTER (WHERE end_us <= epoch_us(watermark)) AS late_events FROM l GROUP BY 1")
def late_event_counts(spark, d):
    out = _late(spark, d).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.count_if("late").alias("late_events"))
    return flat(out.select(F.col("w.start").alias("window_start"), "events", "late_events"))


@query("""SELECT user_id, epoch_us(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01')) AS window_start_us,
 string_agg(event_type, ',' ORDER BY event_id) AS collected FROM events GROUP BY ALL""")
def collect_values(spark, d):
    p = _points(spark, d).select("user_id", "ts", "arrival", F.col("event_type").alias("value"))
    out = windows.windowed(p, windows.TUMBLING, ["collect"], "1 day", by=["user_id"])
    return flat(out.select("user_id", "window_start", F.array_join("collect", ",").alias("collected")))


@query("""WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS s, value FROM events)
SELECT epoch_us(s) AS window_start_us, count(*) AS count FROM w GROUP BY s ORDER BY s DESC LIMIT 1""")
def latest_window(spark, d):
    return flat(windows.newest(windows.time_series(_points(spark, d), "1 hour", ("count",))), "window_start", "count")


# event sourcing


DOMAIN = "e AS (SELECT concat('account:', user_id) AS aggregate_id, event_type, event_id AS sequence, ts, CAST(value AS DECIMAL(18,2)) AS value FROM events)"


def _delta():
    return F.when(F.col("event_type") == "purchase", F.col("value")).when(F.col("event_type") == "click", -F.col("value")).otherwise(F.lit(0).cast("decimal(18,2)"))


DELTA = "CASE event_type WHEN 'purchase' THEN value WHEN 'click' THEN -value ELSE 0 END"


@query(f"WITH {DOMAIN} SELECT aggregate_id, sequence, row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence) AS version FROM e")
def aggregate_versions(spark, d):
    return eventsourcing.with_versions(domain_events(spark, d)).select("aggregate_id", "sequence", F.col("version").cast("long").alias("version"))


@query(f"WITH {DOMAIN} SELECT aggregate_id, CAST(sum({DELTA}) AS DOUBLE) AS balance, count(*) AS version FROM e GROUP BY 1")
def account_fold(spark, d):
    return flat(eventsourcing.fold_sum(domain_events(spark, d), _delta()))


@query(f"WITH {DOMAIN} SELECT aggregate_id, arg_max(event_type, sequence) AS event_type, count(*) AS version FROM e GROUP BY 1")
def last_state_fold(spark, d):
    return eventsourcing.fold_last(domain_events(spark, d), ["event_type"])


@query(f"WITH {DOMAIN} SELECT aggregate_id, sequence, CAST(sum({DELTA}) OVER (PARTITION BY aggregate_id ORDER BY sequence) AS DOUBLE) AS balance FROM e")
def running_balance(spark, d):
    return flat(eventsourcing.running(domain_events(spark, d), _delta()), "aggregate_id", "sequence", "balance")


@query(f"WITH {DOMAIN} SELECT aggregate_id, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) AS events FROM e GROUP BY 1")
def python_fold(spark, d):
    def step(state, event):
        return {"purchases": state["purchases"] + (event["event_type"] == "purchase"), "events": state["events"] + 1}

    e = domain_events(spark, d).select("aggregate_id", "event_type", "sequence")
    return eventsourcing.fold(e, step, {"purchases": 0, "events": 0}, "purchases long, events long")


@query(f"WITH {DOMAIN}, n AS (SELECT aggregate_id, sequence, row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence) AS version FROM e) SELECT sequence, version FROM n WHERE aggregate_id = 'account:5' AND version > 3")
def events_of_aggregate(spark, d):
    return eventsourcing.events_of(domain_events(spark, d), "account:5", 3).select("sequence", F.col("version").cast("long").alias("version"))


@query(f"WITH {DOMAIN} SELECT sequence, aggregate_id FROM e WHERE sequence > 100 ORDER BY sequence LIMIT 50")
def all_events_from(spark, d):
    return eventsourcing.all_events(domain_events(spark, d), 100, 50).select("sequence", "aggregate_id")


@query("SELECT count(*) AS event_count FROM events")
def event_count(spark, d):
    return eventsourcing.event_count(domain_events(spark, d))


@query(f"""WITH {DOMAIN}, a AS (SELECT aggregate_id, count(*) AS actual_version FROM e GROUP BY 1),
x AS (SELECT concat('account:', c_custkey) AS aggregate_id, 20 + c_custkey % 60 AS expected_version FROM customer)
SELECT x.aggregate_id, expected_version, actual_version, actual_version IS NULL OR actual_version = expected_version AS ok FROM x LEFT JOIN a USING (aggregate_id)""")
def concurrency_check(spark, d):
    c = table(spark, d, "customer")
    expected = c.select(F.concat(F.lit("account:"), "c_custkey").alias("aggregate_id"), (F.col("c_custkey") % 60 + 20).alias("expected_version"))
    return eventsourcing.check_expected(domain_events(spark, d), expected)


def _orders(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("total")
    )


PRICE = "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)"


@query(f"SELECT o_orderstatus AS status, count(*) AS orders, {PRICE} AS total FROM orders GROUP BY 1")
def order_projection_by_status(spark, d):
    return flat(projections.orders_by(_orders(spark, d), "status"))


@query(f"SELECT o_custkey AS customer_id, count(*) AS orders, {PRICE} AS total FROM orders GROUP BY 1")
def order_projection_by_customer(spark, d):
    return flat(projections.orders_by(_orders(spark, d), "customer_id"))


@query(f"SELECT {PRICE} AS revenue FROM orders WHERE o_orderstatus = 'F'")
def order_projection_revenue(spark, d):
    return flat(projections.delivered_revenue(_orders(spark, d)))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def projection_manager_counts(spark, d):
    """Two catch-ups of a registered projection."""
    e = domain_events(spark, d)
    m = projections.ProjectionManager()
    m.register(projections.counting("by_type", "event_type"))
    m.process(e.filter("sequence < 400"))
    m.process(e)
    return m.states["by_type"]


@query("""SELECT l_orderkey AS order_id, round(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_quantity AS DECIMAL(18,2))), 2)::DOUBLE AS total FROM lineitem GROUP BY 1""")
def order_totals(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))).alias("items")
    )
    return items.select(F.col("l_orderkey").alias("order_id"), F.round(projections.order_total(F.col("items")), 2).alias("total"))


ALLOWED = [(None, "signup"), ("signup", "view"), ("view", "click"), ("view", "view"), ("click", "purchase"), ("purchase", "view"), ("click", "view")]


@query(f"""WITH {DOMAIN}, p AS (SELECT *, lag(event_type) OVER (PARTITION BY aggregate_id ORDER BY sequence) AS previous FROM e)
SELECT sequence, aggregate_id, previous, event_type, coalesce(previous IS NULL AND event_type = 'signup' OR
 (previous, event_type) IN (('signup','view'),('view','click'),('view','view'),('click','purchase'),('purchase','view'),('click','view')), false) AS legal FROM p""")
def status_transition_check(spark, d):
    out = eventsourcing.check_transitions(domain_events(spark, d), "event_type", ALLOWED)
    return out.select("sequence", "aggregate_id", "previous", "event_type", "legal")


@query(f"""WITH {DOMAIN}, s AS (SELECT aggregate_id, sum({DELTA}) AS balance FROM e GROUP BY 1),
c AS (SELECT concat('account:', o_custkey) AS aggregate_id, o_orderkey AS command_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'open' ELSE 'withdraw' END AS command_type, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders)
SELECT command_id, command_type, coalesce(command_type = 'withdraw' AND balance * 1000 >= amount, false) AS success,
 CASE WHEN command_type <> 'withdraw' THEN 'unknown command' WHEN NOT coalesce(balance * 1000 >= amount, false) THEN 'rejected' END AS error
FROM c LEFT JOIN s USING (aggregate_id)""")
def command_handling(spark, d):
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "open").otherwise("withdraw")
    commands = o.select(
        F.concat(F.lit("account:"), "o_custkey").alias("aggregate_id"), F.col("o_orderkey").alias("command_id"), kind.alias("command_type"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount")
    )
    states = eventsourcing.fold_sum(domain_events(spark, d), _delta()).drop("version")
    out = eventsourcing.handle_commands(commands, states, {"withdraw": F.col("balance") * 1000 >= F.col("amount")})
    return out.select("command_id", "command_type", "success", "error")


# replay


@query(f"WITH {DOMAIN} SELECT sequence, aggregate_id, event_type FROM e WHERE event_type IN ('purchase','view') AND sequence BETWEEN 0 AND 5000 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '{T2}' AND value > 10")
def replay_filter(spark, d):
    where = replay.ReplayFilter(
        event_types=("purchase", "view"), start_time=_ts("2024-01-05 00:00:00"), end_time=_ts(T2), start_sequence=0, end_sequence=5000, custom=F.col("value") > 10
    )
    return replay.iter_events(domain_events(spark, d), where).select("sequence", "aggregate_id", "event_type")


@query("SELECT batch, count(*) AS events, min(event_id) AS first_sequence, max(event_id) AS last_sequence FROM (SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) // 100 AS BIGINT) AS batch FROM events WHERE event_type <> 'view') GROUP BY 1")
def replay_batches(spark, d):
    out = replay.batches(domain_events(spark, d).filter("event_type <> 'view'"), 100)
    return out.groupBy("batch").agg(F.count(F.lit(1)).alias("events"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"))


@query("SELECT count(*) FILTER (WHERE event_type <> 'error') AS processed, count(*) FILTER (WHERE event_type = 'error') AS failed, CAST(0 AS BIGINT) AS skipped, min(event_id) AS first_sequence, max(event_id) AS last_sequence FROM events")
def replay_metrics(spark, d):
    return replay.metrics(domain_events(spark, d), F.col("event_type") == "error")


@query("SELECT event_id AS sequence, event_type, CASE event_type WHEN 'error' THEN 'dead' ELSE 'ok' END AS status, CAST(CASE event_type WHEN 'error' THEN 4 ELSE 1 END AS INTEGER) AS attempts, CASE event_type WHEN 'error' THEN 'ValueError' END AS error_type FROM events")
def replay_with_retries(spark, d):
    def handler(event):
        if event["event_type"] == "error":
            raise ValueError("cannot apply")

    return replay.run(domain_events(spark, d), handler, 3, ["sequence", "event_type"]).select("sequence", "event_type", "status", "attempts", "error_type")


@query(f"SELECT event_id AS sequence, event_type, CAST(3 AS INTEGER) AS retry_count, epoch_us(ts) AS first_failed_at_us FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '{T1}'")
def dead_letters(spark, d):
    letters = replay.dead_letters(domain_events(spark, d), F.col("event_type") == "error")
    return flat(replay.select_dead_letters(letters, "error", _ts(T1)), "sequence", "event_type", "retry_count", "first_failed_at")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1")
def dlq_by_type(spark, d):
    return replay.dead_letter_stats(replay.dead_letters(domain_events(spark, d), F.col("event_type").isin("error", "signup")))


@query("SELECT event_id AS sequence FROM events WHERE event_type = 'error' AND event_id % 2 = 1")
def dead_letter_retry(spark, d):
    def handler(event):
        if event["sequence"] % 2:
            raise ValueError("still failing")

    letters = replay.dead_letters(domain_events(spark, d), F.col("event_type") == "error").select("sequence", "error", "error_type")
    return replay.retry_dead_letters(letters, handler)[1].select("sequence")


@query("SELECT event_id AS sequence FROM events WHERE event_id > 4999")
def replay_resume(spark, d):
    return replay.resume(domain_events(spark, d), 4999).select("sequence")


# event log


LOG = "log AS (SELECT 'events' AS topic, concat('user:', user_id) AS key, event_id AS sequence, CAST(CAST(concat('0x', md5(concat('user:', user_id))) AS UHUGEINT) % 3 AS INTEGER) AS partition FROM events)"
COMMITTED = "c AS (SELECT 'events' AS topic, 0 AS partition, 5000 AS next_offset UNION ALL SELECT 'events', 1, 100)"


def _log(spark, d):
    rows = events(spark, d).select(F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_id").alias("sequence"))
    return eventlog.produce(rows, eventlog.Topic("events"))


def _committed(spark):
    return spark.createDataFrame([("events", 0, 5000), ("events", 1, 100)], "topic string, partition int, next_offset long")


@query("WITH " + LOG + " SELECT DISTINCT key, partition FROM log")
def log_partitions(spark, d):
    return _log(spark, d).select("key", "partition").distinct()


@query("WITH " + LOG + " SELECT topic, partition, min(sequence) AS earliest, max(sequence) AS latest, count(*) AS events FROM log GROUP BY 1, 2")
def log_offsets(spark, d):
    return eventlog.offsets(_log(spark, d))


@query(f"WITH {LOG}, {COMMITTED} SELECT topic, partition, count(*) FILTER (WHERE next_offset IS NULL OR sequence >= next_offset) AS lag FROM log LEFT JOIN c USING (topic, partition) GROUP BY 1, 2")
def consumer_lag(spark, d):
    return eventlog.lag(_log(spark, d), _committed(spark))


@query(f"WITH {LOG}, {COMMITTED} SELECT partition, sequence FROM log LEFT JOIN c USING (topic, partition) WHERE next_offset IS NULL OR sequence >= next_offset")
def unread_events(spark, d):
    return eventlog.unread(_log(spark, d), _committed(spark)).select("partition", "sequence")


@query("WITH " + LOG + " SELECT key, sequence FROM log WHERE partition = 1 AND sequence >= 200 ORDER BY sequence LIMIT 100")
def log_fetch(spark, d):
    return eventlog.fetch(_log(spark, d), "events", 1, 200).select("key", "sequence")


@query("WITH " + LOG + " SELECT key, sequence FROM log WHERE partition = 2 AND sequence BETWEEN 100 AND 900")
def log_replay_range(spark, d):
    return eventlog.replay_range(_log(spark, d), "events", 2, 100, 900).select("key", "sequence")


@query("WITH " + LOG + " SELECT partition, sequence, row_number() OVER (PARTITION BY partition ORDER BY sequence) AS place FROM log")
def log_delivery_order(spark, d):
    out = eventlog.delivery_order(_log(spark, d), ["events"])
    return out.select("partition", "sequence", F.col("place").cast("long").alias("place"))


# content hashes, checksums


@query("SELECT sha256(text) AS address, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_address_dedup(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("address")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


CANON = "concat_ws('|', key, coalesce(CAST(value AS VARCHAR), '~'), CAST(sequence AS VARCHAR), CAST(epoch_us(ts) AS VARCHAR), record_type)"


def _checked(spark, d):
    r = records(spark, d)
    return r.withColumn("checksum", hashing.checksum(F.col("key"), F.col("value"), F.col("sequence"), F.unix_micros("ts"), F.col("record_type")))


@query(f"WITH {RECORDS} SELECT sequence, sha256({CANON}) AS checksum, true AS valid FROM records")
def checksum_verify(spark, d):
    r = _checked(spark, d)
    again = hashing.checksum(F.col("key"), F.col("value"), F.col("sequence"), F.unix_micros("ts"), F.col("record_type"))
    return r.select("sequence", "checksum", (again == F.col("checksum")).alias("valid"))


@query(f"""WITH {LATEST}, h AS (SELECT key, sha256({CANON}) AS hash FROM latest),
b AS (SELECT bucket, sha256(string_agg(p, ',' ORDER BY p)) AS h FROM (SELECT 0 AS bucket, concat(key, ':', hash) AS p FROM h) GROUP BY 1)
SELECT sha256(string_agg(h, ',' ORDER BY bucket)) AS state_hash FROM b""")
def state_hash(spark, d):
    h = versioned.latest(_checked(spark, d)).select("key", F.col("checksum").alias("hash"))
    return hashing.state_hash(h, "key", "hash", buckets=1)


# CRDTs


OPS = """o AS (SELECT concat('user:', user_id) AS key, event_id AS idx, concat('node', event_id % 3) AS node, epoch_us(ts) AS physical, event_type, CAST(value AS DECIMAL(18,2)) AS value FROM events)"""


def _registers(spark, d):
    o = replica_ops(spark, d)
    dead = F.col("event_type") == "error"
    return o.select("key", F.when(~dead, F.col("value")).alias("value"), "hlc", dead.alias("tombstone"))


@query(f"WITH {OPS} SELECT key, CASE WHEN arg_max(event_type, (physical, node)) <> 'error' THEN CAST(arg_max(value, (physical, node)) AS DOUBLE) END AS value, max(physical) AS physical FROM o GROUP BY 1")
def lww_merge(spark, d):
    return flat(crdt.lww_merge(_registers(spark, d)).select("key", "value", F.col("hlc.physical").alias("physical")))


@query(f"WITH {OPS} SELECT key, CASE WHEN arg_min(event_type, (physical, node)) <> 'error' THEN CAST(arg_min(value, (physical, node)) AS DOUBLE) END AS value, min(physical) AS physical FROM o GROUP BY 1")
def fww_merge(spark, d):
    return flat(crdt.fww_merge(_registers(spark, d)).select("key", "value", F.col("hlc.physical").alias("physical")))


@query(f"WITH {OPS} SELECT key, CAST(arg_max(value, (physical, node)) AS DOUBLE) AS value FROM o GROUP BY 1 HAVING arg_max(event_type, (physical, node)) <> 'error'")
def lww_map(spark, d):
    return flat(crdt.lww_map(_registers(spark, d)).select("key", "value"))


@query(f"WITH {OPS} SELECT key, event_type AS value, max(physical) AS physical FROM o GROUP BY 1, 2")
def mv_register(spark, d):
    o = replica_ops(spark, d).select("key", F.col("event_type").alias("value"), "hlc")
    return crdt.mv_merge(o).select("key", "value", F.col("hlc.physical").alias("physical"))


@query(f"""WITH {OPS}, t AS (SELECT idx AS tag, key AS value, physical, node FROM o WHERE event_type = 'purchase'),
r AS (SELECT key AS value, max((physical, node)) AS until FROM o WHERE event_type = 'error' GROUP BY 1)
SELECT DISTINCT t.value FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.value = t.value AND (t.physical, t.node) <= r.until)""")
def or_set(spark, d):
    o = replica_ops(spark, d)
    tags = o.filter("event_type = 'purchase'").select(F.col("idx").alias("tag"), F.col("key").alias("value"), "hlc")
    removals = o.filter("event_type = 'error'").select(F.col("key").alias("value"), "hlc")
    return crdt.or_set(tags, crdt.or_set_tombstones(tags, removals))


@query(f"WITH {OPS} SELECT concat(key, '/', node) AS value FROM o GROUP BY 1 HAVING bool_or(event_type = 'purchase') AND NOT bool_or(event_type = 'error')")
def two_phase_set(spark, d):
    op = F.when(F.col("event_type") == "purchase", "add").when(F.col("event_type") == "error", "remove")
    o = replica_ops(spark, d).select(F.concat("key", F.lit("/"), "node").alias("value"), op.alias("op"))
    return crdt.two_phase_set(o)


#: Each replica reports, per node, how many events it saw up to a time of its own.
STATES = f"""{OPS}, s AS (SELECT r.replica, key, node, CASE event_type WHEN 'error' THEN 'N' ELSE 'P' END AS sign, count(*) AS count
FROM o JOIN (SELECT unnest(range(3)) AS replica) r ON o.idx % 4 <> r.replica GROUP BY ALL)"""


def _states(spark, d, by):
    o = replica_ops(spark, d).withColumn("sign", F.when(F.col("event_type") == "error", "N").otherwise("P"))
    parts = [o.filter(F.col("idx") % 4 != r).groupBy(*by).agg(F.count(F.lit(1)).alias("count")) for r in range(3)]
    return crdt.union_all(parts)


@query(f"WITH {STATES}, n AS (SELECT replica, node, sum(count) AS c FROM s GROUP BY 1, 2), m AS (SELECT node, max(c) AS c FROM n GROUP BY 1) SELECT CAST(sum(c) AS BIGINT) AS value FROM m")
def g_counter(spark, d):
    return crdt.g_counter(_states(spark, d, ["node"]))


@query(f"""WITH {STATES}, n AS (SELECT replica, node, sign, sum(count) AS c FROM s GROUP BY 1, 2, 3), m AS (SELECT node, sign, max(c) AS c FROM n GROUP BY 1, 2)
SELECT CAST(sum(c) FILTER (WHERE sign = 'P') AS BIGINT) AS positive, CAST(sum(c) FILTER (WHERE sign = 'N') AS BIGINT) AS negative,
 CAST(sum(CASE sign WHEN 'P' THEN c ELSE -c END) AS BIGINT) AS value FROM m""")
def pn_counter(spark, d):
    return crdt.pn_counter(_states(spark, d, ["node", "sign"]))


@query(f"WITH {STATES}, n AS (SELECT replica, key, node, sum(count) AS c FROM s GROUP BY 1, 2, 3), m AS (SELECT key, node, max(c) AS c FROM n GROUP BY 1, 2) SELECT key, CAST(sum(c) AS BIGINT) AS value FROM m GROUP BY 1")
def g_counter_map(spark, d):
    return crdt.g_counter(_states(spark, d, ["key", "node"]), ["key"])


@query(f"""WITH {STATES}, m AS (SELECT key, node, sign, max(count) AS c FROM s GROUP BY 1, 2, 3)
SELECT key, CAST(coalesce(sum(c) FILTER (WHERE sign = 'P'), 0) AS BIGINT) AS positive, CAST(coalesce(sum(c) FILTER (WHERE sign = 'N'), 0) AS BIGINT) AS negative,
 CAST(sum(CASE sign WHEN 'P' THEN c ELSE -c END) AS BIGINT) AS value FROM m GROUP BY 1""")
def pn_counter_map(spark, d):
    return crdt.pn_counter(_states(spark, d, ["key", "node", "sign"]), ["key"])


@query(f"WITH {OPS}, s AS (SELECT key, node AS node_id, count(*) AS counter FROM o GROUP BY 1, 2) SELECT key, counter, node_id FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY counter DESC, node_id DESC) = 1")
def lex_counter(spark, d):
    s = replica_ops(spark, d).groupBy("key", F.col("node").alias("node_id")).agg(F.count(F.lit(1)).alias("counter"))
    return crdt.lexicographic_counter(s)


CLOCKS = f"{OPS}, c AS (SELECT key, node, count(*) FILTER (WHERE event_type <> 'view') AS n, count(*) FILTER (WHERE event_type <> 'click') AS m FROM o GROUP BY 1, 2)"


def _clocks(spark, d):
    o = replica_ops(spark, d)
    c = o.groupBy("key", "node").agg(F.count_if(F.col("event_type") != "view").alias("n"), F.count_if(F.col("event_type") != "click").alias("m"))
    to_map = lambda x: F.map_from_entries(F.collect_list(F.struct("node", x)))
    return c.groupBy("key").agg(to_map("n").alias("a"), to_map("m").alias("b"))


@query(f"WITH {CLOCKS} SELECT key, node, greatest(n, m) AS n FROM c")
def vector_clock_merge(spark, d):
    merged = _clocks(spark, d).select("key", F.explode(crdt.clock_merge(F.col("a"), F.col("b"))).alias("node", "n"))
    return merged.select("key", "node", F.col("n").cast("long").alias("n"))


@query(f"WITH {CLOCKS} SELECT key, bool_and(n <= m) AND bool_or(n < m) AS before FROM c GROUP BY 1")
def vc_happens_before(spark, d):
    return _clocks(spark, d).select("key", crdt.happens_before(F.col("a"), F.col("b")).alias("before"))


@query(f"WITH {CLOCKS} SELECT key, NOT (bool_and(n <= m) AND bool_or(n < m)) AND NOT (bool_and(m <= n) AND bool_or(m < n)) AS concurrent, bool_and(n = m) AS equal FROM c GROUP BY 1")
def vc_concurrent(spark, d):
    return _clocks(spark, d).select(
        "key", crdt.is_concurrent(F.col("a"), F.col("b")).alias("concurrent"), crdt.clocks_equal(F.col("a"), F.col("b")).alias("equal")
    )


@query(f"WITH {OPS} SELECT key, CASE WHEN arg_max(event_type, idx) <> 'error' THEN CAST(arg_max(value, idx) AS DOUBLE) END AS value FROM o WHERE idx >= (SELECT max(idx) // 10 FROM o) AND idx < (SELECT max(idx) * 9 // 10 FROM o) GROUP BY 1")
def oplog_replay(spark, d):
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("set")
    top = _top(replica_ops(spark, d), "idx")
    ops = crdt.oplog_slice(replica_ops(spark, d).withColumn("operation_type", kind), top // 10, top * 9 // 10)
    return flat(crdt.oplog_registers(ops))


@query(f"WITH {OPS} SELECT key, CAST(sum(CASE event_type WHEN 'error' THEN -value ELSE value END) AS DOUBLE) AS value FROM o GROUP BY 1")
def oplog_counter_replay(spark, d):
    kind = F.when(F.col("event_type") == "error", "decrement").otherwise("increment")
    return flat(crdt.oplog_counters(replica_ops(spark, d).withColumn("operation_type", kind)))


@query(f"WITH {OPS}, l AS (SELECT key, node, event_type FROM o WHERE event_type IN ('purchase', 'error') QUALIFY row_number() OVER (PARTITION BY key, node ORDER BY idx DESC) = 1) SELECT key, node AS value FROM l WHERE event_type = 'purchase'")
def oplog_set_replay(spark, d):
    o = replica_ops(spark, d).filter("event_type in ('purchase', 'error')")
    kind = F.when(F.col("event_type") == "error", "remove").otherwise("add")
    return crdt.oplog_sets(o.select("key", F.col("node").alias("value"), "idx", kind.alias("operation_type")))


@query(f"""WITH {OPS}, a AS (SELECT key, arg_max(event_type, idx) AS v FROM o WHERE node = 'node0' GROUP BY 1), b AS (SELECT key, arg_max(event_type, idx) AS v FROM o WHERE node = 'node1' GROUP BY 1)
SELECT key, a.v AS left_value, b.v AS right_value FROM a JOIN b USING (key) WHERE a.v <> b.v""")
def diagnose_merge(spark, d):
    o = replica_ops(spark, d)
    last = lambda n: o.filter(F.col("node") == n).groupBy("key").agg(F.max_by("event_type", "idx").alias("value"))
    return crdt.diagnose(last("node0"), last("node1"), ["key"])


@query(f"WITH {OPS} SELECT key, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS value FROM o GROUP BY 1")
def merge_all_resolver(spark, d):
    o = replica_ops(spark, d).select("key", F.col("event_type").alias("value"))
    return crdt.resolver("merge_all")(o, "key").select("key", F.array_join("value", ",").alias("value"))


@query(f"WITH {OPS} SELECT key AS name, event_type AS value, count(*) AS tags, count(*) FILTER (WHERE event_type = 'error' AND idx % 2 = 0) AS gone FROM o GROUP BY 1, 2")
def or_set_merge(spark, d):
    """Two replicas know all tags; one of them has removed some."""
    o = replica_ops(spark, d)
    tags = o.select(F.col("key").alias("name"), F.col("event_type").alias("value"), F.concat_ws("-", "node", "idx").alias("tag"), "hlc", "idx")
    a = tags.withColumn("removed", F.lit(False)).drop("idx")
    b = tags.withColumn("removed", (F.col("value") == "error") & (F.col("idx") % 2 == 0)).drop("idx")
    merged = crdt.merge(["ORSet", "ORSet"], [a, b])
    return merged.groupBy("name", "value").agg(F.count(F.lit(1)).alias("tags"), F.count_if("removed").alias("gone"))


def _counts(spark, d, kind):
    o = replica_ops(spark, d).filter(F.col("event_type") != kind)
    return o.groupBy(F.lit("c").alias("name"), "key", "node").agg(F.count(F.lit(1)).alias("count"))


COUNTS = f"{OPS}, x AS (SELECT key, node, count(*) FILTER (WHERE event_type <> 'view') AS a, count(*) FILTER (WHERE event_type <> 'click') AS b FROM o GROUP BY 1, 2)"


@query(f"WITH {COUNTS} SELECT key, CAST(sum(greatest(a, b)) AS BIGINT) AS value FROM x GROUP BY 1 HAVING sum(a + b) > 0")
def merge_counter_maps(spark, d):
    return crdt.merge_gcounter_map(_counts(spark, d, "view").drop("name"), _counts(spark, d, "click").drop("name"))


@query(f"WITH {COUNTS} SELECT 'counter_mismatch' AS type, concat('c/', key, '/', node) AS entry, CAST(a AS VARCHAR) AS left_value, CAST(b AS VARCHAR) AS right_value FROM x WHERE a > 0 AND b > 0 AND a <> b")
def auto_merge_conflicts(spark, d):
    kinds = ("GCounterMap", "GCounterMap")
    return crdt_state.auto_merge(kinds, _counts(spark, d, "view"), _counts(spark, d, "click")).conflicts


@query("SELECT 'type_mismatch' AS type, CAST(NULL AS VARCHAR) AS entry, 'GCounter' AS left_value, 'PNCounter' AS right_value")
def diagnose_type_clash(spark, d):
    return crdt_state.diagnose(("GCounter", "PNCounter"), _counts(spark, d, "view"), _counts(spark, d, "click"))


@query(f"WITH {OPS} SELECT node AS name, key, CASE event_type WHEN 'error' THEN 'N' ELSE 'P' END AS sign, node, count(*) AS count FROM o GROUP BY ALL")
def crdt_json_counters(spark, d):
    """A map of signed counters for each node, to JSON and back."""
    sign = F.when(F.col("event_type") == "error", "N").otherwise("P")
    o = replica_ops(spark, d).groupBy(F.col("node").alias("name"), "key", sign.alias("sign"), "node").agg(F.count(F.lit(1)).alias("count"))
    return crdt_state.decode("PNCounterMap", crdt_state.encode("PNCounterMap", o))


@query(f"WITH {OPS} SELECT node AS name, key, CAST(arg_max(event_type, idx) AS VARCHAR) AS value, arg_max(event_type, idx) = 'error' AS tombstone, arg_max(physical, idx) AS physical FROM o GROUP BY 1, 2")
def crdt_json_registers(spark, d):
    """A map of registers for each node, to JSON and back."""
    last = F.max_by(F.struct(F.col("event_type").alias("value"), "hlc", (F.col("event_type") == "error").alias("tombstone")), "idx").alias("s")
    o = replica_ops(spark, d).groupBy(F.col("node").alias("name"), "key").agg(last).select("name", "key", "s.*")
    out = crdt_state.decode("LWWMap", crdt_state.encode("LWWMap", o))
    return out.select("name", "key", "value", "tombstone", F.col("hlc.physical").cast("long").alias("physical"))


@query(f"WITH {OPS} SELECT idx, greatest(physical, 1705000000000000) AS ticked, CASE WHEN 1705000000000000 > physical THEN 0 ELSE 1 END AS tick_logical, greatest(physical, 1705000000000000, 1704900000000000) AS received, CASE WHEN greatest(physical, 1705000000000000) = physical THEN 1 ELSE 0 END AS receive_logical FROM o")
def hlc_tick_receive(spark, d):
    now, other = F.lit(1705000000000000), F.struct(F.lit(1704900000000000).alias("physical"), F.lit(4).cast("long").alias("logical"), F.lit("x").alias("node_id"))
    o = replica_ops(spark, d).select("idx", crdt.hlc_tick(F.col("hlc"), now).alias("t"), crdt.hlc_receive(F.col("hlc"), other, now).alias("r"))
    number = lambda c: F.col(c).cast("int")
    return o.select("idx", F.col("t.physical").alias("ticked"), number("t.logical").alias("tick_logical"), F.col("r.physical").alias("received"), number("r.logical").alias("receive_logical"))


@query("SELECT epoch_us(min(time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01')) + INTERVAL '1 hour') AS earliest_end_us FROM events")
def earliest_window_end(spark, d):
    return flat(windows.earliest_end(windows.windowed(_points(spark, d), windows.TUMBLING, ["count"], "1 hour")))


@query("""SELECT epoch_us(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01')) AS window_start_us, count(*) AS count, CAST(min(value) AS DOUBLE) AS min, CAST(max(value) AS DOUBLE) AS max FROM events GROUP BY 1""")
def time_series_1d(spark, d):
    return flat(windows.time_series(_points(spark, d), "1 day", ("count", "min", "max")), "window_start", "count", "min", "max")


@query(f"SELECT epoch_us(TIMESTAMP '{T1}') AS window_start_us, count(*) AS count FROM events WHERE ts >= TIMESTAMP '{T1}' AND ts < TIMESTAMP '{T1}' + INTERVAL '1 day'")
def window_closed_early(spark, d):
    return flat(windows.close_early(_points(spark, d), windows.TUMBLING, ["count"], _ts(T1), "1 day"), "window_start", "count")


@query(f"WITH {LATEST} SELECT key, sequence, record_type FROM latest")
def store_round_trip(spark, d):
    """Records appended to a store, a put and a deletion on top, and read back without the two."""
    from ..operators.ranges import shared_folder
    from ..sources.store import AppendOnlyStore

    store = AppendOnlyStore(spark, shared_folder(spark, "store"))
    rows = records(spark, d)
    store.append_table(spark.createDataFrame([], RECORD_SCHEMA).unionByName(rows.select("key", "sequence", "ts", "record_type", F.col("value").cast("string").alias("value")), allowMissingColumns=True))
    store.put("added", {"n": 1})
    store.delete("added")
    return versioned.latest(store.records).filter("key <> 'added'").select("key", "sequence", "record_type")


# snapshots


#: A full snapshot is taken at seven tenths of the sequences, the next one at nine tenths.
FULL_AT, NEXT_AT = ("(SELECT max(event_id) * %d // 10 FROM events)" % k for k in (7, 9))


def _top(df: DataFrame, column: str) -> int:
    return df.agg(F.max(column)).first()[0] or 0


def _cuts(spark, d):
    r = records(spark, d)
    top = _top(r, "sequence")
    return r, top * 7 // 10, top * 9 // 10


@query(f"WITH {RECORDS} SELECT {ROW} FROM records WHERE sequence <= {FULL_AT} QUALIFY row_number() OVER (PARTITION BY key ORDER BY sequence DESC) = 1")
def snapshot_full(spark, d):
    r, full, _ = _cuts(spark, d)
    return flat(snapshots.capture(r, full), *ROW_COLUMNS)


@query(f"WITH {RECORDS} SELECT {ROW} FROM records WHERE sequence > {FULL_AT} AND sequence <= {NEXT_AT} QUALIFY row_number() OVER (PARTITION BY key ORDER BY sequence DESC) = 1")
def snapshot_incremental(spark, d):
    r, full, after = _cuts(spark, d)
    return flat(snapshots.capture(r, after, full), *ROW_COLUMNS)


@query(f"WITH {RECORDS} SELECT {ROW} FROM records WHERE sequence <= {NEXT_AT} QUALIFY row_number() OVER (PARTITION BY key ORDER BY sequence DESC) = 1")
def snapshot_restore(spark, d):
    r, full, after = _cuts(spark, d)
    return flat(snapshots.restore([snapshots.capture(r, full), snapshots.capture(r, after, full)]), *ROW_COLUMNS)


@query(f"WITH {RECORDS} SELECT count(*) AS record_count, count(DISTINCT key) AS key_count FROM records WHERE sequence <= {FULL_AT}")
def snapshot_counts(spark, d):
    r, full, _ = _cuts(spark, d)
    return snapshots.describe(r, full)


#: Orders stand for snapshots here: an id, a kind, a sequence, sizes and an age.
META = """m AS (SELECT concat('s', o_orderkey) AS snapshot_id, CASE WHEN o_orderkey % 3 = 0 THEN 'FULL' ELSE 'INCREMENTAL' END AS snapshot_type, o_orderkey AS sequence,
 CAST(o_totalprice * 4000 AS BIGINT) AS size_bytes, o_custkey * 900 AS record_count, CAST(o_orderkey * 61 AS DOUBLE) AS age_seconds FROM orders)"""


def _meta(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.concat(F.lit("s"), "o_orderkey").alias("snapshot_id"), F.when(F.col("o_orderkey") % 3 == 0, "FULL").otherwise("INCREMENTAL").alias("snapshot_type"),
        F.col("o_orderkey").alias("sequence"), F.round(F.col("o_totalprice") * 4000).cast("long").alias("size_bytes"), (F.col("o_custkey") * 900).alias("record_count"),
        (F.col("o_orderkey") * 61).cast("double").alias("age_seconds"),
    )


@query(f"WITH {META} SELECT snapshot_type, count(*) AS snapshots, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, CAST(sum(record_count) AS BIGINT) AS records FROM m GROUP BY 1")
def snapshot_stats(spark, d):
    return snapshots.stats_by_type(_meta(spark, d))


@query(f"WITH {META} SELECT snapshot_id, sequence FROM m WHERE snapshot_type = 'FULL' AND sequence BETWEEN 100 AND 5000")
def snapshot_list(spark, d):
    return snapshots.list_snapshots(_meta(spark, d), "FULL", 100, 5000).select("snapshot_id", "sequence")


@query(f"WITH {META} SELECT arg_max(snapshot_id, sequence) AS snapshot_id FROM m WHERE snapshot_type = 'FULL' AND sequence < 1000")
def snapshot_base(spark, d):
    return snapshots.newest_below(_meta(spark, d), 1000)


@query(f"WITH {META} SELECT snapshot_id, sequence FROM m ORDER BY sequence DESC LIMIT 3")
def snapshots_kept(spark, d):
    return snapshots.keep_newest(_meta(spark, d)).select("snapshot_id", "sequence")


SCORES = f"""{META}, p AS (SELECT *, CASE WHEN age_seconds < 3600 THEN 0.0::DOUBLE WHEN age_seconds > 604800 THEN 1.0::DOUBLE ELSE age_seconds / 604800.0::DOUBLE END AS t,
 least(size_bytes / 1073741824.0::DOUBLE, 1.0::DOUBLE) AS s, CASE WHEN record_count < 10000 THEN 0.0::DOUBLE WHEN record_count > 1000000 THEN 1.0::DOUBLE ELSE record_count / 1000000.0::DOUBLE END AS c FROM m)"""


@query(f"WITH {SCORES} SELECT snapshot_id, t AS time, s AS size, c AS count, 0.3::DOUBLE * t + 0.4::DOUBLE * s + 0.3::DOUBLE * c AS hybrid, 0.5::DOUBLE AS custom FROM p")
def compaction_scores(spark, d):
    m = _meta(spark, d)
    cols = [
        scores.compaction_score(k, F.col("age_seconds"), F.col("size_bytes"), F.col("record_count"))
        for k in ("TIME", "SIZE", "COUNT", "HYBRID", "CUSTOM")
    ]
    return m.select("snapshot_id", *[c.cast("double").alias(n) for c, n in zip(cols, ("time", "size", "count", "hybrid", "custom"))])


@query(f"WITH {SCORES}, q AS (SELECT snapshot_id, t, row_number() OVER (ORDER BY t DESC, snapshot_id DESC) AS back FROM p WHERE t > 0.5) SELECT snapshot_id FROM q WHERE back > 5")
def compaction_candidates(spark, d):
    return snapshots.compaction_candidates(_meta(spark, d), "TIME", 5).select("snapshot_id")


@query("""SELECT l AS level, n AS nodes, CAST(CASE l WHEN 'STRONG' THEN n WHEN 'QUORUM' THEN n // 2 + 1 WHEN 'LOCAL_QUORUM' THEN greatest(1, n // 3) ELSE 1 END AS INTEGER) AS required
FROM (SELECT unnest(['STRONG','QUORUM','LOCAL_QUORUM','EVENTUAL']) AS l), (SELECT DISTINCT CAST(n_regionkey + 3 AS INTEGER) AS n FROM nation)""")
def quorum_required(spark, d):
    n = table(spark, d, "nation").select((F.col("n_regionkey") + 3).cast("int").alias("nodes")).distinct()
    levels = n.select("nodes", F.explode(F.array(*[F.lit(x) for x in ("STRONG", "QUORUM", "LOCAL_QUORUM", "EVENTUAL")])).alias("level"))
    return levels.select("level", "nodes", scores.required_replicas(F.col("level"), F.col("nodes")).alias("required"))


@query("""SELECT n_regionkey AS region, list_sort(list(n_nationkey), 'DESC')[len(list(n_nationkey)) // 2 + 1] AS commit_index FROM nation GROUP BY 1""")
def commit_indexes(spark, d):
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.collect_list("n_nationkey").alias("m"))
    return n.select("region", scores.commit_index(F.col("m")).alias("commit_index"))


ANTI = f"WITH {RECORDS}, h AS (SELECT key, sequence, sha256({CANON}) AS hash FROM records), a AS (SELECT key, arg_max(hash, sequence) AS h FROM h WHERE sequence <= {NEXT_AT} GROUP BY 1), b AS (SELECT key, arg_max(hash, sequence) AS h FROM h WHERE sequence > (SELECT max(event_id) // 10 FROM events) GROUP BY 1)"


@query(ANTI + " SELECT coalesce(a.key, b.key) AS key, a.h AS left_hash, b.h AS right_hash, CASE WHEN a.h IS NULL THEN 'missing_left' WHEN b.h IS NULL THEN 'missing_right' ELSE 'different' END AS divergence FROM a FULL OUTER JOIN b ON a.key = b.key WHERE a.h IS DISTINCT FROM b.h")
def anti_entropy_diff(spark, d):
    r = _checked(spark, d).select("key", "sequence", F.col("checksum").alias("hash"))
    # one replica has not got the last tenth yet, the other never had the first
    top = _top(r, "sequence")
    a = versioned.latest(r.filter(F.col("sequence") <= top * 9 // 10))
    b = versioned.latest(r.filter(F.col("sequence") > top // 10))
    return snapshots.divergence(a, b)


# user-defined functions


@query("SELECT user_id, epoch_us(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01')) AS window_start_us, median(value) AS middle FROM events GROUP BY ALL")
def udaf_median(spark, d):
    p = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_id").alias("arrival"))
    out = p.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.median("value").alias("middle"))
    return flat(out.select("user_id", F.col("w.start").alias("window_start"), "middle"))


@query("SELECT user_id, max(value) - min(value) AS spread FROM events GROUP BY 1")
def custom_aggregation(spark, d):
    p = table(spark, d, "events").withColumn("arrival", F.col("event_id"))
    return windows.windowed(p, windows.GLOBAL, [("spread", lambda v: F.max(v) - F.min(v))], by=["user_id"])


@query("SELECT event_id AS sequence FROM events WHERE event_id % 7 = 3")
def udf_filter(spark, d):
    @F.pandas_udf("boolean")
    def chosen(s: pd.Series) -> pd.Series:
        return s % 7 == 3

    return replay.iter_events(domain_events(spark, d), replay.ReplayFilter(custom=chosen("sequence"))).select("sequence")


# streaming


@query("""WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS s, value FROM events)
SELECT epoch_us(s) AS window_start_us, epoch_us(s + INTERVAL '1 hour') AS window_end_us, count(*) AS count, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sum
FROM w GROUP BY s HAVING s + INTERVAL '1 hour' <= (SELECT max(ts) FROM events)""")
def stream_tumbling(spark, d):
    from ..streaming import queries as streaming

    out = streaming.windowed_stream(streaming.event_stream(spark, d), windows.TUMBLING, ["count", "sum"], "1 hour")
    return flat(streaming.run_to_table(out, "stream-tumbling"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) > INTERVAL '30 minutes' THEN 1 ELSE 0 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS window_start_us, epoch_us(max(ts) + INTERVAL '30 minutes') AS window_end_us, count(*) AS count FROM s GROUP BY user_id, s.s
HAVING max(ts) + INTERVAL '30 minutes' <= (SELECT max(ts) FROM events)""")
def stream_session(spark, d):
    from ..streaming import queries as streaming

    out = streaming.windowed_stream(streaming.event_stream(spark, d), windows.SESSION, ["count"], "30 minutes", by=["user_id"])
    return flat(streaming.run_to_table(out, "stream-session"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_projection(spark, d):
    from ..streaming import queries as streaming

    changes = streaming.project_stream(streaming.event_stream(spark, d), "stream-projection", lambda b: b.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
    return changes.groupBy("event_type").agg(F.sum("n").alias("n"))


@query("""WITH n AS (SELECT concat('', user_id) AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT key, max(n) // 10 AS emissions FROM n GROUP BY 1 HAVING max(n) >= 10""")
def stream_stateful(spark, d):
    """ON_COUNT: an emission for every ten events of a user."""
    from ..streaming import queries as streaming

    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = streaming.run_to_table(streaming.emit_on_count(streaming.event_stream(spark, d), "user_id", 10), "stream-stateful")
    finally:
        if held:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    return out.groupBy("key").agg(F.max("emitted").alias("emissions"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return latest_state(spark, d)


