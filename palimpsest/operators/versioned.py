"""Versioned tables: every row is one immutable version of a key.

Operators take records (key, sequence, ts, record_type, value, ...) and return
DataFrames; nothing is collected.  ``sequence`` is the order of writing, ``ts``
when a version became valid.  Equal times resolve to the lowest sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ranges
from ..functions.intervals import interval
from ..schema import DATA, TOMBSTONE

def by_key():
    return Window.partitionBy("key").orderBy("sequence")


def live(df: DataFrame) -> DataFrame:
    return df.filter(F.col("record_type") != TOMBSTONE)


def latest(records: DataFrame) -> DataFrame:
    """The version of highest sequence of each key, deletions included."""
    rest = [c for c in records.columns if c != "key"]
    best = records.groupBy("key").agg(F.max_by(F.struct(*rest), "sequence").alias("r"))
    return best.select("key", *[F.col(f"r.{c}").alias(c) for c in rest])


def scan(records, prefix=None, start_key=None, end_key=None, limit=None, include_tombstones=False) -> DataFrame:
    """Latest versions in key order; bounds are inclusive, the limit counts returned rows.

    Conditions on the key hold for all of its versions, so they are put below
    the aggregation where the file scan sees them.
    """
    rows = records
    if prefix is not None:
        rows = rows.filter(F.col("key").startswith(prefix))
    if start_key is not None:
        rows = rows.filter(F.col("key") >= start_key)
    if end_key is not None:
        rows = rows.filter(F.col("key") <= end_key)
    rows = latest(rows)
    rows = rows if include_tombstones else live(rows)
    rows = rows.orderBy("key")
    return rows.limit(limit) if limit else rows


def keys(records: DataFrame) -> DataFrame:
    """Every key ever written, deleted ones too."""
    return records.select("key").distinct()


def contains(records: DataFrame, key: str) -> bool:
    return not records.filter(F.col("key") == key).isEmpty()


def stats(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count(F.lit(1)).alias("total_records"), F.countDistinct("key").alias("key_count"), F.max("sequence").alias("high_sequence")
    )


def between_times(records: DataFrame, start, end) -> DataFrame:
    """All versions with ts in the closed interval."""
    return records.filter(F.col("ts").between(F.lit(start), F.lit(end)))


def with_validity(records: DataFrame) -> DataFrame:
    """Adds valid_from, valid_to (the next version's ts; null while open) and is_deleted."""
    return records.withColumns(
        {
            "valid_from": F.col("ts"),
            "valid_to": F.lead("ts").over(by_key()),
            "is_deleted": F.col("record_type") == TOMBSTONE,
        }
    )


def history(records: DataFrame, key: str | None = None, include_tombstones: bool = False) -> DataFrame:
    """Versions with validity; deletions end a version's validity even where they are hidden."""
    rows = records if key is None else records.filter(F.col("key") == key)
    rows = with_validity(rows)
    return rows if include_tombstones else live(rows)


def duration_us(df: DataFrame) -> Column:
    """Microseconds of validity; null while open."""
    return F.unix_micros("valid_to") - F.unix_micros("valid_from")


def versions(records: DataFrame) -> DataFrame:
    """Each key's sequences in order."""
    return records.groupBy("key").agg(F.array_sort(F.collect_list("sequence")).alias("versions"))


def as_of(records: DataFrame, ts, with_interval: bool = True) -> DataFrame:
    """Each key's version at ``ts`` (inclusive), deletions included.

    valid_to comes from the whole history.  Without it the filter on ts reaches
    the file scan and only partial aggregates are shuffled; with it the pick
    reuses the window's partitioning.
    """
    rows = with_validity(records) if with_interval else records
    rows = rows.filter(F.col("ts") <= F.lit(ts))
    rest = [c for c in rows.columns if c != "key"]
    first = F.struct("ts", -F.col("sequence"))
    best = rows.groupBy("key").agg(F.max_by(F.struct(*rest), first).alias("r"))
    return best.select("key", *[F.col(f"r.{c}").alias(c) for c in rest])


def as_of_sequence(records: DataFrame, sequence: int) -> DataFrame:
    """The version with exactly this sequence."""
    return history(records, include_tombstones=True).filter(F.col("sequence") == sequence)


def snapshot_at(records: DataFrame, ts, prefix: str | None = None) -> DataFrame:
    """The live keys at a moment."""
    rows = records if prefix is None else records.filter(F.col("key").startswith(prefix))
    return live(as_of(rows, ts, with_interval=False))


def diff(records: DataFrame, t1, t2, prefix: str | None = None, deletes_as_removed: bool = False) -> DataFrame:
    """Keys whose value differs between two moments: added, removed or modified.

    One pass: both states are conditional picks of a single aggregation instead
    of a join.  A deletion is a modification to null unless ``deletes_as_removed``.
    """
    rows = records if prefix is None else records.filter(F.col("key").startswith(prefix))
    state = F.struct("value", "ts", "record_type")
    order = F.struct("ts", -F.col("sequence"))
    at = lambda t: F.max_by(F.when(F.col("ts") <= F.lit(t), state), F.when(F.col("ts") <= F.lit(t), order))
    both = rows.groupBy("key").agg(at(t1).alias("a"), at(t2).alias("b"))
    if deletes_as_removed:
        gone = lambda c: F.when(F.col(f"{c}.record_type") != TOMBSTONE, F.col(c))
        both = both.select("key", gone("a").alias("a"), gone("b").alias("b"))
    kind = (
        F.when(F.col("a").isNull() & F.col("b").isNotNull(), "added")
        .when(F.col("a").isNotNull() & F.col("b").isNull(), "removed")
        .when(~F.col("a.value").eqNullSafe(F.col("b.value")), "modified")
    )
    return both.select(
        "key", kind.alias("change_type"), F.col("a.value").alias("old_value"), F.col("b.value").alias("new_value"),
        F.col("a.ts").alias("old_ts"), F.col("b.ts").alias("new_ts"),
    ).filter(F.col("change_type").isNotNull())


def changes_between(records: DataFrame, start, end, key: str | None = None) -> DataFrame:
    """Versions (deletions too) in a closed interval; valid_to looks beyond it."""
    return history(records, key, include_tombstones=True).filter(F.col("ts").between(F.lit(start), F.lit(end)))


def changes_since(records: DataFrame, since, now, key: str | None = None) -> DataFrame:
    return changes_between(records, since, now, key)


def temporal_aggregate(records: DataFrame, window: str = "1h", key: str | None = None, aggregator=F.sum) -> DataFrame:
    """Live versions' values by key and epoch-aligned bucket; ``aggregator`` maps a column to an aggregate."""
    rows = live(records if key is None else records.filter(F.col("key") == key))
    out = rows.groupBy("key", F.window("ts", interval(window)).alias("w")).agg(aggregator(F.col("value")).alias("result"))
    return out.select("key", F.col("w.start").alias("bucket"), "result")


def value_time_range(records: DataFrame, key: str, value, now) -> DataFrame:
    """When a key first had a value, and until when; ``now`` if it still has."""
    rows = history(records, key).filter(F.col("value").eqNullSafe(F.lit(value).cast(records.schema["value"].dataType)))
    first = rows.agg(F.min_by(F.struct("valid_from", "valid_to"), "sequence").alias("r")).filter("r is not null")
    return first.select(F.col("r.valid_from").alias("valid_from"), F.coalesce("r.valid_to", F.lit(now).cast("timestamp")).alias("valid_to"))


def revert(records: DataFrame, ts, next_sequence: int, now) -> DataFrame:
    """The versions to append so that every key has the value it had at ``ts``.

    Going back to a deletion appends a null value.  Sequences continue from
    ``next_sequence`` in key order.
    """
    old = as_of(records, ts, with_interval=False)
    rank = F.row_number().over(Window.orderBy("key")) - 1
    return old.select(
        "key", (rank + next_sequence).cast("long").alias("sequence"), F.lit(now).cast("timestamp").alias("ts"), F.lit(DATA).alias("record_type"), "value"
    )


def first_change_after(records: DataFrame, ts) -> DataFrame:
    """Each key's first version written after ``ts``."""
    rows = records.filter(F.col("ts") > F.lit(ts))
    best = rows.groupBy("key").agg(F.min_by(F.struct("sequence", "ts", "record_type", "value"), "sequence").alias("r"))
    return best.select("key", "r.*")


def first_match(records: DataFrame, predicate: Column) -> DataFrame:
    """Each key's first version that satisfies a predicate."""
    rest = [c for c in records.columns if c != "key"]
    best = records.filter(predicate).groupBy("key").agg(F.min_by(F.struct(*rest), "sequence").alias("r"))
    return best.select("key", "r.*")


def compact(records: DataFrame) -> DataFrame:
    """Live latest versions in key order with sequences from 1; times are kept.

    Numbers come from ranges of keys: each range numbers its rows and starts
    after the rows of the ranges before it, so no task sees all keys.
    """
    return number_by(live(latest(records)), "key", "sequence")


def number_by(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with column ``name`` numbered from 1 in order of the unique column ``order``."""
    dealt = ranges.cut(df.drop(name), order, name="_part")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return dealt.withColumn(name, local).join(base, "_part").withColumn(name, (F.col(name) + F.col("_base")).cast("long")).drop("_part", "_base")


def as_of_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, columns: list[str], order: str) -> DataFrame:
    """For each row of ``left`` the last row of ``right`` of the same key at or before its time.

    Both sides are put in one stream ordered by key and time and cut into
    ranges, so a key with many rows is many ranges.  A window carries the last
    right row forward inside a range; what a range begins with is the last right
    row of the key's ranges before, a row for each key and range.  ``order``
    names a right column that orders equal times.
    """
    payload = F.struct(*[F.col(c) for c in columns])
    l_rows = left.select(F.col(by).alias("_by"), F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_o"), F.struct(*left.columns).alias("_l"))
    r_rows = right.select(F.col(by).alias("_by"), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.col(order).cast("long").alias("_o"), payload.alias("_r"))
    both = ranges.cut(l_rows.unionByName(r_rows, allowMissingColumns=True), "_by", "_ts", "_side", "_o")
    tails = both.groupBy("_by", "_range").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.struct("_ts", "_o"))).alias("_tail"))
    earlier = Window.partitionBy("_by").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select("_by", "_range", F.last("_tail", ignorenulls=True).over(earlier).alias("_before"))
    upto = Window.partitionBy("_range", "_by").orderBy("_ts", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_r", F.last("_r", ignorenulls=True).over(upto)).filter(F.col("_side") == 1)
    same = F.col("x._by").eqNullSafe(F.col("y._by")) & (F.col("x._range") == F.col("y._range"))
    out = out.alias("x").join(tails.filter("_before is not null").alias("y"), same, "left").withColumn("_m", F.coalesce("_r", "_before"))
    return out.select("_l.*", *[F.col(f"_m.{c}").alias(f"right_{c}") for c in columns])


#: Each level's buckets are so many times longer than the level's before; the last level's are LONGEST.
WIDER, LONGEST = 16, 1 << 62


def interval_overlaps(left: DataFrame, right: DataFrame, by: str, bucket_us: int) -> DataFrame:
    """Pairs of rows of the same key whose [start_us, end_us] meet.

    An interval's level is the first whose buckets are at least as long as it,
    so it touches two buckets at most there and on every level above.  It is
    listed in those and joined on key, level and bucket, an equi-join however
    long intervals or histories are; a pair meets on the higher of its levels,
    in the first bucket that both touch.
    """
    lengths = [bucket_us]
    while lengths[-1] < LONGEST:
        lengths.append(min(lengths[-1] * WIDER, LONGEST))

    def dealt(df, tag):
        long = F.col("end_us") - F.col("start_us")
        own = sum((long > F.lit(x)).cast("int") for x in lengths[:-1])
        cols = [F.col(c).alias(f"{tag}_{c}") for c in df.columns if c != by]
        size = F.element_at(F.array(*[F.lit(x).cast("long") for x in lengths]), F.col("level") + 1)
        out = df.withColumn("own", own).withColumn("level", F.explode(F.sequence("own", F.lit(len(lengths) - 1))))
        touched = F.sequence(F.floor(F.col("start_us") / size), F.floor(F.col("end_us") / size))
        return out.select(by, *cols, "level", (F.col("own") == F.col("level")).alias(f"{tag}_own"), size.alias("size"), F.explode(touched).alias("bucket"))

    a, b = dealt(left.filter("start_us <= end_us"), "a"), dealt(right.filter("start_us <= end_us"), "b").drop("size")
    hit = (F.col("a_start_us") <= F.col("b_end_us")) & (F.col("b_start_us") <= F.col("a_end_us")) & (F.col("a_own") | F.col("b_own"))
    once = F.col("bucket") == F.floor(F.greatest("a_start_us", "b_start_us") / F.col("size"))
    return a.join(b, [by, "level", "bucket"]).filter(hit & once).drop("level", "bucket", "size", "a_own", "b_own")
