"""Replicated state to and from JSON, diagnosis by type, and guarded merges.

A state is the long table that ``crdt`` merges, with a column ``name`` for the
register, set, map or counter a row belongs to.  ``encode`` makes one JSON object
of each name's rows, ``decode`` the rows again; both are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crdt

HLC = "struct<physical:double,logical:bigint,node_id:string>"
ENTRY = f"struct<value:string,timestamp:{HLC},tombstone:boolean>"
COUNTER = "struct<type:string,state:map<string,bigint>>"
PAIR = f"struct<type:string,positive:{COUNTER},negative:{COUNTER}>"


def _map(key: Column, value: Column, where: Column | None = None) -> Column:
    """A map in the order of its keys; values may have no order."""
    pair = F.struct(key.alias("k"), value.alias("v"))
    pairs = F.collect_list(pair if where is None else F.when(where, pair))
    return F.map_from_entries(F.array_sort(pairs, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)))


def _values(where: Column) -> Column:
    return F.array_sort(F.collect_set(F.when(where, F.col("value"))))


def _entry() -> Column:
    return F.struct("value", F.col("hlc").alias("timestamp"), "tombstone")


def _counter(where: Column | None = None) -> Column:
    return F.struct(F.lit("g_counter").alias("type"), _map(F.col("node"), F.col("count"), where).alias("state"))


def _pair() -> Column:
    sides = [_counter(F.col("sign") == s).alias(n) for s, n in (("P", "positive"), ("N", "negative"))]
    return F.struct(F.lit("pn_counter").alias("type"), *sides)


def _sides(state: str) -> Column:
    """The rows of a pair of counters, as an array of (sign, node, count)."""
    one = lambda sign, c: F.transform(F.map_entries(c), lambda e: F.struct(F.lit(sign).alias("sign"), e["key"].alias("node"), e["value"].alias("count")))
    return F.concat(one("P", F.col(f"{state}.positive.state")), one("N", F.col(f"{state}.negative.state")))


def _entries(column: str, key: str) -> Callable[[DataFrame], DataFrame]:
    def rows(df: DataFrame) -> DataFrame:
        out = df.select("name", F.explode(f"s.{column}").alias("k", "e"))
        keyed = [] if key == "value" else [F.col("k").alias(key)]
        return out.select("name", *keyed, F.col("e.value").alias("value"), F.col("e.timestamp").alias("hlc"), F.col("e.tombstone").alias("tombstone"))

    return rows


@dataclass(frozen=True)
class Form:
    """One type's JSON: the name it carries, its schema, and the ways there and back."""

    type: str
    schema: str
    fields: Callable[[], list[Column]]
    rows: Callable[[DataFrame], DataFrame]


def _lww_rows(df: DataFrame) -> DataFrame:
    return df.select("name", F.col("s.entry.value").alias("value"), F.col("s.entry.timestamp").alias("hlc"), F.col("s.entry.tombstone").alias("tombstone"))


def _or_rows(df: DataFrame) -> DataFrame:
    out = df.select("name", F.explode("s.tags").alias("tag", "e"), F.col("s.tombstones").alias("gone"))
    return out.select("name", F.col("e.value").alias("value"), "tag", F.col("e.timestamp").alias("hlc"), F.array_contains("gone", F.col("tag")).alias("removed"))


def _two_rows(df: DataFrame) -> DataFrame:
    side = lambda c, op: df.select("name", F.explode(f"s.{c}").alias("value"), F.lit(op).alias("op"))
    return side("added", "add").unionByName(side("removed", "remove"))


def _pn_rows(df: DataFrame) -> DataFrame:
    return df.select("name", F.explode(_sides("s")).alias("x")).select("name", "x.*")


def _g_map_rows(df: DataFrame) -> DataFrame:
    out = df.select("name", F.explode("s.state").alias("key", "counts"))
    return out.select("name", "key", F.explode("counts").alias("node", "count"))


def _pn_map_rows(df: DataFrame) -> DataFrame:
    out = df.select("name", F.explode("s.state").alias("key", "c"))
    return out.select("name", "key", F.explode(_sides("c")).alias("x")).select("name", "key", "x.*")


FORMS = {
    "LWWRegister": Form("lww_register", f"entry {ENTRY}", lambda: [F.max_by(_entry(), F.struct("hlc", "value")).alias("entry")], _lww_rows),
    "MVRegister": Form("mv_register", f"values map<string,{ENTRY}>", lambda: [_map(F.col("value"), _entry()).alias("values")], _entries("values", "value")),
    "LWWMap": Form("lww_map", f"entries map<string,{ENTRY}>", lambda: [_map(F.col("key"), _entry()).alias("entries")], _entries("entries", "key")),
    "ORSet": Form(
        "or_set", f"tags map<string,struct<value:string,timestamp:{HLC}>>,tombstones array<string>",
        lambda: [_map(F.col("tag"), F.struct("value", F.col("hlc").alias("timestamp"))).alias("tags"), F.array_sort(F.collect_set(F.when(F.col("removed"), F.col("tag")))).alias("tombstones")],
        _or_rows,
    ),
    "TwoPhaseSet": Form(
        "two_phase_set", "added array<string>,removed array<string>",
        lambda: [_values(F.col("op") == "add").alias("added"), _values(F.col("op") == "remove").alias("removed")], _two_rows,
    ),
    "GCounter": Form("g_counter", "state map<string,bigint>", lambda: [_map(F.col("node"), F.col("count")).alias("state")], lambda df: df.select("name", F.explode("s.state").alias("node", "count"))),
    "PNCounter": Form("pn_counter", f"positive {COUNTER},negative {COUNTER}", lambda: [_pair()["positive"].alias("positive"), _pair()["negative"].alias("negative")], _pn_rows),
    "GCounterMap": Form("g_counter_map", "state map<string,map<string,bigint>>", lambda: [_map(F.col("key"), F.col("c")).alias("state")], _g_map_rows),
    "PNCounterMap": Form("pn_counter_map", f"state map<string,{PAIR}>", lambda: [_map(F.col("key"), F.col("c")).alias("state")], _pn_map_rows),
    "LexicographicCounter": Form(
        "lex_counter", "counter bigint,node_id string", lambda: [F.max("counter").alias("counter"), F.max_by("node_id", F.struct("counter", "node_id")).alias("node_id")],
        lambda df: df.select("name", "s.counter", "s.node_id"),
    ),
}
_INNER = {"GCounterMap": lambda: _map(F.col("node"), F.col("count")), "PNCounterMap": _pair}


def encode(kind: str, states: DataFrame) -> DataFrame:
    """(name, state): a JSON object for each name's rows."""
    form = FORMS[kind]
    if kind in _INNER:
        states = states.groupBy("name", "key").agg(_INNER[kind]().alias("c"))
    out = states.groupBy("name").agg(*form.fields())
    columns = [c.split(" ")[0] for c in out.columns if c != "name"]
    return out.select("name", F.to_json(F.struct(F.lit(form.type).alias("type"), *columns)).alias("state"))


def decode(kind: str, encoded: DataFrame) -> DataFrame:
    """The rows that ``encode`` was given, of the objects that are of this kind."""
    form = FORMS[kind]
    parsed = encoded.select("name", F.from_json("state", f"type string,{form.schema}").alias("s"))
    return form.rows(parsed.filter(F.col("s.type") == form.type))


# diagnosis and guarded merges

#: By type: what one entry is known by, and the column whose difference is a conflict.
COMPARED = {
    "LWWRegister": (["name"], "value", "value_mismatch"),
    "LWWMap": (["name", "key"], "value", "value_mismatch"),
    "GCounter": (["name", "node"], "count", "counter_mismatch"),
    "PNCounter": (["name", "sign", "node"], "count", "counter_mismatch"),
    "GCounterMap": (["name", "key", "node"], "count", "counter_mismatch"),
    "PNCounterMap": (["name", "key", "sign", "node"], "count", "counter_mismatch"),
}


def diagnose(kinds: tuple[str, str], a: DataFrame, b: DataFrame) -> DataFrame:
    """(type, entry, left_value, right_value): a type clash as one row, else entries of both that differ.

    ``entry`` is what the entry is known by, joined by slashes.  Types whose
    merge cannot lose a value have no conflicts.
    """
    spark = a.sparkSession
    schema = "type string, entry string, left_value string, right_value string"
    if kinds[0] != kinds[1]:
        return spark.createDataFrame([("type_mismatch", None, *kinds)], schema)
    if kinds[0] not in COMPARED:
        return spark.createDataFrame([], schema)
    by, value, kind = COMPARED[kinds[0]]
    found = crdt.diagnose(a, b, by, value)
    shown = [F.col(c).cast("string").alias(c) for c in ("left_value", "right_value")]
    return found.select(F.lit(kind).alias("type"), F.concat_ws("/", *by).alias("entry"), *shown)


@dataclass
class MergeResult:
    """What ``auto_merge`` gives: the merged table if it succeeded, conflicts as a table, errors as texts."""

    success: bool
    merged: DataFrame | None = None
    merged_type: str | None = None
    conflicts: DataFrame | None = None
    errors: list[str] = field(default_factory=list)


def auto_merge(kinds: tuple[str, str], a: DataFrame, b: DataFrame, **options) -> MergeResult:
    """Merge two states of one type; a type clash or a failing merge is told in ``errors``."""
    if kinds[0] != kinds[1]:
        return MergeResult(False, errors=[f"type mismatch: {kinds[0]} and {kinds[1]}"])
    try:
        merged = crdt.merge(list(kinds), [a, b], **options)
        return MergeResult(True, merged, kinds[0], diagnose(kinds, a, b))
    except Exception as e:  # analysis errors of either state
        return MergeResult(False, errors=[str(e)])
