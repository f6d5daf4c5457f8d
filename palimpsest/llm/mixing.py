"""Mixing sources to target weights with hash-threshold histograms.

Each document gets a 60-bit hash of its content.  Sizes are summed by source
and leading hash bits; the bucket in which a source's budget runs out is the
only one looked at again, with the next bits, until one hash value remains.
The mix is then a filter ``hash < threshold``: no document is sorted or
shuffled, and reruns agree because nothing but content decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, fresh, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix holds this part of all sizes, and at most CAP times a source.
SHARE, CAP = Fraction(3, 2), 2
#: Up to so many sources the plan, under 100 bytes a source, is broadcast.
BROADCAST = 100_000
HASH_BITS, LEVEL_BITS = 60, 10


@dataclass(frozen=True)
class Target:
    key: str
    size: int
    target: float
    copies: int
    budget: float


def source_key(source):
    """A source as a non-null string; the null source sorts after every other."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def content_hash(doc_id, text):
    """The first 60 bits of an md5; SQL engines agree on it."""
    plain = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(plain.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: dict[str, int]) -> list[Target]:
    """Words to take from each source.

    The share is split by weight; a source stops at CAP times its size and the
    excess is split again among the others.  ``w * left > CAP * s * weights``
    in exact integers decides, in the order in which sources fill up.
    """
    keys = sorted(sizes)
    weight = {k: WEIGHTS[i % len(WEIGHTS)] for i, k in enumerate(keys)}
    left, weights, full = SHARE * sum(sizes.values()), sum(weight.values()), set()
    for k in sorted(keys, key=lambda k: (Fraction(sizes[k], weight[k]), k)):
        if weight[k] * left > CAP * sizes[k] * weights:
            full.add(k)
            left -= CAP * sizes[k]
            weights -= weight[k]
    out = []
    for k in keys:
        target = float(CAP * sizes[k]) if k in full else float(weight[k] * left) / weights
        copies = sum(target >= n * sizes[k] for n in range(1, CAP + 1)) if sizes[k] else 0
        out.append(Target(k, sizes[k], target, copies, target - copies * sizes[k]))
    return out


def thresholds(sized: DataFrame, plan: list[Target]) -> dict[str, int]:
    """Of each source the hash below which documents get one more copy.

    One pass over (key, hash, size) per level; what comes to the driver is one
    row per source and level.  The group of equal hashes in which the budget
    runs out is taken if that brings the sum nearer to the budget.
    """
    spark = sized.sparkSession
    limit = {t.key: 0 for t in plan}
    state = {t.key: (0, 0) for t in plan if t.budget > 0}  # prefix, words before it
    budget = {t.key: t.budget for t in plan}
    shift = HASH_BITS
    schema = "key string, prefix long, before long, budget double"
    while state and shift > 0:
        open_rows = [(k, p, b, budget[k]) for k, (p, b) in state.items()]
        edge = _small(spark.createDataFrame(open_rows, schema), len(open_rows))
        inside = sized.join(edge, "key").filter(F.shiftright("hash", shift) == F.col("prefix"))
        shift -= LEVEL_BITS
        hist = inside.groupBy("key", "before", "budget", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )
        upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        cum = hist.withColumn("upto", F.col("before") + F.sum("words").over(upto))
        cut = cum.filter((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("words") <= F.col("budget")))
        found = {r["key"]: r for r in cut.collect()}
        for k in list(state):
            r = found.get(k)
            if r is None:  # the whole bucket fits
                limit[k] = (state[k][0] + 1) << (shift + LEVEL_BITS)
                del state[k]
            elif r["low"] == r["high"] or shift == 0:
                before = r["upto"] - r["words"]
                nearer = r["upto"] - budget[k] <= budget[k] - before
                limit[k] = r["high"] + 1 if nearer else r["low"]
                del state[k]
            else:
                state[k] = (r["bucket"], r["upto"] - r["words"])
    return limit


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, key, size, hash) of every document; a null text has size 0."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        source_key(F.col("source")).alias("key"),
        word_count(F.col("text")).alias("size"),
        content_hash(F.col("doc_id"), F.col("text")).alias("hash"),
    )


def _small(table: DataFrame, sources: int) -> DataFrame:
    """``table``, a row for each source, to be broadcast if there are no more than BROADCAST; beyond that Spark joins by its size."""
    return F.broadcast(table) if sources <= BROADCAST else table


def _plan_table(spark, plan: list[Target], limit: dict[str, int]) -> DataFrame:
    schema = T.StructType.fromDDL("key string, source_size long, target double, copies int, threshold long")
    rows = [(t.key, t.size, t.target, t.copies, limit[t.key]) for t in plan]
    return _small(spark.createDataFrame(rows, schema), len(rows))


def _solve(docs: DataFrame) -> tuple[DataFrame, DataFrame, Scratch]:
    """The measured documents, the plan with thresholds, and what holds them."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = scratch.write(measure(docs), "sized")
    totals = {r["key"]: r["size"] for r in sized.groupBy("key").agg(F.sum("size").alias("size")).collect()}
    plan = targets(totals)
    return sized, _plan_table(spark, plan, thresholds(sized, plan)), scratch


def mix_sizes(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken.

    Every row of ``docs`` gives one row.  Null and empty texts have size 0 and
    nothing is taken of them; rows equal in doc_id and text are taken or left
    together; null sources are one source, ordered last; an empty table gives
    no rows.
    """
    sized, table, _ = _solve(docs)
    extra = (F.col("hash") < F.col("threshold")).cast("int")
    return sized.join(table, "key").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + extra)).alias("taken")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a document taken twice
    comes twice, one not taken is left out.  Documents without a word carry no
    size, so they are kept once wherever their source is taken at least once,
    and by their hash otherwise.
    """
    _, table, scratch = _solve(docs)
    scratch.drop("sized")
    key, h, copies, threshold, n = fresh(docs.columns, "key", "hash", "copies", "threshold", "n")
    table = table.select(
        F.col("key").alias(key), F.col("copies").alias(copies), F.col("threshold").alias(threshold)
    )
    out = docs.withColumns({key: source_key(F.col("source")), h: content_hash(F.col("doc_id"), F.col("text"))})
    times = F.col(copies) + (F.col(h) < F.col(threshold)).cast("int")
    out = out.join(table, key).withColumn(n, F.explode(F.array_repeat(F.lit(1), times)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id,
         CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT k, CAST(sum(size) AS BIGINT) AS s,
         CASE (row_number() OVER (ORDER BY encode(k)) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY k),
f AS (
  SELECT *,
         coalesce(sum(s) OVER before, 0) AS s_before, coalesce(sum(w) OVER before, 0) AS w_before,
         sum(s) OVER () AS s_all, sum(w) OVER () AS w_all
  FROM s
  WINDOW before AS (ORDER BY CAST(s AS DOUBLE) / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (
  SELECT *, w * (3 * s_all - 4 * s_before) > 4 * s * (w_all - w_before) AS filled FROM f),
t AS (
  SELECT k, s,
         CASE WHEN filled THEN CAST(2 * s AS DOUBLE)
              ELSE CAST(w * (3 * s_all - 4 * coalesce(sum(s) FILTER (WHERE filled) OVER (), 0)) AS DOUBLE) / 2
                   / (w_all - coalesce(sum(w) FILTER (WHERE filled) OVER (), 0)) END AS target
  FROM g),
u AS (
  SELECT *, CASE WHEN s = 0 THEN 0 WHEN target >= 2 * s THEN 2 WHEN target >= s THEN 1 ELSE 0 END AS copies FROM t),
c AS (
  SELECT d.*, u.s, u.target, u.copies, u.target - u.copies * u.s AS budget,
         sum(size) OVER (PARTITION BY d.k ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY d.k, h) AS own
  FROM d JOIN u ON d.k = u.k)
SELECT doc_id, size, s AS source_size, target,
       CAST(size * (copies + CASE WHEN upto <= budget THEN 1
                                  WHEN upto - own <= budget AND budget > 0 AND upto - budget <= budget - (upto - own) THEN 1
                                  ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
