"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a Java character class body.
SPACE = r"\x20\x09-\x0D"
#: The same characters, for ``translate`` and ``trim``.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD_PATTERN = rf"[^{SPACE}]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster.  Only where that setting is
    missing and the session is local (tests, a shell) a folder of this
    application's own is used: on a cluster it would be another on every machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found or f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


class Scratch:
    """Tables written to the shared folder to cut lineage.

    ``write`` returns the table as read back, so a lost executor costs no more
    than a re-read.  ``drop`` deletes one as soon as nothing reads it any more;
    what a lazy result still needs is deleted when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def _fs(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str, compression: str = "snappy", by: str | None = None) -> DataFrame:
        writer = df.write.option("compression", compression)
        (writer.partitionBy(by) if by else writer).parquet(self.path(name))
        self.expire(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        """What was written under ``name``, read anew."""
        return self.spark.read.parquet(self.path(name))

    def expire(self, name: str) -> None:
        """Delete what was written under ``name`` when the session ends."""
        path, fs = self._fs(name)
        fs.deleteOnExit(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, fs = self._fs(name)
            fs.delete(path, True)


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Column names near ``wanted`` that do not clash with ``taken``."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it, possibly inside lambdas, in ``body``.

    Catalyst inlines aliases into higher-order lambdas, which would compute an
    array again for every element.  A lambda variable is never inlined.
    """
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def bounded_labels(spark: SparkSession, labels: DataFrame, label: str, limit: int, held_out: bool) -> DataFrame:
    """At most ``limit`` labelled ids per class, the same ones on every run.

    Ids go in the order of their hash.  Rows without an id or a label are not
    used; an id that is labelled more than once counts by its largest label.
    With ``held_out`` the ids whose crc32 leaves 2 modulo 4 are never used.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if held_out:
        rows = rows.filter(~is_held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    one, zero = (rows.filter(F.col("label") == k).orderBy(*order).limit(limit) for k in (1, 0))
    return one.unionByName(zero)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
