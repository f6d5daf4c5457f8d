"""Tables cut into ranges of an order, once and for all.

A global running value or number needs no task with all rows: every range takes
its own, and one row a range carries what came before.  A range is a partition
of a range partitioning; the table is written, so the cut is the same for
whoever reads it, also after an executor is lost.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where all machines see it, deleted when the session ends.

    ``spark.checkpoint.dir`` names where; without that setting only a local
    session may use a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{base or '/tmp/checkpoints/' + spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame, *order: str, name: str = "_range") -> DataFrame:
    """``df`` with the number of each row's range; ranges rise with ``order``, equal rows share one."""
    path = shared_folder(df.sparkSession, "ranges")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.spark_partition_id())
    dealt.write.parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)
