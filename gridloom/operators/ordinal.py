"""Row numbers of all rows in an order, without a single-task window.

Rows are range-partitioned and sorted; each gets its place in its partition, and the
partitions' sizes (one row each) give the starts.  The sorted rows are written once to
the folder that executors share, so that places and sizes are of the same partitioning.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = "__number"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in ``spark.checkpoint.dir``, gone when Python ends; a temporary one in local mode without that setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/gridloom-{name}-{uuid.uuid4().hex[:12]}"

    def remove() -> None:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended  # noqa: BLE001
            return

    atexit.register(remove)
    return path


def numbered(df: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """The rows with ``NUMBER`` (from 1 in this order), and how many there are.  Runs jobs."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # an increasing id is (partition << 33) + place in the partition
    path = shared_folder(df.sparkSession, "rows")
    ranged.withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    part = F.shiftright("__id", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("__start", F.coalesce(before, F.lit(0).cast("bigint"))).drop("__size")
    out = rows.withColumn("__part", part).join(F.broadcast(starts), "__part")  # one row a partition
    number = F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return out.withColumn(NUMBER, number).drop("__part", "__start", "__id"), rows.count()
