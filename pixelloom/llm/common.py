"""What the training-data operators share: intermediate tables, hot-group joins, input clean-up.

Intermediate tables are Parquet in the folder that the cluster names in
``spark.checkpoint.dir``: they cut lineage and survive lost executors.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A group is hot when it holds more than this many rows and more than 1/HOT_SHARE of the table,
#: so there are fewer than HOT_SHARE hot groups in a table of any size.
HOT_ROWS = 200
HOT_SHARE = 2000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pixelloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Bytes that Python workers get at a time, one row at least; whole texts can be long.
BATCH_BYTES = "16777216"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Paths of the tables that were made and not deleted, in order.
MADE: list[str] = []


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has a bound of its own."""
    if spark.conf.get(BATCH_SETTING, None) in (None, "2147483647"):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def fresh_path(spark: SparkSession, name: str) -> str:
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.made_at = path
    return table


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in MADE:
        MADE.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files behind tables made by materialize()."""
    for t in tables:
        remove_path(t.sparkSession, t.made_at)


def sealed(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that make() returns, written; all other tables that it made are deleted, also after an error."""
    before, kept = set(MADE), []
    try:
        table = materialize(make(), name)
        kept = [table.made_at]
        return table
    finally:
        for path in [x for x in MADE if x not in before and x not in kept]:
            remove_path(spark, path)


def release(spark: SparkSession) -> None:
    """Have Spark delete shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df (narrow rows) with `number`, their place from 0 in the given order, a table. Ranges are numbered on their own, and their sizes give the offsets."""
    ranged = materialize(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("range", F.spark_partition_id()), name)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("range").agg(F.count("*").alias("held")).select("range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return materialize(ranged.withColumn("nth", nth).join(F.broadcast(offsets), "range").withColumn("number", F.col("before") + F.col("nth")).drop("range", "nth", "before"), name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def join_group_facts(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows with one fact row per key, when a few keys may hold most of the rows.

    Keys with more than max(HOT_ROWS, total / HOT_SHARE) rows number under HOT_SHARE however large
    the table is; their facts are broadcast and their rows aren't moved. All others are joined by a shuffle.
    rows is read twice, so it should be a table, not a long plan. The others are shuffled at every size, so that plans don't change as tables grow.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(facts.filter(F.col(size) > limit))
    cold = facts.filter(F.col(size) <= limit)
    near = rows.join(hot, key, "inner")
    far = rows.join(F.broadcast(facts.filter(F.col(size) > limit).select(key)), key, "left_anti").join(cold.hint("merge"), key, "left")
    return near.unionByName(far)
