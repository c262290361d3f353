"""The relation that every join takes: (key, payload), both bigint, key not null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def as_relation(df: DataFrame, key: str | Column, payload: str | Column) -> DataFrame:
    """df as (key, payload). Rows without a key, which can match nothing, are left out."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(col(key).cast("long").alias("key"), col(payload).cast("long").alias("payload")).where("key is not null")


def radix(key: Column, bits: int, shift: int = 0) -> Column:
    """Bits [shift, shift + bits) of a key."""
    return F.shiftright(key, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def fits_broadcast(df: DataFrame, most_rows: int = 1_000_000) -> bool:
    """Whether a side of 16-byte rows is small enough to be sent to every executor. Counts it; Parquet answers from its footers."""
    return df.count() <= most_rows


def scratch(spark: SparkSession) -> str:
    """A folder that all machines share: spark.checkpoint.dir, or the context's own setting, or one in the warehouse."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at and (own := context._jsc.sc().getCheckpointDir()).isDefined():
        at = own.get()
    return (at or f"{spark.conf.get('spark.sql.warehouse.dir')}/.sparkloom").rstrip("/")


def pinned(df: DataFrame) -> DataFrame:
    """df checkpointed, so that what depends on the order or partition of its rows stays the same whenever it is read."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(scratch(spark))
    return df.checkpoint()


def row_ids(rel: DataFrame) -> DataFrame:
    """rel with id: its place in the order of (key, payload), from 0. Rows are dealt out by ranges of about equal size, whatever
    the keys (a hot key's rows are parted by payload), sorted and numbered there; only a count per range meets in one task."""
    ranges = int(rel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rel.select("key", "payload").repartitionByRange(ranges, "key", "payload").sortWithinPartitions("key", "payload")
    dealt = pinned(dealt.withColumns({"range": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counted = dealt.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(counted), "range").select("key", "payload", (F.col("before") + within).cast("long").alias("id"))
