"""Partitioning, histogram and order primitives of the joins, as standalone operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relation import radix


def radix_partition(rel: DataFrame, bits: int = 7, shift: int = 0, tasks: int | None = None) -> DataFrame:
    """rel with pid, dealt out by it (to as many tasks as partitions unless told otherwise) and sorted within."""
    return rel.withColumn("pid", radix(F.col("key"), bits, shift)).repartition(tasks or 1 << bits, "pid").sortWithinPartitions("pid")


def two_pass(rel: DataFrame, bits: int = 7) -> DataFrame:
    """(pid1, pid2, n): sizes after a second pass over the next bits; only partitions with rows."""
    return rel.groupBy(radix(F.col("key"), bits).alias("pid1"), radix(F.col("key"), bits, bits).alias("pid2")).agg(F.count("*").alias("n"))


def histogram(rel: DataFrame, bits: int = 7, shift: int = 0) -> DataFrame:
    return rel.groupBy(radix(F.col("key"), bits, shift).alias("pid")).agg(F.count("*").alias("n"))


def prefix_sum(hist: DataFrame) -> DataFrame:
    """The histogram with each partition's first place. A histogram has at most 2 ** bits rows, so one task sums it."""
    before = F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    return hist.withColumn("first", F.coalesce(before, F.lit(0)).cast("long"))


def range_partition(rel: DataFrame, parts: int = 128) -> DataFrame:
    """By key ranges of about equal size, sorted within: together a total order."""
    return rel.repartitionByRange(parts, "key", "payload").sortWithinPartitions("key", "payload")


def block_sizes(r: DataFrame, s: DataFrame) -> DataFrame:
    """(key, height, width, cells): rows of R and of S with the key, and their product; keys of both sides."""
    both = r.select("key", F.lit(0).alias("tid")).unionByName(s.select("key", F.lit(1).alias("tid")))
    sizes = both.groupBy("key").agg(F.count(F.when(F.col("tid") == 0, 1)).alias("height"), F.count(F.when(F.col("tid") == 1, 1)).alias("width"))
    return sizes.withColumn("cells", F.col("height") * F.col("width"))


def expand(df: DataFrame, weight: str) -> DataFrame:
    """Each row as often as its weight says, numbered by copy; weight 0 drops it."""
    return df.where(F.col(weight) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(weight) - 1)))


def distribute(df: DataFrame, place: str, size: int) -> DataFrame:
    """Rows routed to their place among `size` slots; a slot nobody takes is a row of nulls, and is_real tells."""
    slots = df.sparkSession.range(size).withColumnRenamed("id", place)
    return slots.join(df.withColumn("is_real", F.lit(True)), place, "left").withColumn("is_real", F.coalesce("is_real", F.lit(False)))


def stable_size_filter(df: DataFrame, keep: Column) -> DataFrame:
    """A filter whose output has the input's size: rows that fail are blanked and flagged."""
    cols = [F.when(keep, F.col(c)).alias(c) for c in df.columns]
    return df.select(*cols, F.coalesce(keep, F.lit(False)).alias("is_real"))


def order_violations(df: DataFrame, place: str, key: str = "key", width: int = 4096) -> DataFrame:
    """(violations): rows whose key is smaller than that of the row before them by place (0, 1, 2 ...). Blocks of places are
    checked side by side; a block's first row looks at the last of the block before."""
    at = df.select(F.floor(F.col(place) / width).alias("block"), F.col(place).alias("place"), F.col(key).alias("key"))
    lag = F.lag("key").over(Window.partitionBy("block").orderBy("place"))
    inside = at.withColumn("before", lag).where(F.col("before") > F.col("key")).agg(F.count("*").alias("n"))
    ends = at.groupBy("block").agg(F.min_by("key", "place").alias("first"), F.max_by("key", "place").alias("last"))
    next_ = ends.select((F.col("block") + 1).alias("block"), F.col("last").alias("before"))
    edges = ends.join(next_, "block").where(F.col("before") > F.col("first")).agg(F.count("*").alias("n"))
    return inside.unionByName(edges).agg(F.sum("n").cast("long").alias("violations"))
