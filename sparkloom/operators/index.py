"""Ordered lookups on a relation (key, payload): filters that reach a Parquet scan, and changes that give a new relation.

Equal keys are allowed; their order is that of payload. Keys outside the relation find nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find(rel: DataFrame, key: int) -> DataFrame:
    """The rows of a key."""
    return rel.where(F.col("key") == key)


def exists(rel: DataFrame, key: int) -> bool:
    return not find(rel, key).isEmpty()


def count_of(rel: DataFrame, key: int) -> int:
    return find(rel, key).count()


def _first(rel: DataFrame) -> DataFrame:
    return rel.groupBy().agg(F.min(F.struct("key", "payload")).alias("x")).where("x is not null").select("x.*")


def lower_bound(rel: DataFrame, key: int) -> DataFrame:
    """The first row whose key is not below `key`, if any: a pre-aggregated minimum, no sort."""
    return _first(rel.where(F.col("key") >= key))


def upper_bound(rel: DataFrame, key: int) -> DataFrame:
    """The first row whose key is above `key`, if any."""
    return _first(rel.where(F.col("key") > key))


def equal_range(rel: DataFrame, low: int, high: int) -> DataFrame:
    """Rows with low <= key < high."""
    return rel.where((F.col("key") >= low) & (F.col("key") < high))


def insert(rel: DataFrame, rows: DataFrame) -> DataFrame:
    return rel.select("key", "payload").unionByName(rows.select("key", "payload"))


def erase(rel: DataFrame, key: int) -> DataFrame:
    """Without all rows of a key."""
    return rel.where(F.col("key") != key)


def erase_one(rel: DataFrame, key: int) -> DataFrame:
    """Without the first row of a key; of equal rows, only one goes."""
    own = find(rel, key)
    left = own.groupBy("key", "payload").agg(F.count("*").alias("n"))
    low = left.groupBy().agg(F.min("payload").alias("low"))
    left = left.join(F.broadcast(low)).withColumn("n", F.when(F.col("payload") == F.col("low"), F.col("n") - 1).otherwise(F.col("n")))
    return erase(rel, key).select("key", "payload").unionByName(left.where("n > 0").select("key", "payload", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k")).select("key", "payload"))
