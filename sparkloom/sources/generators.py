"""Workload relations (key, payload): payload is the row's number, keys follow the named distribution. Rows have no order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Named data sets: rows of R and S.
DATASETS = {"cache-fit": (1_310_720, 5_242_880), "cache-exceed": (13_107_200, 52_428_800), "L": (50_000_000, 200_000_000)}
ROW_BYTES = 8


def rows_of_megabytes(mb: float) -> int:
    return int(mb * (1 << 20)) // ROW_BYTES


def _relation(spark: SparkSession, n: int, key: F.Column) -> DataFrame:
    return spark.range(n).select(key.cast("long").alias("key"), F.col("id").alias("payload"))


def primary_keys(spark: SparkSession, n: int) -> DataFrame:
    """1 .. n, once each."""
    return _relation(spark, n, F.col("id") + 1)


def foreign_keys(spark: SparkSession, n: int, most: int) -> DataFrame:
    """n keys that go round 1 .. most."""
    return _relation(spark, n, F.col("id") % most + 1)


def foreign_keys_selective(spark: SparkSession, n: int, most: int) -> DataFrame:
    """Whole rounds of 1 .. most, then the remainder strided over the domain; most 0: every key is 0."""
    if not most:
        return _relation(spark, n, F.lit(0))
    whole, rest = divmod(n, most)
    jump = most // rest if rest else 1
    return _relation(spark, n, F.when(F.col("id") < whole * most, F.col("id") % most + 1).otherwise(1 + (F.col("id") - whole * most) * jump))


def domain_of_selectivity(r: int, percent: float) -> int:
    """The key domain in which `percent` of S finds a partner among 1 .. r."""
    return int(100 * r / percent) if percent else 0


def expected_matches(r: int, s: int, percent: float) -> int:
    """Matches of primary_keys(r) with foreign_keys_selective(s, domain_of_selectivity(r, percent))."""
    if not (most := domain_of_selectivity(r, percent)):
        return 0
    whole, rest = divmod(s, most)
    return whole * r + (min(rest, (r - 1) // (most // rest) + 1) if rest else 0)


def primary_keys_selective(spark: SparkSession, n: int, percent: float) -> DataFrame:
    return _relation(spark, n, F.floor(1 + F.col("id") * 100.0 / percent))


def foreign_keys_from(primary: DataFrame, n: int, size: int) -> DataFrame:
    """n rows: the relation's rows (size of them, by payload 0 .. size - 1) round and round."""
    rounds = -(-n // size)
    return primary.select("key", "payload", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("k")).where(F.col("k") * size + F.col("payload") < n).select("key", "payload")


def uniform_keys(spark: SparkSession, n: int, most: int, seed: int = 22222) -> DataFrame:
    """Keys drawn from 0 .. most - 1."""
    return _relation(spark, n, F.floor(F.rand(seed) * most))


def keys_from_list(spark: SparkSession, n: int, keys: list[int]) -> DataFrame:
    """A given list's keys round and round."""
    return _relation(spark, n, F.element_at(F.array(*map(F.lit, keys)), (F.col("id") % len(keys) + 1).cast("int")))


def zipf_cdf(spark: SparkSession, most: int, theta: float) -> DataFrame:
    """(rank, cdf): the cumulative distribution of Zipf's law over ranks 1 .. most, summed up block by block."""
    block = 1 << 14
    w = spark.range(1, most + 1).select(F.col("id").alias("rank"), F.floor((F.col("id") - 1) / block).alias("block"), (1 / F.pow(F.col("id").cast("double"), F.lit(theta))).alias("w"))
    sums = w.groupBy("block").agg(F.sum("w").alias("s"))
    before = sums.select("block", F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    total = sums.agg(F.sum("s").alias("total"))
    run = F.sum("w").over(Window.partitionBy("block").orderBy("rank"))
    return w.withColumn("run", run).join(F.broadcast(before), "block").join(F.broadcast(total)).select("rank", ((F.col("before") + F.col("run")) / F.col("total")).alias("cdf"))


def zipf_keys(spark: SparkSession, n: int, most: int, theta: float, seed: int = 22222) -> DataFrame:
    """n keys by Zipf's law over a permutation of 1 .. most: draws and steps of the distribution meet by the slice of [0, 1) that they are in."""
    slices = 1 << 12
    cdf = zipf_cdf(spark, most, theta)
    first = cdf.select((F.col("rank") + 1).alias("rank"), F.col("cdf").alias("before"))
    steps = cdf.join(first, "rank", "left").select("rank", F.coalesce("before", F.lit(0.0)).alias("low"), F.when(F.col("rank") == most, F.lit(1.0)).otherwise(F.col("cdf")).alias("high"))
    steps = steps.withColumn("slice", F.explode(F.sequence(F.floor(F.col("low") * slices), F.least(F.floor(F.col("high") * slices), F.lit(slices - 1).cast("long")))))
    draws = spark.range(n).select("id", F.rand(seed).alias("u")).withColumn("slice", F.floor(F.col("u") * slices))
    return draws.join(steps, (draws["slice"] == steps["slice"]) & (F.col("low") <= F.col("u")) & (F.col("u") < F.col("high"))).select(zipf_key(F.col("rank"), most).alias("key"), F.col("id").alias("payload"))


def zipf_key(rank: F.Column, most: int) -> F.Column:
    """The key of a rank, by a permutation of 1 .. most."""
    stride = next(x for x in range(most // 2 + 1, 2 * most + 2) if _coprime(x, most))
    return (rank * stride % most + 1).cast("long")


def shuffled(rel: DataFrame, seed: int = 11111) -> DataFrame:
    """The relation's rows in a random physical order, the same for a seed: dealt out at random, and sorted so within."""
    return rel.withColumn("u", F.xxhash64(F.lit(seed), "key", "payload")).repartition("u").sortWithinPartitions("u").drop("u")


def _coprime(a: int, b: int) -> bool:
    while b:
        a, b = b, a % b
    return a == 1


def keys_from_file(spark: SparkSession, path: str) -> DataFrame:
    """A text file of one integer per line; what does not start with one reads as 0. Payload 0."""
    return spark.read.text(path).select(F.coalesce(F.expr(r"try_cast(regexp_extract(value, '^\\s*([+-]?[0-9]+)', 1) as bigint)"), F.lit(0).cast("long")).alias("key"), F.lit(0).cast("long").alias("payload"))
