"""Relations kept sorted: tables in buckets by key, each bucket sorted, which a merge join reads without shuffle or sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The scan tells the planner that a bucket of one file is sorted.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def save_sorted(rel: DataFrame, table: str, buckets: int = 16) -> DataFrame:
    """Write the relation as a table of sorted buckets, one file each, and return it."""
    rel.select("key", "payload").repartition(buckets, "key").sortWithinPartitions("key").write.bucketBy(buckets, "key").sortBy("key").mode("overwrite").saveAsTable(table)
    return rel.sparkSession.table(table)


def join_sorted(spark: SparkSession, r: str, s: str) -> DataFrame:
    """The merge join of two such tables with the same number of buckets."""
    spark.conf.set(ORDERED, "true")
    left, right = (spark.table(t).withColumnRenamed("payload", name) for t, name in ((r, "r_payload"), (s, "s_payload")))
    return left.hint("merge").join(right, "key").select("key", "r_payload", "s_payload")
