"""A relation R that stays, probed by an S that arrives in chunks: only one chunk of S is held at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.relation import fits_broadcast


def read_chunks(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The relation (key, payload) of a folder of Parquet files as a stream, so many files a chunk."""
    return spark.readStream.schema("key bigint, payload bigint").option("maxFilesPerTrigger", files).parquet(path)


def probe(r: DataFrame, s: DataFrame) -> DataFrame:
    """Rows (key, r_payload, s_payload) of a static R and a streamed S. R is sent to every executor if it is small."""
    left, right = r.select("key", F.col("payload").alias("r_payload")), s.select("key", F.col("payload").alias("s_payload"))
    return right.join(F.broadcast(left) if fits_broadcast(r) else left, "key").select("key", "r_payload", "s_payload")


def running_count(rows: DataFrame) -> DataFrame:
    """The matches so far, as a streaming aggregate."""
    return rows.groupBy().agg(F.count("*").alias("matches"))
