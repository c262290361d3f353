"""Joins of joins: the three-way join, and joins of sealed relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sealing
from ..operators.joins import as_built, join_rows


def three_way(r: DataFrame, s: DataFrame, t: DataFrame, strategy: str = "radix_histogram") -> DataFrame:
    """Rows (key, payload) of T, each once for every pair of rows of R and S with its key."""
    both = as_built(join_rows(strategy, r, s))
    return join_rows(strategy, t, both).select("key", F.col("r_payload").alias("payload"))


def sealed_join(r: DataFrame, s: DataFrame, key: bytes, strategy: str = "radix_histogram") -> DataFrame:
    """Unseal both relations, join, and seal (key, payload of R) again."""
    out = as_built(join_rows(strategy, sealing.unseal(r, key), sealing.unseal(s, key)))
    return sealing.seal(out, key)


def sealed_three_way(r: DataFrame, s: DataFrame, t: DataFrame, key: bytes) -> DataFrame:
    return sealing.seal(three_way(*(sealing.unseal(x, key) for x in (r, s, t))), key)
