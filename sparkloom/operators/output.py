"""Writers of relations and join results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import as_text


def write_pairs(rows: DataFrame, path: str) -> None:
    """A join's rows as text, a line "r_payload s_payload" each."""
    as_text(rows).write.mode("overwrite").text(path)


def write_relation(rel: DataFrame, path: str) -> None:
    """A relation as text: in each file a header, and a line "key, payload" for each row."""
    rel.select(F.col("key").alias("#KEY"), F.col("payload").alias("VAL")).write.mode("overwrite").option("sep", ", ").option("comment", "~").csv(path, header=True)


def write_keys(rel: DataFrame, path: str) -> None:
    """A relation's keys as text, one on a line, as sources.generators.keys_from_file reads them."""
    rel.select(F.col("key").cast("string").alias("value")).write.mode("overwrite").text(path)
